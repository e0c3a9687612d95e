"""Table sources: explicit schemas and the binding of the driver tables.

Reads are Parquet with explicit column lists so that Catalyst prunes the
scan (``ReadSchema``) and pushes filters into it (``PushedFilters``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlake.functions.text import first_line

# Schema of a raw document as a crawler writes it (JSON lines).
RAW_DOCUMENT_SCHEMA = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("speakers", T.ArrayType(T.StringType())),
    T.StructField("link", T.StringType()),
])

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


#: Session setting: deal the rows of each table over so many partitions.
SCAN_PARTITIONS = "textlake.scan.partitions"


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None
               ) -> DataFrame:
    """Read one Parquet table, pruned to ``columns``; Spark's scan settings
    (``spark.sql.files.maxPartitionBytes``) make the partitions.

    Only where the caller asks for it with the session setting
    ``textlake.scan.partitions`` (unset by default) the rows are dealt
    round-robin: the bench does, whose tables are one row group each.
    """
    df = spark.read.parquet(table_path(sf_dir, name))
    if columns:
        df = df.select(*columns)
    partitions = spark.conf.get(SCAN_PARTITIONS, None)
    return df.repartition(int(partitions)) if partitions else df


def raw_documents(spark: SparkSession, sf_dir: str, group_cols: tuple[str, ...] = ("lang", "source")
                  ) -> DataFrame:
    """``documents`` bound to the raw-document shape.

    key ``doc_id`` stands for the link, the group columns for the year, the
    first line of the text for the title and the whole text for the content.
    """
    df = read_table(spark, sf_dir, "documents", ["doc_id", *group_cols, "text"])
    return df.select("doc_id", *group_cols, first_line("text").alias("title"),
                     F.col("text").alias("content"))
