"""File sources and sinks: JSON lines and one-word-per-line text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlake.sources.tables import RAW_DOCUMENT_SCHEMA


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType = RAW_DOCUMENT_SCHEMA
               ) -> DataFrame:
    """JSON-lines scan with an explicit schema (no inference pass)."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


#: Column that the JSON reader puts unparsed lines in.
CORRUPT = "_corrupt_record"


def read_jsonl_checked(spark: SparkSession, path: str, schema: T.StructType = RAW_DOCUMENT_SCHEMA
                       ) -> tuple[DataFrame, DataFrame]:
    """(good, bad): the rows of the lines that parse, and the other lines, (line).

    Lines that are no JSON object, or hold a value of another type than the
    schema's, are bad; blank lines are neither.  Both are lazy and read the
    files anew; a caller that uses both often may write one of them.
    """
    kept = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    rows = (spark.read.text(path).where(F.trim("value") != "")
            .select(F.from_json("value", kept, options).alias("row")))
    broken = F.col(f"row.{CORRUPT}")
    return (rows.where(broken.isNull()).select(*[F.col("row")[name].alias(name) for name in schema.names]),
            rows.where(broken.isNotNull()).select(broken.alias("line")))


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """JSON-lines sink; one file per partition, written by the executors."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)
    return path


def read_wordlist(spark: SparkSession, path: str) -> DataFrame:
    """One word per line -> DataFrame[word], blank lines and duplicates dropped.

    The result stays distributed; callers join against it, Spark broadcasts it
    when its size allows, instead of collecting it into a closure.
    """
    words = spark.read.text(path).select(F.trim(F.col("value")).alias("word"))
    return words.where(F.col("word") != "").distinct()


def write_wordlist(df: DataFrame, column: str, path: str) -> str:
    df.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)
    return path
