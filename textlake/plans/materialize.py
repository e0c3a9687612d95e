"""Materialize an intermediate table in the cluster's shared folder.

Trend analysis asks many small questions (one timeline per term list) of the
same word-count and score tables.  Writing such a table once as Parquet under
``spark.checkpoint.dir`` and reading it back (a) runs the normalization of the
corpus once instead of once per question, and (b) cuts the lineage: a lost
executor later recomputes from these files, not from the raw texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from textlake.session import shared_dir


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to a fresh folder under the shared checkpoint dir and
    return a DataFrame over the written files (column pruning and filter
    pushdown apply to later reads)."""
    spark = df.sparkSession
    path = shared_dir(spark, "tables", name)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.parquet(path)


def materialize_by_range(df: DataFrame, name: str, column: str, partitions: int | None = None) -> DataFrame:
    """``materialize`` with the rows laid out by ranges of ``column``, sorted in each
    file: a later filter on it reads few row groups, whose least and largest
    values Parquet keeps.  Rows with one value may spread over several ranges'
    files only where Spark's sampling cuts there; a very common value makes one
    large file."""
    dealt = df.repartitionByRange(column) if partitions is None else df.repartitionByRange(partitions, column)
    return materialize(dealt.sortWithinPartitions(column), name)
