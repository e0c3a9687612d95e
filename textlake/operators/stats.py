"""Corpus statistics per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def corpus_stats(docs: DataFrame, group: Sequence[str], key: str, body: str = "body"
                 ) -> DataFrame:
    """Per group: distinct documents, total body length, mean body length.

    ``count(distinct key)`` is exact: Spark first deduplicates on
    (group, key) -- a shuffle keyed by both, so one large group is still
    spread over many tasks -- then counts per group.
    """
    return (docs.groupBy(*group)
            .agg(F.countDistinct(key).alias("urls"),
                 F.sum(F.length(body)).alias("text_length"))
            .withColumn("avg_document_size",
                        F.try_divide(F.col("text_length").cast("double"), F.col("urls")))
            .orderBy(*group))
