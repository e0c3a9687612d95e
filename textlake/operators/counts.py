"""Counting operators: word counts, array-element counts, group counts, top-k.

Every count is ``explode`` + ``groupBy().count()``: Spark plans a partial
(map-side) HashAggregate before the shuffle, so a hot word is reduced to one
row per map task before it moves, and the final aggregate sees at most
(#map tasks) rows for it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlake.functions.text import tokens


def explode_tokens(docs: DataFrame, keep: Sequence[str], body: str = "body",
                   word: str = "word") -> DataFrame:
    """One row per ' '-separated token (empty tokens kept)."""
    return docs.select(*keep, F.explode(tokens(body)).alias(word))


def word_count(docs: DataFrame, body: str = "body") -> DataFrame:
    return explode_tokens(docs, [], body).groupBy("word").count()


def word_count_per_group(docs: DataFrame, group: Sequence[str], body: str = "body"
                         ) -> DataFrame:
    return explode_tokens(docs, group, body).groupBy(*group, "word").count()


def array_element_count(df: DataFrame, array_col: str, name: str = "word") -> DataFrame:
    """Occurrences of each element over all arrays (e.g. talks per speaker)."""
    return df.select(F.explode(array_col).alias(name)).groupBy(name).count()


def count_per_group(df: DataFrame, group: Sequence[str]) -> DataFrame:
    return df.groupBy(*group).count()


def words_per_group(docs: DataFrame, group: Sequence[str], body: str = "body") -> DataFrame:
    """Number of ' '-separated tokens per group (empty tokens count)."""
    return docs.groupBy(*group).agg(F.sum(F.size(tokens(body))).alias("number_of_words"))


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """Global top-k; Spark plans TakeOrderedAndProject (per-partition top-k,
    then a merge of k rows per partition), never a full sort."""
    return df.orderBy(*order).limit(k)


def tokens_without(docs: DataFrame, keep: Sequence[str], words: DataFrame,
                   body: str = "body", word_col: str = "word") -> DataFrame:
    """Counts of the tokens of ``docs`` per (keep, word), without the words in
    the ``words`` table (left anti).

    For a word list too long to inline as a literal.  Tokens are counted
    before the join, so a frequent word is one row per group there; no side
    is hinted, Spark picks the join from the sides' sizes.
    """
    counted = explode_tokens(docs, keep, body, "word").groupBy(*keep, "word").count()
    return counted.join(words.select(F.col(word_col).alias("word")), on="word", how="left_anti") \
        .select(*keep, "word", "count")
