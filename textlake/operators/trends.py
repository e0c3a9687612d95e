"""Trend queries: term timelines and two-camp comparisons.

A timeline asks about a handful of terms but needs the total of every group.
``term_counts`` answers both from ONE pass over the tokens: tokens outside
the term list are folded into one NULL-word row per group inside the
aggregation, so the shuffle carries (#groups x (#terms + 1)) rows per map
task, and the totals are a sum over that tiny table.  The generic forms over
a precomputed (group, word, count) table are kept for users who already hold
one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textlake.operators.counts import explode_tokens


def term_counts(docs: DataFrame, group: Sequence[str], terms: Sequence[str],
                body: str = "body", drop_empty: bool = False) -> DataFrame:
    """(group, word, count) for ``terms``, plus one row per group with word
    NULL holding the count of all other tokens.  Per-group sums equal those
    of the full word-count table.  ``drop_empty`` leaves empty tokens out
    (the token set the TF-IDF tables are built on)."""
    toks = explode_tokens(docs, group, body)
    if drop_empty:
        toks = toks.where(F.col("word") != "")
    kept = F.when(F.col("word").isin(list(terms)), F.col("word")).alias("word")
    return toks.select(*group, kept).groupBy(*group, "word").count()


def term_share(docs: DataFrame, group: Sequence[str], terms: Sequence[str],
               body: str = "body", scale: float = 100.0, relative: str = "relative_count",
               drop_empty: bool = False, keep_total: bool = False) -> DataFrame:
    """``timeline_relative`` in one pass over the texts.

    The group totals are a window sum over the ``term_counts`` table, which
    has at most (#terms + 1) rows per group -- so the window partition of
    even the largest group is tiny -- and the texts are scanned and
    normalized once instead of once per join side.
    """
    tc = term_counts(docs, group, terms, body, drop_empty)
    total = F.sum("count").over(Window.partitionBy(*group))
    share = F.col("count") / F.col("total")
    if scale != 1.0:
        share = share * F.lit(scale)
    cols = [*group, "word", "count"] + (["total"] if keep_total else []) + [share.alias(relative)]
    return (tc.withColumn("total", total)
            .where(F.col("word").isNotNull())
            .select(*cols)
            .orderBy(*group, "count", "word"))


def label_camps(df: DataFrame, first: Sequence[str], first_label: str, second_label: str,
                word: str = "word") -> DataFrame:
    """Replace the term column by its camp label."""
    label = F.when(F.col(word).isin(list(first)), F.lit(first_label)) \
        .otherwise(F.lit(second_label))
    return df.withColumn(word, label).withColumnRenamed(word, "technology")


def group_totals(counts: DataFrame, group: Sequence[str], value: str = "count",
                 total: str = "total") -> DataFrame:
    return counts.groupBy(*group).agg(F.sum(value).alias(total))


def timeline(counts: DataFrame, group: Sequence[str], terms: Sequence[str],
             word: str = "word", value: str = "count") -> DataFrame:
    """Value of each term per group, ordered by group then value."""
    return (counts.where(F.col(word).isin(list(terms)))
            .select(*group, word, value)
            .orderBy(*group, value, word))


def timeline_relative(counts: DataFrame, group: Sequence[str], terms: Sequence[str],
                      word: str = "word", value: str = "count", scale: float = 100.0,
                      relative: str = "relative_count", keep_total: bool = False) -> DataFrame:
    """Value of each term and its share of the group total (x ``scale``).

    The totals side has one row per group; AQE broadcasts it when its
    runtime size is under the broadcast threshold, else it shuffles.
    """
    totals = group_totals(counts, group, value)
    picked = counts.where(F.col(word).isin(list(terms)))
    joined = picked.join(totals, on=list(group), how="left")
    share = F.col(value) / F.col("total")
    if scale != 1.0:
        share = share * F.lit(scale)
    cols = [*group, word, value] + (["total"] if keep_total else []) + [share.alias(relative)]
    return joined.select(*cols).orderBy(*group, value, word)


def camp_comparison(counts: DataFrame, group: Sequence[str], first: Sequence[str],
                    second: Sequence[str], first_label: str, second_label: str,
                    word: str = "word", value: str = "count", relative: bool = True,
                    scale: float = 100.0) -> DataFrame:
    """One row per (group, term) of either camp, labelled by camp, with the
    term's value and (optionally) its share of the group total."""
    label = F.when(F.col(word).isin(list(first)), F.lit(first_label)) \
        .otherwise(F.lit(second_label)).alias("technology")
    picked = counts.where(F.col(word).isin(list(first) + list(second)))
    if not relative:
        return picked.select(*group, label, value).orderBy(*group, value, "technology")
    totals = group_totals(counts, group, value)
    joined = picked.join(totals, on=list(group), how="left")
    share = (F.col(value) / F.col("total") * F.lit(scale)).alias("relative_count")
    return joined.select(*group, label, value, share).orderBy(*group, value, "technology")
