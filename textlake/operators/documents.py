"""Document views: clean documents, session filter, group filter, preview."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlake.functions.constants import DEFAULT_STOPWORDS, NON_SESSION_TITLES, PHRASES
from textlake.functions.text import clean_string, normalize_text


def clean_documents(raw: DataFrame, keep: Sequence[str], title: str = "title",
                    content: str = "content", stopwords: Sequence[str] = DEFAULT_STOPWORDS,
                    phrases: Sequence[str] = PHRASES) -> DataFrame:
    """Raw documents -> ``keep`` columns + cleaned title/content + normalized body.

    body = normalize(lower(title || ' ' || content)).  Columns a later step
    does not use are pruned by Catalyst, so the cleaned ``content`` costs
    nothing unless it is selected.
    """
    t, c = F.col(title), F.col(content)
    return raw.select(
        *keep,
        clean_string(F.lower(t)).alias("title"),
        clean_string(F.lower(c)).alias("content"),
        normalize_text(F.concat(t, F.lit(" "), c), stopwords, phrases).alias("body"),
    )


def _any_like(col: Column, patterns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [col.like(p) for p in patterns])


def filter_sessions(docs: DataFrame, link: str, include: Sequence[str],
                    title: str = "title", exclude: Sequence[str] = NON_SESSION_TITLES
                    ) -> DataFrame:
    """Keep rows whose ``link`` matches any ``include`` LIKE pattern and whose
    ``title`` matches none of ``exclude``.  Prefix/suffix/contains LIKE
    patterns become StartsWith/EndsWith/Contains and reach the Parquet scan
    when the columns come straight from it."""
    keep = _any_like(F.col(link), include)
    if exclude:
        keep = keep & ~_any_like(F.col(title), exclude)
    return docs.where(keep)


def filter_by_group(docs: DataFrame, group: str, value) -> DataFrame:
    """Equality on a string group key, compared as strings (no implicit
    numeric cast, which would fail on '' under ANSI mode)."""
    return docs.where(F.col(group) == F.lit(str(value)))


def preview_nonempty(docs: DataFrame, content: str, order_by: Sequence[str], n: int = 10
                     ) -> DataFrame:
    """First ``n`` rows whose cleaned ``content`` is not empty, in a stable key
    order.  Takes raw documents: the cheap test, the sort and the limit come
    first, so the caller normalizes ``n`` rows and not the corpus."""
    keeps_something = F.lower(F.col(content)).rlike("[a-zA-Z0-9]")
    return docs.where(keeps_something).orderBy(*order_by).limit(n)
