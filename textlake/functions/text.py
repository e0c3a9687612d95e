"""Text normalization as Column -> Column functions.

All functions are built from Spark SQL built-ins, so they run inside the JVM
(no Python worker round trip) and compose freely with filters and
aggregations.  NULL in gives NULL out.

Semantics (single-space token model):
  clean_string   lower-case input assumed; delete every character outside
                 [a-zA-Z0-9 ], squeeze runs of blanks, trim.
  remove_stopwords  split on ' ', drop tokens in the list, join with ' '.
  strip_plural   drop exactly one trailing 's' of every ' '-separated token.
  glue_phrases   plain substring replacement of each phrase by the phrase
                 without blanks, applied in list order (replacements chain).
  normalize_text clean -> stopwords -> plural -> phrases.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from textlake.functions.constants import DEFAULT_STOPWORDS, PHRASES

ColumnOrName = Column | str


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


def sql_literal(s: str) -> str:
    """A string as Spark SQL text."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_let(value: str, name: str, body: str) -> str:
    """SQL text of ``body`` in which ``name`` stands for ``value``, evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


# Every code point except [a-zA-Z0-9 ], written as positive ranges.  It is
# the same set as [^a-zA-Z0-9 ], but java.util.regex scans a run of positive
# ranges about five times faster than that negated class (measured on the
# fixture corpus), and the normalizer runs over every byte of text.
NOT_WORD_CHARS = r"[\x00-\x1f\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x{10FFFF}]+"


def clean_string(c: ColumnOrName) -> Column:
    """Keep [a-zA-Z0-9 ] only, squeeze blanks, trim."""
    kept = F.regexp_replace(_col(c), NOT_WORD_CHARS, "")
    return F.trim(F.regexp_replace(kept, r" {2,}", " "))


def remove_stopwords(c: ColumnOrName, stopwords: Sequence[str] = DEFAULT_STOPWORDS) -> Column:
    """Drop ' '-separated tokens that are in ``stopwords``.

    The list is an IN list inside the expression (it ships with the plan and
    is a hash set for longer lists).  For lists too large to inline, use
    ``textlake.operators.counts.tokens_without`` (anti join).
    """
    words = list(dict.fromkeys(stopwords))
    if not words:
        return _col(c)
    return F.array_join(F.filter(F.split(_col(c), " "), lambda w: ~w.isin(words)), " ")


def strip_plural(c: ColumnOrName) -> Column:
    """Drop one final 's' of every ' '-separated token ('ss' -> 's')."""
    return F.regexp_replace(_col(c), r"s(?= |\z)", "")


def glue_phrases(c: ColumnOrName, phrases: Sequence[str] = PHRASES) -> Column:
    """Replace each phrase by itself without blanks, in list order."""
    out = _col(c)
    for phrase in phrases:
        out = F.replace(out, F.lit(phrase), F.lit(phrase.replace(" ", "")))
    return out


def normalize_text(c: ColumnOrName, stopwords: Sequence[str] = DEFAULT_STOPWORDS,
                   phrases: Sequence[str] = PHRASES) -> Column:
    """Full normalizer: lower -> clean -> stopwords -> plural -> phrases."""
    cleaned = clean_string(F.lower(_col(c)))
    return glue_phrases(strip_plural(remove_stopwords(cleaned, stopwords)), phrases)


# Every code point Python's str.isspace() accepts (what str.strip() removes),
# written with escapes both java.util.regex and RE2 read the same way.
UNICODE_SPACE = (r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
                 r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
STRIP_PATTERN = rf"^{UNICODE_SPACE}+|{UNICODE_SPACE}+\z"


def strip_blank(c: ColumnOrName) -> Column:
    """Remove leading and trailing whitespace, Unicode spaces included."""
    return F.regexp_replace(_col(c), STRIP_PATTERN, "")


def normalize_array(c: ColumnOrName) -> Column:
    """Lower-case and strip every element of an array<string>."""
    return F.transform(_col(c), lambda x: strip_blank(F.lower(x)))


def first_line(c: ColumnOrName) -> Column:
    """Text up to the first newline (the whole text if there is none)."""
    return F.substring_index(_col(c), "\n", 1)


def tokens(c: ColumnOrName) -> Column:
    """Split on single blanks, keeping empty tokens (as a word count does)."""
    return F.split(_col(c), " ")
