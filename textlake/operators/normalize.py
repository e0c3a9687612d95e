"""The normalizer with its stopwords in a table.

For word lists too long to inline: the tokens of all texts, with their
positions, go through an anti join with the word table, and each text is
rebuilt from what is left, in order; plurals and phrases then see the texts
without the words, as in the inline form.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlake.functions.constants import PHRASES
from textlake.functions.text import clean_string, glue_phrases, strip_plural, tokens


def remove_words(docs: DataFrame, key: Sequence[str], text: str, words: DataFrame, word_col: str = "word") -> DataFrame:
    """(key..., text): each text's ' '-separated tokens without the table's words, in order.

    ``key`` tells the rows apart.  No side is hinted: Spark broadcasts the words
    when their size allows, else it splits a frequent token's rows (they come
    from a shuffle).  A text is rebuilt from its own tokens, so a group is as
    large as one text.  A text of nothing but the words becomes empty, a null
    one stays null.
    """
    # position -1 keeps the row of every text through the join; its word is none of the table's
    marks = F.array(F.struct(F.lit(-1).alias("pos"), F.lit(None).cast("string").alias("word")))
    numbered = F.transform(tokens(text), lambda w, i: F.struct(i.alias("pos"), w.alias("word")))
    rows = docs.select(*key, F.col(text).isNull().alias("_none"), F.explode(F.concat(marks, F.coalesce(numbered, F.array()))).alias("_t"))
    rows = rows.select(*key, "_none", "_t.pos", "_t.word")
    left = rows.join(words.select(F.col(word_col).alias("word")).where("word IS NOT NULL").distinct(), on="word", how="left_anti")
    parts = left.groupBy(*key, "_none").agg(F.sort_array(F.collect_list(F.struct("pos", "word"))).alias("_ts"))
    kept = F.transform(F.filter("_ts", lambda t: t["pos"] >= 0), lambda t: t["word"])
    return parts.select(*key, F.when(~F.col("_none"), F.array_join(kept, " ")).alias(text))


def normalize_with_words(docs: DataFrame, key: Sequence[str], text: str, words: DataFrame, phrases: Sequence[str] = PHRASES,
                         out: str = "body") -> DataFrame:
    """(key..., out): clean -> stopwords of the table -> plural -> phrases."""
    cleaned = docs.select(*key, clean_string(F.lower(text)).alias(out))
    return remove_words(cleaned, key, out, words).withColumn(out, glue_phrases(strip_plural(out), phrases))
