"""Language identification by compression.

1. *Learning.*  Of each language at most ``per_language`` labelled texts are
   read, those with the least hashes.  Their words are counted on the cluster,
   each once a text; a language's dictionary holds its commonest words up to
   ``dictionary_bytes``, the commonest last, where a match is cheapest.  The
   driver sees these words only: ``dictionary_bytes`` a language.
2. *Encoding.*  A text's different words are compressed by zstandard with each
   language's dictionary as raw content, so matches reach into its words; the
   language with the smallest output is predicted.  The work is the same for
   every text, and every word of it is encoded.
3. *Rejecting.*  A language weighs half as much for every byte that its output
   is longer.  ``score`` is the share of the smallest; ``sure`` is false where
   it is below ``least_score``, that is where the margin is narrow: languages
   tie or are a few bytes apart, as in texts of a word or two.

Words are runs of letters and the marks on them, in lower case.  Scoring needs no
shuffle: texts are independent, and the dictionaries travel with the tasks.

Defined results.  Texts that are null or have no letter get ``und``, score 0,
and aren't sure; so do all texts if there was nothing to learn from.  Of equal
outputs the language with more labelled rows wins, then the first by name.
Labels that are null and texts without letters teach nothing.  Rows that repeat
an id are scored each.  An empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlake.llm.common import save
from textlake.llm.words import bounded_batches

UNKNOWN = "und"
#: Search settings: short matches are worth finding in word lists.
SEARCH = {"compression_level": 3, "min_match": 3, "strategy": zstandard.STRATEGY_BTLAZY2, "window_log": 17,
          "hash_log": 16, "chain_log": 16, "search_log": 3, "write_content_size": False}


def words_of(text: str | Column) -> Column:
    """The different words of a text in order, lower case; null or none: empty."""
    return F.filter(F.array_distinct(F.split(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{M}]+", " "), " ")), lambda w: w.rlike("\\p{L}"))


@dataclass(frozen=True)
class Languages:
    """Names in the order in which ties are decided, and a dictionary for each."""

    names: tuple[str, ...]
    dictionaries: tuple[bytes, ...]

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        settings = zstandard.ZstdCompressionParameters(**SEARCH)
        out = []
        for words in self.dictionaries:
            content = zstandard.ZstdCompressionDict(words, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(compression_params=settings)
            out.append(zstandard.ZstdCompressor(dict_data=content, compression_params=settings))
        return out


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          per_language: int = 400, dictionary_bytes: int = 65_536) -> Languages:
    """Dictionaries of the languages of ``docs``, all of whose rows may teach."""
    known = docs.where(F.col(lang_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.xxhash64(id_col, text_col, F.lit("language")).alias("hash"), F.col(text_col).alias("text"))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return Languages((), ())
    # rows with small hashes first, so that few are ranked, however many a language has
    share = {lang: min(1.0, (per_language + 8 * per_language**0.5 + 32) / n) for lang, n in counts.items()}
    shares = docs.sparkSession.createDataFrame(list(share.items()), "lang string, share double")
    some = known.join(F.broadcast(shares), on="lang").where((F.col("hash") + 2.0**63) / 2.0**64 <= F.col("share"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("hash", F.xxhash64("text")))
    read = some.withColumn("rank", rank).where(F.col("rank") <= per_language).select("lang", F.explode(words_of("text")).alias("word"))
    held = save(read.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")), "language-words")
    common = Window.partitionBy("lang").orderBy(F.desc("n"), "word").rowsBetween(Window.unboundedPreceding, 0)
    # words that are too rare for any place in a dictionary needn't be sorted: each takes two bytes at least
    top = held.withColumn("place", F.row_number().over(common)).where(F.col("place") <= dictionary_bytes // 2)
    fit = top.withColumn("end", F.sum(F.octet_length("word") + 1).over(common)).where(F.col("end") <= dictionary_bytes - 1)
    words = fit.groupBy("lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "word")), asc=False), lambda s: s["word"]).alias("words"))
    of = {r["lang"]: f" {' '.join(r['words'])} ".encode() for r in words.collect()}
    names = sorted(of, key=lambda lang: (-counts[lang], lang))
    return Languages(tuple(names), tuple(of[lang] for lang in names))


def output_sizes(texts: pa.Array, compressors: list[zstandard.ZstdCompressor]) -> np.ndarray:
    """Bytes of each text's output (texts x languages)."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1 + texts.offset)[texts.offset:]
    data = memoryview(texts.buffers()[2] or b"")
    sizes = np.empty((len(texts), len(compressors)), np.int64)
    for i, (start, end) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        text = data[start:end]
        sizes[i] = [len(c.compress(text)) for c in compressors]
    return sizes


def _predict(languages: Languages, least_score: float):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors, names = languages.compressors(), np.array([*languages.names, UNKNOWN], object)
        for batch in batches:
            words = batch.column("words")
            sizes = output_sizes(words, compressors)
            best = np.full(len(words), len(names) - 1)
            score = np.zeros(len(words))
            some = np.flatnonzero(pa.compute.binary_length(words).to_numpy() > 0) if len(names) > 1 else []
            if len(some):
                best[some] = sizes[some].argmin(axis=1)
                over = sizes[some] - sizes[some].min(axis=1, keepdims=True)
                score[some] = 1 / np.exp2(-np.minimum(over, 1000).astype(float)).sum(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(names[best], pa.string()), pa.array(score), pa.array(score >= least_score)],
                names=["id", "lang_pred", "score", "sure"])
    return predict


def identify(docs: DataFrame, languages: Languages, id_col: str = "doc_id", text_col: str = "text", least_score: float = 0.9) -> DataFrame:
    """(id, lang_pred, score, sure), one row for each input row."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.array_join(words_of(text_col), " "), F.lit("")).alias("words"))
    out = rows.mapInArrow(_predict(languages, least_score), f"id {kind}, lang_pred string, score double, sure boolean")
    return out.withColumnRenamed("id", id_col)
