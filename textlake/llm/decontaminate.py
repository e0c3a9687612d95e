"""Benchmark decontamination: winnowed fingerprints of training and test texts.

A window is ``window`` consecutive words of a test item (an item of fewer
words is one window).  Document words inside an occurrence of a window are hit.

1. Winnowing keeps, of each window, the ``gram``-word run with the least hash:
   a document that holds an item's window holds the same fingerprint, so no
   shared span of ``window`` words is missed.
2. The items' fingerprints are set in a bitset of fixed size (``bits``, 512 KB
   by default, whatever the tables' sizes), which tasks carry along.  Document
   fingerprints whose bit is not set belong to no item and go at once; on a
   benchmark too large for the bitset more of them stay, and results are the same.
3. The others are extended to their windows with 128-bit hashes and joined to
   the items' windows; overlapping windows merge into hits.

Items shorter than a window are looked up whole, at their own length, of
which there are fewer than ``window``.

Defined results.  Null texts have no words, and neither do texts of
separators only; they are never contaminated, and such items have no window.
Items with a null id are ignored.  Rows that repeat are reported each.  An
item id that several rows share counts once.  Empty tables give empty
results, or no hits.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlake.llm.common import has_bit, hashed_bits, save
from textlake.llm.words import FOLDED, Texts, bounded_batches, lists, range_hash, signed, slices, winnow

WINDOWS = "array<struct<at:int,n:int,anchor:bigint,w1:bigint,w2:bigint>>"


def _windows(texts: Texts, window: int, gram: int, short: tuple[int, ...], known: np.ndarray | None):
    """Arrays at, n, anchor, w1, w2 of windows: all, or those whose anchor may be ``known``."""
    hashes = texts.word_hashes()
    at, _, key = winnow(texts, hashes, gram, window)
    found = []

    def add(at, n, key):
        if known is not None:
            keep = has_bit(known, key)
            at, key = at[keep], key[keep]
        found.append((at, np.full(len(at), n), key, *(range_hash(hashes, at, at + n, k) for k in (0, 1))))

    add(at, window, key)
    for n in short:
        if known is None:  # items: those of n words
            begin = texts.first[:-1][texts.counts == n]
        else:
            owner = texts.text_of_word()
            begin = np.flatnonzero(owner[: len(owner) - n + 1] == owner[n - 1:]) if len(owner) >= n else owner
        add(begin, n, range_hash(hashes, begin, begin + n))
    return [np.concatenate(x) for x in zip(*found, strict=True)]


def _emit(window: int, gram: int, short: tuple[int, ...], known: np.ndarray | None, ids: tuple[str, ...]):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in slices(batch.column("text"), FOLDED, fold=True):
                at, n, key, w1, w2 = _windows(texts, window, gram, short, known)
                row = np.searchsorted(texts.first, at, "right") - 1
                order = np.argsort(row, kind="stable")
                fields = [(at - texts.first[row]).astype(np.int32), n.astype(np.int32), *map(signed, (key, w1, w2))]
                entries = pa.StructArray.from_arrays([pa.array(x[order]) for x in fields], names=["at", "n", "anchor", "w1", "w2"])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(start, len(texts)) for c in ids), pa.array(texts.counts.astype(np.int64)),
                     lists(entries, np.bincount(row, minlength=len(texts)))], names=[*ids, "n_words", "windows"])
    return emit


def item_windows(items: DataFrame, id_col: str, text_col: str, window: int, gram: int) -> DataFrame:
    """(item, n, anchor, w1, w2), each different window of an item once."""
    rows = items.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    return save(rows.mapInArrow(_emit(window, gram, tuple(range(1, window)), None, ("item",)),
                                f"item string, n_words bigint, windows {WINDOWS}")
                .select("item", F.explode("windows").alias("w")).select("item", "w.n", "w.anchor", "w.w1", "w.w2")
                .distinct(), "item-windows")


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text: str = "text", window: int = 13, gram: int = 5, one_in: int = 20, bits: int = 1 << 22) -> DataFrame:
    """(id, th, n_words, n_hit, items, spans, contaminated), one row for each input row.

    ``items``: ids of items with a window in the text, sorted as strings;
    ``spans``: the hit word ranges; ``contaminated``: at least one word in
    ``one_in`` is hit; ``th``: the hash of id and text by which rows are known.
    """
    if bits & (bits - 1) or bits < 64:
        raise ValueError("bits must be a power of two, 64 at least")
    bounded_batches(docs.sparkSession)
    known_windows = item_windows(items, item_col, item_text, window, gram)
    known = hashed_bits(known_windows, "anchor", bits)
    short = tuple(sorted(r["n"] for r in known_windows.where(F.col("n") < window).select("n").distinct().collect()))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("th"),
                       F.col(text_col).alias("text"))
    marked = save(rows.mapInArrow(_emit(window, gram, short, known, ("id", "th")),
                                  f"id bigint, th bigint, n_words bigint, windows {WINDOWS}"), "document-windows")
    same = ["n", "anchor", "w1", "w2"]
    # rows that repeat have the same id, text and windows: one of them is looked up
    hits = (marked.where(F.size("windows") > 0).select(F.coalesce("id", F.lit(-(1 << 63))).alias("id"), "th",
                                                        F.explode("windows").alias("w"))
            .select("id", "th", "w.at", "w.n", "w.anchor", "w.w1", "w.w2").distinct())
    hits = save(hits.join(known_windows.select(*same).distinct(), on=same), "hits")
    named = hits.select("id", "th", *same).distinct().join(known_windows, on=same)
    by_row = (hits.groupBy("id", "th").agg(F.array_sort(F.collect_set(F.struct("at", (F.col("at") + F.col("n")).alias("to")))).alias("w"))
              .join(named.groupBy("id", "th").agg(F.array_sort(F.collect_set("item")).alias("items")), on=["id", "th"]))
    spans = F.aggregate("w", F.array().cast("array<struct<from:int,to:int>>"), lambda done, x: F.when(
        (F.size(done) > 0) & (F.element_at(done, -1)["to"] >= x["at"]), F.concat(
            F.slice(done, 1, F.size(done) - 1), F.array(F.struct(
                F.element_at(done, -1)["from"].alias("from"),
                F.greatest(F.element_at(done, -1)["to"], x["to"]).alias("to"))))).otherwise(
        F.concat(done, F.array(F.struct(x["at"].alias("from"), x["to"].alias("to"))))))
    by_row = save(by_row.select("id", "th", "items", spans.alias("spans")), "hit-documents")
    out = (marked.select("id", "th", "n_words").withColumn("key", F.coalesce("id", F.lit(-(1 << 63))))
           .join(by_row.withColumnRenamed("id", "key"), on=["key", "th"], how="left"))
    none = F.array().cast("array<struct<from:int,to:int>>")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["to"] - s["from"])
    return (out.withColumn("spans", F.coalesce("spans", none)).withColumn("n_hit", n_hit)
            .select(F.col("id").alias(id_col), "th", "n_words", "n_hit",
                    F.coalesce("items", F.array().cast("array<string>")).alias("items"), "spans",
                    ((F.col("n_hit") > 0) & (F.col("n_hit") * one_in >= F.col("n_words"))).alias("contaminated")))


def drop_contaminated(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``decontaminate`` calls clean, with all their columns."""
    bad = save(found.where("contaminated").select(F.coalesce(id_col, F.lit(-(1 << 63))).alias("__id"), F.col("th").alias("__th")).distinct(),
               "contaminated")
    rows = docs.withColumns({"__id": F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))),
                             "__th": F.xxhash64(F.col(id_col), F.col(text_col))})
    return rows.join(bad, on=["__id", "__th"], how="left_anti").select(*docs.columns)
