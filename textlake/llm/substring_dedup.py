"""Substring dedup: seed and extend on winnowed anchors.

A word goes when a run of ``min_words`` words around it also starts somewhere
else, in another document or in the same one.

1. *Seeds.*  Every window of ``min_words`` words has one anchor, its
   ``gram``-word run with the least hash; equal windows have equal anchors.
   A pass emits, for each anchor, the span of the windows it stands for (its
   extension both ways) with a hash: a row for about fifteen words.
2. *Join.*  Anchors that occur once go.  The spans of the others are counted
   by anchor and hash.  A span that occurs twice repeats as a whole, so a
   group of copies costs one row from here on, however large it is; no
   pairs are made.
3. *Extend.*  Where different spans meet at one anchor, a repeat ends inside
   them.  Of each different span one occurrence is read again and its
   windows are hashed; windows of one anchor found twice repeat.  This finds
   the exact ends of every maximal repeat, against all occurrences.
4. *Remove.*  A document's repeated windows are merged into maximal spans and
   their words leave.

Spans and windows are told apart by two 64-bit hashes, that of the anchor
and their own.  Texts are read four times.  Of the two joins that need them
again only the texts that a bitset of fixed size lets through are shuffled,
compressed; the others are finished where they are read.

Defined results.  A null text has no words.  A text of fewer than
``min_words`` words keeps them all.  Rows that repeat are different places,
so their long runs all go.  Rows may share an id or have none: a row is known
by its id and text, and equal rows have equal results.  An empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textlake.llm.common import has_bit, hashed_bits, save
from textlake.llm.words import Texts, bounded_batches, range_hash, signed, slices, winnow

SPANS = "id bigint, th bigint, first int, n int, anchor bigint, c1 bigint"


def spans_of(texts: Texts, min_words: int, gram: int) -> tuple[np.ndarray, ...]:
    """For each anchor: the first window it stands for, how many windows, its
    hash, and the hash of the span of those windows."""
    hashes = texts.word_hashes()
    at, anchor, key = winnow(texts, hashes, gram, min_words)
    if not len(at):
        none = np.empty(0, np.int64)
        return none, none, none, none
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)]))
    first, n = at[new], np.diff(np.append(new, len(at)))
    place = (anchor[new] - first).astype(np.uint64)  # spans are alike when their anchors stand alike
    return first, n, signed(key[new]), signed(range_hash(hashes, first, first + n - 1 + min_words) + place)


def _emit_spans(min_words: int, gram: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in slices(batch.column("text")):
                first, n, anchor, c1 = spans_of(texts, min_words, gram)
                row = np.searchsorted(texts.first, first, "right") - 1
                ids = [batch.column(c).to_numpy(zero_copy_only=False)[start + row] for c in ("id", "th")]
                yield pa.RecordBatch.from_arrays([
                    *map(pa.array, ids), pa.array((first - texts.first[row]).astype(np.int32)),
                    pa.array(n.astype(np.int32)), pa.array(anchor), pa.array(c1)],
                    names=["id", "th", "first", "n", "anchor", "c1"])
    return emit


def _pack(known: np.ndarray):
    """Rows whose ``th`` may be in the bitset, their texts compressed for the shuffle."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            th = batch.column("th").to_numpy(zero_copy_only=False)
            keep = has_bit(known, th.view(np.uint64))
            some = batch.filter(pa.array(keep))
            texts = [(x.as_py() or "").encode() for x in some.column("text")]
            yield pa.RecordBatch.from_arrays(
                [some.column("id"), some.column("th"), some.column("doc_id"), pa.array(map(len, texts), pa.int64()),
                 pa.array([pa.compress(x, "zstd", asbytes=True) for x in texts], pa.binary())],
                names=["id", "th", "doc_id", "size", "packed"])
    return emit


PACKED = "id bigint, th bigint, doc_id bigint, size bigint, packed binary"


def _unpack(batch: pa.RecordBatch, i: int) -> bytes:
    size = batch.column("size")[i].as_py()
    return pa.decompress(batch.column("packed")[i].as_py(), size, "zstd", asbytes=True) if size else b""


WINDOWS = "anchor bigint, c1 bigint, w1 bigint, place int, times bigint"


def _emit_windows(min_words: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            todo = batch.column("todo")
            for i in range(batch.num_rows):
                rows = todo[i].values  # spans of this text that are to be extended
                part = {f.name: rows.field(f.name).to_numpy(zero_copy_only=False) for f in rows.type}
                n = part["n"].astype(np.int64)
                place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                at = np.repeat(part["first"], n) + place
                for _, texts in slices(pa.array([_unpack(batch, i).decode()]), most_bytes=1 << 62):
                    w1 = signed(range_hash(texts.word_hashes(), at, at + min_words))
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(np.repeat(part[c], n)) for c in ("anchor", "c1")), pa.array(w1),
                     pa.array(place.astype(np.int32)), pa.array(np.repeat(part["times"], n))],
                    names=["anchor", "c1", "w1", "place", "times"])
    return emit


def removed_words(n_words: int, first: np.ndarray, mask: np.ndarray, min_words: int) -> np.ndarray:
    """Which words the repeated windows cover: window ``first + b`` for each bit b of ``mask``."""
    edge = np.zeros(n_words + 1, np.int64)
    for bit in range(64):
        at = first[(mask >> bit) & 1 == 1] + bit
        if len(at):
            np.add.at(edge, at, 1)
            np.add.at(edge, at + min_words, -1)
    return np.cumsum(edge[:-1]) > 0


RESULT = ("doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, "
          "spans array<struct<from:bigint,to:bigint>>, kept_text string")


class _Kept:
    """Result rows of one batch."""

    def __init__(self, min_words: int, with_text: bool):
        self.min_words, self.with_text = min_words, with_text
        self.rows = []

    def add(self, doc_id: int | None, text: bytes, repeats: pa.Scalar | None) -> None:
        words = text.split()
        kept, edges = words, []
        if repeats is not None and repeats.is_valid:
            drop = removed_words(len(words), repeats.values.field("first").to_numpy().astype(np.int64),
                                 repeats.values.field("mask").to_numpy(), self.min_words)
            edges = np.flatnonzero(np.diff(np.concatenate([[0], drop.view(np.int8), [0]]))).tolist()
            kept, at = [], 0
            for a, b in zip(edges[::2], edges[1::2], strict=True):
                kept += words[at:a]
                at = b
            kept += words[at:]
        joined = b" ".join(kept)
        spans = [{"from": a, "to": b} for a, b in zip(edges[::2], edges[1::2], strict=True)]
        self.rows.append((doc_id, len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), spans,
                          joined.decode() if self.with_text else None))

    def batch(self) -> pa.RecordBatch:
        cols = list(zip(*self.rows, strict=True)) or [[]] * 6
        span = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), span, pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                                          names=["doc_id", "n_words", "n_removed", "kept_sha256", "spans", "kept_text"])


def _finish_others(known: np.ndarray, min_words: int, with_text: bool):
    """Rows that surely have no repeat."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = _Kept(min_words, with_text)
            keep = ~has_bit(known, batch.column("th").to_numpy(zero_copy_only=False).view(np.uint64))
            for i in np.flatnonzero(keep):
                out.add(batch.column("doc_id")[i].as_py(), (batch.column("text")[i].as_py() or "").encode(), None)
            yield out.batch()
    return emit


def _finish(min_words: int, with_text: bool):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = _Kept(min_words, with_text)
            for i in range(batch.num_rows):
                out.add(batch.column("doc_id")[i].as_py(), _unpack(batch, i), batch.column("repeats")[i])
            yield out.batch()
    return emit


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 35,
                    gram: int = 8, with_text: bool = True, bits: int = 1 << 22) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256, spans, kept_text), one row for each
    input row.  ``spans``: the maximal repeats that left, as word ranges;
    ``kept_text`` is null unless ``with_text``.  ``bits``: size of the bitsets."""
    if not 0 < min_words - gram + 1 <= 62:
        raise ValueError("gram must be at most min_words, and an anchor may stand for 62 windows at most")
    bounded_batches(docs.sparkSession)
    # id as the join key: a null id is one more value
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("id"),
                       F.xxhash64(F.col(id_col), F.col(text_col)).alias("th"), F.col(id_col).cast("long").alias("doc_id"),
                       F.col(text_col).alias("text"))
    key = ["anchor", "c1"]
    spans = rows.select("id", "th", "text").mapInArrow(_emit_spans(min_words, gram), SPANS)
    anchors = save(spans.groupBy("anchor").agg(F.count(F.lit(1)).alias("times"), F.min("c1").alias("lo"), F.max("c1").alias("hi"))
                   .where("times > 1").select("anchor", (F.col("lo") != F.col("hi")).alias("meet")), "anchors")
    spans = save(spans.join(anchors, on="anchor"), "spans")
    different = save(spans.groupBy(*key).agg(
        F.count(F.lit(1)).alias("times"), F.max("n").alias("n"), F.max("meet").alias("meet"),
        *[F.first(c).alias(c) for c in ("id", "th", "first")]), "different-spans")
    todo = save(different.where("meet").groupBy("id", "th").agg(
        F.collect_list(F.struct("first", "n", *key, "times")).alias("todo")), "to-extend")
    packed = rows.mapInArrow(_pack(hashed_bits(todo, "th", bits)), PACKED)
    one = F.row_number().over(Window.partitionBy("id", "th").orderBy("size"))  # of equal rows one is read
    windows = save(packed.join(todo, on=["id", "th"]).withColumn("one", one).where("one = 1").select("size", "packed", "todo")
                   .mapInArrow(_emit_windows(min_words), WINDOWS), "windows")
    twice = save(windows.groupBy("anchor", "w1").agg(F.sum("times").alias("times")).where("times > 1").select("anchor", "w1"),
                 "repeated-windows")
    inside = (windows.join(twice, on=["anchor", "w1"], how="left_semi").groupBy(*key)
              .agg(F.sum(F.expr("shiftleft(1L, place)")).alias("mask")))
    whole = different.where("times > 1").select(*key, F.expr("shiftleft(1L, n) - 1").alias("mask"))
    masks = save(whole.unionByName(inside).groupBy(*key).agg(F.bit_or("mask").alias("mask")), "repeats")
    repeats = save(spans.join(masks, on=key).groupBy("id", "th")
                   .agg(F.collect_set(F.struct("first", "mask")).alias("repeats")), "row-repeats")
    known = hashed_bits(repeats, "th", bits)
    joined = rows.mapInArrow(_pack(known), PACKED).join(repeats, on=["id", "th"], how="left")
    out = (joined.select("doc_id", "size", "packed", "repeats").mapInArrow(_finish(min_words, with_text), RESULT)
           .unionByName(rows.select("doc_id", "th", "text").mapInArrow(_finish_others(known, min_words, with_text), RESULT)))
    return out.withColumnRenamed("doc_id", id_col)
