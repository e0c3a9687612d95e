"""Words of a batch of texts as numpy arrays, and hashes over them.

These run inside ``mapInArrow`` tasks on one Arrow batch at a time: Spark
partitions, shuffles and joins; numpy only turns a batch's bytes into word
positions and 64-bit hashes.  A batch is handled in slices of a few
megabytes, so that the arrays stay small whatever the texts' lengths.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

U = np.uint64
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)


def bounded_batches(spark: SparkSession, megabytes: int = 8) -> None:
    """Let Spark cut Arrow batches by bytes too, unless the session says how:
    ten thousand long texts in one batch would not fit a worker."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name, str(2**31 - 1))) > megabytes << 20:
        spark.conf.set(name, str(megabytes << 20))


def byte_class(*, plain: bool) -> np.ndarray:
    """Which bytes belong to words.  plain: all but 0x20 and 0x09-0x0D; else
    0-9, a-z and the bytes of characters beyond ASCII."""
    table = np.ones(256, bool)
    if plain:
        table[[0x20, *range(0x09, 0x0E)]] = False
    else:
        table[:0x80] = False
        table[0x30:0x3A] = table[0x61:0x7B] = True
    return table


PLAIN, FOLDED = byte_class(plain=True), byte_class(plain=False)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray, key: int = 0) -> np.ndarray:
    """A 64-bit mixing of each element (splitmix64's finalizer)."""
    x = x + U(key * 0x9E3779B97F4A7C15 & (2**64 - 1))
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** 0.. and its inverses modulo 2 ** 64, ``size`` of each at least."""
    if base not in _TABLES or len(_TABLES[base][0]) < size:
        size = max(1 << 16, 1 << (size - 1).bit_length())
        up, down = np.full(size, base, U), np.full(size, pow(base, -1, 2**64), U)
        up[0] = down[0] = 1
        _TABLES[base] = np.cumprod(up, dtype=U), np.cumprod(down, dtype=U)
    return _TABLES[base]


def range_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A hash of each values[start:end], the same wherever the range lies."""
    up, down = _tables(_ODD[which], len(values) + 1)
    sums = np.zeros(len(values) + 1, U)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U) * U(_ODD[2]), which + 1)


class Texts:
    """A slice of a batch: its words' byte ranges, and for each text the range of its words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray, fold: bool):
        self.data = data = _LOWER[data] if fold else data
        self.offsets = offsets
        inside = table[data]
        before, after = np.empty_like(inside), np.empty_like(inside)
        if len(data):
            before[1:], after[:-1] = inside[:-1], inside[1:]
            filled = offsets[:-1] < offsets[1:]
            before[offsets[:-1][filled]] = False
            after[offsets[1:][filled] - 1] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets)  # of a text's words; one more at the end

    def __len__(self) -> int:
        return len(self.first) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), self.counts)

    def word_hashes(self) -> np.ndarray:
        if not len(self.starts):
            return np.empty(0, U)
        return range_hash(self.data.astype(U) + U(1), self.starts, self.ends)

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i]:self.ends[i]].tobytes()


def slices(column: pa.Array, table: np.ndarray = PLAIN, fold: bool = False,
           most_bytes: int = 2 << 20, most_texts: int = 1 << 14) -> Iterator[tuple[int, Texts]]:
    """(index of the first text, Texts) for slices of a string column; a text of
    more than ``most_bytes`` is a slice of its own.  Nulls have no words."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1 + column.offset)[column.offset:]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most_bytes, "right")) - 1)
        to = min(to, at + most_texts, len(column))
        yield at, Texts(data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at], table, fold)
        at = to


def windows(texts: Texts, size: int) -> np.ndarray:
    """First words of all runs of ``size`` words inside one text."""
    n = len(texts.starts)
    if n < size:
        return np.empty(0, np.int64)
    owner = texts.text_of_word()
    return np.flatnonzero(owner[: n - size + 1] == owner[size - 1:])


def winnow(texts: Texts, hashes: np.ndarray, gram: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Winnowing: of each window of ``size`` words the ``gram``-word run with the
    least hash.  Returns the windows' first words, their anchors' first words
    and the hashes of the anchors.  Equal windows have equal anchors, so two
    texts that share ``size`` words share an anchor."""
    at = windows(texts, size)
    if not len(at):
        return at, at, np.empty(0, U)
    n = len(hashes)
    begins = np.arange(n - gram + 1)
    grams = range_hash(hashes, begins, begins + gram)
    wide = np.lib.stride_tricks.sliding_window_view(grams, size - gram + 1)
    anchor = at + wide[at].argmin(axis=1) if len(at) < len(wide) else at + wide.argmin(axis=1)
    return at, anchor, grams[anchor]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def lists(values: pa.Array, counts: np.ndarray) -> pa.ListArray:
    """``values`` cut into lists of the given lengths."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values)
