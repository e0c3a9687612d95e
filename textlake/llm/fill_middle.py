"""Fill-in-middle transformation by displacement scatter.

A text is cut in two places between its tokens; prefix, middle and suffix are
written in another order with three marks.  Texts travel in Arrow batches, one
array of bytes each.

1. *Cuts.*  Word ends of all texts of a batch come from one scan of the bytes;
   four numbers of a hash of the document's id choose the cuts and the form.
2. *Displacement.*  Every part of a text moves as a whole.  A difference array
   holds, where a part begins, by how much its shift differs from the part
   before; the cumulative sum is the output shift of every byte, and one scatter
   puts all bytes of the batch in place.  Marks are scattered into the gaps.
3. *Restoring* uses the output and its form alone: the marks are found, give
   the same differences, and a gather with the inverse shift makes the text.  No
   part holds a mark and a mark can't begin inside another one, so the marks
   found are the ones written.

Documents are independent: no shuffle, and a task that runs again gives the same.

Defined results.  A null text counts as empty and stays plain; so does a text
that holds one of the marks.  A null id is hashed as an empty one.  A text of
white space is one token.  Rows that repeat an id are cut by the same numbers.
An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlake.llm.common import text_or_empty
from textlake.llm.words import Texts, bounded_batches, slices

#: Marks of prefix, suffix and middle, three bytes each.
MARKS = ("<P>", "<S>", "<M>")
FORMS = ("plain", "psm", "spm")
#: Order of the parts (0 prefix, 1 middle, 2 suffix) and of the marks before them.
ORDER = {1: ((0, 0), (2, 1), (1, 2)), 2: ((2, 1), (0, 0), (1, 2))}
WIDTH = 3


def numbers(id_col: str, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers of a document: groups of the hex sha256 of ``seed:id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substr(digest, F.lit(1 + 8 * i), F.lit(8)), 16, 10).cast("bigint").alias(f"h{i + 1}") for i in range(4)]


def mark_places(data: np.ndarray) -> np.ndarray:
    """Where marks begin in ``data``."""
    middle = np.zeros(256, bool)
    middle[[ord(m[1]) for m in MARKS]] = True
    if len(data) < WIDTH:
        return np.empty(0, np.int64)
    return np.flatnonzero((data[:-2] == ord("<")) & middle[data[1:-1]] & (data[2:] == ord(">")))


def owners(at: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The text that each place of the joined bytes lies in."""
    return np.searchsorted(offsets, at, "right") - 1


def shifts(size: int, starts: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """Every byte's shift: parts begin at ``starts`` (ascending) and move by ``shift`` each."""
    change = np.zeros(size + 1, np.int64)
    np.add.at(change, starts, np.diff(shift, prepend=0))  # parts of no bytes begin where the next one does
    return np.cumsum(change[:size])


def token_counts(texts: Texts) -> np.ndarray:
    """Words of each text, and one more where white space ends it."""
    last = np.where(texts.counts > 0, texts.ends[np.maximum(texts.first[1:] - 1, 0)] if len(texts.ends) else 0, texts.offsets[:-1])
    return texts.counts + (last < texts.offsets[1:])


def cut_bytes(texts: Texts, units: np.ndarray) -> np.ndarray:
    """Where the first ``units`` tokens of each text end, in the joined bytes."""
    inside = (units > 0) & (units <= texts.counts)
    ends = texts.ends[np.where(inside, texts.first[:-1] + units - 1, 0)] if len(texts.ends) else texts.offsets[:-1]
    return np.where(units == 0, texts.offsets[:-1], np.where(inside, ends, texts.offsets[1:]))


def layout(form: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(where each part begins in its text's output, where each mark does, the output's length);
    ``sizes`` are the parts' bytes (texts x 3)."""
    begins, marks = np.zeros_like(sizes), np.zeros_like(sizes)
    begins[:, 1], begins[:, 2] = sizes[:, 0], sizes[:, 0] + sizes[:, 1]
    for code, order in ORDER.items():
        mine, at = form == code, np.zeros(int((form == code).sum()), np.int64)
        for part, mark in order:
            marks[mine, mark] = at
            begins[mine, part] = at + WIDTH
            at = at + WIDTH + sizes[mine, part]
    return begins, marks, sizes.sum(axis=1) + np.where(form > 0, WIDTH * len(MARKS), 0)


def strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Slices of bytes as a string column."""
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data))


def arranged(texts: Texts, form: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The outputs of a slice: every byte moved by its shift, marks between the parts."""
    offsets = texts.offsets
    edges = np.concatenate([offsets[:-1, None], cuts, offsets[1:, None]], axis=1)
    begins, marks, length = layout(form, np.diff(edges, axis=1))
    out_offsets = np.concatenate([[0], np.cumsum(length)])
    move = out_offsets[:-1, None] + begins - edges[:, :3]
    out = np.zeros(out_offsets[-1], np.uint8)
    out[np.arange(len(texts.data)) + shifts(len(texts.data), edges[:, :3].reshape(-1), move.reshape(-1))] = texts.data
    formed = np.flatnonzero(form > 0)
    for m, mark in enumerate(MARKS):
        at = out_offsets[formed] + marks[formed, m]
        for i, byte in enumerate(mark.encode()):
            out[at + i] = byte
    return strings(out, out_offsets)


def restored(data: np.ndarray, offsets: np.ndarray, form: np.ndarray) -> pa.Array:
    """The texts of a slice of outputs, from their bytes and forms."""
    marks = mark_places(data)
    owner = owners(marks, offsets)
    marks = marks[(form[owner] > 0) & (marks + WIDTH <= offsets[owner + 1])].reshape(-1, 3)
    n = len(form)
    begins = np.repeat(offsets[:-1, None], 3, axis=1)  # of prefix, middle, suffix in the output
    sizes = np.zeros((n, 3), np.int64)
    sizes[:, 0] = np.diff(offsets)
    begins[:, 1:] = offsets[1:, None]
    for code, order in ORDER.items():
        mine = np.flatnonzero(form == code)
        at = marks[np.searchsorted(np.flatnonzero(form > 0), mine)]
        ends = np.concatenate([at[:, 1:], offsets[mine + 1, None]], axis=1)
        for place, (part, _) in enumerate(order):
            begins[mine, part], sizes[mine, part] = at[:, place] + WIDTH, ends[:, place] - at[:, place] - WIDTH
    starts = np.concatenate([[0], np.cumsum(sizes.reshape(-1))])  # of every part in the restored bytes
    gather = np.arange(starts[-1]) + shifts(starts[-1], starts[:-1], (begins.reshape(-1) - starts[:-1]))
    return strings(data[gather], starts[::3])


def _transform(rate: int, spm: int):
    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = [batch.column(f"h{i}").to_numpy() for i in (1, 2, 3, 4)]
            for at, texts in slices(batch.column("text")):
                n, rows = token_counts(texts), slice(at, at + len(texts))
                units = np.sort(np.stack([h[0][rows] % (n + 1), h[1][rows] % (n + 1)], axis=1), axis=1)
                marks, size = mark_places(texts.data), np.diff(texts.offsets)
                held = owners(marks, texts.offsets)
                held = held[marks + WIDTH <= texts.offsets[held + 1]]
                plain = (size == 0) | (h[2][rows] % 100 >= rate)
                plain[held] = True
                form = np.where(plain, 0, np.where(h[3][rows] % 100 < spm, 2, 1))
                cuts = np.stack([cut_bytes(texts, units[:, i]) for i in (0, 1)], axis=1)
                out = arranged(texts, form, np.where(plain[:, None], texts.offsets[1:, None], cuts))
                points = np.concatenate([[0], np.cumsum((texts.data & 0xC0) != 0x80)])  # code points begin
                prefix = points[cuts[:, 0]] - points[texts.offsets[:-1]]
                middle = points[cuts[:, 1]] - points[cuts[:, 0]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(at, len(texts)), pa.array(n.astype(np.int64)), pa.array(np.array(FORMS, object)[form], pa.string()),
                     pa.array(prefix, pa.int64(), mask=plain), pa.array(middle, pa.int64(), mask=plain), out],
                    names=["id", "n", "form", "prefix_chars", "middle_chars", "output"])
    return transform


def _restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        form = batch.column("form").to_numpy(zero_copy_only=False)
        code = np.select([form == f for f in FORMS[1:]], [1, 2], 0)
        for at, texts in slices(batch.column("output")):
            text = restored(texts.data, texts.offsets, code[at:at + len(texts)])
            yield pa.RecordBatch.from_arrays([*(c.slice(at, len(texts)) for c in batch.columns), text], names=[*batch.schema.names, "restored"])


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output), one row for each input row.

    Of a hundred texts about ``rate`` are cut, and of a hundred of those about
    ``spm`` have the suffix first; ``form`` is plain, psm or spm.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"), *numbers(id_col, seed))
    out = rows.mapInArrow(_transform(rate, spm), f"id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")
    return out.withColumnRenamed("id", id_col)


def restore(formed: DataFrame) -> DataFrame:
    """``fill_in_middle``'s rows with ``restored``, the text rebuilt from ``output`` and ``form`` alone."""
    bounded_batches(formed.sparkSession)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in formed.schema.fields)
    return formed.mapInArrow(_restore, f"{schema}, restored string")
