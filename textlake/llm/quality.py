"""Quality classifier: positive-unlabelled learning with a non-negative risk.

Trusted positives are rows labelled good; all other texts count as unlabelled,
whatever a label says of them.

1. *Sample.*  At most ``max_positive`` positives and ``max_unlabelled`` other
   texts, those with the least hash of their id, are read and turned into
   features (shares of characters and words, repetition, lengths); the
   features, at most 40,000 short rows by default, go to the driver.
2. *Class prior.*  A classifier of positives against unlabelled texts ranks
   both; the prior is the least ratio, over thresholds, of the shares above
   the threshold (unlabelled over positive).  Where no bad text ranks so high
   the ratio is the share of good ones among the unlabelled.
3. *Risk.*  Logistic loss with prior p: p * R+(positives) + max(0, R-(unlabelled)
   - p * R-(positives)), minimised by gradient steps; where the difference
   turns negative the step goes against it, so the model does not learn the
   positives by heart.
4. *Score.*  Every whole text is scored in one pass without a shuffle.

Defined results.  A null text counts as empty; a text without words has the
features of an empty one and is scored like any other.  Rows with a null id
are scored and never learned from.  Repeated rows are scored alike.  Without
positive labels every score is the prior of 0.5.  An empty table gives an
empty result.  Labels, language, source and id are no features.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlake.llm.common import first_rows
from textlake.llm.linear import Model, descend, sigmoid, standard
from textlake.llm.words import Texts, bounded_batches, slices

NAMES = ("words", "bytes_per_word", "long_words", "short_words", "distinct", "same_as_before", "top_word", "lines_per_word",
         "upper", "digits", "beyond_ascii", "stops", "commas", "other_marks", "bars", "marks_in_word", "capital_words", "upper_words")


MARKS = np.zeros(256, bool)
MARKS[np.frombuffer(b"!#$%&*+/<=>?@[\\]^_`{|}~\"'();:-", np.uint8)] = True


def features(texts: Texts) -> np.ndarray:
    """A row of numbers for each text; shares are of its words or bytes."""
    n = len(texts)
    words = texts.counts.astype(np.float64)
    per_word = 1 / np.maximum(words, 1)
    owner = texts.text_of_word()
    length = (texts.ends - texts.starts).astype(np.float64)
    per_byte = 1 / np.maximum(np.bincount(owner, length, n), 1)
    data, m = texts.data, len(texts.starts)

    def of_words(x):
        return np.bincount(owner, x, n) * per_word

    def counted(inside: np.ndarray) -> np.ndarray:  # how many such bytes each word has
        sums = np.concatenate([[0], np.cumsum(inside)])
        return (sums[texts.ends] - sums[texts.starts]).astype(np.float64)

    hashes = texts.word_hashes()
    packed = (owner.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24))  # sorted by text, then hash
    packed.sort()
    new = np.ones(m, bool)
    new[1:] = packed[1:] != packed[:-1]
    begin = np.flatnonzero(new)
    run, run_owner = np.diff(np.append(begin, m)), (packed[begin] >> np.uint64(40)).astype(np.int64)
    top = np.zeros(n)
    np.maximum.at(top, run_owner, run)
    distinct = np.bincount(run_owner, minlength=n)
    same = np.zeros(m)
    same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    upper, marks = (data >= 0x41) & (data <= 0x5A), MARKS[data]
    up, mark = counted(upper), counted(marks)
    lines = np.concatenate([[0], np.cumsum(data == 0x0A)])[texts.offsets]
    first_byte = data[texts.starts] if m else np.empty(0, np.uint8)
    cols = [np.log1p(words), np.log1p(of_words(length)), of_words(length > 20), of_words(length <= 1), distinct * per_word,
            of_words(same), top * per_word, np.diff(lines) * per_word]
    byte_share = lambda x: np.bincount(owner, x, n) * per_byte
    cols += [byte_share(up), byte_share(counted((data >= 0x30) & (data <= 0x39))), byte_share(counted(data >= 0x80)),
             byte_share(counted(data == 0x2E)), byte_share(counted(data == 0x2C)), byte_share(mark),
             byte_share(counted(data == 0x7C)), of_words((mark > 0) & (length > 1)),
             of_words((first_byte >= 0x41) & (first_byte <= 0x5A)), of_words((up == length) & (length > 1))]
    return np.stack(cols, axis=1)


def _emit_features(names: tuple[str, ...]):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in slices(batch.column("text")):
                x = features(texts)
                rows = pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), x.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(start, len(texts)) for c in names), rows.cast(pa.list_(pa.float64()))], names=[*names, "x"])
    return emit


def smallest_hashes(ids: DataFrame, id_col: str, n: int, seed: int) -> DataFrame:
    """(id) of the at most ``n`` rows whose id has the least hash: a sample that
    depends on ids only.  Ids whose hash is surely too large are dropped before
    the rest is sorted (``first_rows``)."""
    rows = ids.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id")).distinct()
    hashed = F.xxhash64("id", F.lit(seed))
    return first_rows(rows, [hashed, F.col("id")], (hashed.cast("double") + F.lit(2.0**63)) / F.lit(2.0**64), n)


def sampled_features(docs: DataFrame, positives: DataFrame, unlabelled: DataFrame, id_col: str, text_col: str, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Features of both samples; of rows that share an id, one is read."""
    wanted = (positives.select("id", F.lit(True).alias("positive"))
              .unionByName(unlabelled.select("id", F.lit(False).alias("positive"))))
    rows = (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
            .join(F.broadcast(wanted), on="id")  # at most ``most`` ids
            .dropDuplicates(["id", "positive"]).select("positive", "text")
            .mapInArrow(_emit_features(("positive",)), "positive boolean, x array<double>").limit(most).toArrow())
    x = rows.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))
    order = np.lexsort(x.T)  # the fit doesn't depend on the order in which rows arrive
    positive = rows.column("positive").to_numpy()[order].astype(bool)
    return x[order][positive], x[order][~positive]


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, l2: float = 1e-4) -> float:
    """Share of positives among the unlabelled, by mixture proportion: each half is
    ranked by a classifier of positives against unlabelled fitted on the other."""
    scores = [[], []]
    for side in (0, 1):
        fit = [x[side::2] for x in (positive, unlabelled)]
        base = standard(np.concatenate(fit))
        a, b = (base.design(x) for x in fit)
        w = descend(lambda w, a=a, b=b: a.T @ (sigmoid(a @ w) - 1) / len(a) + b.T @ sigmoid(b @ w) / len(b) + l2 * w, a.shape[1], 300)
        for x, out in zip((positive, unlabelled), scores, strict=True):
            out.append(base.design(x[1 - side::2]) @ w)
    p, u = (np.sort(np.concatenate(x)) for x in scores)
    at = np.quantile(p, np.linspace(0, 0.5, 51))
    above_p, above_u = (1 - np.searchsorted(x, at) / len(x) for x in (p, u))
    return float(np.clip((above_u / above_p).min(), 0.02, 0.98))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None, l2: float = 1e-3) -> Model:
    """Minimise the non-negative unbiased risk; ``prior`` is estimated unless given."""
    base = standard(np.concatenate([positive, unlabelled]))
    if len(positive) < 4 or len(unlabelled) < 4:
        return base
    prior = class_prior(positive, unlabelled) if prior is None else prior
    a, b = base.design(positive), base.design(unlabelled)

    def gradient(w):
        p, u = sigmoid(a @ w), sigmoid(b @ w)
        negative = np.mean(-np.log1p(-np.minimum(u, 1 - 1e-12))) - prior * np.mean(-np.log1p(-np.minimum(p, 1 - 1e-12)))
        down = b.T @ u / len(b) - prior * (a.T @ p) / len(a)
        return (prior * (a.T @ (p - 1)) / len(a) + down if negative >= 0 else -down) + l2 * w

    return Model(base.mean, base.scale, descend(gradient, a.shape[1]))


def learn(docs: DataFrame, positives: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          unlabelled: Column | None = None, max_positive: int = 20_000, max_unlabelled: int = 20_000, seed: int = 11) -> Model:
    """A model from ``positives`` (their ids) and unlabelled rows of ``docs``; the
    condition ``unlabelled`` says which rows may be learned from."""
    bounded_batches(docs.sparkSession)
    pool = docs if unlabelled is None else docs.where(unlabelled)
    some = smallest_hashes(positives, id_col, max_positive, seed)
    rest = smallest_hashes(pool, id_col, max_unlabelled, seed + 1)
    return fit(*sampled_features(docs, some, rest, id_col, text_col, max_positive + max_unlabelled))


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score", drop_text: bool = False) -> DataFrame:
    """``docs`` with the column ``out``: how likely the text is a good one, 0 to 1.
    ``out`` takes the place of a column of that name; ``drop_text`` leaves the text out."""
    bounded_batches(docs.sparkSession)
    names = [c for c in docs.columns if c != out and not (drop_text and c == text_col)]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [model.score(features(texts)) for _, texts in slices(batch.column(text_col))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(np.concatenate([np.empty(0), *got]))],
                                             names=[*names, out])

    schema = docs.select(*[F.col(c) for c in names]).withColumn(out, F.lit(0.0)).schema
    return docs.mapInArrow(emit, schema)
