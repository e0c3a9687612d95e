"""Toxicity: a lexicon trie met by Levenshtein automata, judged in context.

1. *Lexicon.*  From a bounded sample of labelled rows the terms that toxic
   texts use far more often than clean ones are counted on the cluster; of
   near copies in the sample one counts.  Every term that passes a fixed test of
   significance goes in, so the sample alone bounds their number.
2. *Automaton.*  The terms form a trie.  The Levenshtein automaton of one
   edit (terms of five letters and more) is intersected with it by subset
   construction: one table that takes a word letter by letter and tells at
   its end the term it is, or the term one edit away.  Its size depends on
   the lexicon alone; tasks run all words of a slice through it at once.
3. *Context.*  A hit inside a pair of quotation marks (paired along its line)
   that stand within six words on either side, or one of them if a reporting verb
   goes before, counts as quoted and not as abuse; hits that stand close together
   count more.  These sums, weighed by a logistic
   model fitted on the sample, give the score.
4. Every whole text is scored in one pass without a shuffle.

Defined results.  A null text counts as empty; a text without words has no
hits and gets the score of one.  Rows with a null id are scored and never
learned from.  Repeated rows are scored alike.  Without labels of both kinds
there is no lexicon and every score is 0.5 (no labels) or the sample's only
label's side.  An empty table gives an empty result.  Labels, language,
source and id are no features.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlake.llm.common import save
from textlake.llm.linear import Model, descend, sigmoid, standard
from textlake.llm.quality import smallest_hashes
from textlake.llm.words import FOLDED, Texts, bounded_batches, lists, range_hash, slices, windows

#: Verbs that report what others said (fixed values).
REPORTING = ("said", "says", "wrote", "writes", "quoted", "quote", "called", "reported", "cited")
CONTEXT = 6  # words on either side in which quotation marks are looked for
CLOSE = 20  # words between hits that stand close together


def folded(column: pa.Array):
    """Slices of a text column for this operator: in lower case, whatever the script,
    and quotation marks as the plain one, so that they part words like other marks do."""
    column = pc.utf8_lower(column)
    for sign in "“”„«»":
        column = pc.replace_substring(column, sign, '"')
    return slices(column, FOLDED, fold=True)


# --- letters ---------------------------------------------------------------

def letters(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the slice's letters, and each word's range of them."""
    data = texts.data
    head = (data & 0xC0) != 0x80
    at = np.flatnonzero(head)
    b = np.concatenate([data, np.zeros(4, np.uint8)]).astype(np.int32)
    lead, b1, b2, b3 = b[at], b[at + 1] & 0x3F, b[at + 2] & 0x3F, b[at + 3] & 0x3F
    point = np.select([lead < 0x80, lead < 0xE0, lead < 0xF0],
                      [lead, (lead & 0x1F) << 6 | b1, (lead & 0x0F) << 12 | b1 << 6 | b2], (lead & 0x07) << 18 | b1 << 12 | b2 << 6 | b3)
    number = np.cumsum(head) - 1
    ends = np.concatenate([number, [len(at)]])
    return point, number[texts.starts], ends[texts.ends]


class Automaton:
    """All words within the allowed edits of a lexicon, as one transition table.

    ``step[state, symbol]`` leads on, state 0 is dead, 1 the start;
    ``term[state]`` is the term a word that ends there stands for (-1: none)
    and ``edits[state]`` its distance.
    """

    def __init__(self, terms: list[str], long: int = 5):
        self.points = np.array(sorted({ord(c) for t in terms for c in t}), np.int64)  # symbols 1 on; 0: a letter that no term has
        number = {int(p): i + 1 for i, p in enumerate(self.points)}
        child, end, allowed = [{}], [-1], [0]
        for i, t in enumerate(terms):
            at = 0
            budget = int(len(t) >= long)
            allowed[0] = max(allowed[0], budget)
            for c in t:
                s = number[ord(c)]
                if s not in child[at]:
                    child[at][s] = len(child)
                    child.append({})
                    end.append(-1)
                    allowed.append(0)
                at = child[at][s]
                allowed[at] = max(allowed[at], budget)
            end[at] = i
        budget_of = [int(len(t) >= long) for t in terms]

        def closed(pairs):  # a letter of the term may be missing in the word
            best = {}
            for node, e in pairs:
                if e <= allowed[node] and best.get(node, 9) > e:
                    best[node] = e
            for node, e in list(best.items()):
                if e == 0:
                    for nxt in child[node].values():
                        if allowed[nxt] >= 1:
                            best.setdefault(nxt, 1)
            return tuple(sorted(best.items()))

        def after(state, s):
            out = []
            for node, e in state:
                if s in child[node]:
                    out.append((child[node][s], e))
                if e == 0:
                    out.append((node, 1))
                    out += [(nxt, 1) for nxt in child[node].values()]
            return closed(out)

        start = closed([(0, 0)])
        numbers, todo = {(): 0, start: 1}, deque([start])
        width = len(self.points) + 1
        step = [np.zeros(width, np.int32)]
        while todo:
            state = todo.popleft()
            row = np.zeros(width, np.int32)
            loose = any(e == 0 for _, e in state)
            live = range(width) if loose else {s for node, _ in state for s in child[node]}
            other = None
            for s in live:
                if loose and not any(s in child[node] for node, _ in state):  # all such letters lead alike
                    if other is None:
                        other = after(state, -1)
                    new = other
                else:
                    new = after(state, s)
                if new not in numbers:
                    numbers[new] = len(numbers)
                    todo.append(new)
                row[s] = numbers[new]
            step.append(row)
        self.step = np.stack(step)
        self.term, self.edits = np.full(len(numbers), -1, np.int32), np.zeros(len(numbers), np.int32)
        for state, number in numbers.items():
            ends = sorted((e, end[node]) for node, e in state if end[node] >= 0 and e <= budget_of[end[node]])
            if ends:
                self.edits[number], self.term[number] = ends[0]
        self.longest = max(map(len, terms), default=0) + 1

    def symbols(self, point: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.points, point), len(self.points) - 1)
        return np.where(self.points[at] == point, at + 1, 0)

    def hits(self, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, term, edits) of the words that the automaton accepts."""
        if len(self.step) < 3 or not len(texts.starts):
            none = np.empty(0, np.int64)
            return none, none, none
        point, first, last = letters(texts)
        sym = self.symbols(point)
        length = last - first
        word = np.flatnonzero((length <= self.longest) & (length > 0))
        state = np.ones(len(word), np.int32)
        found = []
        for j in range(self.longest + 1):
            done = length[word] == j
            if done.any():
                w, s = word[done], state[done]
                ok = self.term[s] >= 0
                found.append((w[ok], self.term[s[ok]], self.edits[s[ok]]))
                word, state = word[~done], state[~done]
            if not len(word):
                break
            state = self.step[state, sym[first[word] + j]]
            alive = state > 0
            word, state = word[alive], state[alive]
        got = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.empty(0, np.int64)] * 3
        order = np.argsort(got[0], kind="stable")
        return tuple(x[order] for x in got)


# --- context and features ---------------------------------------------------

VERBS = np.concatenate([t.word_hashes() for _, t in slices(pa.array([" ".join(REPORTING)]), FOLDED, fold=True)])


def quoted(texts: Texts, word: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether a word stands inside a pair of quotation marks with both of them near,
    or with one of them and a reporting verb before."""
    if not len(word):
        return np.empty(0, bool)
    data = texts.data
    mark = np.zeros(len(data) + 1, np.int64)
    np.cumsum(data == 0x22, out=mark[1:])
    row = np.searchsorted(texts.first, word, "right") - 1
    low = np.maximum(word - CONTEXT, texts.first[row])
    high = np.minimum(word + CONTEXT, texts.first[row + 1] - 1)
    begin = np.where(low == texts.first[row], texts.offsets[row], texts.starts[low])
    finish = np.where(high == texts.first[row + 1] - 1, texts.offsets[row + 1], texts.ends[high])
    before = mark[texts.starts[word]] - mark[begin] > 0
    behind = mark[finish] - mark[texts.ends[word]] > 0
    # marks are paired along a line: a word is inside after an odd number of its line's marks
    line = np.union1d(np.flatnonzero(data == 0x0A) + 1, texts.offsets[:-1])
    inside = (mark[texts.starts[word]] - mark[line[np.searchsorted(line, texts.starts[word], "right") - 1]]) % 2 == 1
    report = np.concatenate([[0], np.cumsum(np.isin(hashes, VERBS))])
    return inside & ((before & behind) | ((report[word] - report[low] > 0) & (before | behind)))


def features(texts: Texts, automaton: Automaton, weight: np.ndarray) -> np.ndarray:
    n = len(texts)
    word, term, edits = automaton.hits(texts)
    row = np.searchsorted(texts.first, word, "right") - 1
    cite = quoted(texts, word, texts.word_hashes()) if len(word) else np.empty(0, bool)
    exact, near = (edits == 0) & ~cite, (edits > 0) & ~cite
    gap = np.full(len(word), 1 << 30)
    if len(word) > 1:
        gap[1:] = np.where(row[1:] == row[:-1], word[1:] - word[:-1], 1 << 30)
    close = (gap <= CLOSE) & ~cite
    pairs = np.unique(row[exact] * (len(weight) + 1) + term[exact]) if len(word) else np.empty(0, np.int64)
    w = weight[term] if len(word) else np.empty(0)

    def total(x):
        return np.bincount(row, x, n) if len(word) else np.zeros(n)

    strongest = np.zeros(n)
    if len(word):
        np.maximum.at(strongest, row[exact], w[exact])
    different = np.bincount(pairs // (len(weight) + 1), minlength=n) if len(pairs) else np.zeros(n)
    share = total(exact) / np.maximum(texts.counts, 1)
    cols = [np.log1p(total(exact)), np.log1p(total(near)), np.log1p(total(cite)), np.log1p(different), strongest,
            np.log1p(total(w * exact)), np.log1p(total(close)), np.sqrt(share)]
    return np.stack(cols, axis=1)


N_FEATURES = 8


# --- learning ----------------------------------------------------------------

@dataclass(frozen=True)
class Toxicity:
    terms: list[str]
    weight: np.ndarray
    automaton: Automaton
    model: Model


def _emit_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Different words of each text, and a hash that near copies mostly share:
    the least among its five-word runs."""
    for batch in batches:
        for start, texts in folded(batch.column("text")):
            hashes, words, counts, least = texts.word_hashes(), [], [], []
            at = windows(texts, 5)
            runs, owner = range_hash(hashes, at, at + 5), np.searchsorted(texts.first, at, "right") - 1
            for i in range(len(texts)):
                own = {texts.word(j) for j in range(texts.first[i], texts.first[i + 1])}
                words += sorted(w.decode(errors="replace") for w in own)
                counts.append(len(words) - sum(counts))
                mine = runs[owner == i]
                mine = mine if len(mine) else range_hash(hashes, texts.first[i:i + 1], texts.first[i + 1:i + 2])
                least.append(int(mine.min().view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic").slice(start, len(texts)), pa.array(least, pa.int64()),
                 lists(pa.array(words, pa.string()), np.array(counts, np.int64))], names=["toxic", "least", "words"])


#: A term's least number of toxic texts, least G-test statistic and least lift over clean texts.
LEAST_TEXTS, LEAST_G, LEAST_LIFT = 3, 15.0, 8.0


def lexicon(sample: DataFrame) -> tuple[list[str], np.ndarray]:
    """Terms and weights (log lift) from the sample's (toxic, text) rows: all terms whose
    share of toxic texts differs from that of clean ones by the G test and the lift."""
    rows = (sample.mapInArrow(_emit_terms, "toxic int, least bigint, words array<string>")
            .groupBy("least").agg(F.max("toxic").alias("toxic"), F.first("words").alias("words")))
    n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = n.get(1, 0), n.get(0, 0)
    if not bad or not good:
        return [], np.empty(0)
    counts = (rows.select("toxic", F.explode(F.array_distinct("words")).alias("term")).groupBy("term")
              .agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")))
    t, c = F.col("t"), F.col("c")
    ratio = ((t + 0.0) / bad) / ((c + 0.5) / good)
    # the four cells of texts with and without the term, toxic and clean, against what independence expects
    cell = lambda seen, row, col: F.when(seen > 0, 2 * seen * F.log(seen * (bad + good) / (row * col))).otherwise(0.0)
    with_it, without = t + c, bad + good - t - c
    g = cell(t, with_it, bad) + cell(c, with_it, good) + cell(bad - t, without, bad) + cell(good - c, without, good)
    best = counts.where((t >= LEAST_TEXTS) & (g >= LEAST_G) & (ratio >= LEAST_LIFT)).select("term", F.log(ratio).alias("w")).collect()
    best.sort(key=lambda r: r["term"])
    return [r["term"] for r in best], np.array([r["w"] for r in best])


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          max_toxic: int = 10_000, max_clean: int = 20_000, seed: int = 13, l2: float = 1e-3) -> Toxicity:
    """Learn from ``labels`` (id, label); at most ``max_toxic`` and ``max_clean``
    labelled rows, those with the least hash of their id, are read."""
    spark = docs.sparkSession
    bounded_batches(spark)
    known = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col)).agg(F.max(label_col).cast("int").alias("toxic"))
    ids = None
    for kind, most in ((1, max_toxic), (0, max_clean)):
        some = smallest_hashes(known.where(F.col("toxic") == kind), id_col, most, seed).withColumn("toxic", F.lit(kind))
        ids = some if ids is None else ids.unionByName(some)
    sample = (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
              .join(F.broadcast(ids), on="id")  # at most max_toxic + max_clean ids
              .dropDuplicates(["id"]).select("toxic", "text"))
    sample = save(sample, "toxicity-sample")
    terms, weight = lexicon(sample)
    automaton = Automaton(terms)
    emit = _emit_features(automaton, weight, ("toxic",))
    rows = sample.mapInArrow(emit, "toxic int, x array<double>").toArrow()
    x = rows.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, N_FEATURES)
    order = np.lexsort(x.T)
    x, y = x[order], rows.column("toxic").to_numpy()[order].astype(np.float64)
    base = standard(x)
    if not len(x):
        return Toxicity(terms, weight, automaton, base)
    a = base.design(x)
    w = descend(lambda w: a.T @ (sigmoid(a @ w) - y) / len(a) + l2 * w, a.shape[1])
    return Toxicity(terms, weight, automaton, Model(base.mean, base.scale, w))


def _emit_features(automaton: Automaton, weight: np.ndarray, names: tuple[str, ...]):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in folded(batch.column("text")):
                x = features(texts, automaton, weight)
                rows = pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), N_FEATURES).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(start, len(texts)) for c in names), rows], names=[*names, "x"])
    return emit


def score(docs: DataFrame, learned: Toxicity, text_col: str = "text", out: str = "score", drop_text: bool = False) -> DataFrame:
    """``docs`` with the column ``out``, the score in 0..1; see quality.score."""
    bounded_batches(docs.sparkSession)
    names = [c for c in docs.columns if c != out and not (drop_text and c == text_col)]
    automaton, weight, model = learned.automaton, learned.weight, learned.model

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [model.score(features(texts, automaton, weight)) for _, texts in folded(batch.column(text_col))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(np.concatenate([np.empty(0), *got]))],
                                             names=[*names, out])

    schema = docs.select(*[F.col(c) for c in names]).withColumn(out, F.lit(0.0)).schema
    return docs.mapInArrow(emit, schema)
