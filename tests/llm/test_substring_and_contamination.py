"""Substring dedup and decontamination against brute force over all windows."""

import hashlib
import random
import re
from collections import Counter

import pytest

from textlake.llm.decontaminate import decontaminate, drop_contaminated
from textlake.llm.substring_dedup import substring_dedup

SCHEMA = "doc_id long, text string, th string, first int, anchor string, n_words string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y", "z") for i, t in rows], SCHEMA)


def repeats(rows, size):
    """Words that stay, by the definition: every window counted as text."""
    count = Counter()
    words = [(t or "").encode().split() for _, t in rows]
    for w in words:
        count.update(b" ".join(w[i:i + size]) for i in range(len(w) - size + 1))
    out = []
    for (doc_id, _), w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - size + 1):
            if count[b" ".join(w[i:i + size])] > 1:
                gone.update(range(i, i + size))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed, n=40, vocabulary=60):
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(vocabulary)}"
    shared = [[word() for _ in range(r.randrange(8, 30))] for _ in range(4)]
    rows = []
    for i in range(n):
        w = [word() for _ in range(r.randrange(0, 40))]
        for _ in range(r.randrange(3)):
            at = r.randrange(len(w) + 1)
            w[at:at] = r.choice(shared)
        rows.append((i, r.choice([" ", "\n", "\t "]).join(w)))
    rows += [(n, None), (n + 1, ""), (n + 2, " \n"), (3, rows[3][1]), (None, rows[4][1]), (None, rows[5][1]),
             (n + 3, "same " * 60), (n + 4, " ".join(f"u{i}" for i in range(30_000)) + " " + rows[6][1])]
    return rows


@pytest.mark.parametrize(("seed", "size", "gram", "bits"), [(1, 12, 4, 64), (2, 9, 3, 1 << 22), (3, 35, 8, 1 << 10)])
def test_substring_dedup(spark, seed, size, gram, bits):
    rows = corpus(seed)
    got = substring_dedup(frame(spark, rows), min_words=size, gram=gram, bits=bits).collect()
    assert sorted((tuple(r)[:4] for r in got), key=repr) == repeats(rows, size)
    for r in got:
        assert hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256
        assert sum(s["to"] - s["from"] for s in r.spans) == r.n_removed


def test_substring_dedup_of_nothing(spark):
    assert substring_dedup(frame(spark, [])).count() == 0


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def contamination(rows, items, size=13):
    wins = {}
    for item, t in items:
        w = words_of(t)
        for i in range(max(len(w) - size, 0) + 1 if w else 0):
            if item is not None:
                wins.setdefault(tuple(w[i:i + size]), set()).add(str(item))
    sizes = {len(k) for k in wins}
    out = []
    for doc_id, t in rows:
        w, hit, found = words_of(t), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in wins:
                    hit.update(range(i, i + n))
                    found |= wins[tuple(w[i:i + n])]
        out.append((doc_id, len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("seed", "bits"), [(1, 64), (2, 1 << 22)])
def test_decontaminate(spark, seed, bits):
    r = random.Random(seed)
    items = [(i, " ".join(f"W{r.randrange(40)}" for _ in range(r.choice([0, 1, 3, 12, 13, 14, 30])))) for i in range(25)]
    items += [(25, None), (None, "w1 w2 w3 w4"), (1, items[2][1]), (26, items[3][1]), (27, "...")]
    rows = []
    for i in range(60):
        w = [f"w{r.randrange(60)}" for _ in range(r.randrange(60))]
        if i % 2:
            part = words_of(r.choice(items)[1])
            at = r.randrange(len(w) + 1)
            w[at:at] = part[r.randrange(4):]
        rows.append((i, r.choice([" ", "-", "\n* "]).join(w)))
    rows += [(60, None), (61, ""), (62, "?!"), (3, rows[3][1]), (None, rows[5][1]), (None, rows[7][1]), (63, "É " * 100)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate(frame(spark, rows), bench, bits=bits)
    got = [(x.doc_id, x.n_words, x.n_hit, x["items"], x.contaminated) for x in found.collect()]
    want = contamination(rows, items)
    assert sorted(got, key=repr) == want and any(x[4] for x in want) and not all(x[4] for x in want)
    kept = drop_contaminated(frame(spark, rows), found)
    assert kept.columns == frame(spark, rows).columns and kept.count() == sum(not x[4] for x in want)


@pytest.mark.parametrize(("docs", "items"), [([], [(1, "a b")]), ([(1, "a b")], []), ([], [])])
def test_decontaminate_empty_tables(spark, docs, items):
    found = decontaminate(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert [(r.doc_id, r.n_hit, r.contaminated) for r in found] == [(i, 0, False) for i, _ in docs]
