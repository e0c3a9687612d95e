"""Near-dedup and line dedup against brute force; connected components."""

import os
import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textlake.llm import common, line_dedup, near_dedup
from textlake.llm.common import connected_components, relabelled
from textlake.llm.line_dedup import BITS, BLOCK, BLOCKS, bucket_pairs, dedup_lines, keep_lines, key_masks, line_hashes, line_keys
from textlake.llm.near_dedup import agreeing, agreeing_folded, keep_one, near_duplicates, needed, packed, regions, shingles, signatures
from textlake.llm.words import slices

SCHEMA = "doc_id long, text string, node string, band int, component string, line int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "n", 1, "c", 2) for i, t in rows], SCHEMA)


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


def test_connected_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(140)] + [(i, i + 1) for i in range(1000, 1060)]
    edges += [(5000, x) for x in range(5001, 5200)] + [(7, 7), (-3, 7)]
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = roots({x for e in edges for x in e}, edges)
    assert {n: c for n, c in want.items() if n in got} == got
    assert set(want) - set(got) <= {a for a, b in edges if a == b}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def shingle_bag(t):
    w = (t or "").encode().split()
    return Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def alike(a, b):
    return sum((a & b).values()) >= 0.8 * sum((a | b).values())


def near_rows(seed):
    r = random.Random(seed)
    rows = []
    for _ in range(25):
        base = [f"w{r.randrange(500)}" for _ in range(r.choice([3, 6, 40, 90, 200]))]
        for _ in range(r.choice([1, 1, 2, 6])):
            w = list(base)
            for _ in range(r.randrange(4)):
                w[r.randrange(len(w))] = f"x{r.randrange(500)}"
            rows.append((len(rows), " ".join(w)))
    # a ball of copies: each near the first, few near each other
    base = [f"b{r.randrange(500)}" for _ in range(120)]
    for i in range(40):
        w = list(base)
        for _ in range(i % 7):
            w[r.randrange(120)] = f"y{r.randrange(500)}"
        rows.append((len(rows), " ".join(w)))
    r.shuffle(rows)
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    n = len(rows)
    return rows + [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "one"), (n + 4, "one"), (n + 5, "one two three four"),
                   (n + 6, "same " * 3000), (n + 7, "same " * 3000 + "end"), (None, rows[0][1]), (None, "alone here")]


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates(spark, seed):
    rows = near_rows(seed)
    bags = [shingle_bag(t) for _, t in rows]
    index = defaultdict(list)
    for i, b in enumerate(bags):
        for s in b:
            index[s].append(i)
    pairs = {p for ids in index.values() for p in combinations(ids, 2)}
    links = [(a, b) for a, b in pairs if alike(bags[a], bags[b])]
    empty = [i for i, b in enumerate(bags) if not b]
    group = roots(range(len(rows)), links + [(empty[0], x) for x in empty])
    members = defaultdict(list)
    for i, g in group.items():
        members[g].append(rows[i][0])
    want = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [x for x in members[group[i]] if x is not None]
        lead = min(ids) if ids else None
        want.append((doc_id, lead, len(members[group[i]]), doc_id == lead))
    docs = frame(spark, rows)
    got = near_duplicates(docs, salts=4)
    assert sorted(((r.doc_id, r.class_id, r.class_size, r.kept) for r in got.collect()), key=repr) == sorted(want, key=repr)
    kept = keep_one(docs, got)
    assert kept.columns == docs.columns and kept.count() == len(members)


def test_near_duplicates_repeated_rows_and_nothing(spark):
    docs = frame(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "q"), (None, "q")])
    got = near_duplicates(docs)
    assert sorted((r.doc_id or 0, r.class_id or 0, r.class_size, r.kept) for r in got.collect()) == [
        (0, 0, 2, True), (0, 0, 2, True), (1, 1, 3, True), (1, 1, 3, True), (2, 1, 3, False)]
    assert keep_one(docs, got).count() == 2
    assert near_duplicates(frame(spark, [])).count() == 0


def test_signatures_estimate_the_weighted_similarity(spark):
    r = random.Random(3)
    base = [f"w{r.randrange(300)}" for _ in range(400)]
    other = base[:300] + [f"z{r.randrange(300)}" for _ in range(100)]
    k = 3600
    for _, t in slices(pa.array([" ".join(base), " ".join(other), "w1", ""])):
        row, region = regions(*shingles(t, 5))
        s = signatures(row, region, 4, k)
    a, b = shingle_bag(" ".join(base)), shingle_bag(" ".join(other))
    truth = sum((a & b).values()) / sum((a | b).values())
    assert abs((s[0] == s[1]).mean() - truth) < 0.04
    assert (s[:3] != 0).all() and (s[3] == 0).all()
    k = 100
    few = np.array(packed(s[:2, :k]).to_pylist(), dtype=np.int64)
    df = spark.createDataFrame([(few[0].tolist(), few[1].tolist())], "a array<bigint>, b array<bigint>")
    n = df.select(agreeing("a", "b", k), agreeing_folded("a", "b", k)).first()
    same = int((s[0, :k] == s[1, :k]).sum())
    assert n[0] == n[1] and same <= n[0] <= same + 5
    assert needed(144, 0.8) < 0.8 * 144 and needed(4, 0.1) == 0


def norm(line):
    return re.sub(r"[\x00-`{-\x7f]+", " ", line.lower()).strip(" ")


def edits(x, y):
    d = list(range(len(y) + 1))
    for i, c in enumerate(x, 1):
        p, d[0] = d[0], i
        for j, e in enumerate(y, 1):
            p, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, p + (c != e))
    return d[-1]


def line_rows(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 6)))
    lines = [" ".join(word() for _ in range(r.choice([1, 2, 5, 60, 150]))) for _ in range(40)]
    rows = []
    for i in range(60):
        own = []
        for _ in range(r.randrange(6)):
            w = r.choice(lines).split()
            if len(w) > 50:
                for _ in range(r.randrange(3)):
                    w[r.randrange(len(w))] = word()
            own.append(r.choice(["", "12 ", "* "]) + r.choice([str.upper, str.title, str])(" ".join(w)) + r.choice(["", ".", " 2024"]))
        rows.append((i, "\n".join(own)))
    return rows + [(60, None), (61, ""), (62, "\n\n"), (3, rows[3][1]), (None, rows[4][1]), (63, "1 2 3\n" + "zz yy xx " * 5000)]


@pytest.mark.parametrize("seed", [1, 2])
def test_dedup_lines(spark, seed):
    rows = line_rows(seed)
    docs = frame(spark, rows)
    marked = dedup_lines(docs)
    got = marked.collect()
    low = -(1 << 63)
    text = {(low if i is None else i, t): (t or "").split("\n") for i, t in rows}
    lines = {(i, n): norm(line) for (i, _), parts in text.items() for n, line in enumerate(parts)}
    assert sorted((r.id, r.line) for r in got) == sorted(lines)
    of_class, kept = defaultdict(set), Counter()
    for r in got:
        n = lines[r.id, r.line]
        if len(n.split()) < 3:
            assert r.kept and (r.class_id, r.class_line) == (r.id, r.line)
            continue
        of_class[r.class_id, r.class_line].add(n)
        kept[r.class_id, r.class_line] += r.kept
        assert r.kept == ((r.id, r.line) == (r.class_id, r.class_line))
    assert set(kept.values()) == {1}
    where = defaultdict(set)
    for c, ns in of_class.items():
        for n in ns:
            where[n].add(c)
    assert all(len(c) == 1 for c in where.values())  # equal lines are one class
    fuzzy = 0
    for ns in of_class.values():  # every line of a class is similar to another of it
        for a in ns:
            if len(ns) > 1:
                fuzzy += 1
                A = a.split(" ")
                assert any(edits(A, b.split(" ")) <= 0.2 * max(len(A), len(b.split(" "))) for b in ns - {a})
    assert fuzzy
    first = {c: min(k for k, n in lines.items() if n in ns) for c, ns in of_class.items()}
    assert all(c == k for c, k in first.items())
    gone = {(r.id, r.line) for r in got if not r.kept}
    out = keep_lines(docs, marked).collect()
    want = [(i, None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (low if i is None else i, n) not in gone))
            for i, t in rows]
    assert sorted(((r.doc_id, r.text) for r in out), key=repr) == sorted(want, key=repr)


def test_simhash_is_the_sign_of_the_words_bits(spark):
    """Against the words' hashes, counted bit by bit; equal lines have equal bits."""
    r = random.Random(3)
    rows = [(i, " ".join("".join(r.choices("abcd", k=2)) for _ in range(n))) for i, n in enumerate([1, 2, 3, 7, 50, 51, 4000, 4])]
    rows.append((8, rows[4][1].upper() + "!"))
    got = {x.id: x for x in line_hashes(frame(spark, rows), "doc_id", "text").collect()}
    words = sorted({w for _, t in rows for w in norm(t).split()})
    hashes = {x.w: (x.a, x.b) for x in spark.createDataFrame([(w,) for w in words], "w string").selectExpr(
        "w", "xxhash64(2, w) AS a", "xxhash64(3, w) AS b").collect()}
    for i, t in rows:
        ws = norm(t).split()
        for k in (0, 1):
            want = sum(1 << j for j in range(BITS // 2) if 2 * sum(hashes[w][k] >> j & 1 for w in ws) > len(ws))
            assert got[i][f"sim{k}"] == want, (i, k)
    assert (got[8].sim0, got[8].sim1, got[8].h1) == (got[4].sim0, got[4].sim1, got[4].h1)


def test_keys_are_blocks_of_the_bits(spark):
    masks = key_masks(30)
    assert all(bin(a).count("1") + bin(b).count("1") == BLOCK * BLOCKS for a, b in masks) and len(set(masks)) == 30
    rows = [(i, " ".join(f"{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(n))) for i, n in enumerate([5, 19, 20, 49, 50, 500])]
    lines = line_hashes(frame(spark, rows), "doc_id", "text")
    keys = {x.id: x.k for x in lines.select("id", line_keys().alias("k")).collect()}
    assert [len(keys[i]) for i, _ in rows] == [84, 84, 48, 48, 24, 24]
    parts = [{x.id: x.k for x in lines.select("id", line_keys(at, at + 21).alias("k")).collect()} for at in range(0, 84, 21)]
    assert all(sum((p[i] for p in parts), []) == keys[i] for i, _ in rows)  # some at a time are all


def test_small_buckets_lose_no_pair(spark):
    """All pairs of buckets of two and three come out; of fuller ones the members."""
    r = random.Random(5)
    bases = [[f"{chr(97 + g)}{chr(97 + i)}" for i in range(30)] for g in range(12)]
    rows = []
    for g, base in enumerate(bases):
        for _ in range(1 + g % 6):
            w = list(base)
            w[r.randrange(1, 29)] = "".join(r.choices("uvwxyz", k=4))
            rows.append((len(rows), " ".join(w)))
    info = line_hashes(frame(spark, rows), "doc_id", "text").withColumnRenamed("h1", "node")
    of_key = defaultdict(set)
    for x in info.select("node", line_keys().alias("k")).collect():
        for key in x.k:
            of_key[key].add(x.node)
    few, full = bucket_pairs(info)
    got = {tuple(sorted((p.u, p.v))) for p in few.collect()}
    assert got == {p for ns in of_key.values() if len(ns) <= 3 for p in combinations(sorted(ns), 2)}
    assert {(x.key, x.node, x["size"]) for x in full.collect()} == {(k, n, len(ns)) for k, ns in of_key.items() if len(ns) > 3 for n in ns}


def test_dedup_lines_of_nothing(spark):
    docs = frame(spark, [])
    marked = dedup_lines(docs)
    assert marked.count() == 0 and keep_lines(docs, marked).count() == 0


def test_copies_and_old_links_are_not_gone_through_again(spark, monkeypatch):
    """Exact copies make no link at all; what later waves find counts once for two components."""
    r = random.Random(11)
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(base)] * 300
    for i in range(30):
        w = list(base)
        w[r.randrange(200)] = f"x{i}"
        texts.append(" ".join(w))
    seen, plain = [], near_dedup.connected_components
    monkeypatch.setattr(near_dedup, "connected_components", lambda edges, **k: (seen.append(edges.count()), plain(edges, **k))[1])
    got = near_duplicates(frame(spark, list(enumerate(texts)))).collect()
    assert {(x.class_id, x.class_size) for x in got} == {(0, 330)} and sum(x.kept for x in got) == 1
    assert 30 <= sum(seen) <= 4 * 31  # a node's links of the first wave, no copy


def test_relabelled(spark):
    groups = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (7, 5), (5, 5), (9, 8)], "node long, component long")
    merged = spark.createDataFrame([(5, 1), (1, 1), (20, 1), (31, 30), (30, 30)], "node long, component long")
    got = sorted((x.node, x.component) for x in relabelled(groups, merged, salts=3).collect())
    assert got == [(1, 1), (2, 1), (3, 1), (5, 1), (7, 1), (9, 8), (20, 1), (30, 30), (31, 30)]


def test_buckets_do_not_stay_on_disk(spark, monkeypatch):
    """The tables of full buckets go when they are dealt, and what a deal leaves are pairs that may be near."""
    saved, plain = [], line_dedup.save
    monkeypatch.setattr(line_dedup, "save", lambda df, name: (saved.append((name, plain(df, name))), saved[-1][1])[1])
    r = random.Random(6)
    rows = [(i, "begin " + " ".join("".join(r.choices("abcdefgh", k=2)) for _ in range(8 + i % 3)) + " end") for i in range(200)]
    rows += [(200 + i, rows[i % 5][1].replace("end", "x" * (1 + i // 5) + " end")) for i in range(40)]
    got = {x.id: x.class_id for x in dedup_lines(frame(spark, rows)).collect()}
    assert all(got[200 + i] == got[i % 5] for i in range(40))
    there = lambda df: os.path.exists(df.saved_at.removeprefix("file://"))
    assert not [n for n, df in saved if n in ("line-buckets", "marked-buckets") and there(df)]
    near = [df.count() for n, df in saved if n == "dealt-pairs"]
    full = sum(df.count() for n, df in saved if n == "full-buckets")
    assert near and full and max(near) < full


def there(df):
    return os.path.exists(df.saved_at.removeprefix("file://"))


def saves_of(monkeypatch, *modules):
    """(name, table) of all that ``save`` writes from here on."""
    saved = []
    for module in modules:
        plain = module.save
        monkeypatch.setattr(module, "save", lambda df, name, plain=plain: (saved.append((name, plain(df, name))), saved[-1][1])[1])
    return saved


def test_members_of_a_bucket_meet_its_hubs_of_other_components(spark):
    rows = [(1, n, c) for n, c in ((10, 10), (11, 10), (12, 12), (13, 13), (14, 10))] + [(2, n, 20) for n in (20, 21)]
    members = spark.createDataFrame(rows, "band long, node long, component long")
    orders = ["struct(node, component)", "struct(-node AS h, node, component)"]
    one, both = (near_dedup.led_pairs(members, [F.expr(o) for o in orders[:k]]).collect() for k in (1, 2))
    assert sorted((x.u, x.v, x.a, x.b) for x in one) == [(12, 10, 12, 10), (13, 10, 13, 10)]  # no pair of one component
    assert sorted((x.u, x.v) for x in both) == [(12, 10), (13, 10), (14, 12), (14, 13)]


def test_near_duplicates_leave_only_their_result(spark, monkeypatch):
    saved = saves_of(monkeypatch, near_dedup, common)
    rows = [(i, " ".join(f"w{j}" if j != i else "x" for j in range(40))) for i in range(30)]
    out = near_duplicates(frame(spark, rows))
    assert {n for n, df in saved if there(df)} == {"classes"}
    assert out.count() == 30


def test_lines_leave_only_their_result(spark, monkeypatch):
    saved = saves_of(monkeypatch, line_dedup, common)
    rows = line_rows(1)
    out = dedup_lines(frame(spark, rows))
    assert {n for n, df in saved if there(df)} == {"lines", "line-classes", "line-occurrences", "line-firsts"}
    assert out.count() >= len(rows) - 1


def test_links_of_the_first_keys_suffice_for_a_large_group(spark, monkeypatch, n=300):
    """Lines of one group are linked by a few keys; the others only make links between components."""
    r = random.Random(2)
    base = ["".join(r.choices("abcdefgh", k=4)) for _ in range(60)]
    rows = []
    for i in range(n):
        w = list(base)
        for at in r.sample(range(1, 59), 2):
            w[at] = "".join(r.choices("stuvwxyz", k=4))
        rows.append((i, " ".join(w)))
    seen, plain = [], line_dedup.connected_components
    monkeypatch.setattr(line_dedup, "connected_components", lambda edges, **k: (seen.append(edges.count()), plain(edges, **k))[1])
    assert {x.class_id for x in dedup_lines(frame(spark, rows)).collect()} == {0}
    assert sum(seen) <= 6 * n


def test_small_buckets_are_gone_through_once(spark, monkeypatch):
    """After the first keys, lines that happen to share a key are neither dealt nor carried on."""
    r = random.Random(6)
    rows = [(i, "begin " + " ".join("".join(r.choices("abcdefgh", k=2)) for _ in range(8 + i % 3)) + " end") for i in range(200)]
    rows += [(200 + i, rows[i % 5][1].replace("end", "x" * (1 + i // 5) + " end")) for i in range(40)]
    sizes, plain = [], line_dedup.dealt_pairs
    monkeypatch.setattr(line_dedup, "dealt_pairs", lambda inside, *a: (sizes.append(sorted(x["size"] for x in inside.collect())), plain(inside, *a))[1])
    got = {x.id: x.class_id for x in dedup_lines(frame(spark, rows)).collect()}
    assert all(got[200 + i] == got[i % 5] for i in range(40))
    assert sizes[0] and all(n > 256 for later in sizes[1:] for n in later)


def test_lines_of_different_components_meet(spark):
    marks = "n long, p0 long, p1 long, p2 long, p3 long"
    info = spark.createDataFrame([(n, 10, 0, 0, 0, 0) for n in (1, 2, 3, 4)] + [(5, 30, 0, 0, 0, 0), (6, 10, -1, 0, 0, 0)], f"node long, {marks}")
    inside = spark.createDataFrame([(7, 1, 1), (7, 2, 1), (7, 3, 3), (7, 5, 5), (7, 6, 6), (8, 4, 4), (8, 3, 3), (9, 3, 3), (9, 1, 1)],
                                   "key long, node long, component long")
    got = sorted(tuple(x) for x in line_dedup.crossed_pairs(inside, info, 0.8).select("u", "v", "a", "b").collect())
    assert got == [(1, 3, 1, 3), (2, 3, 1, 3), (3, 4, 3, 4)]
