"""Exact dedup and source mixing against brute force."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from textlake.llm.exact_dedup import exact_dedup
from textlake.llm.mix_sources import draw, hypergeometric, mix, mix_sources, shards_for, splitting_tree

DOCS = "doc_id long, text string, source string, id int, h string, sha string, salt int, size int"
ROWS = [(1, "a b", "x"), (2, "a b", "x"), (3, "", None), (4, None, None), (5, "a  b", "y"), (5, "a  b", "y"),
        (None, "a b", "x"), (None, "only", "é"), (None, "only", "é"), (7, "long " * 50_000, "z")]


def frame(spark, rows=ROWS):
    """Rows with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, 0, "h", "s", 1, 2) for r in rows], DOCS)


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(spark, keep, weak):
    # a weak hash puts different texts into one group; comparing the bytes tells them apart
    kind = {"hash_of": lambda t: F.unhex(F.md5(F.substring(t, 1, 1)))} if weak else {}
    got = exact_dedup(frame(spark), keep=keep, salts=4, **kind).collect()
    groups = defaultdict(list)
    for i, t, _ in ROWS:
        groups[t or ""].append(i)
    want = []
    for i, t, _ in ROWS:
        ids = [x for x in groups[t or ""] if x is not None]
        k = (min if keep == "smallest" else max)(ids) if ids else None
        want.append((i, k, len(groups[t or ""]), i == k, hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_exact_dedup_of_nothing(spark):
    assert exact_dedup(frame(spark, [])).count() == 0


def test_hypergeometric_is_exact(spark):
    """Quantiles over a fine grid of u reproduce the probabilities of small cases."""
    from math import comb
    for pool, marked, draws in ((10, 4, 5), (7, 7, 3), (9, 0, 4), (6, 2, 6), (40, 1, 3)):
        grid = spark.range(4000).select(hypergeometric(
            F.lit(pool).cast("long"), F.lit(marked).cast("long"), F.lit(draws).cast("long"), (F.col("id") + 0.5) / 4000).alias("k"))
        share = {r.k: r["count"] / 4000 for r in grid.groupBy("k").count().collect()}
        for k in range(draws + 1):
            p = comb(marked, k) * comb(pool - marked, draws - k) / comb(pool, draws) if draws >= k and pool - marked >= draws - k else 0
            assert abs(share.get(k, 0) - p) < 1 / 2000


def test_splitting_tree_keeps_quotas(spark):
    quotas = {0: 1000, 1: 3, 2: 0, 3: 77}
    rows = splitting_tree(spark.createDataFrame(list(quotas.items()), "rank int, blocks long"), 8, 3).collect()
    by_source, by_shard = defaultdict(int), defaultdict(int)
    for r in rows:
        assert r.blocks >= 0
        by_source[r["rank"]] += r.blocks
        by_shard[r.shard] += r.blocks
    assert by_source == quotas and len(by_shard) == 8 and max(by_shard.values()) - min(by_shard.values()) <= 3


def expected_targets(sizes, share=1.5, cap=2.0):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    above, total = set(), share * sum(sizes.values())
    while True:
        left, over = total - sum(cap * sizes[s] for s in above), sum(weight[s] for s in order if s not in above)
        target = {s: cap * sizes[s] if s in above else weight[s] * left / over for s in order}
        new = {s for s in order if target[s] > cap * sizes[s]}
        if not new:
            return target
        above |= new


def mix_rows():
    rows = [(i, "w " * (1 + i * 37 % 400), ["a", "b", "é", "z", None][i % 5 if i % 3 else 0]) for i in range(300)]
    return rows + [(5, rows[5][1], rows[5][2]), (None, "w w", "a"), (9999, None, "b"), (9998, "", "empty")]


def test_mix_sources(spark):
    rows = mix_rows()
    plan = mix_sources(frame(spark, rows), n_shards=8, block_words=16, keep=("text",)).collect()
    assert len(plan) == len(rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    target = expected_targets(sizes)
    runs, pieces = defaultdict(list), defaultdict(int)
    for r in plan:
        assert r.size == len((r.text or "").split()) and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(target[r.source]) and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
        for p in r.pieces:
            assert 0 <= p["from"] < p["to"] <= r.size
            pieces[p["shard"]] += p["to"] - p["from"]
        for turn in (0, 1):  # no word is offered twice in one pass
            spans = sorted((p["from"], p["to"]) for p in r.pieces if p["pass"] == turn)
            assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 0.5
    assert len(pieces) == 8 and max(pieces.values()) - min(pieces.values()) < 16 * 8
    again = mix_sources(frame(spark, rows[::-1]).repartition(5), n_shards=8, block_words=16)
    assert sorted((r.doc_id or -1, r.size, r.taken) for r in again.collect()) == sorted((r.doc_id or -1, r.size, r.taken) for r in plan)


def test_draw_gives_the_planned_words(spark):
    rows = [(i, " ".join(f"d{i}w{j}" for j in range(5 + i % 90)), "ab"[i % 2]) for i in range(60)]
    plan = mix_sources(frame(spark, rows), n_shards=4, block_words=8, keep=("text",))
    drawn = draw(plan, n_shards=4).collect()
    words = defaultdict(int)
    for r in drawn:
        assert len(r.text.split()) == r.n_words
        for w in r.text.split():
            assert w.startswith(f"d{r.doc_id}w")
            words[w] += 1
    assert max(words.values()) <= 2 and sum(words.values()) == sum(r.taken for r in plan.collect())


@pytest.mark.parametrize("rows", [[], [(1, None, "a"), (2, "", None)]])
def test_mix_of_no_words(spark, rows):
    got = mix_sources(frame(spark, rows), n_shards=4).collect()
    assert len(got) == len(rows) and all(r.taken == 0 and r.target == 0 for r in got)


def test_mix_refuses_other_shards(spark):
    with pytest.raises(ValueError):
        mix_sources(frame(spark), n_shards=3)


def test_mix_is_plan_and_draw(spark):
    """Texts joined to planned pieces give what a plan that carries the texts gives; repeated
    rows, null texts and ids, and a column named like the row hash's."""
    rows = [(i, "\n".join(f"w{i}x{k}" for k in range(i % 37)) if i % 11 else None, f"s{i % 4}" if i % 5 else None) for i in range(120)]
    rows += [(7, rows[7][1], "s3")] * 3 + [(None, "some words of no id", "s1")]
    docs = frame(spark, rows).withColumn("pieces", F.lit("clash"))
    plain = draw(mix_sources(docs, n_shards=4, block_words=8, keep=("text",)), n_shards=4)
    got = mix(docs, n_shards=4, block_words=8)
    assert got.columns == plain.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, plain.collect()))
    assert mix(docs.limit(0)).count() == 0


def test_shards_follow_the_size():
    assert [shards_for(n, 100) for n in (0, 1, 6400, 6401, 12_800, 12_801)] == [64, 64, 64, 128, 128, 256]
