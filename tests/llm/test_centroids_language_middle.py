"""Centroid clustering, language identification and fill-in-middle against plain versions."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from textlake.llm import language
from textlake.llm.centroids import MOST, centroid_clusters, distances
from textlake.llm.common import first_rows
from textlake.llm.fill_middle import fill_in_middle, restore

# --- centroids ---------------------------------------------------------------


def plain_clusters(rows, k, rounds, dims, scale=256, seed=2):
    """rows: (id, vector); the contract, vector by vector, with Python's integers."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    kept = [(i, [max(-MOST, min(MOST, x)) for x in v]) for i, v in kept]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [v for _, v in first[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min(range(len(centroids)), key=lambda c: (far(v, centroids[c]), c))
    for _ in range(rounds):
        of = {}
        for _, v in kept:
            of.setdefault(near(v), []).append(v)
        centroids = [[sum(x) // len(of[c]) for x in zip(*of[c], strict=True)] if c in of else old for c, old in enumerate(centroids)]
    out = [(i, near(v), far(v, centroids[near(v)])) for i, v in kept]
    inertia = {}
    for _, c, d in out:
        inertia[c] = inertia.get(c, 0) + d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), sha[c]) for i, c, d in out), key=repr)


def clusters(spark, rows, **settings):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id bigint, embedding array<double>, cluster int").repartition(3)
    out, _ = centroid_clusters(df, **settings)
    return sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in out.collect()), key=repr)


def test_clusters_equal_plain(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(rng.choice((-1, 0, 2)), 0.3) for _ in range(4)]) for i in range(300)]
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, [0.0] * 4)]  # repeated and null ids
    rows += [(400, None), (401, [1.0] * 3), (402, []), (403, [1.0, None, 0.0, 0.0]), (404, [1.0, float("nan"), 0.0, 0.0]),
             (405, [float("inf"), 0.0, 0.0, 0.0]), (406, [-0.001] * 4)]
    assert clusters(spark, rows, k=9, rounds=3, dims=4) == plain_clusters(rows, 9, 3, 4)


def test_clusters_of_ties_few_and_large(spark):
    same = [(i, [0.5, -0.5]) for i in range(20)]
    got = clusters(spark, same, k=5, rounds=2, dims=2)
    assert got == plain_clusters(same, 5, 2, 2) and {r[1] for r in got} == {0}  # the smaller number wins; four stay empty
    few = [(1, [0.0, 1.0]), (2, [3.0, 4.0])]
    assert clusters(spark, few, k=5, rounds=2, dims=2) == plain_clusters(few, 5, 2, 2)
    large = [(1, [1e300, -1e300]), (2, [-3e38, 0.1]), (3, [0.0, 0.0])]
    assert clusters(spark, large, k=2, rounds=2, dims=2) == plain_clusters(large, 2, 2, 2)
    assert clusters(spark, [(1, None)], k=2, dims=2) == []
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    out, centroids = centroid_clusters(empty)
    assert out.count() == 0 and centroids.shape == (0, 64) and "centroid_sha256" in out.columns


def test_lookup_tables_give_squared_distances():
    rng = np.random.default_rng(1)
    vectors, centroids = rng.integers(-50, 50, (100, 8)), rng.integers(-50, 50, (5, 8))
    assert (distances(vectors, centroids) == ((vectors[:, None] - centroids) ** 2).sum(axis=2)).all()


def test_a_task_sends_a_row_for_each_centroid(spark):
    from textlake.llm.centroids import _sums, whole_vectors
    df = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(4000)], "vec_id bigint, embedding array<double>").repartition(4)
    parts = whole_vectors(df, "vec_id", "embedding", 2, 256).select("q").mapInArrow(
        _sums(np.array([[0, 256], [512, 256]])), "cluster int, n bigint, total array<bigint>")
    assert parts.count() <= 4 * 2 and parts.agg(F.sum("n")).first()[0] == 4000


def test_first_rows_takes_the_same_from_any_share(spark):
    rows = spark.range(5000).withColumn("h", F.xxhash64("id") + 2.0**63).withColumn("h", F.col("h") / 2.0**64)
    whole = [r.id for r in rows.orderBy("h").limit(40).collect()]
    assert [r.id for r in first_rows(rows, [F.col("h")], F.col("h"), 40).collect()] == whole
    # a place that bunches the rows: larger shares are taken until enough are found
    bunched = rows.withColumn("h", 0.9 + F.col("h") / 10)
    assert [r.id for r in first_rows(bunched, [F.col("h")], F.col("h"), 40).collect()] == whole
    assert first_rows(rows.limit(0), [F.col("h")], F.col("h"), 40).count() == 0


# --- fill in middle --------------------------------------------------------------

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_middle(doc_id, text, seed=42, rate=50, spm=80):
    text = text or ""
    units, digest = UNIT.findall(text), hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i:8 * i + 8], 16) for i in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    if h4 % 100 < spm:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


PIECES = ["a", "bc", " ", "  ", "\n", "\t", "\x0b", "é", "語", "😀", "<", "<P", "P>", "<S", ">", "S>", "M>", "\x00", "\x1f", " ", " ", "word"]


def test_fill_in_middle_equals_plain_and_restores(spark):
    rng = random.Random(5)
    texts = [None, "", " ", "\n\n", "x", " x", "x ", "<P>", "a <M> b", "<<S>>", "long " * 30_000, "é" * 100_000 + " z"]
    texts += ["".join(rng.choices(PIECES, k=rng.randrange(1, 40))) for _ in range(1500)]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(3, "again and again", "x"), (3, "again and again", "x"), (None, "no id here", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, form string").repartition(3)
    for settings in ({}, {"rate": 100, "spm": 40, "seed": 7}):
        got = restore(fill_in_middle(df, **settings)).collect()
        want = sorted(((i, *plain_middle(i, t, **settings), t or "") for i, t, _ in rows), key=repr)
        assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in got), key=repr) == want
        assert {r.form for r in got} == {"plain", "spm", "psm"}


def test_fill_in_middle_of_nothing(spark):
    assert restore(fill_in_middle(spark.createDataFrame([], "doc_id bigint, text string"))).count() == 0


# --- languages ----------------------------------------------------------------------


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    from textlake.llm.queries import fold
    learned = language.learn(docs.where(fold(5) != 0))
    assert set(learned.names) == {"de", "en", "es", "fr"} and learned.names[0] == "en"
    assert all(len(d) <= 65_536 for d in learned.dictionaries)
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got = {r.doc_id: r for r in language.identify(docs, learned).collect()}
    assert set(got) == set(truth)
    unseen = [i for i in truth if held_out(i)]
    assert sum(got[i].lang_pred == truth[i] for i in unseen) >= 0.97 * len(unseen)
    sure = [i for i in unseen if got[i].sure]
    assert len(sure) >= 0.9 * len(unseen) and sum(got[i].lang_pred == truth[i] for i in sure) >= 0.99 * len(sure)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_prediction_is_the_smallest_output(spark):
    taught = [(i, t, lang, "z") for i, (t, lang) in enumerate([
        ("the cat and the dog sat there", "en"), ("this is the other thing", "en"), ("the weather is fine", "en"),
        ("der Hund und die Katze", "de"), ("das Wetter ist heute schön", "de"), ("नमस्ते दुनिया", "hi"), ("123 456", "num"), ("nichts", None)])]
    df = spark.createDataFrame(taught, "doc_id bigint, text string, lang string, score string")
    learned = language.learn(df)
    assert learned.names == ("en", "de", "hi")  # by labelled rows; digits teach nothing
    texts = ["THE CAT, the dog!", "der Hund und das Wetter", "दुनिया नमस्ते", "", None, "123 -- !?", "xylophone", "heute heute heute", "the " * 50_000]
    got = {r.doc_id: r for r in language.identify(spark.createDataFrame(
        list(enumerate(texts)), "doc_id bigint, text string"), learned).collect()}
    compressors = learned.compressors()
    for i, text in enumerate(texts):
        words = list(dict.fromkeys(re.findall(r"[^\W\d_]+(?:[ऀ-ःऺ-ॏ]+[^\W\d_]*)*", (text or "").lower())))
        if not words:
            assert got[i].lang_pred == "und" and got[i].score == 0 and not got[i].sure
            continue
        size = [len(c.compress(" ".join(words).encode())) for c in compressors]
        assert got[i].lang_pred == learned.names[size.index(min(size))], text
        assert math.isclose(got[i].score, 1 / sum(2.0 ** (min(size) - z) for z in size))
        assert got[i].sure == (got[i].score >= 0.9)
    assert got[2].lang_pred == "hi"
    assert got[6].lang_pred == "en" and not got[6].sure  # a tie: the language with more rows, and not sure


def test_compression_parts_languages_that_share_letters(spark):
    rng = random.Random(9)
    parts = {"xa": ["ka", "ro", "mi", "tel"], "xb": ["lu", "sen", "ka", "dor"]}
    word = lambda lang: "".join(rng.choices(parts[lang], k=rng.randrange(2, 5)))
    text = lambda lang: " ".join(word(lang) for _ in range(rng.randrange(20, 60)))
    rows = [(i, text(lang), lang) for i, lang in enumerate(["xa", "xb"] * 60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    learned = language.learn(df.where("doc_id < 100"))
    assert all(r.lang_pred == r.lang for r in language.identify(df, learned).join(df, "doc_id").where("doc_id >= 100").collect())


def test_languages_without_labels_or_rows(spark):
    none = spark.createDataFrame([(1, "some text", None)], "doc_id bigint, text string, lang string")
    learned = language.learn(none)
    assert learned.names == ()
    assert [(r.lang_pred, r.score) for r in language.identify(none, learned).collect()] == [("und", 0.0)]
    one = language.learn(spark.createDataFrame([(1, "some text", "x")], none.schema))
    assert [(r.lang_pred, r.score) for r in language.identify(none, one).collect()] == [("x", 1.0)]
    assert language.identify(none.limit(0), one).count() == 0


@pytest.mark.parametrize("name", ["op11_centroid_clusters", "op12_language_id", "op13_fill_in_middle"])
def test_registered(name):
    from __spark_entry__ import oracle_sql, queries
    assert name in queries() and (name in oracle_sql()) == (name != "op12_language_id")
