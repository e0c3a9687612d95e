"""TF-IDF: exact invariants, ranks, and hashed long form vs the ML vectors."""

import math
import re

from pyspark.sql import functions as F

from conftest import SF_SMALL
from textlake.functions.hashing import hashing_tf_bucket
from textlake.operators import tfidf
from textlake.plans.queries import QUERIES, _docs


def test_exact_inline_values(spark):
    docs = spark.createDataFrame([(1, "a b b"), (2, "b c"), (3, "")], "d int, body string")
    got = {(r.d, r.term): (r.tf, round(r.score, 9)) for r in tfidf.tfidf_exact(docs, ["d"]).collect()}
    ln = math.log
    assert got == {(1, "a"): (1.0, round(ln(4 / 2), 9)), (1, "b"): (2.0, round(2 * ln(4 / 3), 9)),
                   (2, "b"): (1.0, round(ln(4 / 3), 9)), (2, "c"): (1.0, round(ln(4 / 2), 9))}


def test_term_in_every_document_scores_zero(spark):
    docs = spark.createDataFrame([(1, "x a"), (2, "x b"), (3, "x")], "d int, body string")
    rows = tfidf.tfidf_exact(docs, ["d"]).where("term = 'x'").collect()
    assert len(rows) == 3 and all(r.score == 0.0 for r in rows)


def test_group_as_document_equals_concatenation(spark):
    docs = spark.createDataFrame([("g1", "a b"), ("g1", "b"), ("g2", "c a")], "g string, body string")
    concat = docs.groupBy("g").agg(F.concat_ws(" ", F.collect_list("body")).alias("body"))
    a = sorted(tuple(r) for r in tfidf.tfidf_exact(docs, ["g"]).collect())
    b = sorted(tuple(r) for r in tfidf.tfidf_exact(concat, ["g"]).collect())
    assert a == b


def test_dense_rank_with_ties(spark):
    scores = spark.createDataFrame(
        [("g", f"t{i}", float(s)) for i, s in enumerate([5, 5, 4, 3, 3, 3, 2, 1, 0])],
        "g string, term string, score double")
    top = tfidf.top_terms_per_group(scores, ["g"], k=3).collect()
    assert [r["rank"] for r in top] == [1, 1, 2, 3, 3, 3]
    assert all(r.score != 0 for r in top)


def test_ranks_dense_on_fixture(spark):
    scores = tfidf.tfidf_exact(_docs(spark, SF_SMALL), ["lang"])
    top = tfidf.top_terms_per_group(scores, ["lang"]).collect()
    by_group = {}
    for r in top:
        by_group.setdefault(r.lang, set()).add(r["rank"])
    for ranks in by_group.values():
        assert ranks == set(range(1, max(ranks) + 1))


def test_hashed_long_form_equals_ml_vectors(spark):
    docs = _docs(spark, SF_SMALL).select("doc_id", "body")
    vec = tfidf.hashed_tfidf_vectors(docs).select("doc_id", "words", "rawFeatures", "features")
    terms = vec.select(F.explode("words").alias("term")).distinct()
    bucket = {r.term: r.bucket for r in terms.select(
        "term", hashing_tf_bucket("term", tfidf.NUM_FEATURES).alias("bucket")).collect()}
    h = tfidf.HashingTF(numFeatures=tfidf.NUM_FEATURES)
    for t in sorted(bucket)[:40]:  # the JVM-side bucket is HashingTF's own index
        assert bucket[t] == h.indexOf(t)
    expected = {}
    for r in vec.collect():
        for t in set(r.words):
            i = bucket[t]
            expected[(r.doc_id, t)] = (round(float(r.features[i]), 9), float(r.rawFeatures[i]))
    got = {(r.doc_id, r.term): (round(r.score, 9), r.tf)
           for r in tfidf.tfidf_hashed_scores(docs, ["doc_id"]).collect()}
    assert got == expected


def test_hashed_agrees_with_exact_outside_shared_buckets(spark):
    docs = _docs(spark, SF_SMALL).select("doc_id", "body")
    ex = {(r.doc_id, r.term): (r.tf, r.score) for r in tfidf.tfidf_exact(docs, ["doc_id"]).collect()}
    ha = {(r.doc_id, r.term): (r.tf, r.score)
          for r in tfidf.tfidf_hashed_scores(docs, ["doc_id"]).collect()}
    assert ex.keys() == ha.keys()
    terms = spark.createDataFrame([(t,) for t in sorted({t for _, t in ex})], "term string")
    bucket = {r.term: r.bucket for r in terms.select(
        "term", hashing_tf_bucket("term", tfidf.NUM_FEATURES).alias("bucket")).collect()}
    per_bucket = {}
    for t, b in bucket.items():
        per_bucket[b] = per_bucket.get(b, 0) + 1
    alone = [k for k in ex if per_bucket[bucket[k[1]]] == 1]
    assert len(alone) > 0.9 * len(ex)
    for k in alone:
        assert ex[k][0] == ha[k][0] and abs(ex[k][1] - ha[k][1]) < 1e-9


def test_bucket_audit_inline(spark):
    tf = spark.createDataFrame([(1, "a", 1), (1, "b", 1), (2, "c", 3)], "d int, term string, tf long")
    rows = tfidf.hash_bucket_audit(tf, num_features=1).collect()
    assert [(r.bucket, r.n_terms, r.first_term, r.last_term) for r in rows] == [(0, 3, "a", "c")]


def test_vector_scores_equal_long_form(spark):
    docs = _docs(spark, SF_SMALL).select("doc_id", "body")
    vec = tfidf.hashed_tfidf_vectors(docs)
    a = {(r.doc_id, r.term): (round(r.score, 9), r.tf)
         for r in tfidf.vector_scores(vec, ["doc_id"]).collect()}
    b = {(r.doc_id, r.term): (round(r.score, 9), r.tf)
         for r in tfidf.tfidf_hashed_scores(docs, ["doc_id"]).collect()}
    assert a == b and a


def test_vector_scores_take_the_size_from_the_vectors(spark):
    docs = _docs(spark, SF_SMALL).select("doc_id", "body")
    vec = tfidf.hashed_tfidf_vectors(docs, num_features=1024)
    a = {(r.doc_id, r.term): (round(r.score, 9), r.tf)
         for r in tfidf.vector_scores(vec, ["doc_id"]).collect()}
    b = {(r.doc_id, r.term): (round(r.score, 9), r.tf)
         for r in tfidf.tfidf_hashed_scores(docs, ["doc_id"], num_features=1024).collect()}
    assert a == b and a


def test_persisted_features_equal_unpersisted(spark):
    docs = _docs(spark, SF_SMALL).select("doc_id", "body")
    cached = tfidf.hashed_features(docs).persist()
    a = {r.doc_id: r.features for r in tfidf.idf_vectors(cached).select("doc_id", "features").collect()}
    b = {r.doc_id: r.features for r in
         tfidf.hashed_tfidf_vectors(docs).select("doc_id", "features").collect()}
    assert a == b and a
    cached.unpersist()


def test_salts_make_no_difference(spark):
    docs = _docs(spark, SF_SMALL)
    plain = sorted(tuple(r) for r in tfidf.tfidf_exact(docs, ["doc_id"], salts=1).collect())
    for k in (2, 50):
        assert sorted(tuple(r) for r in tfidf.tfidf_exact(docs, ["doc_id"], salts=k).collect()) == plain


def test_murmur_buckets_are_hashing_tfs(spark):
    terms = ["", "a", "ab", "abc", "abcd", "abcde", "straße", "日本語", "x" * 37, "lucene", "\U0001F600"]
    h = tfidf.HashingTF(numFeatures=1000)  # not a power of two: the sign of the hash matters
    got = {r.t: r.b for r in spark.createDataFrame([(t,) for t in terms], "t string")
           .select("t", hashing_tf_bucket("t", 1000).alias("b")).collect()}
    assert got == {t: h.indexOf(t) for t in terms}


def test_hash_bucket_terms_inline(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a a"), (3, "c")], "d int, body string")
    got = {r.term: (r.n_terms, round(r.weight, 9)) for r in tfidf.hash_bucket_terms(docs, num_features=1).collect()}
    assert got == {t: (3, round(math.log(4 / 4), 9)) for t in "abc"}


def test_tfidf_of_document_equals_the_whole(spark):
    docs = _docs(spark, SF_SMALL)
    whole = sorted(tuple(r) for r in tfidf.tfidf_exact(docs, ["doc_id"]).where("doc_id = 7").collect())
    assert sorted(tuple(r) for r in tfidf.tfidf_of_document(docs, "doc_id", 7).collect()) == whole and whole


def _hashes_by_expression(df) -> bool:
    """Whether the plan spells HashingTF's hash out, byte by byte, for its terms."""
    return "conv(" in df._jdf.queryExecution().optimizedPlan().toString()


def test_buckets_of_terms_are_hashing_tfs(spark):
    terms = ["", "a", "abcde", "straße", "日本語", "\U0001F600"]
    rows = spark.createDataFrame([(t,) for t in terms], "term string")
    for n in (1000, 1 << 20):
        h = tfidf.HashingTF(numFeatures=n)
        assert {r.term: r.bucket for r in tfidf.with_buckets(rows, n).collect()} == {t: h.indexOf(t) for t in terms}


def test_hash_bucket_terms_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a  b a"), (1, "b"), (None, None), (2, ""), (3, " ")], "d int, body string")
    out = tfidf.hash_bucket_terms(docs)
    h = tfidf.HashingTF(numFeatures=tfidf.NUM_FEATURES)
    assert {(r.term, r.bucket, r.n_terms, round(r.weight, 9)) for r in out.collect()} == {
        ("a", h.indexOf("a"), 1, round(math.log(6 / 2), 9)), ("b", h.indexOf("b"), 1, round(math.log(6 / 3), 9))}
    assert not _hashes_by_expression(out)


def test_vector_scores_of_repeated_keys(spark):
    docs = spark.createDataFrame([(1, "a b b"), (1, "a c"), (2, "b"), (None, "a"), (3, "")], "d int, body string")
    out = tfidf.vector_scores(tfidf.hashed_tfidf_vectors(docs), ["d"])
    assert not _hashes_by_expression(out)
    # rows that share a key see each other's entries; a null key meets none
    assert sorted((r.d, r.term, r.tf) for r in out.collect()) == [
        (1, "a", 1.0), (1, "a", 1.0), (1, "a", 1.0), (1, "a", 1.0), (1, "b", 2.0), (1, "c", 1.0), (2, "b", 1.0)]


def test_vector_query_normalizes_the_texts_once(spark):
    plan = QUERIES["tfidf_hashed_vectors"](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan


def test_cached_features_scores_hash_no_bytes(spark):
    docs = spark.createDataFrame([(1, "a b b"), (2, "b")], "d int, body string")
    with tfidf.cached_features(docs, num_features=4096) as features:
        out = tfidf.vector_scores(tfidf.idf_vectors(features), ["d"])
        assert not _hashes_by_expression(out)
        assert sorted((r.d, r.term, r.tf) for r in out.collect()) == [(1, "a", 1.0), (1, "b", 2.0), (2, "b", 1.0)]


def test_cached_features_take_no_memory_of_the_executors(spark):
    docs = spark.createDataFrame([(i, f"a b{i} c{i % 7}") for i in range(300)], "d int, body string")
    storage = spark.sparkContext._jsc.sc()
    known = {i.id() for i in storage.getRDDStorageInfo()}
    with tfidf.cached_features(docs, num_features=4096) as features:
        assert tfidf.vector_scores(tfidf.idf_vectors(features), ["d"]).count() == 900
        held = [i for i in storage.getRDDStorageInfo() if i.id() not in known]
        assert len(held) == 1 and held[0].isCached()
        assert held[0].memSize() == 0 and held[0].diskSize() > 0


def test_hashed_scores_join_no_vocabulary(spark):
    docs = spark.createDataFrame([(1, "a b b"), (2, "b")], "d int, body string")
    df = tfidf.tfidf_hashed_scores(docs, ["d"])
    assert not _hashes_by_expression(df)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1  # the buckets' weights


def test_rows_are_dealt_by_term_and_salt_once(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        docs = spark.createDataFrame([(1, "a b b"), (2, "b"), (None, "b c")], "d int, body string")
        df = tfidf.tfidf_exact(docs, ["d"])
        plan = df._jdf.queryExecution().executedPlan().toString()
        got = {(r.d, r.term, r.tf) for r in df.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert got == {(1, "a", 1.0), (1, "b", 2.0), (2, "b", 1.0), (None, "b", 1.0), (None, "c", 1.0)}
    made = [x for x in plan.splitlines() if re.search(r"[:+]- Exchange hashpartitioning\(term", x)]
    assert len(made) == 3  # the rows, the pairs by term, the totals by pair
