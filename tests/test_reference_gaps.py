"""Stopword tables in the normalizer, broken JSON lines, vectors without JSON, presence, the
feature cache, occupied salts and ranged tables."""

import json

from pyspark.ml.feature import HashingTF
from pyspark.sql import functions as F

from conftest import SF_SMALL
from textlake.functions.text import normalize_text
from textlake.operators import counts, documents, normalize, tfidf, trends
from textlake.plans.materialize import materialize_by_range
from textlake.plans.queries import QUERIES
from textlake.session import shared_dir
from textlake.sources import files, tables


def words(spark, *ws):
    return spark.createDataFrame([(w,) for w in ws], "word string")


def docs_of(spark):
    return documents.clean_documents(tables.raw_documents(spark, SF_SMALL, ("lang",)), ["doc_id", "lang"])


# --- stopwords from a table -------------------------------------------------------

def test_table_normalizer_equals_inline_on_all_documents(spark):
    stop = ["the", "and", "of", "und", "la", "de", "", "is"]
    docs = tables.read_table(spark, SF_SMALL, "documents", ["doc_id", "text"])
    inline = dict(docs.select("doc_id", normalize_text("text", stop)).collect())
    table = {r.doc_id: r.body for r in normalize.normalize_with_words(docs, ["doc_id"], "text", words(spark, *stop)).collect()}
    assert table == inline


def test_table_normalizer_of_odd_rows(spark):
    rows = [(1, "The big and data"), (2, None), (3, ""), (4, "the the"), (5, "b the a the b"), (None, "the end")]
    docs = spark.createDataFrame(rows, "k int, t string")
    out = normalize.normalize_with_words(docs, ["k"], "t", words(spark, "the", "and", "the", None))
    # removal goes before phrases: "big and data" becomes the phrase "big data"
    assert {r.k: r.body for r in out.collect()} == {1: "bigdata", 2: None, 3: "", 4: "", 5: "b a b", None: "end"}
    assert {r.k: r.body for r in normalize.normalize_with_words(docs, ["k"], "t", words(spark).limit(0)).collect()}[4] == "the the"


def test_words_are_joined_not_collected(spark):
    docs = tables.read_table(spark, SF_SMALL, "documents", ["doc_id", "text"])
    plan = normalize.normalize_with_words(docs, ["doc_id"], "text", words(spark, "the"))._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in plan and "NestedLoop" not in plan


# --- broken JSON lines ---------------------------------------------------------------

def test_broken_lines_are_told_apart(spark):
    good = {"title": "t", "content": "c", "speakers": ["a", "b"], "link": "l"}
    lines = [json.dumps(good), json.dumps(good)[:-3], "#" + json.dumps(good), "", "   ", "[1", json.dumps({**good, "speakers": "no list"}),
             json.dumps({"title": "only"}), "{}", "plain text"]
    path = shared_dir(spark, "jsonl")
    files.write_wordlist(spark.createDataFrame([(x,) for x in lines], "line string").coalesce(1), "line", path)
    ok, bad = files.read_jsonl_checked(spark, path)
    assert {tuple(map(str, r)) for r in ok.collect()} == {
        ("t", "c", "['a', 'b']", "l"), ("only", "None", "None", "None"), ("None", "None", "None", "None")}
    assert ok.count() == 3
    assert ok.columns == ["title", "content", "speakers", "link"]
    assert sorted(r.line for r in bad.collect()) == sorted([lines[1], lines[2], lines[5], lines[6], lines[9]])


def test_no_line_is_lost(spark):
    rows = QUERIES["scan_jsonl_broken"](spark, SF_SMALL).groupBy("broken").count().collect()
    n = tables.read_table(spark, SF_SMALL, "documents", ["doc_id"]).count()
    assert {r.broken: r["count"] for r in rows} == {True: n // 5, False: n - n // 5}


# --- vectors ----------------------------------------------------------------------------

def test_vectors_are_read_without_json(spark):
    plan = QUERIES["tfidf_hashed_vectors"](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "to_json" not in plan and "from_json" not in plan


def test_presence_of_terms(spark):
    docs = spark.createDataFrame([(1, "a b b"), (2, "b"), (3, "")], "d int, body string")
    vectors = tfidf.hashed_tfidf_vectors(docs, num_features=4096)
    got = {(r.d, r.term): r for r in tfidf.term_presence(vectors, ["d"], ["a", "b", "c"]).collect()}
    index = HashingTF(numFeatures=4096).indexOf
    want = {r.d: (r.rawFeatures, r.features) for r in vectors.collect()}
    assert len(got) == 9
    for (d, term), r in got.items():
        raw, weights = want[d]
        assert r.bucket == index(term) and r.tf == raw[r.bucket] and r.weight == weights[r.bucket]
        assert r.present == (r.bucket in list(raw.indices))


def test_cache_holds_one_frame_and_is_released(spark):
    docs = docs_of(spark).select("doc_id", "body")
    storage = spark.sparkContext._jsc.sc()
    before = storage.getPersistentRDDs().size()
    with tfidf.cached_features(docs) as features:
        vectors = tfidf.idf_vectors(features)
        assert vectors._jdf.queryExecution().executedPlan().toString().count("InMemoryRelation") == 1
        n = vectors.count()
        assert storage.getPersistentRDDs().size() == before + 1
    assert storage.getPersistentRDDs().size() == before and not features.is_cached and n == docs.count()
    try:
        with tfidf.cached_features(docs) as features:
            features.count()
            raise RuntimeError("inside")
    except RuntimeError:
        pass
    assert storage.getPersistentRDDs().size() == before


# --- salts that occur -----------------------------------------------------------------------

def test_salted_totals_are_no_more_than_the_rows(spark):
    tf = tfidf.term_frequencies(docs_of(spark), ["doc_id"])
    out = tfidf.with_term_values(tf, ["doc_id"], 16)
    assert out.count() == tf.count() and "_salt" not in out.columns
    df = {r.term: r.df for r in tfidf.document_frequency(tf).collect()}
    assert all(df[r.term] == r.df for r in out.select("term", "df").distinct().collect())
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode(") == plan.count("Generate explode(split(")  # no vocabulary repeated


def test_hashed_scores_normalize_the_texts_once(spark):
    df = QUERIES["tfidf_hashed"](spark, SF_SMALL)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("\n+- == Initial Plan ==")[0]
    assert final.split("== Final Plan ==")[-1].count("Generate explode(split(") <= 1


# --- ranged tables ---------------------------------------------------------------------------

def test_few_row_groups_are_read_for_few_words(spark):
    counted = counts.word_count_per_group(docs_of(spark), ["lang"])
    written = materialize_by_range(counted, "wc", "word", 16)
    assert sorted(map(tuple, written.collect())) == sorted(map(tuple, counted.collect()))
    line = trends.timeline(written, ["lang"], ["und", "que"])
    plan = line._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "In(word" in plan
    # a word's rows lie in one or two files
    where = written.where("word IN ('und', 'que')").select(F.input_file_name().alias("f")).distinct().count()
    assert 1 <= where <= 4 < written.select(F.input_file_name().alias("f")).distinct().count()
