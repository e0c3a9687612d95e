"""Counts and trends: invariants on the fixture corpus and small inline tables."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from textlake.operators import counts, stats, trends
from textlake.plans.queries import QUERIES, _docs


def test_word_counts_sum_to_token_count(spark):
    docs = _docs(spark, SF_SMALL)
    n_tokens = docs.select(F.sum(F.size(F.split("body", " ")))).first()[0]
    total = counts.word_count(docs).select(F.sum("count")).first()[0]
    assert total == n_tokens


def test_relative_counts_sum_to_100_over_all_terms(spark):
    docs = _docs(spark, SF_SMALL)
    vocab = [r.word for r in counts.word_count(docs).select("word").collect()]
    share = trends.term_share(docs, ["lang"], vocab)
    sums = share.groupBy("lang").agg(F.sum("relative_count").alias("s")).collect()
    assert sums and all(abs(r.s - 100.0) < 1e-6 for r in sums)


def test_term_share_equals_join_form(spark):
    docs = _docs(spark, SF_SMALL)
    terms = ["with", "und", "que", "der", "nope-not-there"]
    one_pass = trends.term_share(docs, ["lang"], terms)
    full = counts.word_count_per_group(docs, ["lang"])
    joined = trends.timeline_relative(full, ["lang"], terms)
    a = sorted((r.lang, r.word, r["count"], round(r.relative_count, 9)) for r in one_pass.collect())
    b = sorted((r.lang, r.word, r["count"], round(r.relative_count, 9)) for r in joined.collect())
    assert a == b and a


def test_inline_timeline_and_camps(spark):
    docs = spark.createDataFrame(
        [("2015", "spark spark hadoop x"), ("2015", "flink"), ("2016", "hadoop y y y")],
        "year string, body string")
    share = trends.term_share(docs, ["year"], ["spark", "hadoop", "flink"]).collect()
    got = {(r.year, r.word): (r["count"], round(r.relative_count, 6)) for r in share}
    assert got == {("2015", "spark"): (2, 40.0), ("2015", "hadoop"): (1, 20.0),
                   ("2015", "flink"): (1, 20.0), ("2016", "hadoop"): (1, 25.0)}
    camps = trends.label_camps(trends.term_share(docs, ["year"], ["spark", "hadoop"]),
                               ["hadoop"], "old", "new").collect()
    assert sorted((r.year, r.technology, r["count"]) for r in camps) == \
        [("2015", "new", 2), ("2015", "old", 1), ("2016", "old", 1)]


def test_array_element_count_and_topk(spark):
    df = spark.createDataFrame([(["ann", "bob"],), (["ann"],), ([],), (None,)], "s array<string>")
    got = {r.word: r["count"] for r in counts.array_element_count(df, "s").collect()}
    assert got == {"ann": 2, "bob": 1}
    top = counts.top_k(counts.array_element_count(df, "s"),
                       [F.col("count").desc(), F.col("word")], 1).collect()
    assert [(r.word, r["count"]) for r in top] == [("ann", 2)]


def test_corpus_stats_inline(spark):
    docs = spark.createDataFrame([("a", 1, "xx"), ("a", 1, "xx"), ("a", 2, "y"), ("b", 3, "")],
                                 "g string, k int, body string")
    got = {r.g: (r.urls, r.text_length, r.avg_document_size)
           for r in stats.corpus_stats(docs, ["g"], "k").collect()}
    assert got == {"a": (2, 5, 2.5), "b": (1, 0, 0.0)}


def test_filter_by_group_string_compare_no_ansi_error(spark):
    docs = spark.createDataFrame([("",), ("2015",), ("2016",)], "year string")
    from textlake.operators.documents import filter_by_group
    assert [r.year for r in filter_by_group(docs, "year", 2015).collect()] == ["2015"]


def test_entry_runs(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.columns == ["lang", "word", "count", "relative_count"]
    assert df.count() > 0


def test_registry_covers_oracles():
    import __spark_entry__ as E
    qs, os_ = E.queries(), E.oracle_sql()
    assert set(os_) <= set(qs)
    # the training-data queries come on top where their subpackage is present
    assert set(QUERIES) <= set(qs) and set(QUERIES) - set(os_) == {"page_direct_text"}


def test_camp_comparison_over_full_counts_equals_one_pass(spark):
    docs = _docs(spark, SF_SMALL)
    full = counts.word_count_per_group(docs, ["lang"])
    a = trends.camp_comparison(full, ["lang"], ["que", "les"], ["der", "die"], "A", "B")
    b = trends.label_camps(trends.term_share(docs, ["lang"], ["que", "les", "der", "die"]),
                           ["que", "les"], "A", "B")
    key = lambda r: (r.lang, r.technology, r["count"], round(r.relative_count, 9))
    assert sorted(map(key, a.collect())) == sorted(map(key, b.collect())) != []


def test_edge_texts_through_the_pipeline(spark):
    from textlake.operators import documents, tfidf
    raw = spark.createDataFrame(
        [(1, "g", "t1", None), (2, "g", "", ""), (3, "g", "The", "the a of"), (4, "g", "s", "s s"),
         (5, "h", "Big", "data stores")],
        "doc_id long, grp string, title string, content string")
    docs = documents.clean_documents(raw, ["doc_id", "grp"])
    bodies = {r.doc_id: r.body for r in docs.collect()}
    assert bodies == {1: None, 2: "", 3: "", 4: "  ", 5: "bigdatastore"}
    wc = {(r.grp, r.word): r["count"] for r in counts.word_count_per_group(docs, ["grp"]).collect()}
    # doc 1 adds no token; "" is one empty token; "  " is three empty tokens
    assert wc == {("g", ""): 5, ("h", "bigdatastore"): 1}
    scores = tfidf.tfidf_exact(docs, ["doc_id"]).collect()
    assert [(r.doc_id, r.term, r.tf) for r in scores] == [(5, "bigdatastore", 1.0)]
