"""The plan a large cluster runs: no broadcast joins.

On small fixtures Spark broadcasts every join side; at scale the
vocabulary-sized sides are too big, so joins run as sort-merge joins; a
frequent term (a skewed key) is spread by a salt, not by AQE.  These tests
force that path and check the results still equal the oracle SQL.
"""

import duckdb
import pytest

from conftest import SF_SMALL
from test_oracles import _rows
from textlake.plans.oracles import ORACLES
from textlake.plans.queries import QUERIES
from textlake.sources.tables import TABLES, table_path

LARGE_PATH = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1KB",
}

NAMES = ["tfidf_exact", "tfidf_per_group", "top_terms_per_group", "timeline_relative",
         "corpus_stats_by_label", "stopwords_anti_join", "document_frequency"]


def explain(spark, df) -> str:
    """Full plan text as df.explain() prints it (final + initial plans)."""
    return spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")


@pytest.fixture()
def large_path(spark):
    old = {k: spark.conf.get(k, None) for k in LARGE_PATH}
    for k, v in LARGE_PATH.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(SF_SMALL, t)}')")
    yield con
    con.close()


@pytest.mark.parametrize("name", NAMES)
def test_sort_merge_path_matches_oracle(large_path, duck, name):
    df = QUERIES[name](large_path, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    plan = explain(large_path, df)
    assert "BroadcastHashJoin" not in plan
    res = duck.execute(ORACLES[name])
    d_cols = [d[0] for d in res.description]
    assert _rows(df.columns, rows) == _rows(d_cols, res.fetchall())


def test_tfidf_join_is_sort_merge_with_reused_tf(large_path):
    df = QUERIES["tfidf_exact"](large_path, SF_SMALL)
    df.collect()
    plan = explain(large_path, df)
    assert "SortMergeJoin" in plan and "ReusedExchange" in plan


def test_hot_term_is_spread_and_texts_are_read_once(spark):
    """A term in every document, without broadcasts and without AQE: no task
    of the join holds more than a part of its rows, and the plan has one
    explode of the tokens."""
    from pyspark.sql import functions as F

    from textlake.operators import tfidf
    docs = spark.range(20_000).select(F.col("id").alias("d"),
                                      F.concat(F.lit("hot t"), F.col("id") % 50).alias("body")).repartition(4)
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled",
                                                "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        df = tfidf.tfidf_exact(docs, ["d"])
        hot = df.where("term = 'hot'").groupBy(F.spark_partition_id().alias("p")).count().collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert sum(r["count"] for r in hot) == 20_000 and len(hot) > 4
    assert max(r["count"] for r in hot) < 0.5 * 20_000
    assert plan.count("Generate explode(split(") == 1 and "ReusedExchange" in plan and "BroadcastHashJoin" not in plan


def test_no_hash_below_the_token_aggregate(spark):
    df = QUERIES["tfidf_hashed"](spark, SF_SMALL)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    # indented deeper than the aggregate of the tokens, no line mentions the bucket's hash
    lines = plan.splitlines()
    first = next(i for i, x in enumerate(lines) if "Aggregate [doc_id" in x and "term" in x and "count(1)" in x)
    assert "conv(" not in "\n".join(x for x in lines[first + 1:first + 4])


def test_plans_start_no_job_but_the_schema_reads(spark):
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup(None))
    names = ("tfidf_exact", "stopwords_anti_join", "page_extract_by_layout", "timeline_relative")
    for name in names:
        QUERIES[name](spark, SF_SMALL)
    assert len(tracker.getJobIdsForGroup(None)) <= before + len(names)  # Parquet footers, one a table


def test_cheaper_plans(spark):
    def plan(name):
        return QUERIES[name](spark, SF_SMALL)._jdf.queryExecution()

    assert plan("document_frequency").executedPlan().toString().count("Exchange") == 1
    lines = plan("preview_nonempty").optimizedPlan().toString().splitlines()
    normalized = [i for i, x in enumerate(lines) if "regexp_replace" in x]
    assert normalized and max(normalized) < next(i for i, x in enumerate(lines) if "Sort [" in x)
    assert "LeftSemi" in plan("top_terms_for_document").executedPlan().toString()
