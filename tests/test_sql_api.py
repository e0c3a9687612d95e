"""SQL functions and views: SQL text gives the same results as the DataFrame API."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from textlake.functions import text as T
from textlake.functions.constants import PHRASES
from textlake.plans.sql_api import register_sql_functions, register_views
from textlake.sources import tables

STOP = ["the", "a", "of", "is", "and", "to", "this", "on", "it", "at", "don't"]


def test_sql_functions_equal_column_functions(spark):
    register_sql_functions(spark, STOP, PHRASES)
    tables.read_table(spark, SF_SMALL, "documents", ["doc_id", "text"]) \
        .createOrReplaceTempView("tl_docs")
    sql = spark.sql("SELECT doc_id, clearAll(lower(text)) AS a, cleanString(lower(text)) AS b, "
                    "array_size(split(text, ' ')) AS n FROM tl_docs")
    api = tables.read_table(spark, SF_SMALL, "documents", ["doc_id", "text"]).select(
        "doc_id", T.normalize_text("text", STOP, PHRASES).alias("a"),
        T.clean_string(F.lower("text")).alias("b"), F.size(F.split("text", " ")).alias("n"))
    assert sorted(map(tuple, sql.collect())) == sorted(map(tuple, api.collect()))


def test_sql_golden_and_strip_array(spark):
    register_sql_functions(spark, STOP, PHRASES)
    r = spark.sql("SELECT clearAll(lower('hdfs redis class ss')) AS a, "
                  "clearAll(lower('big data stores')) AS b, clearAll(NULL) AS c, "
                  "stripArray(array('  Ana ', 'BOB\\n')) AS d").first()
    assert (r.a, r.b, r.c, r.d) == ("hdf redi clas s", "bigdatastore", None, ["ana", "bob"])


def test_views_answer_original_style_sql(spark):
    register_views(spark, SF_SMALL)
    got = spark.sql(
        "SELECT w.lang, word, count, count / total * 100 AS relative_count "
        "FROM wordcounts_per_group w LEFT JOIN (SELECT lang, sum(count) AS total "
        "FROM wordcounts_per_group GROUP BY lang) t ON (w.lang = t.lang) "
        "WHERE word IN ('with', 'und') ORDER BY lang, count").collect()
    assert got and all(0 < r.relative_count < 100 for r in got)
    top = spark.sql(
        "SELECT lang, term, score, rank FROM (SELECT lang, term, score, dense_rank() OVER "
        "(PARTITION BY lang ORDER BY score DESC) AS rank FROM scores_per_group WHERE score <> 0) "
        "WHERE rank <= 10 ORDER BY lang, rank").collect()
    assert top and max(r["rank"] for r in top) <= 10


def test_materialized_views_equal_lazy(spark):
    register_views(spark, SF_SMALL)
    lazy = sorted(map(tuple, spark.table("wordcounts_per_group").collect()))
    register_views(spark, SF_SMALL, materialized=True)
    plan = spark.table("wordcounts_per_group")._jdf.queryExecution().executedPlan().toString()
    assert "textlake/tables/wordcounts_per_group" in plan  # reads the written files
    assert sorted(map(tuple, spark.table("wordcounts_per_group").collect())) == lazy


def test_materialize_partitioned(spark):
    from textlake.operators import counts
    from textlake.plans.materialize import materialize
    from textlake.plans.queries import _docs
    wc = counts.word_count_per_group(_docs(spark, SF_SMALL), ["lang"])
    back = materialize(wc, "wc_by_lang", partition_by=["lang"])
    plan = back.where("lang = 'de'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(lang" in plan  # a group read prunes folders
    assert sorted(map(tuple, back.select("lang", "word", "count").collect())) == \
        sorted(map(tuple, wc.collect()))
