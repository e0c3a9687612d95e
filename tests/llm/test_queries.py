"""The registered queries against their SQL, and the pipeline against its stages' definitions."""

import math
import os
import subprocess
import sys

import duckdb
import pytest

import corpus_pipeline
from conftest import ROOT, SF_SMALL
from textlake.llm.common import read, save
from textlake.llm.queries import ORACLES, QUERIES


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    value = lambda v: None if isinstance(v, float) and math.isnan(v) else v
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    df = QUERIES[name](spark, SF_SMALL)
    want = con.execute(ORACLES[name])
    assert rows_of(df.columns, map(tuple, df.collect())) == rows_of([d[0] for d in want.description], want.fetchall())


def test_ten_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


def test_native_operators_run_no_python(spark):
    for name in ("op5_mix_sources", "op7_line_dedup", "op9_secret_scan", "op10_exact_dedup"):
        plan = QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop")), name


def test_pipeline_stages(spark):
    """Each stage on what its predecessor kept, judged by that operator's own brute-force-tested result."""
    docs = read(spark, SF_SMALL, "documents", *corpus_pipeline.COLUMNS)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "line dedup", "MinHash near-dedup", "benchmark decontamination",
                     "mixing sources to target weights"]
    counts = [docs.count()]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, save(stage(spark, docs, SF_SMALL), "test-stage")
        counts.append(docs.count())
        kept[name] = (before, docs)
        if name != names[-1]:
            assert docs.dtypes == before.dtypes
    assert counts[1] < counts[0] and counts[2] == counts[1] and counts[3] < counts[2] and counts[4] < counts[3]
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    before, after = kept["quality classifier"]
    good = before.join(labels.where("quality = 1"), on="doc_id")
    assert after.join(labels.where("quality = 1"), on="doc_id").count() >= 0.97 * good.count()
    before, after = kept["line dedup"]
    lines = lambda d: [x for r in d.collect() for x in r.text.split("\n") if len(x.split()) > 3]
    assert set(lines(after)) <= set(lines(before)) and len(lines(after)) == len(set(lines(after)))
    assert all(r.n_chars == len(r.text) for r in after.collect())
    _, mixed = kept[names[-1]]
    before, _ = kept[names[-1]]
    total = sum(len(r.text.split()) for r in before.collect())
    assert sum(r.n_words for r in mixed.collect()) == pytest.approx(1.5 * total, abs=20)


def test_pipeline_on_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, None, None, None, None, 3), (2, "", "en", "s", 0, 4), (None, "some fine words to keep here", "en", "s", 28, 5),
         (3, "some other fine words to keep", None, None, 29, 6), (3, "some other fine words to keep", None, None, 29, 6)],
        "doc_id long, text string, lang string, source string, n_chars long, th long")
    for _, stage in corpus_pipeline.STAGES:
        docs = save(stage(spark, docs, SF_SMALL), "odd-stage")
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        empty = save(stage(spark, empty, SF_SMALL), "empty-stage")
    assert empty.count() == 0


def test_the_rest_works_without_the_subpackage():
    code = ("import sys; sys.modules['textlake.llm'] = None\n"
            "import __spark_entry__ as e; q = e.queries(); assert 'tfidf_exact' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)")
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, env=os.environ | {"PYTHONPATH": ROOT})
