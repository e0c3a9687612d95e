"""Plan guards: the physical plans keep the properties the scale design needs.

Checked on every registered query (explain only, nothing is run):
  * no Cartesian product or nested-loop join (no all-pairs work);
  * no Python workers;
  * no aggregate that gathers a whole group into one value (collect_list /
    collect_set), but where the group is one document's own tokens; string min/max may plan as a partial + final SortAggregate,
    which is map-side and spills, so it is allowed;
  * scans read only the columns they need.
"""

import re

import pytest

from conftest import SF_SMALL
from textlake.plans.queries import QUERIES


OF_ONE_DOCUMENT = {"normalize_text_table"}


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark):
    return {name: plan_of(fn(spark, SF_SMALL)) for name, fn in QUERIES.items()}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_all_pairs_no_row_udf(plans, name):
    p = plans[name]
    assert "CartesianProduct" not in p
    assert "BroadcastNestedLoopJoin" not in p
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p
    assert name in OF_ONE_DOCUMENT or not re.search(r"collect_(list|set)", p)
    assert "MapInPandas" not in p and "PythonUDF" not in p


def test_documents_scan_is_pruned(plans):
    # n_chars is never needed; no query may read it
    for name, p in plans.items():
        for schema in re.findall(r"ReadSchema: (struct<[^\]]*?>)", p):
            assert "n_chars" not in schema, name


def test_counts_aggregate_map_side(plans):
    for name in ["word_count", "word_count_per_group", "array_element_count",
                 "timeline_relative", "tfidf_exact", "document_frequency"]:
        assert "partial_count" in plans[name] or "partial_sum" in plans[name], name


def test_rank_limit_is_pushed_before_shuffle(plans):
    for name in ["top_terms_per_group", "top_terms_per_source"]:
        assert "WindowGroupLimit" in plans[name], name


def test_topk_is_take_ordered(plans):
    for name in ["word_count_topk", "word_count_per_group_topk", "array_element_topk",
                 "top_tf_in_group"]:
        assert "TakeOrderedAndProject" in plans[name], name


def test_group_filter_reaches_scan(plans):
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(lang,en\)", plans["top_tf_in_group"])


def test_timeline_scans_texts_once(spark):
    from textlake.plans.queries import q_timeline_relative
    df = q_timeline_relative(spark, SF_SMALL)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("FileScan parquet") == 1
