"""Write PLANS.md: final (post-AQE) physical plans of the headline queries.

Usage: python tools/plan_report.py [sf_dir]   (default /root/testdata/sf0.01)

Each query is executed once (its rows are counted through the ``noop``
sink is not enough to keep the plan, so the DataFrame is collected at this
small scale) and the final adaptive plan is reduced to operator names with
their key arguments, so shuffles, reuse, broadcasts and limits stand out.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from bench import HEADLINE  # noqa: E402
from textlake.plans.queries import QUERIES  # noqa: E402
from textlake.session import get_session  # noqa: E402

KEEP = re.compile(r"(Exchange|ReusedExchange|HashAggregate|SortAggregate|Window|WindowGroupLimit|"
                  r"SortMergeJoin|BroadcastHashJoin|BroadcastExchange|TakeOrderedAndProject|"
                  r"Generate|FileScan|MapInPandas|Subquery|Filter|AQEShuffleRead|Sort )")


def trim(line: str) -> str:
    line = re.sub(r"#\d+L?", "", line)
    line = re.sub(r", \[plan_id=\d+\]", "", line)
    line = re.sub(r"Location: InMemoryFileIndex\([^)]*\)\[[^\]]*\], ", "", line)
    line = re.sub(r"Project \[.*", "Project [...]", line)
    line = re.sub(r"Generate explode\(split\(.*?\)\)", "Generate explode(split(body))", line)
    return line[:170]


def final_plan(spark, df) -> list[str]:
    text = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")
    lines = text.splitlines()
    top = [i for i, line in enumerate(lines) if line.startswith("+- == Initial Plan ==")]
    if top:  # the top-level initial plan is everything after its marker
        lines = lines[:top[0]]
    out, skipping = [], 0
    for line in lines:
        indent = len(line) - len(line.lstrip(" :|+-"))
        if skipping and indent >= skipping:
            continue
        skipping = 0
        if "== Initial Plan ==" in line:  # a subquery's initial plan
            skipping = indent
            continue
        if KEEP.search(line):
            out.append(trim(line))
    return out


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_session("local[8]", 16)
    parts = ["# Final physical plans of the headline queries",
             "",
             f"Generated by `tools/plan_report.py` at `{sf_dir}` (local[8], AQE on). Operator lines",
             "only; expressions trimmed. At this scale AQE broadcasts small join sides; with",
             "broadcasts off the same plans use sort-merge joins (`tests/test_large_plan_path.py`).",
             ""]
    for name in HEADLINE:
        df = QUERIES[name](spark, sf_dir)
        df.collect()
        parts += [f"## {name}", "", "```"] + final_plan(spark, df) + ["```", ""]
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))),
                           "PLANS.md"), "w") as f:
        f.write("\n".join(parts))
    spark.stop()


if __name__ == "__main__":
    main()
