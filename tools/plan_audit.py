"""Plan shape of every registered query as it would be planned for large inputs.

    python tools/plan_audit.py [sf_dir] [query ...]

Size-based broadcasting is switched off, so every join the optimizer would
broadcast only because the test tables are small is planned as a shuffle join;
the broadcasts left are the ones the code asks for (the bounded hot-key tables). Counts come from the initial physical
plan (before AQE re-plans with run-time sizes). Queries that write
intermediate tables run those writes while being built.
"""

from __future__ import annotations

import re
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from cartcast.plans.registry import QUERIES  # noqa: E402
from cartcast.session import get_session  # noqa: E402

OFF = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}


def shape(df) -> dict[str, int]:
    plan = df._jdf.queryExecution().executedPlan().toString()
    count = lambda pat: len(re.findall(pat, plan))
    return {
        "raw_scans": count(r"Scan parquet [^\n]*events|FileScan parquet [^\n]*events|events\.parquet"),
        "written_scans": count(r"cartcast/"),
        "exchanges": count(r"Exchange hashpartitioning|Exchange rangepartitioning|Exchange SinglePartition"),
        "sort_merge_joins": count(r"SortMergeJoin"),
        "broadcasts": count(r"BroadcastExchange"),
        "python_udfs": count(r"BatchEvalPython|ArrowEvalPython|FlatMapGroupsInPandas|MapInPandas|InArrow"),
    }


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = get_session("local[8]", 8, **OFF)
    skip = {n for n in QUERIES if "holdout" in n or "submission" in n or "csv" in n or "libsvm" in n}
    skip |= {"stream_filter_log", "log_by_day"}
    header = None
    for name in names:
        if name in skip:
            continue
        s = shape(QUERIES[name](spark, sf))
        if header is None:
            header = list(s)
            print(f"{'query':26s}" + "".join(f"{k:>18s}" for k in header))
        print(f"{name:26s}" + "".join(f"{s[k]:>18d}" for k in header))


if __name__ == "__main__":
    main()
