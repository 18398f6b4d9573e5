"""Write condensed physical plans of the headline queries (PLANS.md).

usage: python tools/plans.py [sf_dir]   (bulk-loads the issue table first)
"""

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from defectlens.plans.catalog import load_all  # noqa: E402
from defectlens.session import build_session, scratch_path  # noqa: E402
from defectlens.sources.adapter import Tables, issues, materialize_issues  # noqa: E402

HEADLINE = ["issues_by_sprint", "kpis_by_module", "sprint_trends", "sprint_comparison", "top_assignees",
            "top_assignees_per_module", "module_breakdown", "assignee_rollup", "filtered_summary",
            "alerts_by_environment", "rule_table_eval", "reconcile_sprints"]


def _explain(df) -> str:
    jvm = df.sparkSession._jvm
    return jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def tree(df) -> str:
    txt = _explain(df)
    head = txt.split("\n\n")[0]
    return head.replace("== Physical Plan ==\n", "")


def scans(df) -> list[str]:
    txt = _explain(df)
    return sorted(set(re.findall(r"(PushedFilters: \[.+\]|PartitionFilters: \[.+\])", txt)))


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = build_session()
    out = ["# Physical plans", "",
           f"`tools/plans.py` on `{sf}`, local[8], Spark {spark.version}, AQE on (initial plans; AQE may "
           "coalesce partitions or switch a join to broadcast at runtime).", "",
           "## Star join (adapter, bulk load input)", "", "```", tree(issues(spark, sf)), "```", ""]
    path = materialize_issues(spark, sf, scratch_path(spark, "issue-plans"))
    t = Tables(spark, sf, issue_path=path)
    reg = load_all()
    for name in HEADLINE:
        df = reg[name].fn(t)
        out += [f"## `{name}` ({reg[name].operators})", "", "```", tree(df), "```"]
        sc = scans(df)
        if sc:
            out += [""] + [f"- {x}" for x in sc]
        out.append("")
    open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w").write(
        "\n".join(out))
    spark.stop()


if __name__ == "__main__":
    main()
