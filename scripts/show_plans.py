"""Write the executed (adaptive) physical plans of key queries to docs/PLANS.md.

usage: python scripts/show_plans.py [sf_dir]
Each query is collected first (results are small at sf0.01), so the plan
shown is the final adaptive plan with AQE's runtime choices.
"""

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from quarry.functions.lines import PY_WHITESPACE  # noqa: E402
from quarry.plans.registry import load_all  # noqa: E402
from quarry.session import get_session  # noqa: E402

KEY = ["e13_reason_breakdown", "h2_import_files", "h3_tag_fold", "g1_search", "e11_statistics",
       "e4_top_repos", "g5_first_files_per_repo", "c3_ast_complexity", "j2_job_status", "b12_point_lookup"]


def tree(df) -> str:
    qe = df._jdf.queryExecution()
    plan = qe.executedPlan()
    text = plan.toString().replace(PY_WHITESPACE, "<whitespace set>")
    m = re.search(r"Final Plan ==\n(.*?)(\n\+- == Initial Plan|$)", text, re.S)
    body = m.group(1) if m else text
    out = []
    for line in body.splitlines():
        line = re.sub(r"#\d+L?", "", line)
        line = re.sub(r", \[plan_id=\d+\]", "", line)
        line = re.sub(r"\[id=#?\d+\]", "", line)
        out.append(line[:170])
    return "\n".join(out)


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_session("local[8]", 8)
    reg = load_all()
    parts = ["# Physical plans of key queries",
             "",
             f"Generated by `scripts/show_plans.py` at `{sf}` (local[8], AQE on). Each plan is the final",
             "adaptive plan after running the query (a few print as `isFinalPlan=false`: the",
             "initial adaptive plan, before AQE's runtime changes); expression ids are stripped",
             "and the strip function's whitespace set is shown as `<whitespace set>`.",
             ""]
    for name in KEY:
        df = reg[name].build(spark, sf)
        df._jdf.collectAsList()  # small at sf0.01; runs this frame's own execution, so its plan is final
        parts += [f"## {name}", "", reg[name].doc, "", "```", tree(df), "```", ""]
    open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "docs", "PLANS.md"), "w").write(
        "\n".join(parts))


if __name__ == "__main__":
    main()
