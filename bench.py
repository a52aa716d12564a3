"""Benchmark the headline queries.

Runs each query of HEADLINE over the tables in $BENCH_SF_DIR (default
/root/testdata/sf0.1) on local[$BENCH_CPUS] and prints ONE JSON line:
{"metric": "headline_total", "value": <sum of seconds>, "unit": "sec",
 "queries": {name: seconds}, "sf": <scale>, ...}.

Each query is fully executed into the `noop` sink (every row produced, nothing
collected to the driver). Before timing, an untimed warm-up runs the flagship
and one catalogue query on the smallest scale (/root/testdata/sf0.001 when
present) so JVM start, JIT and Python worker start-up are not charged to the
first timed query.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "e13_reason_breakdown",   # flagship: signals + verdict + reason counts
    "c1_code_lines",
    "c2_lint_score",
    "b3_verdict",
    "b4_apply_verdict",
    "b2_license_text",
    "c3_ast_complexity",
    "h2_import_files",
    "h3_tag_fold",
    "d3_attach_tags",
    "g1_search",
    "g1_search_tags",
    "e11_statistics",
    "e12_dashboard",
    "e4_top_repos",
    "a9_export_flat",
    "h9_replace_content",
    "g5_first_files_per_repo",
    "j2_job_status",
    "c11_progress_pct",
    "j1_incremental_ingest",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from quarry.plans.registry import load_all
    from quarry.session import get_session

    spark = get_session(f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8,
                        extra={"spark.driver.memory": "16g"})
    reg = load_all()
    # warm-up (untimed): JVM, JIT, codegen, Python workers
    warm_dir = "/root/testdata/sf0.001" if os.path.isdir("/root/testdata/sf0.001") else sf_dir
    for name in ("e13_reason_breakdown", "h2_import_files", "c3_ast_complexity"):
        reg[name].build(spark, warm_dir).write.format("noop").mode("overwrite").save()

    times: dict[str, float] = {}
    for name in HEADLINE:
        if name not in reg:
            continue
        t0 = time.perf_counter()
        reg[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {
        "metric": "headline_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
        "files": docs,
        "flagship_files_per_sec": round(docs / times["e13_reason_breakdown"], 1) if times.get("e13_reason_breakdown") else None,
        "cpus": cpus,
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
