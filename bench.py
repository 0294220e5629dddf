"""Time the headline queries: one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose input and cores.
Every query runs in full and its result is written to the no-op sink. Queries that read the
processed decision rows share one written copy; building it is a query of its own here.
"""

from __future__ import annotations

import json
import os
import sys
import time

from throughline.plans.catalog import CATALOG
from throughline.plans.study import study_rows
from throughline.session import local_session

HEADLINE = """profile_columns top_k_by_count decision_table pa_history repertoire_mix matchup_memory
view_O view_OM run_expectancy log_loss markov_backoff eb_run_value calibration ablation_delta
cluster_bootstrap permute_history permutation_pvalue mdp_value ope_table stepwise_dr value_interval
exploitability bits_seq""".split()


def main() -> None:
    path = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus)
    spark.read.parquet(f"{path}/lineitem.parquet").count()  # start the JVM's machinery
    took: dict[str, float] = {}

    def clock(name, run) -> None:
        t0 = time.perf_counter()
        run()
        took[name] = round(time.perf_counter() - t0, 3)
        print(f"{name} {took[name]}", file=sys.stderr, flush=True)

    clock("build_decision_rows", lambda: study_rows(spark, path))
    for name in HEADLINE:
        clock(name, lambda: CATALOG[name].run(spark, path).write.format("noop").mode("overwrite").save())
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec",
        "queries": took, "sf": os.path.basename(path.rstrip("/")), "cpus": int(cpus),
        "spark": spark.version, "driver_memory": spark.conf.get("spark.driver.memory", "default"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
