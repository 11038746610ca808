"""Wall-clock of the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose
data and cores.  Every query runs whole and is written to the no-op sink, so no
column is pruned away.  A query that takes less than BENCH_AGAIN seconds (default
8) is run a second time and the better time counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from riskweave.queries import catalog  # noqa: E402
from riskweave.session import local_session  # noqa: E402

# one per operator group
HEADLINE = [
    "missingness_report", "harmonize_union", "median_impute", "standard_scale", "fold_fit_transform",
    "extended_metrics", "calibration_table", "fairness_grouping_sets", "agreement_scores", "agreement_summary",
    "stratified_folds", "oof_alignment", "fold_metric_summary", "isotonic", "platt", "shapley_exact",
    "stability_summary", "cf_single", "cf_dual", "score_batch", "score_stream",
]
FITTED = ["surrogate_fit"]
# whole procedures, minutes each: python bench.py --procedures, with a figure of their own
PROCEDURES = ["adaboost", "tree_attribution", "random_search", "external_compare"]


def run_once(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    again_below = float(os.environ.get("BENCH_AGAIN", "8"))
    spark = local_session(cpus, riskweave__spread="true")
    run_once(spark, "missingness_report", sf_dir)
    times = {}
    procedures = "--procedures" in sys.argv
    for name in PROCEDURES if procedures else HEADLINE + FITTED:
        taken = run_once(spark, name, sf_dir)
        if taken < again_below:
            taken = min(taken, run_once(spark, name, sf_dir))
        times[name] = round(taken, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "procedures_total" if procedures else "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
