"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tablewise.functions.staging import drop_staged  # noqa: E402
from tablewise.plans import QUERIES  # noqa: E402
from tablewise.session import local_session  # noqa: E402

HEADLINE = [
    "audit_missing", "audit_duplicates", "clean_table", "iqr_cap", "clean_cap_describe",
    "describe_numeric_lineitem", "describe_categorical", "quantiles", "histogram",
    "pearson_matrix", "spearman_matrix", "average_rank",
    "chi2", "welch", "mwu", "anova", "kruskal", "dagostino",
    "resample_daily_mean", "resample_monthly_sum", "gap_fill", "ar_linear_forecast",
    "roc_auc", "multiclass_metrics", "regression_metrics", "feature_selection", "pearson_wide", "pearson_wide_nulls",
]

#: Model searches: run once, without a warm-up.
ONCE = ["automl_classification", "automl_regression", "kmeans", "isolation_forest_flags", "ar_forest_by_type"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = os.environ.get("BENCH_QUERIES", "").split() or [*HEADLINE, *ONCE]
    spark = local_session(cpus)
    seconds: dict[str, float] = {}
    for name in names:
        times = []
        for _ in range(1 if name in ONCE else runs + 1):  # the first run warms up
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
            drop_staged(spark)
        seconds[name] = round(statistics.median(times[1:] or times), 3)
        print(f"{name:32s} {seconds[name]:7.3f}", file=sys.stderr, flush=True)
    result = {
        "metric": "headline_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cpus": cpus,
        "runs": runs,
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
