"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from studyspark.catalog import REGISTRY  # noqa: E402
from studyspark.session import build_session  # noqa: E402

HEADLINE = [
    "qc_flags_iqr",
    "qc_flags_zscore",
    "qc_reason_counts",
    "qc_strict_rate",
    "infer_types",
    "months_since_baseline",
    "rule_chain",
    "rule_formula",
    "tap_lists",
    "clean_sessions",
    "describe_numeric",
    "describe_categorical",
    "profile_totals",
    "exact_quantiles",
    "compare_two_groups",
    "compare_k_groups",
    "within_subject",
    "paired_t",
    "slopes",
    "progression_summary",
    "hist_by_group",
    "box_stats",
    "split_by_time",
    "split_stratified",
    "auc",
    "ridge_fit",
    "classify",
    "logit_predictions",
    "importances",
    "forest_regression",
    "report_model",
    "report_qc",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        tempfile.mkdtemp(prefix="bench-"),
        spark__ui__enabled="false",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="8g",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/lineitem.parquet").selectExpr("sum(l_quantity)").collect()
    times = {}
    for name in names:
        start = time.time()
        REGISTRY[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
