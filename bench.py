"""Time the headline queries and print one JSON line.

BENCH_SF_DIR and BENCH_CPUS set the data folder and the number of local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from catalogue import QUERIES  # noqa: E402
from tabwright.session import build_session  # noqa: E402

HEADLINE = (
    "profile_missing",
    "profile_describe_num",
    "profile_describe_text",
    "profile_corr",
    "profile_duplicates",
    "meta_features",
    "outlier_zscore",
    "outlier_iqr",
    "outlier_isolation_forest",
    "feat_interactions",
    "feat_label_encode",
    "select_mutual_information",
    "preprocess",
    "split_holdout",
    "kfold_stratified",
    "metrics_class",
    "metrics_auc_ovr",
    "model_gaussian_bayes",
    "model_neighbours",
    "model_board_LogisticRegression",
    "model_board_RandomForestClassifier",
    "cross_validation",
    "explain_kernel_shap",
    "explain_tree_shap",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.log.level": "ERROR"},
    )
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in HEADLINE:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        spark.catalog.clearCache()
    spark.stop()
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
