"""Benchmark the headline queries.

Runs at $BENCH_SF_DIR (default /root/testdata/sf0.1) on local[$BENCH_CPUS]
and prints ONE JSON line: {"metric", "value", "unit", "queries", "sf"}.
Each query is materialised with the ``noop`` sink (full execution, nothing
collected to the driver).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "flagship",
    "a1_describe_lineitem",
    "a5_pearson_lineitem_nulls",
    "a6_spearman_lineitem",
    "a11_histogram_lineitem",
    "b9_split_lineitem",
    "b12_stratified_kfold_lineitem",
    "p2_impute_mean_lineitem",
    "f3_standard_scale_lineitem",
    "o1_outliers_iqr_lineitem",
    "k2_kbest_anova_lineitem",
    "r1_ols_lineitem",
    "c5_gaussian_nb_lineitem",
    "e10_auc_ap_nb_lineitem",
    "e12_roc_curve_nb_lineitem",
    "t6_cv_ols_lineitem",
    "j4_nearest_center_embeddings",
    "c10_knn_classify_embeddings",
    "e17_cluster_scores_embeddings",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:]
    from quarry.plans.all_queries import REGISTRY
    from quarry.plans.flagship import flagship
    from quarry.session import get_spark

    spark = get_spark(f"local[{cpus}]", int(cpus) * 2,
                      extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")})
    fns = {"flagship": flagship, **REGISTRY}
    names = only or HEADLINE
    # warm-up: JVM, Python workers, parquet footers
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.time()
        df = fns[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_queries_total_wall", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(m.group(1)) if m else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
