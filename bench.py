"""Time the headline jobs on one machine and print one JSON line.

Every job runs to completion into a sink that discards rows; the first small scan only starts the JVM.
"""

from __future__ import annotations

import json
import os
import sys
import time

from ebbtide.plans.registry import JOBS
from ebbtide.session import build_session

HEADLINE = """
churn_slots churn_scenarios scenario_control_totals sql_features sql_features_multi_month month_scenarios
panel_monthly panel_lags client_training_set hotel_training_set zero_trading_runs rolling_12w rolling_weekday_12w nbinom_scores
country_day_probability anomaly_flags outlier_trim column_profile contribution_curve rank_max_margin roc_auc
correlated_pairs churn_model_scores
""".split()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "12g"),
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/nation.parquet").count()
    names = sys.argv[1:] or HEADLINE
    seconds: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        JOBS[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        spark.catalog.clearCache()
    print(
        json.dumps(
            {
                "metric": "headline jobs, total time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
