"""Wall time of the headline queries on local[$BENCH_CPUS] at $BENCH_SF_DIR.

Prints one JSON line. Each query runs once to warm up and then $BENCH_RUNS times; the
median counts. The result is written to Spark's no-op sink, so all of it is computed.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from parecer.plans import catalog  # noqa: E402
from parecer.session import local_session  # noqa: E402

HEADLINE = [
    "q1_delay_dose",
    "q2_freight_ratio",
    "q3_category_bad_rate",
    "q4_payment_installments",
    "q5_segments",
    "q6_review_group_delay",
    "order_facts",
    "order_facts_category",
    "eda_category_gmv",
    "eda_delay_box",
    "eda_pareto",
    "t1_chi2",
    "t2_stratified",
    "t3_odds_ratios",
    "t4_relative_risk",
    "t5_auc",
    "t6_threshold_scan",
    "n1_top_words",
    "n2_theme_share",
    "n5_bad_sources",
    "l0_vocabulary",
    "l1_lda_topics",
    "r1_category_rates",
    "r2_delay_lift",
    "r3_risk_score",
    "r4_bad_volume",
    "r5_tiers",
    "rollup_monthly",
    "rollup_category_risk",
]


def once(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    catalog.run(name, spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in names:
        once(spark, name, folder)
        times[name] = round(statistics.median(once(spark, name, folder) for _ in range(runs)), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
                "runs": runs,
            }
        )
    )


if __name__ == "__main__":
    main()
