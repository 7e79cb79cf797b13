"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from pricebook.session import build_session
from workload import QUERIES

# The operators of each stage that do the most work.
HEADLINE = [
    "cheapest_offer_per_canonical",
    "compare_list",
    "at_a_glance",
    "flag_duplicate_keys",
    "price_changes",
    "price_moves",
    "price_series",
    "rapid_fire_day",
    "memory_state",
    "normalize_title",
    "normalize_offers",
    "match_cascade",
    "suggest_total",
    "with_siblings",
    "potential_duplicates",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = build_session(
        "pricebook-bench",
        f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    # One untimed run, so that the first query does not pay for the start of the JVM.
    QUERIES[HEADLINE[0]](spark, sf).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        took = []
        for _ in range(runs):
            start = time.time()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            took.append(time.time() - start)
        times[name] = round(sorted(took)[len(took) // 2], 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
