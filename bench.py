"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import time
from statistics import median

from tidewater import registry
from tidewater.session import local_session

HEADLINE = [f"h_q{i:02d}" for i in range(1, 23)] + [
    "ds_q03", "ds_q04", "ds_q11", "ds_q14", "ds_q23", "ds_q51", "ds_q64", "ds_q67", "ds_q72", "ds_q95", "qm_suite_summary", "hw_01_scalar_stats", "fe_01_totals", "rk_02_composite_score",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "tidewater-bench")
    spark.sparkContext.setLogLevel("OFF")
    queries = registry.queries()

    def run(name: str) -> float:
        start = time.perf_counter()
        # every row is produced; none travels to the driver
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    # one pass that is not timed compiles the code; then the median of three for the suite that has published figures, once for others
    times = {}
    for name in HEADLINE:
        if name.startswith("h_q"):
            run(name)
    for name in HEADLINE:
        times[name] = round(median(run(name) for _ in range(3 if name.startswith("h_q") else 1)), 3)
    geo = 1.0
    for i in range(1, 23):
        geo *= times[f"h_q{i:02d}"] ** (1 / 22)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/")), "h_geo_mean_sec": round(geo, 3)}))
    spark.stop()


if __name__ == "__main__":
    main()
