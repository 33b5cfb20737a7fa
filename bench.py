"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
Every query writes to the no-op sink, so all rows and columns are computed. The first
run of a query also pays JVM warm-up and code generation; `queries` holds the second run,
`first_run` the first.
"""

import json
import os
import time

from granulith import plans
from granulith.session import build_session

HEADLINES = ["e00_size_report", "b09_reclassify", "e01_image_stats", "e05_d_values", "e08_sphericity",
             "e10_majority_solid", "e11_volume_shares", "e12_half_volume_count", "e15_histogram",
             "d01_view_overlay", "d07_match_labels", "f02_evaluation_report", "f06_fit_thresholds",
             "g01_review_queue", "i05_plan"]


def timed(run, spark, sf_dir) -> float:
    t = time.perf_counter()
    run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - t, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", "bench", shuffle_partitions=int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    runnable = plans.queries()
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    first, warm = {}, {}
    for name in HEADLINES:
        first[name] = timed(runnable[name], spark, sf_dir)
    for name in HEADLINES:
        warm[name] = timed(runnable[name], spark, sf_dir)
    print(json.dumps({
        "metric": "headline query time, warm", "value": round(sum(warm.values()), 3), "unit": "sec",
        "queries": warm, "first_run": first, "particles": rows,
        "particles_per_sec": {n: round(rows / s) for n, s in warm.items()},
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
