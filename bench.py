"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs twice into Spark's noop sink; the better time counts, so the
numbers are for a warm session.
"""

from __future__ import annotations

import json
import os
import time

from tilescope.plans import all_queries
from tilescope.session import local_session

HEADLINE = [
    "tile_grid",
    "embed_tiles",
    "band_stack",
    "cloud_ratio",
    "hist_match",
    "knn_search",
    "land_cover_tags",
    "detect_scene_change",
    "pairwise_intervals",
    "index_change",
    "pixel_diff",
    "percentile_stretch",
    "audit_upsert",
    "review_append",
    "hotspot_list",
    "nearest_hotspot",
    "kmeans",
    "latency_stats",
    "provenance_export",
]
# What one run of a query works through, for throughput: (table, rows per table row, name).
WORK = {
    "detect_scene_change": ("embeddings", 1 / 3, "pairs"),
    "embed_tiles": ("orders", 1, "pixels"),
    "tile_grid": ("orders", 1, "pixels"),
    "index_change": ("lineitem", 1, "pixels"),
    "knn_search": ("embeddings", 1, "vectors"),
}


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    registry = all_queries()
    times: dict[str, float] = {}
    for name in HEADLINE:
        runs = []
        for _ in range(2):
            start = time.perf_counter()
            registry[name].run(spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(min(runs), 3)
    rates = {}
    for name, (table, factor, unit) in WORK.items():
        rows = spark.read.parquet(f"{folder}/{table}.parquet").count()
        rates[f"{name}_{unit}_per_sec"] = round(rows * factor / times[name], 1)
    result = {
        "metric": "headline_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "rates": rates,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
        "cpus": cpus,
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
