"""Time the headline queries; prints one JSON line.

Each query is run once to warm up and then three times; the median counts. Results
go to Spark's no-op sink, so every row and column is computed and nothing is
collected. BENCH_SF_DIR, BENCH_CPUS and BENCH_QUERIES (comma separated) override the
folder, the cores and the queries.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

HEADLINES = (
    "comment_stripping",
    "overlapping_chunks",
    "budget_packing_lines",
    "fuzzy_search",
    "fuzzy_search_many",
    "directory_tree",
    "tokens_by_file",
    "binary_flag",
    "language_detection",
    "document_tokens",
    "line_search",
    "match_stats",
    "latest_writes",
    "selection_state",
    "selected_contents",
    "context_bundle",
    "ordered_bundle",
    "aligned_search",
    "json_document",
    "xml_bundle",
    "json_bundle",
    "yaml_bundle",
    "tree_scan",
    "listed_bundle",
    "incremental_scan",
    "selection_from_stream",
)
RUNS = 3


def main() -> None:
    from sheaf.plans.queries import QUERIES
    from sheaf.session import build_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINES
    spark = build_session(
        f"local[{cpus}]",
        "bench",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    shuffled: dict[str, float] = {}
    store = spark.sparkContext._jsc.sc().statusStore()

    def written() -> int:
        executors = store.executorList(False)
        return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))

    for name in names:
        times = []
        before = written()
        for _ in range(RUNS + 1):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 4)
        shuffled[name] = round((written() - before) / (RUNS + 1) / 1e6, 3)
        print(f"{name}: {seconds[name]} s, {shuffled[name]} MB shuffled", file=sys.stderr, flush=True)
    spark.stop()
    total = round(sum(seconds.values()), 4)
    scale = os.path.basename(folder.rstrip("/"))
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": total,
                "unit": "sec",
                "queries": seconds,
                "shuffle_mb": shuffled,
                "sf": scale,
            }
        )
    )


if __name__ == "__main__":
    main()
