"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local threads. Every query runs once to
warm up and then RUNS times; the median counts. Results go to a no-op sink, so whole
results are computed and nothing is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ledgerlens.plans import catalog
from ledgerlens.session import get_spark

RUNS = 2
HEADLINE = [
    "peer_benchmark", "peer_benchmark_all", "peer_rank", "numeric_flags", "keyword_flags", "flag_merge", "risk_summary",
    "section_chunks", "paragraph_chunks", "line_dedup_exact", "fuzzy_line_dedup", "normalised_documents", "tfidf_stats", "tfidf_topk",
    "research_answers", "vector_topk", "line_facts", "fact_best", "extracted_documents", "report_metrics", "number_parse", "currency_canonical",
    "keyed_update", "session_tree",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = get_spark(
        "bench", f"local[{cpus}]", **{
            "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g",
        },
    )
    spark.sparkContext.setLogLevel("OFF")
    queries, times = catalog.queries(), {}
    for name in names:
        seconds = []
        for _ in range(RUNS + 1):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds.append(time.perf_counter() - start)
        times[name] = round(statistics.median(seconds[1:]), 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()
