"""Benchmark: seconds per headline query at one scale factor.

Runs each query of the catalogue's headline set on ``local[$BENCH_CPUS]`` against
``$BENCH_SF_DIR`` (default /root/testdata/sf0.1), warm session, median of
``$BENCH_REPEAT`` runs (default 3). Every run executes the whole plan into Spark's
``noop`` sink (no collect to the driver). Prints ONE JSON line:
``{"metric": ..., "value": total, "unit": "sec", "queries": {...}, "sf": ...}``.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "page_overview", "page_paragraphs", "page_links_all", "domain_rollup", "contacts_email",
    "contacts_phone", "clean_text", "block_pages", "error_classify", "source_health",
    "slo_success_rate", "slo_latency_p95", "fallback_first_success", "merge_all_engines",
    "result_limit", "crawl_bfs", "keyword_search_bm25", "federated_search", "page_statistics",
    "serp_web_roundtrip", "serp_news_roundtrip", "stream_service_levels",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]

    from webcorpus.plans import catalog
    from webcorpus.session import get_session

    spark = get_session(f"local[{cpus}]", app_name="webcorpus-bench", shuffle_partitions=int(cpus))
    spark.conf.set("spark.webcorpus.scanPartitions", cpus)  # the given files hold one row group each
    catalog.load_all()
    names = only or [q for q in HEADLINE if q in catalog.QUERIES]
    # warm-up: JVM, Python workers, file listing
    catalog.QUERIES["page_title_lang"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        runs = []
        for _ in range(repeat):
            t0 = time.perf_counter()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(runs), 3)
    sf = os.path.basename(os.path.normpath(sf_dir)).replace("sf", "")
    print(json.dumps({"metric": "sum_of_median_query_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf, "cpus": int(cpus), "repeat": repeat}))
    spark.stop()


if __name__ == "__main__":
    main()
