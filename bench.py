"""Times the headline queries: one JSON line on standard output.

Each query is built and written to the no-op sink, which computes every row; the best of the runs counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from opinara.session import local_session
from workload.queries import all_queries

HEADLINE = [
    "kpi_summary", "rating_distribution", "avg_rating_by_city", "top_businesses", "needs_attention", "city_performance",
    "monthly_sentiment", "growth_rate", "running_avg_rounded", "above_city_average", "view_business_summary",
    "view_city_summary", "business_rank", "rank_in_city", "city_quartile_asc", "best_city_per_category",
    "declining_rounded", "build_businesses", "build_reviews", "clean_pages", "clean_reviews", "cleaning_metrics",
    "parse_dates", "sample_exact", "word_frequency", "word_frequency_by_label", "complaint_tags", "complaint_frequency",
    "business_complaints", "tfidf_keywords", "themes_by_label", "sentiment_scores", "insights",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    queries["kpi_summary"](spark, folder).collect()  # start-up is not a query's time
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        best = float("inf")
        for _ in range(runs):
            start = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - start)
        seconds[name] = round(best, 3)
    result = {
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")), "cores": cpus,
    }
    spark.stop()
    print(json.dumps(result))


if __name__ == "__main__":
    main()
