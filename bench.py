"""Benchmark: headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``.

Each query is planned from the parquet tables and executed into Spark's
``noop`` sink (full execution, no result transfer).  ``pipeline`` runs the
reference's main chain — dedup, then every aggregate and time series — as one
analysis.  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from chorus.plans import analyze, catalog  # noqa: E402
from chorus.session import get_spark  # noqa: E402

HEADLINE = [
    "daily_sentiment", "trend_summary", "volatility", "anomalies", "peak_summary", "forecast_indicators",
    "engagement_stats", "author_stats", "negative_users", "viral_posts", "sentiment_leaders", "user_patterns",
    "top_hashtags", "content_hash", "dedup_stats", "sentiment_scores", "word_frequencies", "mention_graph",
    "triangular_network", "ingest_tweets",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark(f"local[{cpus}]", "chorus-bench", shuffle_partitions=int(cpus) * 2,
                      extra_conf={"spark.driver.memory": "16g",
                                  "spark.sql.files.maxPartitionBytes": str(64 * 1024 * 1024)})
    # warm-up: JVM, parquet footers
    run(catalog.QUERIES["by_platform"](spark, sf_dir))
    times = {}
    for name in HEADLINE:
        t0 = time.time()
        run(catalog.QUERIES[name](spark, sf_dir))
        times[name] = round(time.time() - t0, 3)
        print(f"{name}: {times[name]}s", file=sys.stderr, flush=True)
    t0 = time.time()
    results = analyze.analyze_posts(catalog.posts(spark, sf_dir))
    for df in results.values():
        run(df)
    times["pipeline"] = round(time.time() - t0, 3)
    n_posts = catalog.posts(spark, sf_dir).count()
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": times,
                      "sf": Path(sf_dir).name.replace("sf", ""), "posts": n_posts,
                      "pipeline_posts_per_sec": round(n_posts / times["pipeline"], 1)}))
    spark.stop()


if __name__ == "__main__":
    main()
