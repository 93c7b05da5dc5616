"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from moodfeed import queries as q  # noqa: E402
from moodfeed.sources import fixtures  # noqa: E402
from moodfeed.staging import release  # noqa: E402

HEADLINE = {
    "process": q.process_tweets_twitter,
    "process_whitespace": q.process_tweets,
    "tfidf": q.flagship,
    "entities": q.entity_counts,
    "collect": q.collect_all_tweets,
    "linear_score": q.linear_score,
    "experiment_distant": q.experiment_distant,
}


def run(df: DataFrame) -> None:
    """Compute every row and column without keeping them."""
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("moodfeed-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    n_tweets = fixtures.tweets(spark, sf_dir).count()
    seconds = {}
    for name, query in HEADLINE.items():
        start = time.perf_counter()
        run(query(spark, sf_dir))
        seconds[name] = round(time.perf_counter() - start, 3)
    release(spark)
    print(
        json.dumps(
            {
                "metric": "total time of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rstrip("/").rsplit("/sf", 1)[-1],
                "tweets": n_tweets,
                "tweets_per_sec": {k: round(n_tweets / s) for k, s in seconds.items()},
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
