"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` is the folder of the tables, ``BENCH_CPUS`` the number of local cores,
``BENCH_RUNS`` how often each query is timed after one untimed run; the median counts.
``value`` is the sum over the headline queries. ``contract_lineitem_one_job_per_rule`` runs
the same contract rule by rule, for comparison, and is not part of the sum. ``skewed`` times
queries once on a wider input in many files, in which one key has a third of all rows.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import tablecheck as tc  # noqa: E402
from example_queries import QUERIES  # noqa: E402
from example_queries.base import approved, table  # noqa: E402
from example_queries.contracts import LINEITEM_RULES  # noqa: E402

HEADLINE = [
    "contract_lineitem",
    "contract_run",
    "rule_unique_long_text",
    "duplicate_rows_lineitem",
    "duplicate_rows_long_text",
    "profile_distinct",
    "profile_quantiles",
    "profile_top_long_texts",
    "profile_columns_orders",
    "profile_columns_lineitem",
    "profile_columns_documents",
]


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tablecheck-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.codegen.cache.maxEntries", "2000")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def approximate_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tc.profile_columns(table(spark, sf_dir, "orders"), approx=True)


def one_job_per_rule(spark: SparkSession, sf_dir: str) -> None:
    lineitem = table(spark, sf_dir, "lineitem")
    for rule in LINEITEM_RULES:
        tc.run_contract(lineitem, approved(rule)).collect()


COPIES, FILES = 5, 16


def skewed(spark: SparkSession, sf_dir: str, folder: str) -> dict[str, float]:
    """Seconds on copies of ``lineitem`` with other keys, one of them in a third of the rows."""
    copy = F.explode(F.sequence(F.lit(1), F.lit(COPIES))).alias("copy")
    wide = table(spark, sf_dir, "lineitem").select("*", copy)
    key = F.when(F.col("l_partkey") % 3 == 0, F.lit(1)).otherwise(F.col("l_orderkey") * COPIES + F.col("copy"))
    wide = wide.withColumn("l_orderkey", key.cast("long")).drop("copy")
    wide.repartition(FILES).write.parquet(f"{folder}/lineitem")
    df = spark.read.parquet(f"{folder}/lineitem")
    runs = {
        "contract": lambda: tc.run_contract(df, approved(*LINEITEM_RULES)),
        "duplicate_rows": lambda: tc.duplicate_rows(df),
        "profile_columns": lambda: tc.profile_columns(df),
        "uniform_sample": lambda: tc.uniform_sample(df, 100_000).agg(F.count("*")),
    }
    return {name: timed(lambda: build().collect(), 1) for name, build in runs.items()}


def timed(run, runs: int) -> float:
    run()
    seconds = []
    for _ in range(runs):
        start = time.perf_counter()
        run()
        seconds.append(time.perf_counter() - start)
    return round(statistics.median(seconds), 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = session(cpus)
    headline = {name: QUERIES[name] for name in HEADLINE}
    headline["profile_columns_orders_approx"] = approximate_profile
    times = {
        name: timed(lambda: build(spark, sf_dir).collect(), runs)
        for name, build in headline.items()
    }
    compared = timed(lambda: one_job_per_rule(spark, sf_dir), runs)
    # Where all executors see it: the folder of checkpoints, else one in the warehouse.
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    hot = skewed(spark, sf_dir, f"{shared.rstrip('/')}/bench-{uuid.uuid4().hex}")
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "compared": {"contract_lineitem_one_job_per_rule": compared},
                "skewed": hot,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
                "spark": spark.version,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
