"""Samples. Which rows are drawn is Spark's choice; how many, and from where, is not."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

import tablecheck as tc
from example_queries.base import query, table

KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]


def described(sample: DataFrame, source: DataFrame, sampled: bool) -> DataFrame:
    """Rows drawn, and how many of them are rows of the source."""
    drawn = sample.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("drawn"))
    there = source.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("there"))
    return drawn.join(there, KEYS, "left").agg(
        F.coalesce(F.sum("drawn"), F.lit(0)).alias("rows_drawn"),
        F.coalesce(F.sum(F.least("drawn", "there")), F.lit(0)).alias("rows_of_source"),
        F.lit(sampled).alias("sampled"),
    )


def drawn_sql(rows: int, sampled: str) -> str:
    return f"""
    SELECT least({rows}, count(*))::BIGINT AS rows_drawn,
           least({rows}, count(*))::BIGINT AS rows_of_source, {sampled} AS sampled
    FROM lineitem"""


@query("uniform_sample", drawn_sql(1000, "true"))
def uniform_sample(spark, sf_dir):
    lineitem = table(spark, sf_dir, "lineitem")
    return described(tc.uniform_sample(lineitem, 1000, seed=7), lineitem, True)


@query("hash_sample", drawn_sql(1000, "true"))
def hash_sample(spark, sf_dir):
    lineitem = table(spark, sf_dir, "lineitem")
    return described(tc.hash_sample(lineitem, 1000, seed=7), lineitem, True)


@query("profiling_load_sampled", drawn_sql(1000, "count(*) > 1000"))
def profiling_load_sampled(spark, sf_dir):
    lineitem = table(spark, sf_dir, "lineitem")
    load = tc.profiling_load(lineitem, max_rows=1000, estimate=lineitem.count())
    return described(load.df, lineitem, load.sampled)


@query("profiling_load_unknown_size", drawn_sql(1000, "true"))
def profiling_load_unknown_size(spark, sf_dir):
    lineitem = table(spark, sf_dir, "lineitem")
    load = tc.profiling_load(lineitem, max_rows=1000)
    return described(load.df, lineitem, load.sampled)


@query("profiling_load_files", drawn_sql(1000, "count(*) > 1000"))
def profiling_load_files(spark, sf_dir):
    load = tc.load_file_profiling(spark, f"{sf_dir}/lineitem.parquet", max_rows=1000)
    return described(load.df, table(spark, sf_dir, "lineitem"), load.sampled)


@query("profiling_load_whole", drawn_sql(10_000_000, "false"))
def profiling_load_whole(spark, sf_dir):
    lineitem = table(spark, sf_dir, "lineitem")
    load = tc.profiling_load(lineitem, max_rows=10_000_000, estimate=lineitem.count())
    return described(load.df, lineitem, load.sampled)


# --- spread: a sample has its share of every part of the table ---

PLACE = "CAST(floor((l_orderkey - low) * 10 / (high - low + 1)) AS INT)"
SPREAD_SQL = f"""
    SELECT {PLACE.replace("INT)", "INTEGER)")} AS tenth, count(*)::BIGINT AS there, true AS in_proportion
    FROM lineitem, (SELECT min(l_orderkey)::DOUBLE AS low, max(l_orderkey)::DOUBLE AS high FROM lineitem)
    GROUP BY 1"""


def spread(sample: DataFrame, source: DataFrame) -> DataFrame:
    """Rows of each tenth of the keys, and whether between half and twice its share was drawn."""
    low, high = source.agg(F.min("l_orderkey").cast("double"), F.max("l_orderkey").cast("double")).first()
    tenth = F.expr(PLACE.replace("low", f"{low}D").replace("high", f"{high}D")).alias("tenth")
    there = source.groupBy(tenth).agg(F.count("*").alias("there"))
    drawn = sample.groupBy(tenth).agg(F.count("*").alias("drawn"))
    rows = F.sum("there").over(Window.partitionBy(F.lit(1))), F.sum("drawn").over(Window.partitionBy(F.lit(1)))
    ratio = F.col("drawn") / rows[1] / (F.col("there") / rows[0])
    both = there.join(drawn, "tenth", "left")
    return both.select("tenth", "there", F.coalesce(ratio.between(0.5, 2.0), F.lit(False)).alias("in_proportion"))


@query("uniform_sample_spread", SPREAD_SQL)
def uniform_sample_spread(spark, sf_dir):
    lineitem = table(spark, sf_dir, "lineitem")
    return spread(tc.uniform_sample(lineitem, 2000, seed=3), lineitem)


@query("hash_sample_spread", SPREAD_SQL)
def hash_sample_spread(spark, sf_dir):
    lineitem = table(spark, sf_dir, "lineitem")
    return spread(tc.hash_sample(lineitem, 2000, seed=3), lineitem)


@query("profiling_load_spread", SPREAD_SQL)
def profiling_load_spread(spark, sf_dir):
    lineitem = tc.load_table(spark, f"{sf_dir}/lineitem.parquet")
    return spread(tc.profiling_load(lineitem, max_rows=2000).df, lineitem)
