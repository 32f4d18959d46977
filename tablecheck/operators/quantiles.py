"""Exact order statistics of many columns without sorting or collecting a column.

The row of rank ``k`` is found by narrowing value intervals: count the values per bucket of
a monotone bucketing, pick the bucket that holds rank ``k``, and bucket its interval again.
Each step is a counting aggregation with a bounded number of groups, done mostly in the map
tasks, so neither a hot value nor a skewed distribution makes a large group anywhere.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tablecheck.functions.columns import chunks, quoted

QUARTILES = (0.25, 0.5, 0.75)

# Columns narrowed together; more are done in several groups.
COLUMNS_PER_SCAN = 40

# First step: buckets of equal ratio, SLICES per power of two. Doubles span the powers
# -1074 .. 1023, so there are at most about 69,000 buckets per column.
SLICES = 16
_OFFSET = 1075 * SLICES

# Later steps: SLOTS equal parts of the interval. After two of them fewer than 2**20
# distinct doubles can be left in it, whatever the data (52 mantissa bits, less 4 from the
# first step and 16 from each later one, plus rounding).
SLOTS = 65_536
STEPS = 2


def _ratio_bucket(v: Column) -> Column:
    size = F.floor(F.log2(F.abs(v)) * SLICES) + _OFFSET
    top = _OFFSET * 2
    return (
        F.when(F.isnan(v), top + 1)
        .when(v == float("inf"), top)
        .when(v == float("-inf"), -top)
        .when(v == 0, 0)
        .when(v > 0, size)
        .otherwise(-size)
    )


def _slot(v: Column, lo: Column, hi: Column) -> Column:
    part = F.floor((v - lo) / (hi - lo) * SLOTS)
    return F.when(hi > lo, F.least(part, F.lit(SLOTS - 1))).otherwise(F.lit(0))


def _pick(counted: DataFrame, group: list[str], order: str) -> DataFrame:
    """Keep, per group, the bucket that contains ``rank``; make ``rank`` relative to it."""
    before = Window.partitionBy(*group).orderBy(order).rowsBetween(
        Window.unboundedPreceding, -1
    )
    return (
        counted.withColumn("below", F.coalesce(F.sum("cnt").over(before), F.lit(0)))
        .where((F.col("rank") >= F.col("below")) & (F.col("rank") < F.col("below") + F.col("cnt")))
        .withColumn("rank", F.col("rank") - F.col("below"))
    )


def order_statistics(
    df: DataFrame, columns: list[str], quantiles: tuple[float, ...] = QUARTILES
) -> DataFrame:
    """``slot, q, value``: per numeric column (numbered from 0 in the given order) and
    quantile the non-null value whose 0-based rank is ``q * (n - 1)`` rounded half up, as
    double. Columns without non-null values have no rows. NaN ranks above every number.
    """
    groups = chunks(list(enumerate(columns)), COLUMNS_PER_SCAN)
    return reduce(DataFrame.union, [_narrowed(_values(df, group), quantiles) for group in groups])


def _values(df: DataFrame, columns: list[tuple[int, str]]) -> DataFrame:
    # one narrow row per value; the scan reads the numeric columns only
    pairs = [
        F.struct(F.lit(i).alias("slot"), quoted(c).cast("double").alias("v"))
        for i, c in columns
    ]
    values = df.select(F.inline(F.array(*pairs))).where(F.col("v").isNotNull())
    return values.withColumn("cnt", F.lit(1).cast("bigint"))


def _narrowed(values: DataFrame, quantiles: tuple[float, ...]) -> DataFrame:
    """The order statistics of rows ``slot, v, cnt``: a value as often as it counts."""
    tally = [F.sum("cnt").alias("cnt"), F.min("v").alias("lo"), F.max("v").alias("hi")]

    buckets = values.groupBy("slot", _ratio_bucket(F.col("v")).alias("bucket")).agg(*tally)
    n = F.sum("cnt").over(Window.partitionBy("slot"))
    target = F.floor(F.col("q") * (F.col("n") - 1) + 0.5)
    ranked = (
        buckets.withColumn("n", n)
        .withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in quantiles])))
        .withColumn("rank", target)
    )
    picked = _pick(ranked, ["slot", "q"], "bucket")

    for _ in range(STEPS):
        inside = _inside(values, picked)
        slot = _slot(F.col("v"), F.col("from"), F.col("to")).alias("bucket")
        counted = inside.groupBy("slot", "q", "rank", slot).agg(*tally)
        picked = _pick(counted, ["slot", "q"], "bucket")

    inside = _inside(values, picked)
    counted = inside.groupBy("slot", "q", "rank", "v").agg(F.sum("cnt").alias("cnt"))
    found = _pick(counted, ["slot", "q"], "v")
    return found.select("slot", "q", F.col("v").alias("value"))


def _inside(values: DataFrame, picked: DataFrame) -> DataFrame:
    # one interval per column and quantile, so the broadcast side never grows with the data
    intervals = picked.select("slot", "q", "rank", F.col("lo").alias("from"), F.col("hi").alias("to"))
    return values.join(F.broadcast(intervals), "slot").where(
        (F.col("v") >= F.col("from")) & (F.col("v") <= F.col("to"))
    )


def quartiles(df: DataFrame, columns: list[str]) -> DataFrame:
    """``slot, p25, p50, p75`` per numeric column."""
    return _by_slot(order_statistics(df, columns, QUARTILES))


def counted_quartiles(values: DataFrame) -> DataFrame:
    """The same from rows ``slot, v, cnt`` of distinct values that are counted already."""
    return _by_slot(_narrowed(values, QUARTILES))


def _by_slot(stats: DataFrame) -> DataFrame:
    return stats.groupBy("slot").agg(
        *[
            F.max(F.when(F.col("q") == q, F.col("value"))).alias(name)
            for q, name in zip(QUARTILES, ("p25", "p50", "p75"))
        ]
    )
