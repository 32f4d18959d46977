"""Samples of a DataFrame: exact in size, uniform, sized for profiling.

Every row gets a key of random or hashed bits, and the sample is the rows with the n smallest
keys. The n-th smallest is found by counting rows per range of keys, so the sample is a filter on
the table: it keeps the partitions of the table, has no prefix, whatever n is. Finding it runs two
counting jobs, now; the sample itself is lazy. The first counts 2 ** 16 ranges, the second the keys
of the range where the sample ends. Only where that range has more than ``EDGE_ROWS`` rows, as one
key value fills much of the table, it is cut into ranges again before its keys are counted.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from tablecheck.functions.columns import quoted

# A block sample of a database aims at this multiple of the wanted rows before
# the exact cut, and never below this percentage.
OVERSHOOT = 1.5
MIN_PERCENT = 0.000001

# The most rows whose keys are ordered in one task.
EDGE_ROWS = 1_000_000

_DIGIT_BITS = 16
_KEY_BITS = 64
_SIGN = -(1 << 63)


class ProfilingLoad(NamedTuple):
    """A table sized for profiling, whether it is a sample, and the estimate behind it.

    ``method`` says how it was read: ``whole``, ``sample`` (uniform) or ``prefix`` (the first
    rows in storage order, only where that was asked for).
    """

    df: DataFrame
    sampled: bool
    estimated_rows: int | None
    method: str = "sample"


def sample_percent(max_rows: int, estimate: int) -> float:
    """Share of the table to draw so that ``max_rows`` rows are very likely to come out."""
    wanted = max_rows / estimate * 100.0 * OVERSHOOT
    return min(100.0, max(MIN_PERCENT, wanted))


class _Cut(NamedTuple):
    """Where the n smallest keys end: ``below`` holds for rows that are in, ``at`` for rows with
    the last key, of which ``more`` are in. ``at`` is None where all rows fit exactly."""

    below: Column
    at: Column | None
    more: int


def _cut(keyed: DataFrame, keys: list[str], n: int) -> _Cut | None:
    """The cut after the n smallest keys; None if there are no more rows than n."""
    below, at, done = F.lit(False), F.lit(True), 0
    for key in keys:
        for shift in range(_KEY_BITS - _DIGIT_BITS, -1, -_DIGIT_BITS):
            digit = F.shiftrightunsigned(key, shift).bitwiseAND((1 << _DIGIT_BITS) - 1)
            held = keyed.where(at).groupBy(digit.alias("digit")).agg(F.count("*").alias("held"))
            upto = F.sum("held").over(Window.orderBy("digit"))
            first = held.withColumn("upto", upto).where(F.col("upto") >= n - done).orderBy("digit").first()
            if first is None:
                return None
            done += first["upto"] - first["held"]
            below, at = below | (at & (digit < first["digit"])), at & (digit == first["digit"])
            if done + first["held"] == n:
                return _Cut(below | at, None, 0)
            if first["held"] <= EDGE_ROWS:
                return _edge(keyed, keys, below, at, n - done)
    return _Cut(below, at, n - done)


def _edge(keyed: DataFrame, keys: list[str], below: Column, at: Column, n: int) -> _Cut:
    """The cut after the n smallest keys of the rows ``at``, besides all rows ``below``."""
    # Keys are compared without sign, as their ranges are.
    order = [F.col(k).bitwiseXOR(F.lit(_SIGN)) for k in keys]
    held = keyed.where(at).groupBy(*keys).agg(F.count("*").alias("held"))
    upto = held.withColumn("upto", F.sum("held").over(Window.orderBy(*order)))
    last = upto.where(F.col("upto") >= n).orderBy(*order).first()
    smaller, same = F.lit(False), F.lit(True)
    for key, place in zip(keys, order):
        smaller = smaller | (same & (place < F.lit(last[key] ^ _SIGN)))
        same = same & (F.col(key) == F.lit(last[key]))
    if last["upto"] == n:
        return _Cut(below | (at & (smaller | same)), None, 0)
    return _Cut(below | (at & smaller), at & same, n - (last["upto"] - last["held"]))


def uniform_sample(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows, or all if there are fewer; every row equally likely.

    The same rows for the same input files, partitioning and seed.
    """
    if n <= 0:
        return df.where(F.lit(False))
    bits = [F.floor(F.rand(seed + i) * F.lit(float(1 << 31))).cast("long") for i in (0, 1)]
    keyed = df.withColumn("__key", F.shiftleft(bits[0], 31).bitwiseOR(bits[1]))
    cut = _cut(keyed.select("__key"), ["__key"], n)
    if cut is None:
        return df
    # 62 random bits: rows that tie with the last one are as good as excluded.
    kept = keyed.where(cut.below if cut.at is None else cut.below | cut.at)
    return kept.drop("__key")


def hash_sample(df: DataFrame, n: int, seed: int = 0, key: list[str] | None = None) -> DataFrame:
    """``n`` rows chosen by a hash of their content: the same rows under any partitioning.

    ``key`` names the columns that are hashed (default all); rows that agree in them follow one
    another in the order of a hash of the whole row. Only rows equal to the last one are
    grouped: they are counted in the tasks that read them, and as many as needed are restored.
    """
    if n <= 0:
        return df.where(F.lit(False))
    names = [quoted(c) for c in df.columns]
    by_key = F.xxhash64(F.lit(seed), *[quoted(c) for c in key or df.columns])
    whole = F.xxhash64(F.lit(seed + 1), *names)
    keyed = df.withColumns({"__key": by_key, "__row": whole})
    cut = _cut(keyed.select("__key", "__row"), ["__key", "__row"], n)
    if cut is None:
        return df
    kept = keyed.where(cut.below).select(*names)
    if cut.at is None:
        return kept
    last = keyed.where(cut.at).groupBy(*names).agg(F.count("*").alias("__n"))
    # One kind of row here, but for collisions of both hashes.
    upto = F.sum("__n").over(Window.orderBy(F.sha2(F.to_json(F.struct(*names)), 256)))
    copies = F.least(F.col("__n"), F.lit(cut.more) - upto + F.col("__n"))
    last = last.withColumn("__copies", copies).where(F.col("__copies") > 0)
    last = last.withColumn("__i", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__copies"))))
    return kept.union(last.select(*names))


def profiling_load(
    df: DataFrame, max_rows: int, seed: int = 0, estimate: int | None = None, prefix: bool = False
) -> ProfilingLoad:
    """The whole table if it has at most ``max_rows`` rows, else a uniform sample of that many.

    Without an estimate the rows are counted. ``prefix`` asks for the first rows in storage order
    where there is no estimate, which reads no more than it returns and is no sample.
    """
    if estimate is None and prefix:
        return ProfilingLoad(df.limit(max_rows), True, None, "prefix")
    if (df.count() if estimate is None else estimate) <= max_rows:
        return ProfilingLoad(df, False, estimate, "whole")
    return ProfilingLoad(uniform_sample(df, max_rows, seed), True, estimate)
