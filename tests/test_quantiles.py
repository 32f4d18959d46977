"""Order statistics against sorting."""

import math
import random

import pytest

import tablecheck as tc
from tablecheck.operators import quantiles as Q

QS = (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0)


def expected(values, q):
    ranked = sorted(values, key=lambda v: (math.isnan(v), v))
    return ranked[math.floor(q * (len(ranked) - 1) + 0.5)]


def found(df, columns, qs=QS):
    return {(r.slot, r.q): r.value for r in tc.order_statistics(df, columns, qs).collect()}


def compare(spark, *columns):
    rows = list(zip(*columns))
    names = [f"c{i}" for i in range(len(columns))]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).repartition(3)
    got = found(df, names)
    for i, values in enumerate(columns):
        present = [v for v in values if v is not None]
        for q in QS:
            want = expected(present, q)
            have = got[(i, q)]
            assert have == want or (math.isnan(have) and math.isnan(want)), (i, q)


def test_distributions(spark):
    rng = random.Random(5)
    n = 3001
    uniform = [rng.uniform(-5, 5) for _ in range(n)]
    magnitudes = [rng.choice((-1, 1)) * 10.0 ** rng.uniform(-300, 300) for _ in range(n)]
    hot = [7.0 if rng.random() < 0.4 else rng.gauss(0, 1) for _ in range(n)]
    outliers = [rng.random() for _ in range(n - 2)] + [1e300, -1e300]
    close = [1.0 + rng.randrange(50) * 2.0**-52 for _ in range(n)]
    cents = [rng.randrange(10_000) / 100 for _ in range(n)]
    nulls = [None if rng.random() < 0.7 else float(rng.randrange(9)) for _ in range(n)]
    special = [rng.choice((math.inf, -math.inf, math.nan, 0.0, -0.0, 5e-324)) for _ in range(n)]
    compare(spark, uniform, magnitudes, hot, outliers, close, cents, nulls, special)


@pytest.mark.parametrize("values", [[3.0], [2.0, 1.0], [1.0, 1.0, 1.0], [0.0, 0.0, -1.0]])
def test_few_values(spark, values):
    compare(spark, values)


def test_integers_decimals_and_rank_rule(spark):
    df = spark.range(1, 21).selectExpr("id", "CAST(id AS DECIMAL(20, 2)) AS d", "CAST(id AS SMALLINT) AS s")
    got = found(df, ["id", "d", "s"], (0.25, 0.5, 0.75))
    # ranks 4.75, 9.5 and 14.25 round half up to 5, 10 and 14
    assert all(got[(i, q)] == v for i in range(3) for q, v in ((0.25, 6), (0.5, 11), (0.75, 15)))


def test_no_values(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0)], "a double, b double")
    assert set(found(df, ["a", "b"], (0.5,))) == {(1, 0.5)}


def test_buckets_are_monotone(spark):
    from pyspark.sql import functions as F

    rng = random.Random(9)
    values = [s * 2.0**e * m for s in (-1, 1) for e in range(-1074, 1024, 7)
              for m in (1.0, 1.0 + 2**-52, 1.999, rng.uniform(1, 2))]
    values = [v for v in values if math.isfinite(v)] + [0.0, math.inf, -math.inf]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    rows = sorted((r.v, r.b) for r in df.select("v", Q._ratio_bucket(F.col("v")).alias("b")).collect())
    buckets = [b for _, b in rows]
    assert buckets == sorted(buckets)
    assert len(set(buckets)) <= 4 * Q._OFFSET
