"""Samples: exact sizes, spread, reproducibility, skew."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

import tablecheck as tc
from tablecheck.operators import sampling
from tablecheck.operators.sampling import sample_percent


def ids(df):
    return sorted(r[0] for r in df.collect())


def spread(sample, rows, parts=10):
    """How many of the sampled numbers fall into each part of their range."""
    counts = [0] * parts
    for i in sample:
        counts[i * parts // rows] += 1
    return counts


@pytest.mark.parametrize("n, rows", [(0, 0), (1, 1), (500, 500), (999, 999), (1000, 1000), (2000, 1000)])
def test_uniform_sample_size(spark, n, rows):
    sample = ids(tc.uniform_sample(spark.range(1000), n, seed=3))
    assert len(sample) == rows == len(set(sample))


@pytest.mark.parametrize("draw", [tc.uniform_sample, tc.hash_sample, lambda df, n, seed: tc.profiling_load(df, n, seed).df])
def test_samples_reach_every_part_of_the_table(spark, draw):
    rows, n = 200_000, 20_000
    df = spark.range(0, rows, 1, 4)
    sample = draw(df, n, seed=5)
    found = ids(sample)
    assert len(found) == len(set(found)) == n
    assert all(1800 < c < 2200 for c in spread(found, rows))
    # the sample keeps the partitions of the table
    assert sample.select(F.spark_partition_id()).distinct().count() == 4


def test_uniform_sample_is_reproducible_and_seeded(spark):
    df = spark.range(0, 20_000, 1, 4)
    one, same, other = (ids(tc.uniform_sample(df, 50, seed=s)) for s in (1, 1, 2))
    assert one == same != other
    assert len(one) == 50


def test_hash_sample_does_not_depend_on_partitioning(spark):
    df = spark.range(0, 5000).selectExpr("id", "id % 7 AS g")
    samples = [ids(tc.hash_sample(df.repartition(p), 200, seed=1)) for p in (1, 2, 8)]
    assert samples[0] == samples[1] == samples[2]
    assert len(set(samples[0])) == 200
    assert ids(tc.hash_sample(df, 200, seed=2)) != samples[0]


@pytest.mark.parametrize("n", [10, 900, 1500, 2999, 5000])
def test_hash_sample_with_a_row_that_fills_a_third_of_the_table(spark, n):
    df = spark.range(0, 3000).selectExpr("if(id % 3 = 0, -1, id) AS id")
    for seed in range(3):
        sample = ids(tc.hash_sample(df, n, seed=seed))
        assert len(sample) == min(n, 3000)
        others = [i for i in sample if i != -1]
        assert len(set(others)) == len(others)


def test_rows_of_one_key_are_sampled_uniformly(spark):
    df = spark.range(0, 20_000).selectExpr("id", "id % 2 AS k")
    found = ids(tc.hash_sample(df, 1000, key=["k"]))
    assert len(found) == 1000 and len({i % 2 for i in found}) == 1
    assert all(60 < c < 140 for c in spread(found, 20_000))
    assert found == ids(tc.hash_sample(df.repartition(5), 1000, key=["k"]))


def test_hash_sample_of_maps_and_of_nothing(spark):
    df = spark.range(0, 1000).selectExpr("id", "map('a', id) AS m")
    assert len(ids(tc.hash_sample(df.drop("m"), 10, key=["id"]))) == 10
    assert ids(tc.hash_sample(df.drop("m").where("id < 0"), 10, key=["id"])) == []


def test_profiling_load(spark):
    df = spark.range(0, 10_000, 1, 4)
    whole = tc.profiling_load(df, 10_000, estimate=10_000)
    assert (whole.sampled, whole.estimated_rows, whole.df, whole.method) == (False, 10_000, df, "whole")
    part = tc.profiling_load(df, 500, estimate=10_000)
    assert (part.sampled, part.df.count(), part.method) == (True, 500, "sample")
    assert ids(part.df) == ids(tc.profiling_load(df, 500, estimate=10_000).df)
    unknown = tc.profiling_load(df, 500)
    assert (unknown.sampled, unknown.estimated_rows, unknown.method) == (True, None, "sample")
    assert all(20 < c < 85 for c in spread(ids(unknown.df), 10_000))
    assert tc.profiling_load(df, 10_000).sampled is False
    prefix = tc.profiling_load(df, 500, prefix=True)
    assert (prefix.sampled, prefix.method, prefix.df.count()) == (True, "prefix", 500)


def test_sample_percent():
    assert sample_percent(50_000, 10_000_000) == pytest.approx(0.75)
    assert sample_percent(1, 10**12) == 0.000001
    assert sample_percent(900, 1000) == 100.0


@pytest.mark.parametrize("edge_rows, jobs", [(1_000_000, 2), (2, None)])
@pytest.mark.parametrize("n", [1, 77, 1500, 2999])
def test_hash_samples_are_the_smallest_keys_in_two_jobs(spark, monkeypatch, edge_rows, jobs, n):
    monkeypatch.setattr(sampling, "EDGE_ROWS", edge_rows)
    run, first = [], DataFrame.first
    monkeypatch.setattr(DataFrame, "first", lambda df: run.append(1) or first(df))
    df = spark.range(0, 3000, 1, 4).selectExpr("if(id % 3 = 0, -1, id) AS id", "id % 5 AS part")
    sample = tc.hash_sample(df, n, seed=4, key=["id"])
    assert jobs is None or len(run) <= jobs
    hashed = df.select(F.xxhash64(F.lit(4), "id"), F.xxhash64(F.lit(5), "id", "part"), "id", "part").collect()
    want = sorted(tuple(k)[2:] for k in sorted(hashed, key=lambda k: [x % (1 << 64) for x in k[:2]])[:n])
    assert sorted(map(tuple, sample.collect())) == want
