"""Distinct values in bitmaps, duplicates in two stages."""

import datetime
import decimal

import pytest
from pyspark.sql import functions as F

import tablecheck as tc
from conftest import SF_DIR, check
from tablecheck.operators import duplicates
from tablecheck.operators.bitmaps import Bitmaps, distinct_values
from tablecheck.operators.frequency import Frequencies, frequencies

LONGS = [0, 1, 63, 64, -1, -64, -65, 2**63 - 1, -(2**63), 2**63 - 1, 0, None, None, 5, 5, 5]


def test_bits_of_whole_numbers_days_and_instants(spark):
    day, at = datetime.date(1969, 12, 31), datetime.datetime(1969, 12, 31, 23, 59, 59, 999999)
    rows = [(v, None if v is None else v % 100, day + datetime.timedelta(days=(v or 0) % 70), at, str(v)) for v in LONGS]
    df = spark.createDataFrame(rows, "l long, b byte, d date, t timestamp, s string").repartition(4)
    got = {r["column_name"]: tuple(r)[1:] for r in tc.distinct_counts(df).collect()}
    for i, name in enumerate(df.columns):
        values = [r[i] for r in rows]
        present = [v for v in values if v is not None]
        assert got[name] == (len(values), len(present), len(set(present)))
    kinds = [type(p) for p in distinct_values(df)]
    assert kinds == [Bitmaps, Frequencies]


@pytest.mark.parametrize("columns", [["l"], ["s", "l", "l2"], ["l2", "s"]])
def test_slots_and_surplus(spark, columns):
    df = spark.createDataFrame([(v, str(v), (v or 0) % 3) for v in LONGS], "l long, s string, l2 int")
    surplus = {}
    for part in distinct_values(df, columns):
        row = part.surplus().first()
        assert row["n"] == len(LONGS)
        surplus |= {columns[slot]: row[f"s{slot}"] for slot, _ in part.columns}
    assert surplus == {c: {"l": 4, "s": 5, "l2": 13}[c] for c in columns}
    empty = distinct_values(df.limit(0), columns)
    assert all(set(p.surplus().first()) == {0} for p in empty)
    assert sum(p.distinct().count() for p in empty) == 0


def test_unique_rule_counts_copies(spark):
    df = spark.createDataFrame([(v,) for v in LONGS], "l long")
    assert check(df, "unique_check", column="l")["violation_count"] == 4


def _exchanged(frame):
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan()
    return _shuffle_bytes(plan)


def _shuffle_bytes(plan) -> int:
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return _shuffle_bytes(plan.executedPlan())
    if name.endswith("QueryStageExec"):
        return _shuffle_bytes(plan.plan())
    own = plan.metrics().apply("dataSize").value() if name == "ShuffleExchangeExec" else 0
    children = plan.children()
    return own + sum(_shuffle_bytes(children.apply(i)) for i in range(children.size()))


def test_dense_keys_exchange_a_fraction(spark):
    """Order keys travel up to 64 to a row."""
    rows = spark.read.parquet(f"{SF_DIR}/lineitem.parquet").select("l_orderkey")
    bits = distinct_values(rows)[0].distinct()
    values = frequencies(rows)[0].distinct()
    assert bits.collect() == values.collect()
    assert 0 < _exchanged(bits) < _exchanged(values) / 4


def test_duplicates_of_many_types(spark):
    row = (1, 2.5, decimal.Decimal("1.50"), "x" * 100, True, datetime.date(2020, 1, 1), bytearray(b"ab"), [1, 2], {"k": 1})
    other = (*row[:7], [1, 3], {"k": 1})
    schema = "a int, b double, c decimal(9,2), d string, e boolean, f date, g binary, h array<int>, i map<string,int>"
    df = spark.createDataFrame([row, row, other, row, (*[None] * 9,), (*[None] * 9,)], schema)
    assert tuple(tc.duplicate_rows(df).first()) == (6, 3)
    assert tuple(tc.duplicate_rows(df.select("h")).first()) == (6, 3)
    assert tuple(tc.duplicate_rows(df.limit(0)).first()) == (0, 0)


def test_equal_hashes_are_told_apart(spark, monkeypatch):
    """Rows that pass the filter by chance are counted as what they are."""
    monkeypatch.setattr(duplicates, "_is_hashed", lambda data_type: data_type.simpleString() == "int")
    df = spark.createDataFrame([(i % 3, f"t{i % 50}") for i in range(120)], "a int, b string")
    assert tuple(tc.duplicate_rows(df).first()) == (120, 0)
    assert tuple(tc.duplicate_rows(df.union(df)).first()) == (240, 120)
    monkeypatch.setattr(duplicates, "FILTER_WORDS_LOG2", 1)
    assert tuple(tc.duplicate_rows(df.union(df)).first()) == (240, 120)


def test_table_without_duplicates_is_not_read_again(spark):
    df = spark.read.parquet(f"{SF_DIR}/orders.parquet")
    result = tc.duplicate_rows(df)
    assert result.collect()[0]["duplicate_row_count"] == 0
    final = str(result._jdf.queryExecution().executedPlan().toString()).split("Initial Plan")[0]
    assert final.count("FileScan") == 1 and "EmptyRelation" in final


def test_zeros_of_both_signs_are_one(spark):
    df = spark.createDataFrame([(0.0, "a"), (-0.0, "a"), (float("nan"), "b"), (float("nan"), "b")], "x double, y string")
    assert tuple(tc.duplicate_rows(df).first()) == (4, 2)
    assert tuple(tc.duplicate_rows(df.withColumn("x", F.col("x").cast("float"))).first()) == (4, 2)
