"""Statistics from Parquet footers: right values, no column read, a way out without statistics."""

import datetime

import pytest
from pyspark.sql import functions as F

import tablecheck as tc
from tablecheck.sources import footers

SCHEMA = "i int, l long, d date, b boolean, f double, s string, t timestamp, a array<int>, `odd.name` int"


@pytest.fixture
def files(spark, tmp_path):
    day, now = datetime.date(2024, 2, 29), datetime.datetime(2024, 1, 1)
    rows = [(k, 1 << 40, day, k > 3, float("nan"), "x" * 200, now, [k], -k) for k in range(10)]
    rows += [(None, None, None, None, None, None, None, None, None), (11, -5, None, None, 1.0, "", now, [], 7)]
    path = str(tmp_path / "t.parquet")
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(path)
    return path


def statistics(df):
    return {r["column_name"]: tuple(r)[1:] for r in df.collect()}


def test_statistics(spark, files):
    assert statistics(tc.footer_statistics(spark, files)) == {
        "i": (12, 1, "0", "11"),
        "l": (12, 1, "-5", str(1 << 40)),
        "d": (12, 2, "2024-02-29", "2024-02-29"),
        "b": (12, 2, "false", "true"),
        "f": (12, 1, None, None),
        "s": (12, 1, None, None),
        "t": (12, 1, None, None),
        "a": (12, None, None, None),
        "odd.name": (12, 1, "-9", "7"),
    }
    assert list(statistics(tc.footer_statistics(spark, files, ["l"]))) == ["l"]


def test_no_column_is_read(spark, files):
    df = footers.footer_aggregate(spark, files, ["l", "s", "f"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedAggregation: [")[1].split("]")[0]
    assert "COUNT(*)" in pushed and "MIN(l)" in pushed and "COUNT(s)" in pushed
    assert "MIN(s)" not in pushed and "MIN(f)" not in pushed
    # the settings of the session itself stay
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"


def test_row_groups_without_extremes(spark, tmp_path):
    path = str(tmp_path / "n.parquet")
    spark.range(5).selectExpr("cast(null as int) AS i", "id").coalesce(1).write.parquet(path)
    assert statistics(tc.footer_statistics(spark, path)) == {"i": (5, 5, None, None), "id": (5, 0, "0", "4")}


def test_empty_and_missing_files(spark, tmp_path):
    path = str(tmp_path / "e.parquet")
    spark.range(0).write.parquet(path)
    assert statistics(tc.footer_statistics(spark, path)) == {"id": (0, 0, None, None)}
    assert tc.estimate_file_rows(spark, path) == 0
    with pytest.raises(FileNotFoundError):
        tc.footer_statistics(spark, str(tmp_path / "none.parquet"))


def test_loads_sized_by_footers(spark, tmp_path):
    path = str(tmp_path / "r.parquet")
    spark.range(0, 5000, 1, 3).write.parquet(path)
    whole, part = tc.load_file_profiling(spark, path, 5000), tc.load_file_profiling(spark, path, 40, seed=2)
    assert (whole.sampled, whole.estimated_rows, whole.df.count()) == (False, 5000, 5000)
    assert (part.sampled, part.estimated_rows, part.df.count()) == (True, 5000, 40)
    assert part.df.agg(F.countDistinct("id")).first()[0] == 40
