"""Rows that break rules, and the isolation of rules that raise."""

import pytest
from pyspark.sql import functions as F

import tablecheck as tc
from conftest import contract

RULES = [
    ("null_check", {"column": "customer_id"}),
    ("unique_check", {"column": "order_id"}),
    ("range_check", {"column": "amount", "min_val": 0}),
    ("allowed_values", {"column": "status", "values": ["shipped", "delivered", "pending", "cancelled"]}),
    ("min_row_count", {"min_rows": 100}),
    ("range_check", {"column": "no_such_column", "min_val": 0}),
    ("null_check", {"column": "amount"}),
]


def test_rows_and_their_rules(orders):
    found = tc.violating_rows(orders, contract(*RULES))
    rows = [(r["order_id"], r["customer_id"], [(b["ordinal"], b["rule_id"], b["column_name"]) for b in r["broken_rules"]]) for r in found.rows.collect()]
    assert sorted(rows) == [
        (1001, "C001", [(1, "unique_check", "order_id")]),
        (1001, "C002", [(1, "unique_check", "order_id")]),
        (1005, None, [(0, "null_check", "customer_id")]),
        (1008, None, [(0, "null_check", "customer_id")]),
        (1011, "C011", [(2, "range_check", "amount")]),
        (1013, "C013", [(6, "null_check", "amount")]),
        (1017, "C017", [(3, "allowed_values", "status")]),
    ]
    assert found.observation.get == {"row_count": 20, "v0": 2, "v1": 2, "v2": 1, "v3": 1, "v6": 1}
    assert set(found.left_out) == {4, 5} and "no_such_column" in found.left_out[5]
    assert found.rows.columns == [*orders.columns, "broken_rules"]


def test_row_rules_take_one_scan_and_no_shuffle(spark, orders, tmp_path):
    orders.write.parquet(str(tmp_path / "o"))
    df = spark.read.parquet(str(tmp_path / "o"))
    found = tc.violating_rows(df, contract(*[r for r in RULES if r[0] != "unique_check"]))
    plan = found.rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan


def test_long_texts_nan_and_nulls_that_repeat(spark):
    long = "x" * 500
    df = spark.createDataFrame([(1, long, float("nan")), (2, long, float("nan")), (3, long + "y", 0.0), (4, None, -0.0), (5, None, None)], "id int, s string, x double")
    found = tc.violating_rows(df, contract(("unique_check", {"column": "s"}), ("unique_check", {"column": "x"})), into="why")
    got = {r["id"]: [b["ordinal"] for b in r["why"]] for r in found.rows.collect()}
    assert got == {1: [0, 1], 2: [0, 1], 3: [1], 4: [1]}
    with pytest.raises(ValueError):
        tc.violating_rows(df.withColumn("why", F.lit(1)), contract(*RULES), into="why")


def test_no_rules_and_no_rows(orders, no_orders):
    assert tc.violating_rows(no_orders, contract(*RULES)).rows.count() == 0
    assert tc.violating_rows(orders, contract()).rows.count() == 0
    with pytest.raises(tc.ContractNotApprovedError):
        tc.violating_rows(orders, contract(*RULES, approved_at=None))


@pytest.fixture()
def raising():
    """Twelve registered rules, two of which raise while they run."""
    names = [f"own_{i}" for i in range(12)]
    for i, name in enumerate(names):
        bad = i in (3, 10)
        tc.register_rule(
            name, name=name, parameters={"column": tc.Param("str", True)},
            build=lambda df, column, bad=bad, i=i: F.col(column).cast("int") > 15 if bad else F.octet_length(column) > i,
        )
    yield names
    for name in names:
        tc.unregister_rule(name)


def test_isolation_by_halves(spark, orders, raising):
    tracker = spark.sparkContext.statusTracker()

    def jobs(names):
        spark.sparkContext.setJobGroup("isolated", "", False)
        before = set(tracker.getJobIdsForGroup("isolated"))
        rows = tc.run_contract(orders, contract(*[(n, {"column": "email"}) for n in names]))
        made = len(set(tracker.getJobIdsForGroup("isolated")) - before)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return rows.collect(), made

    good = [n for i, n in enumerate(raising) if i not in (3, 10)]
    rows, least = jobs(good[:1])
    rows, made = jobs(good)
    assert made == least and all(r["error"] is None for r in rows)  # ten rules in one job
    rows, _ = jobs(raising)
    assert [i for i, r in enumerate(rows) if r["error"]] == [3, 10]
    assert [r["violation_count"] is None for r in rows] == [i in (3, 10) for i in range(12)]
    assert all("CAST_INVALID_INPUT" in rows[i]["error"] for i in (3, 10))
    lengths = [len(r["email"]) for r in orders.collect()]
    assert [r["violation_count"] for i, r in enumerate(rows) if i not in (3, 10)] == [sum(n > i for n in lengths) for i in range(12) if i not in (3, 10)]
