"""Profiles, redaction and suggestions."""

import datetime

import pytest
from pyspark.sql import functions as F

import tablecheck as tc
from tablecheck.operators.schema import fingerprint
from conftest import EMAIL, ROWS, run


def by_name(columns) -> dict:
    return {r["name"]: r for r in columns.collect()}


@pytest.fixture(scope="module")
def report(orders):
    return tc.profile(orders, "orders", profiled_at=datetime.date(2026, 6, 12))


@pytest.fixture(scope="module")
def columns(report):
    return by_name(report.columns)


def profiled(spark, schema, *rows, **options):
    return by_name(tc.profile_columns(spark.createDataFrame(list(rows), schema), **options))


# --- table ---


def test_table(report):
    row = report.table.first()
    assert (row.dataset, row.row_count, row.duplicate_row_count) == ("orders", ROWS, 0)
    assert (row.redacted, row.sampled) == (False, False)
    assert row.profiled_at == datetime.datetime(2026, 6, 12)


def test_duplicate_rows(spark):
    df = spark.createDataFrame([(1, "x")] * 3 + [(2, "y")], "a bigint, b string")
    assert tuple(tc.duplicate_rows(df).first()) == (4, 2)
    assert tuple(tc.duplicate_rows(df.where("a > 5")).first()) == (0, 0)


def test_duplicate_rows_null_nan_zero_and_nested(spark):
    df = spark.sql(
        "SELECT * FROM VALUES (NULL, 0.0D, map('a', 1)), (NULL, -0.0D, map('a', 1)),"
        " (1, double('NaN'), map()), (1, double('NaN'), map()), (1, NULL, map()) AS t(a, b, c)"
    )
    assert tc.duplicate_rows(df).first().duplicate_row_count == 2


@pytest.mark.parametrize("width", [3, 20])
def test_duplicate_rows_keeps_neighbouring_values_apart(spark, width):
    padding = ", ".join(f"0 AS p{i}" for i in range(width - 3))
    df = spark.sql(
        f"SELECT *{', ' + padding if padding else ''} FROM VALUES ('ab', 'c', NULL), ('a', 'bc', NULL),"
        " ('a', 'bc', NULL), ('ab', NULL, 'c'), (NULL, 'ab', 'c'), ('1:a', '', 'n') AS t(x, y, z)"
    )
    assert tc.duplicate_rows(df).first().duplicate_row_count == 1


def test_fingerprint(orders):
    same = tc.profile_table(orders, "other", sampled=True).first().schema_fingerprint
    assert same == tc.fingerprint(orders.schema) and len(same) == 16
    assert tc.fingerprint(orders.withColumnRenamed("amount", "total").schema) != same
    assert tc.fingerprint(orders.withColumn("amount", F.lit(1)).schema) != same


# --- columns ---


def test_columns_in_order(report, orders):
    rows = report.columns.collect()
    assert [r.name for r in rows] == orders.columns
    assert [r["ordinal"] for r in rows] == list(range(len(orders.columns)))
    assert rows[0].dtype == "bigint"


def test_rates(columns):
    assert columns["customer_id"].null_rate == 2 / ROWS
    assert columns["order_id"].null_rate == 0.0
    assert columns["order_id"].uniqueness_ratio == 19 / 20
    assert columns["customer_id"].uniqueness_ratio == 1.0


def test_numbers(columns):
    amount = columns["amount"]
    assert (amount.min, amount.max, amount.min_num, amount.max_num) == ("-50.0", "300.0", -50, 300)
    values = [99.99, 149.5, 25, 200, 75, 50, 300, 120, 89.99, 45, -50, 175, 60, 90, 130, 55, 210, 40, 95]
    mean = sum(values) / len(values)
    std = (sum((v - mean) ** 2 for v in values) / (len(values) - 1)) ** 0.5
    assert amount.numeric.mean == pytest.approx(mean)
    assert amount.numeric.std == pytest.approx(std)
    ranked = sorted(values)
    picks = [ranked[int(q * (len(values) - 1) + 0.5)] for q in (0.25, 0.5, 0.75)]
    assert [amount.numeric.p25, amount.numeric.p50, amount.numeric.p75] == picks


def test_times_and_texts(columns):
    created = columns["created_at"]
    assert (created.min, created.max, created.numeric) == ("2020-01-15", "2026-06-05", None)
    status = columns["status"]
    assert (status.min, status.max, status.min_num, status.numeric) == (None,) * 4


def test_top_values(columns):
    assert [tuple(t) for t in columns["status"].top_values] == [
        ("delivered", 6), ("shipped", 6), ("pending", 4), ("cancelled", 3), ("refunded", 1),
    ]
    assert columns["order_id"].top_values[0] == ("1001", 2)


def test_hints(columns):
    assert {name: c.semantic_hint for name, c in columns.items()} == {
        "order_id": "id", "customer_id": "id", "email": "email", "amount": None,
        "status": None, "created_at": "date", "phone": "phone",
    }
    assert all(c.inferred_dtype is None for c in columns.values())


@pytest.mark.parametrize(
    "days, hint",
    [
        (["2026-01-01", "2026-01-02", "not a date"], None),
        (["2026-01-01", "2026-01-02", "2026-01-03"], "date"),
    ],
)
def test_date_hint(spark, days, hint):
    columns = profiled(spark, "event_day string", *[(d,) for d in days])
    assert columns["event_day"].semantic_hint == hint


@pytest.mark.parametrize(
    "name, is_id",
    [("id", True), ("order_id", True), ("x-ID", True), ("customerId", False), ("paid", False)],
)
def test_id_hint(spark, name, is_id):
    columns = by_name(tc.profile_columns(spark.range(3).withColumnRenamed("id", name)))
    assert (columns[name].semantic_hint == "id") is is_id


def test_hidden_types(spark):
    columns = profiled(
        spark, "count string, weight string, day string, label string, mixed string",
        ("1", "1.5", "2026-01-01", "alpha", "1"), ("2", "2.0", "2026-01-02", "beta", "2"),
        ("3", "3.25", "2026-01-03", "gamma", "x"), ("4", "4", "2026-01-04", "delta", "y"),
    )
    assert {n: c.inferred_dtype for n, c in columns.items()} == {
        "count": "Int64", "weight": "Float64", "day": "Date", "label": None, "mixed": None,
    }
    assert columns["count"].inferred_match_rate == 1.0
    assert columns["mixed"].inferred_match_rate is None


def test_empty_table(no_orders):
    report = tc.profile(no_orders, "orders")
    row = report.table.first()
    assert (row.row_count, row.duplicate_row_count) == (0, 0)
    rows = report.columns.collect()
    assert len(rows) == 7
    for c in rows:
        assert c.null_rate is None and c.uniqueness_ratio is None and c.top_values == []
        assert c.numeric is None and c["min"] is None


def test_all_null_columns(spark):
    columns = profiled(spark, "x string, y double, z array<int>", (None,) * 3, (None,) * 3)
    for c in columns.values():
        assert (c.null_rate, c.uniqueness_ratio, c.semantic_hint, c.top_values) == (1.0, None, None, [])


def test_many_types(spark):
    df = spark.sql(
        """SELECT * FROM VALUES
        (CAST(1 AS TINYINT), 1.50BD, CAST(1.5 AS FLOAT), true, X'00FF', array(1, 2),
         named_struct('a', 1), map('k', 1), TIMESTAMP_NTZ'2026-01-01 10:00:00.25',
         TIMESTAMP'2026-01-01 10:00:00', INTERVAL '1' DAY, 'a'),
        (CAST(2 AS TINYINT), 2.50BD, CAST('NaN' AS FLOAT), false, X'00FF', array(1, 2),
         named_struct('a', 2), map('k', 1), TIMESTAMP_NTZ'2026-01-02 00:00:00',
         TIMESTAMP'2026-01-02 00:00:00', INTERVAL '2' DAY, NULL)
        AS t(tiny, deci, flo, boo, bin, arr, str, ma, ntz, ltz, inter, txt)"""
    )
    c = by_name(tc.profile_columns(df))
    assert (c["tiny"].min_num, c["deci"].max_num, c["deci"].min) == (1, 2.5, "1.50")
    assert (c["flo"].min_num, c["flo"].max_num) == (1.5, 1.5)  # NaN is neither
    assert c["flo"].numeric.mean != c["flo"].numeric.mean  # but the mean is NaN
    assert c["ntz"].min == "2026-01-01T10:00:00.250000" and c["ntz"].max == "2026-01-02T00:00:00"
    assert c["ltz"].min == "2026-01-01T10:00:00"
    assert {c[n].semantic_hint for n in ("ntz", "ltz", "inter")} == {"date"}
    ratios = {n: c[n].uniqueness_ratio for n in ("boo", "bin", "arr", "str", "ma")}
    assert ratios == {"boo": 1.0, "bin": 0.5, "arr": 0.5, "str": 1.0, "ma": 0.5}
    assert [tuple(t) for t in c["bin"].top_values] == [("00FF", 2)]
    assert by_name(tc.profile_columns(df, approx=True))["tiny"].min_num == 1


def test_odd_names_and_many_columns(spark):
    names = ["a b.c", "x`y", "it's", *[f"n{i}" for i in range(45)]]
    df = spark.createDataFrame([tuple(range(48)), tuple(range(48))], names)
    columns = by_name(tc.profile_columns(df))
    assert list(columns) == names
    for i, name in enumerate(names):
        c = columns[name]
        assert (c.min_num, c.distinct_count, c.numeric.p50) == (i, 1, i)
        assert [tuple(t) for t in c.top_values] == [(str(i), 2)]


def test_long_texts_are_shown_whole(spark):
    long, other = "w " * 500, "v " * 500
    columns = profiled(spark, "t string", (long,), (long,), (other,), ("short",))
    assert [tuple(t) for t in columns["t"].top_values][0] == (long, 2)
    assert {t.value for t in columns["t"].top_values} == {long, other, "short"}


def test_hint_sample(orders):
    columns = by_name(tc.profile_columns(orders, hint_sample_rows=5))
    assert columns["email"].row_count == ROWS
    assert columns["email"].semantic_hint == "email"
    assert columns["order_id"].uniqueness_ratio == 19 / 20


def test_sampled(orders):
    report = tc.profile(orders, "orders", sampled=True)
    row = report.table.first()
    assert (row.sampled, row.duplicate_row_count, row.row_count) == (True, None, ROWS)
    assert by_name(report.columns)["amount"]["min"] == "-50.0"


def test_approx(orders, columns):
    approx = by_name(tc.profile_columns(orders, approx=True))
    for name, exact in columns.items():
        assert approx[name].null_rate == exact.null_rate
        assert approx[name].uniqueness_ratio == pytest.approx(exact.uniqueness_ratio, abs=0.1)
        assert approx[name]["min"] == exact["min"]
        assert approx[name].semantic_hint == exact.semantic_hint
    assert sorted(approx["status"].top_values) == sorted(columns["status"].top_values)


def test_approx_reads_the_table_once_without_shuffling_values(spark, tmp_path, orders, capsys):
    orders.write.parquet(str(tmp_path / "o"))
    tc.profile_columns(spark.read.parquet(str(tmp_path / "o")), approx=True).explain()
    plan = capsys.readouterr().out
    # the lists of top values are read again for the long texts among them, and the texts once
    assert plan.count("FileScan") <= 4
    plain = spark.read.parquet(str(tmp_path / "o")).drop("customer_id", "email", "status", "phone")
    tc.profile_columns(plain, approx=True).explain()
    plan = capsys.readouterr().out
    assert plan.count("FileScan") == 1
    # the only exchange by key merges the report rows
    assert plan.count("hashpartitioning") == plan.count("hashpartitioning(ordinal") == 1


def test_exact_profile_shares_the_frequency_shuffle(spark, tmp_path, orders, capsys):
    numbers = orders.select("order_id", "amount", "created_at")
    numbers.write.parquet(str(tmp_path / "o"))
    profiled = tc.profile_columns(spark.read.parquet(str(tmp_path / "o")))
    profiled.collect()
    profiled.explain()
    plan = capsys.readouterr().out.split("Initial Plan")[0]
    # one pass for the statistics and one per type for the frequencies, which all else shares
    assert plan.count("FileScan") == 4
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "Python" not in plan


@pytest.mark.parametrize(
    "columns, cut",
    [
        (["order_id"], "row_number(), 5, Partial"),
        (["email", "status"], "row_number(), 5, Partial"),
        (["email"], "row_number(), 5, Partial"),
    ],
)
def test_tasks_send_only_their_own_top_values(spark, tmp_path, orders, capsys, columns, cut):
    orders.write.parquet(str(tmp_path / "o"))
    tc.top_values(spark.read.parquet(str(tmp_path / "o")), columns).explain()
    plan = capsys.readouterr().out
    assert cut in plan
    # a window below which nothing was cut would receive every distinct value
    assert plan.count("- Window [") <= plan.count(cut)


def test_top_values_of_any_number(spark):
    df = spark.range(0, 6000).selectExpr("id % 3000 AS a", "CAST(id % 2000 AS STRING) AS b", "id AS c")
    for k in (1000, 2500):
        rows = tc.top_values(df, k=k).collect()
        for name, kinds, copies in (("a", 3000, 2), ("b", 2000, 3), ("c", 6000, 1)):
            own = [r for r in rows if r["column_name"] == name]
            assert len(own) == min(k, kinds) and {r["count"] for r in own} == {copies}
            assert [r["rank"] for r in own] == list(range(1, len(own) + 1))
    assert [r["value"] for r in tc.top_values(df, ["c"], k=1500).orderBy("rank").collect()] == [str(i) for i in range(1500)]


def test_one_tie_rule_for_short_and_long_texts(spark):
    import hashlib

    texts = ["b", "a" * 63, "a" * 64, "a" * 100, "a" * 50 + "x" * 13, "a" * 48 + "y" * 40, "c" * 300, "", "ä" * 40]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    want = sorted(texts, key=lambda t: (t[:48].encode(), hashlib.sha256(t.encode()).hexdigest()))
    for k in (9, 2000):
        assert [r["value"] for r in tc.top_values(df, k=k).orderBy("rank").collect()] == want


def test_approx_shows_texts_and_leaves_out_what_it_cannot_measure(spark):
    long = ["x" * 70, "y" * 90]
    df = spark.createDataFrame(
        [(long[i % 2], bytearray([i % 3]), [i % 4], {"a": i % 5}, i) for i in range(40)],
        "t string, b binary, l array<int>, m map<string,int>, i int",
    )
    columns = by_name(tc.profile_columns(df, approx=True))
    assert sorted(t["value"] for t in columns["t"].top_values) == sorted(long)
    assert [columns[c].distinct_count for c in "tbl"] == [2, 3, 4]
    assert columns["m"].distinct_count is None and columns["b"].top_values is None
    draft = tc.draft_contract(df.select("t"), "d", tc.suggest_rules(tc.profile_columns(df.select("t"), approx=True)))
    assert all(r.passed for r in tc.run_contract(df.select("t"), draft | {"approved_at": "x"}).collect())


def test_rows_of_any_width_are_compared_as_values(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        df = spark.sql("SELECT timestamp_seconds(t) AS t FROM VALUES (1698537600), (1698541200), (1698541200) AS v(t)")
        for width in (1, 15, 16, 17, 40):
            wide = df.select("t", *[F.lit(i).alias(f"c{i}") for i in range(width)])
            assert tc.duplicate_rows(wide).first()["duplicate_row_count"] == 1
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_texts_count_byte_by_byte_whatever_their_collation(spark):
    df = spark.sql("SELECT CAST(x AS STRING COLLATE UTF8_LCASE) AS x FROM VALUES ('A'), ('a'), ('a') AS v(x)")
    assert tc.distinct_counts(df).first()["distinct_count"] == 2
    assert tc.duplicate_rows(df).first()["duplicate_row_count"] == 1
    result = tc.run_contract(df, {"dataset": "d", "approved_at": "x", "rules": [{"rule_id": "unique_check", "params": {"column": "x"}}]})
    assert result.first().violation_count == 1


def test_intervals(spark):
    df = spark.sql("SELECT INTERVAL '1 02:03:04' DAY TO SECOND * id AS d, make_ym_interval(1, id) AS y FROM range(1, 4)")
    columns = by_name(tc.profile_columns(df))
    low, high = (df.agg(f("d").cast("string")).first()[0] for f in (F.min, F.max))
    assert (columns["d"].min, columns["d"].max) == (low, high)
    assert "T" not in columns["y"].min.removeprefix("INTERVAL").replace("YEAR TO MONTH", "")


def test_fingerprint_is_of_names_and_types_apart(spark):
    def schema(ddl):
        return spark.createDataFrame([], ddl).schema

    kinds = ["`a:int|b` int", "a int, b int", "b int, a int", "a int", "a bigint", "a int, `b\": \"int` int", "a struct<b:int>"]
    assert len({fingerprint(schema(k)) for k in kinds}) == len(kinds)


def test_deterministic(orders):
    first, second = (tc.profile_columns(orders).collect() for _ in range(2))
    assert first == second


# --- redaction ---


def test_redaction(report):
    safe = tc.redact(report)
    assert safe.table.first().redacted and not report.table.first().redacted
    redacted, original = by_name(safe.columns), by_name(report.columns)
    assert all(c.top_values is None for c in redacted.values())
    assert all(c.top_values is not None for c in original.values())
    assert redacted["amount"]["min"] == "-50.0"
    assert redacted["customer_id"].null_rate == 2 / ROWS
    text = " ".join(safe.columns.toJSON().collect() + safe.table.toJSON().collect())
    for raw in ("alice@example.com", "not-an-email", "C001", "+1-555-0101", "shipped"):
        assert raw not in text


def test_hidden_type_survives_redaction(spark):
    df = spark.createDataFrame([("1",), ("2",)], "count string")
    assert tc.redact(tc.profile(df, "t")).columns.first().inferred_dtype == "Int64"


# --- suggestions ---


def test_suggestions_make_a_contract_that_runs_once_approved(orders, report):
    suggested = tc.suggest_rules(report.columns)
    found = {(r.column_name, r.rule_id) for r in suggested.collect()}
    assert {
        ("order_id", "unique_check"), ("order_id", "null_check"), ("customer_id", "null_check"),
        ("email", "regex_match"), ("status", "allowed_values"), ("created_at", "null_check"),
    } <= found
    assert ("amount", "range_check") not in found  # an amount is negative
    assert ("phone", "allowed_values") not in found  # all values differ

    draft = tc.draft_contract(orders, "orders", suggested)
    assert draft["approved_at"] is None and draft["columns"] == tc.snapshot(orders)
    with pytest.raises(tc.ContractNotApprovedError):
        tc.run_contract(orders, draft)
    rows = tc.run_contract(orders, draft | {"approved_at": "2026-06-12"}).collect()
    assert all(r.error is None for r in rows)
    failed = {(r.rule_id, r.column_name) for r in rows if not r.passed}
    assert failed == {
        ("unique_check", "order_id"), ("null_check", "customer_id"), ("regex_match", "email"),
    }


def test_suggestions_for_text_columns(spark):
    df = spark.createDataFrame([("1", "2026-01-01", "1.5")] * 3, "n string, d string, f string")
    suggested = tc.suggest_rules(tc.profile_columns(df)).where("rule_id = 'type_conformance'")
    assert {r.column_name: r.params["expected_type"] for r in suggested.collect()} == {
        "n": "int", "d": "date", "f": "float",
    }


def test_draft_rejects_rules_that_could_not_run(spark, orders):
    schema = "ordinal int, column_name string, rule_id string, params map<string,string>"
    unknown = spark.createDataFrame([(0, "x", "nope", {})], schema)
    with pytest.raises(ValueError, match="unknown rule 'nope'"):
        tc.draft_contract(orders, "orders", unknown)
    wrong = spark.createDataFrame([(0, "x", "null_check", {"colunm": "x"})], schema)
    with pytest.raises(ValueError, match="unknown param 'colunm'"):
        tc.draft_contract(orders, "orders", wrong)


def test_draft_keeps_decoded_parameters(spark, orders):
    schema = "ordinal int, column_name string, rule_id string, params map<string,string>"
    rows = [
        (0, "amount", "range_check", {"column": "amount", "min_val": "0.0"}),
        (1, "status", "allowed_values", {"column": "status", "values": '["a", "b"]'}),
    ]
    draft = tc.draft_contract(orders, "orders", spark.createDataFrame(rows, schema))
    assert [r["params"] for r in draft["rules"]] == [
        {"column": "amount", "min_val": 0.0}, {"column": "status", "values": ["a", "b"]},
    ]
    specs = [(r["rule_id"], r["params"]) for r in draft["rules"]]
    assert [r.error for r in run(orders, *specs)] == [None, None]


def test_email_pattern_is_the_suggested_one(report):
    email = tc.suggest_rules(report.columns).where("rule_id = 'regex_match'").first()
    assert email.params == {"column": "email", "pattern": EMAIL}
