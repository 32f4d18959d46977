"""Every rule on small tables, with exact rates."""

import datetime

import pytest

from conftest import EMAIL, ROWS, STATUSES, check, run


def frame(spark, schema, *values):
    return spark.createDataFrame([(v,) for v in values], schema)


def outcome(row):
    return row.passed, row.violation_rate, row.error


# --- completeness ---


def test_null_check(orders):
    clean, dirty, tolerated = run(
        orders,
        ("null_check", {"column": "order_id", "max_null_rate": 0.0}),
        ("null_check", {"column": "customer_id", "max_null_rate": 0.0}),
        ("null_check", {"column": "amount", "max_null_rate": 1 / ROWS}),
    )
    assert outcome(clean) == (True, 0.0, None)
    assert outcome(dirty) == (False, 2 / ROWS, None)
    assert (dirty.violation_count, dirty.row_count) == (2, ROWS)
    assert tolerated.passed and tolerated.violation_rate == 1 / ROWS


def test_null_check_all_null_and_nan(spark):
    assert check(frame(spark, "x bigint", None, None), "null_check", column="x").violation_rate == 1
    assert check(frame(spark, "x double", float("nan"), 1.0), "null_check", column="x").passed


# --- uniqueness ---


def test_unique_check(orders, spark):
    dup, clean = run(
        orders, ("unique_check", {"column": "order_id"}), ("unique_check", {"column": "email"})
    )
    assert outcome(dup) == (False, 1 / ROWS, None)
    assert outcome(clean) == (True, 0.0, None)
    nulls = frame(spark, "x bigint", 1, 2, None, None)
    assert outcome(check(nulls, "unique_check", column="x")) == (True, 0.0, None)


def test_unique_check_counts_copies_beyond_the_first(spark):
    row = check(frame(spark, "x string", "a", "a", "a", "b", None), "unique_check", column="x")
    assert (row.violation_count, row.violation_rate) == (2, 2 / 5)


@pytest.mark.parametrize("length", [63, 64, 65, 5000])
def test_unique_check_sees_whole_texts(spark, length):
    long = "x" * (length - 1)
    df = frame(spark, "x string", long + "a", long + "b", long + "a", "é" * length)
    assert check(df, "unique_check", column="x").violation_count == 1


def test_unique_check_text_equal_to_a_digest(spark):
    import hashlib

    text = "y" * 100
    digest = hashlib.sha256(text.encode()).hexdigest()
    assert check(frame(spark, "x string", text, digest), "unique_check", column="x").passed


# --- range ---


def test_range_check(orders, spark):
    assert outcome(check(orders, "range_check", column="amount", min_val=0.0)) == (
        False, 1 / ROWS, None,
    )
    three = frame(spark, "x double", 1.0, None, 3.0)
    assert check(three, "range_check", column="x", min_val=0.0, max_val=5.0).passed
    high = frame(spark, "x double", 1.0, 2.0, 100.0)
    assert outcome(check(high, "range_check", column="x", max_val=10.0)) == (False, 1 / 3, None)


def test_range_check_bounds_are_inclusive_and_nan_is_above(spark):
    df = frame(spark, "x double", 1.0, 5.0, float("nan"))
    both, low = run(
        df,
        ("range_check", {"column": "x", "min_val": 1, "max_val": 5}),
        ("range_check", {"column": "x", "min_val": 1}),
    )
    assert both.violation_count == 1 and low.violation_count == 0


def test_range_check_without_bounds_is_not_evaluated(spark):
    row = check(frame(spark, "x double", 1.0, 2.0), "range_check", column="x")
    assert not row.passed and row.violation_rate is None
    assert row.error == "range_check requires at least one of min_val or max_val"
    nulls = check(frame(spark, "x double", 1.0), "range_check", column="x", min_val=None)
    assert "at least one" in nulls.error


def test_range_check_needs_numbers(orders):
    assert "numeric" in check(orders, "range_check", column="status", min_val=0).error


# --- allowed values ---


def test_allowed_values(orders, spark):
    assert outcome(check(orders, "allowed_values", column="status", values=STATUSES)) == (
        False, 1 / ROWS, None,
    )
    assert check(orders, "allowed_values", column="status", values=[*STATUSES, "refunded"]).passed
    assert check(frame(spark, "x string", "a", "b", None), "allowed_values",
                 column="x", values=["a", "b"]).passed


def test_allowed_values_lists(spark):
    df = frame(spark, "x bigint", 1, 2, 3, None)
    with_null, empty, only_null, floats = run(
        df,
        ("allowed_values", {"column": "x", "values": [1, 2, None]}),
        ("allowed_values", {"column": "x", "values": []}),
        ("allowed_values", {"column": "x", "values": [None]}),
        ("allowed_values", {"column": "x", "values": [1.0, 2.5]}),
    )
    assert with_null.violation_count == 1  # a null in the list hides nothing
    assert empty.violation_count == only_null.violation_count == 3
    assert floats.violation_count == 2


@pytest.mark.parametrize(
    "schema, value, listed",
    [
        ("x bigint", 1, ["a"]),
        ("x string", "1", [1]),
        ("x double", 1.0, ["1"]),
        ("x bigint", 1, [True]),
        ("x boolean", True, [1]),
    ],
)
def test_allowed_values_of_another_type_is_an_error(spark, schema, value, listed):
    row = check(frame(spark, schema, value), "allowed_values", column="x", values=listed)
    assert row.violation_rate is None and "cannot be compared" in row.error


def test_allowed_values_dates(orders):
    row = check(orders, "allowed_values", column="created_at",
                values=[datetime.date(2020, 1, 15)])
    assert row.violation_count == ROWS - 1


# --- regex ---


def test_regex_match(orders, spark):
    assert outcome(check(orders, "regex_match", column="email", pattern=EMAIL)) == (
        False, 1 / ROWS, None,
    )
    assert check(orders, "regex_match", column="phone", pattern=r"^\+\d-\d{3}-\d{4}$").passed
    nulls = frame(spark, "x string", "abc", None)
    assert check(nulls, "regex_match", column="x", pattern=r"^\d+$").violation_rate == 0.5


def test_regex_match_is_a_full_match(spark):
    df = frame(spark, "code string", "12345", "12-AB-99", "xx")
    assert check(df, "regex_match", column="code", pattern=r"\d+").violation_rate == 2 / 3
    alternation = frame(spark, "x string", "a", "b", "ab")
    assert check(alternation, "regex_match", column="x", pattern="a|b").violation_count == 1
    line_end = frame(spark, "x string", "abc\n", "abc")
    assert check(line_end, "regex_match", column="x", pattern="^abc$").violation_count == 1
    dialect = frame(spark, "x string", "a\rb", "٣٤")
    assert check(dialect, "regex_match", column="x", pattern=r"a.b|\d+").passed


def test_regex_match_bad_pattern_or_column_is_an_error(orders):
    bad, number, fine = run(
        orders,
        ("regex_match", {"column": "email", "pattern": "("}),
        ("regex_match", {"column": "amount", "pattern": ".*"}),
        ("regex_match", {"column": "email", "pattern": ".*"}),
    )
    assert bad.error and bad.violation_rate is None
    assert "string" in number.error
    assert fine.passed


# --- freshness ---


def test_freshness(orders):
    as_of = datetime.date(2026, 6, 11)
    stale, wide, text = run(
        orders,
        ("freshness", {"column": "created_at", "max_days": 365, "as_of": as_of}),
        ("freshness", {"column": "created_at", "max_days": 9999, "as_of": as_of}),
        ("freshness", {"column": "created_at", "max_days": 365, "as_of": "2026-06-11"}),
    )
    assert outcome(stale) == outcome(text) == (False, 1 / ROWS, None)
    assert outcome(wide) == (True, 0.0, None)
    assert stale.severity == "warning"


def test_freshness_defaults_to_today(orders):
    today = datetime.date.today()
    pinned, default, null = run(
        orders,
        ("freshness", {"column": "created_at", "max_days": 30, "as_of": today}),
        ("freshness", {"column": "created_at", "max_days": 30}),
        ("freshness", {"column": "created_at", "max_days": 30, "as_of": None}),
    )
    assert outcome(pinned) == outcome(default) == outcome(null)


@pytest.mark.parametrize("type_", ["timestamp", "timestamp_ntz", "date"])
def test_freshness_on_timestamps(spark, type_):
    df = spark.sql(
        f"SELECT CAST(x AS {type_}) AS x FROM VALUES "
        "('2026-01-09 23:59:59'), ('2026-01-10 00:00:00'), ('2026-02-01 00:00:00'), (NULL) AS t(x)"
    )
    rows = run(
        df,
        ("freshness", {"column": "x", "max_days": 10, "as_of": "2026-01-20"}),
        ("freshness", {"column": "x", "max_days": 10,
                       "as_of": datetime.datetime(2026, 1, 20, 12)}),
    )
    # the cutoff itself is fresh, the future and nulls too; a cutoff at noon is later
    assert [r.violation_count for r in rows] == [1, 2]


def test_freshness_needs_dates(orders):
    assert "date or timestamp" in check(orders, "freshness", column="status", max_days=1).error


# --- volume ---


@pytest.mark.parametrize(
    "min_rows, passed, rate",
    [(ROWS - 1, True, 0.0), (ROWS, True, 0.0), (ROWS + 5, False, 5 / (ROWS + 5)), (0, True, 0.0)],
)
def test_min_row_count(orders, min_rows, passed, rate):
    assert outcome(check(orders, "min_row_count", min_rows=min_rows)) == (passed, rate, None)


def test_min_row_count_far_below(spark):
    assert check(frame(spark, "x bigint", 1), "min_row_count", min_rows=100).violation_rate == 0.99


# --- type conformance ---


def test_type_conformance_native_types(orders):
    rows = run(
        orders,
        ("type_conformance", {"column": "amount", "expected_type": "float"}),
        ("type_conformance", {"column": "amount", "expected_type": "int"}),
        ("type_conformance", {"column": "created_at", "expected_type": "date"}),
        ("type_conformance", {"column": "created_at", "expected_type": "int"}),
        ("type_conformance", {"column": "order_id", "expected_type": "date"}),
    )
    # a number cannot encode a date, so every value fails
    assert [r.violation_count for r in rows] == [0, 0, 0, 0, ROWS]


@pytest.mark.parametrize(
    "expected_type, values",
    [
        ("int", ["1", "2", "x"]),
        ("float", ["1.5", "2.0", "bad"]),
        ("date", ["2026-01-01", "2026-01-02", "not a date"]),
        ("datetime", ["2026-01-01 10:00:00", "2026-01-02T11:30:00.25", "noon"]),
    ],
)
def test_type_conformance_text(spark, expected_type, values):
    row = check(frame(spark, "x string", *values), "type_conformance",
                column="x", expected_type=expected_type)
    assert outcome(row) == (False, 1 / 3, None)


def test_type_conformance_ignores_nulls(spark):
    df = frame(spark, "x string", "1", None, "2")
    assert outcome(check(df, "type_conformance", column="x", expected_type="int")) == (
        True, 0.0, None,
    )
    for expected in ("int", "float", "date", "datetime"):
        nulls = frame(spark, "x string", None, None)
        assert check(nulls, "type_conformance", column="x", expected_type=expected).passed


def test_type_conformance_rejects_what_a_cast_would_accept(spark):
    texts = frame(spark, "x string", " 1 ", "1.0", "99999999999999999999", "+7", "-7")
    assert check(texts, "type_conformance", column="x", expected_type="int").violation_count == 3
    texts = frame(spark, "x string", "1d", "1f", "0x1p3", " 1", "1e5", ".5", "5.", "NaN", "-inf")
    assert check(texts, "type_conformance", column="x", expected_type="float").violation_count == 4
    texts = frame(spark, "x string", "2026", "2026-1-2", "2026-01-02 10:00:00", "2026-02-30",
                  "2026-02-28")
    assert check(texts, "type_conformance", column="x", expected_type="date").violation_count == 4


def test_type_conformance_a_column_has_one_date_format(spark):
    df = frame(spark, "x string", "31/12/2025", "30/12/2025", "2025-12-31", "12/31/2025")
    assert check(df, "type_conformance", column="x", expected_type="date").violation_count == 2
    df = frame(spark, "x string", "31-12-2025 08:30", "30-12-2025", "29-12-2025T01:02:03")
    assert check(df, "type_conformance", column="x", expected_type="datetime").passed


def test_type_conformance_unsupported_type(spark):
    row = check(frame(spark, "x string", "1", "2"), "type_conformance",
                column="x", expected_type="complex")
    assert not row.passed and row.violation_rate is None
    assert "unsupported expected_type 'complex'" in row.error


def test_odd_column_names(spark):
    df = spark.createDataFrame([(1, 2, "a")], ["a b.c", "x`y", "Name"])
    rows = run(
        df,
        ("null_check", {"column": "a b.c"}),
        ("unique_check", {"column": "x`y"}),
        ("type_conformance", {"column": "Name", "expected_type": "int"}),
        ("null_check", {"column": "name"}),
    )
    assert [r.passed for r in rows] == [True, True, False, False]
    assert rows[3].error == "column 'name' not found"
