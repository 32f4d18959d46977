"""Scores and report rows."""

import pytest

import tablecheck as tc
from conftest import EMAIL, STATUSES, contract

EXPECTED = [
    ("null_check", "customer_id"), ("unique_check", "order_id"), ("range_check", "amount"),
    ("regex_match", "email"), ("allowed_values", "status"), ("freshness", "created_at"),
]
IDEAL = [
    ("null_check", {"column": "customer_id", "max_null_rate": 0.0}),
    ("unique_check", {"column": "order_id"}),
    ("range_check", {"column": "amount", "min_val": 0.0}),
    ("regex_match", {"column": "email", "pattern": EMAIL}),
    ("allowed_values", {"column": "status", "values": STATUSES}),
    ("freshness", {"column": "created_at", "max_days": 365, "as_of": "2026-06-12"}),
]


def scored(orders, *rules, expected=EXPECTED):
    results = tc.run_contract(orders, contract(*rules))
    row = tc.score(results, tc.expected_issues(orders.sparkSession, expected)).first()
    lists = {s: [tuple(i) for i in row[s]] for s in ("caught", "missed", "spurious")}
    return lists, row.recall, row.precision


def test_ideal_contract(orders):
    lists, recall, precision = scored(orders, *IDEAL)
    assert lists == {"caught": sorted(EXPECTED), "missed": [], "spurious": []}
    assert (recall, precision) == (1.0, 1.0)


def test_partial_contract(orders):
    lists, recall, precision = scored(orders, *IDEAL[:2])
    assert lists["caught"] == sorted(EXPECTED[:2]) and lists["missed"] == sorted(EXPECTED[2:])
    assert (recall, precision) == (pytest.approx(2 / 6), 1.0)


def test_empty_contract_and_nothing_expected(orders):
    lists, recall, precision = scored(orders)
    assert (lists["caught"], recall, precision) == ([], 0.0, 1.0)
    assert scored(orders, expected=[])[1:] == (1.0, 1.0)


def test_spurious_errors_and_passing_rules(orders):
    lists, recall, precision = scored(
        orders,
        IDEAL[0],
        ("null_check", {"column": "amount", "max_null_rate": 0.0}),
        ("null_check", {"column": "amount"}),  # the same issue
        ("null_check", {}),  # an error is no finding
        ("null_check", {"column": "order_id"}),  # passes
        ("min_row_count", {"min_rows": 100}),
        expected=[*EXPECTED, ("min_row_count", None)],
    )
    assert lists["caught"] == [("min_row_count", None), ("null_check", "customer_id")]
    assert lists["spurious"] == [("null_check", "amount")]
    assert (recall, precision) == (pytest.approx(2 / 7), pytest.approx(2 / 3))


# --- reports ---


def reported(orders, *rules):
    made = contract(*rules)
    results = tc.run_contract(orders, made)
    return tc.summary(results, "orders").first(), tc.report_rows(results, made).collect()


@pytest.mark.parametrize(
    "rules, text",
    [
        ([], "No rules in contract."),
        ([("null_check", {"column": "order_id"}), ("unique_check", {"column": "email"})],
         "All 2 rules passed."),
        (IDEAL[:2], "All 2 rules failed."),
        (IDEAL[:1], "All 1 rule failed."),
        ([("null_check", {"column": "order_id"}), IDEAL[0]], "1 of 2 rules passed, 1 failed."),
    ],
)
def test_summary(orders, rules, text):
    summary, rows = reported(orders, *rules)
    assert (summary.dataset, summary.summary, summary.rules) == ("orders", text, len(rules))
    assert len(rows) == len(rules)


def test_rows(orders):
    _, rows = reported(
        orders,
        ("null_check", {"column": "customer_id"}, "warning"),
        ("min_row_count", {"min_rows": 5}),
        ("null_check", {}),
        ("unique_check", {"column": "email"}),
        ("null_check", {"column": "amount"}),
        ("mystery", {}),
    )
    assert [tuple(r) for r in rows] == [
        ("PASSED", 1, "Minimum Row Count", None, "min 5 rows", "0.0% violation rate"),
        ("PASSED", 3, "Unique Check", None, "email", "0.0% violation rate"),
        ("FAILED", 0, "Null Check", "warning", "customer_id", "10.0% violation rate"),
        ("FAILED", 2, "Null Check", None, None,
         "error: rule 'null_check': missing required param 'column'"),
        ("FAILED", 4, "Null Check", None, "amount", "5.0% violation rate"),
        ("FAILED", 5, "mystery", None, None, "error: rule 'mystery' not found in registry"),
    ]
