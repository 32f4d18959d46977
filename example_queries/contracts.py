"""Whole contracts: fused runs, errors, severities, drift, scores and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

import tablecheck as tc
from example_queries.base import (
    approved,
    error_sql,
    measured_sql,
    query,
    results_sql,
    rounded,
    table,
)

# --- one contract with every rule, on orders with some nulls ---

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"]
ORDERS_RULES = [
    ("min_row_count", {"min_rows": 1000}),
    ("null_check", {"column": "status", "max_null_rate": 0.1}),
    ("unique_check", {"column": "o_orderkey"}),
    ("unique_check", {"column": "o_custkey"}),
    ("range_check", {"column": "o_totalprice", "min_val": 0, "max_val": 400_000}, "warning"),
    ("allowed_values", {"column": "o_orderpriority", "values": PRIORITIES}),
    ("regex_match", {"column": "o_orderpriority", "pattern": r"[1-5]-[A-Z ]+"}),
    ("freshness", {"column": "o_orderdate", "max_days": 2000, "as_of": "2001-08-01"}),
    ("type_conformance", {"column": "o_orderpriority", "expected_type": "int"}),
]
ORDERS_SOURCE = "SELECT *, nullif(o_orderstatus, 'P') AS status FROM orders"
ORDERS_COUNTS = {
    "nulls": "count(*) - count(status)",
    "dup_order": "count(o_orderkey) - count(DISTINCT o_orderkey)",
    "dup_cust": "count(o_custkey) - count(DISTINCT o_custkey)",
    "outside": "count(*) FILTER (WHERE o_totalprice < 0 OR o_totalprice > 400000)",
    "unlisted": "count(*) FILTER (WHERE o_orderpriority NOT IN "
    "('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED'))",
    "unmatched": "count(*) FILTER (WHERE NOT regexp_full_match(o_orderpriority, '[1-5]-[A-Z ]+'))",
    "stale": "count(*) FILTER (WHERE o_orderdate < DATE '2001-08-01' - INTERVAL 2000 DAY)",
    "not_int": "count(*) FILTER (WHERE NOT regexp_full_match(o_orderpriority, '[+-]?[0-9]+'))",
}
ORDERS_ROWS = [
    measured_sql(0, "min_row_count", None, "greatest(1000 - n, 0)",
                 rate="greatest(1000 - n, 0)::DOUBLE / 1000"),
    measured_sql(1, "null_check", "status", "nulls", max_rate=0.1),
    measured_sql(2, "unique_check", "o_orderkey", "dup_order"),
    measured_sql(3, "unique_check", "o_custkey", "dup_cust"),
    measured_sql(4, "range_check", "o_totalprice", "outside", severity="warning"),
    measured_sql(5, "allowed_values", "o_orderpriority", "unlisted"),
    measured_sql(6, "regex_match", "o_orderpriority", "unmatched"),
    measured_sql(7, "freshness", "o_orderdate", "stale", severity="warning"),
    measured_sql(8, "type_conformance", "o_orderpriority", "not_int"),
]
ORDERS_SQL = results_sql(ORDERS_SOURCE, ORDERS_COUNTS, ORDERS_ROWS)


def orders_with_nulls(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").withColumn("status", F.expr("nullif(o_orderstatus, 'P')"))


def orders_results(spark, sf_dir) -> DataFrame:
    return tc.run_contract(orders_with_nulls(spark, sf_dir), approved(*ORDERS_RULES))


@query("contract_run", ORDERS_SQL)
def contract_run(spark, sf_dir):
    return rounded(orders_results(spark, sf_dir))


@query("contract_gate", f"SELECT * FROM ({ORDERS_SQL}) WHERE severity = 'error' AND NOT passed")
def contract_gate(spark, sf_dir):
    return rounded(tc.blocking_failures(orders_results(spark, sf_dir)))


# --- eight rules on the largest table ---

LINEITEM_RULES = [
    ("min_row_count", {"min_rows": 1}),
    ("null_check", {"column": "l_orderkey"}),
    ("unique_check", {"column": "l_orderkey"}),
    ("range_check", {"column": "l_quantity", "min_val": 1, "max_val": 40}),
    ("range_check", {"column": "l_discount", "min_val": 0.0, "max_val": 0.05}),
    ("allowed_values", {"column": "l_returnflag", "values": ["A", "N"]}),
    ("regex_match", {"column": "l_linestatus", "pattern": "O|F"}),
    ("freshness", {"column": "l_shipdate", "max_days": 1500, "as_of": "2001-08-01"}),
]
LINEITEM_SQL = results_sql(
    "SELECT * FROM lineitem",
    {
        "nulls": "count(*) - count(l_orderkey)",
        "dups": "count(l_orderkey) - count(DISTINCT l_orderkey)",
        "qty": "count(*) FILTER (WHERE l_quantity < 1 OR l_quantity > 40)",
        "disc": "count(*) FILTER (WHERE l_discount < 0::DOUBLE OR l_discount > 0.05::DOUBLE)",
        "flag": "count(*) FILTER (WHERE l_returnflag NOT IN ('A', 'N'))",
        "line": "count(*) FILTER (WHERE NOT regexp_full_match(l_linestatus, 'O|F'))",
        "stale": "count(*) FILTER (WHERE l_shipdate < DATE '2001-08-01' - INTERVAL 1500 DAY)",
    },
    [
        measured_sql(0, "min_row_count", None, "greatest(1 - n, 0)",
                     rate="greatest(1 - n, 0)::DOUBLE"),
        measured_sql(1, "null_check", "l_orderkey", "nulls"),
        measured_sql(2, "unique_check", "l_orderkey", "dups"),
        measured_sql(3, "range_check", "l_quantity", "qty"),
        measured_sql(4, "range_check", "l_discount", "disc"),
        measured_sql(5, "allowed_values", "l_returnflag", "flag"),
        measured_sql(6, "regex_match", "l_linestatus", "line"),
        measured_sql(7, "freshness", "l_shipdate", "stale", severity="warning"),
    ],
)


@query("contract_lineitem", LINEITEM_SQL)
def contract_lineitem(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    contract = approved(*LINEITEM_RULES, dataset="lineitem", columns=tc.snapshot(df))
    return rounded(tc.run_contract(df, contract))


# --- rules that cannot be evaluated, beside rules that can ---

N = "n"


@query(
    "contract_errors",
    results_sql(
        "SELECT * FROM customer",
        {
            "negative": "count(*) FILTER (WHERE c_acctbal < 0)",
            "dups": "count(c_custkey) - count(DISTINCT c_custkey)",
        },
        [
            error_sql(0, "null_check", None, "rule 'null_check': missing required param 'column'"),
            error_sql(1, "null_check", None,
                      "rule 'null_check': missing required param 'column'; "
                      "rule 'null_check': unknown param 'colunm'"),
            error_sql(2, "null_check", "c_name",
                      "rule 'null_check': param 'max_null_rate' must be float, got str"),
            error_sql(3, "row_sum", "c_name", "rule 'row_sum' not found in registry", None),
            error_sql(4, "range_check", "c_acctbal",
                      "range_check requires at least one of min_val or max_val", row_count=N),
            error_sql(5, "type_conformance", "c_name",
                      "unsupported expected_type 'complex'; "
                      "one of ['date', 'datetime', 'float', 'int']", row_count=N),
            error_sql(6, "null_check", "c_email", "column 'c_email' not found", row_count=N),
            error_sql(7, "range_check", "c_name",
                      "range_check needs a numeric column, 'c_name' is string", row_count=N),
            error_sql(8, "allowed_values", "c_nationkey",
                      "allowed_values: 'FRANCE' cannot be compared with column 'c_nationkey' "
                      "of type int", row_count=N),
            measured_sql(9, "range_check", "c_acctbal", "negative"),
            measured_sql(10, "unique_check", "c_custkey", "dups"),
        ],
    ),
)
def contract_errors(spark, sf_dir):
    contract = approved(
        ("null_check", {}),
        ("null_check", {"colunm": "c_name"}),
        ("null_check", {"column": "c_name", "max_null_rate": "high"}),
        ("row_sum", {"column": "c_name"}),
        ("range_check", {"column": "c_acctbal"}),
        ("type_conformance", {"column": "c_name", "expected_type": "complex"}),
        ("null_check", {"column": "c_email"}),
        ("range_check", {"column": "c_name", "min_val": 0}),
        ("allowed_values", {"column": "c_nationkey", "values": ["FRANCE"]}),
        ("range_check", {"column": "c_acctbal", "min_val": 0}),
        ("unique_check", {"column": "c_custkey"}),
    )
    return rounded(tc.run_contract(table(spark, sf_dir, "customer"), contract))


# --- a table in which no row is left ---

EMPTY = "cannot evaluate: dataset is empty"


@query(
    "contract_empty",
    results_sql(
        "SELECT * FROM orders WHERE o_totalprice + o_custkey < 0",
        {},
        [
            error_sql(0, "null_check", "o_orderkey", EMPTY, row_count=N),
            error_sql(1, "unique_check", "o_orderkey", EMPTY, row_count=N),
            error_sql(2, "range_check", "o_totalprice", EMPTY, row_count=N),
            error_sql(3, "freshness", "o_orderdate", EMPTY, "warning", row_count=N),
            error_sql(4, "null_check", None, "rule 'null_check': missing required param 'column'"),
            measured_sql(5, "min_row_count", None, "greatest(10 - n, 0)",
                         rate="greatest(10 - n, 0)::DOUBLE / 10"),
        ],
    ),
)
def contract_empty(spark, sf_dir):
    contract = approved(
        ("null_check", {"column": "o_orderkey"}),
        ("unique_check", {"column": "o_orderkey"}),
        ("range_check", {"column": "o_totalprice"}),
        ("freshness", {"column": "o_orderdate", "max_days": 1}),
        ("null_check", {}),
        ("min_row_count", {"min_rows": 10}),
    )
    none_left = table(spark, sf_dir, "orders").where("o_totalprice + o_custkey < 0")
    return rounded(tc.run_contract(none_left, contract))


# --- schema drift, with the number of values behind each live column ---

CUSTOMER_SNAPSHOT = {
    "c_custkey": "Int32",
    "c_name": "String",
    "c_acctbal": "Int64",
    "c_mktsegment": "String",
    "c_phone": "String",
}


@query(
    "schema_diff",
    """
    SELECT 'removed' AS change, 'c_phone' AS column_name, 'String' AS expected,
           CAST(NULL AS VARCHAR) AS live, CAST(NULL AS BIGINT) AS live_values
    UNION ALL
    SELECT 'added', 'c_nationkey', NULL, 'int', count(c_nationkey)::BIGINT FROM customer
    UNION ALL
    SELECT 'changed', 'c_acctbal', 'Int64', 'double', count(c_acctbal)::BIGINT FROM customer
    """,
)
def schema_diff(spark, sf_dir):
    df = table(spark, sf_dir, "customer")
    counts = df.agg(*[F.count(c).alias(c) for c in df.columns]).unpivot(
        [], df.columns, "column_name", "live_values"
    )
    return tc.schema_diff(df, CUSTOMER_SNAPSHOT).join(F.broadcast(counts), "column_name", "left")


# --- scores and reports on the results of the orders contract ---

EXPECTED = [
    ("null_check", "status"),
    ("unique_check", "o_custkey"),
    ("unique_check", "o_orderkey"),
    ("min_row_count", None),
    ("type_conformance", "o_orderpriority"),
]
STATUS_SQL = f"""
    WITH r AS ({ORDERS_SQL}),
         found AS (SELECT DISTINCT rule_id, column_name FROM r WHERE NOT passed AND error IS NULL),
         expected(rule_id, column_name) AS (VALUES
           ('null_check', 'status'), ('unique_check', 'o_custkey'),
           ('unique_check', 'o_orderkey'), ('min_row_count', NULL),
           ('type_conformance', 'o_orderpriority'))
    SELECT coalesce(e.rule_id, f.rule_id) AS rule_id,
           coalesce(e.column_name, f.column_name) AS column_name,
           CASE WHEN f.rule_id IS NULL THEN 'missed'
                WHEN e.rule_id IS NULL THEN 'spurious' ELSE 'caught' END AS status
    FROM expected e FULL JOIN found f
      ON e.rule_id = f.rule_id AND e.column_name IS NOT DISTINCT FROM f.column_name
"""


@query("issue_status", STATUS_SQL)
def issue_status(spark, sf_dir):
    return tc.issue_status(orders_results(spark, sf_dir), tc.expected_issues(spark, EXPECTED))


@query(
    "score_contract",
    f"""
    SELECT count(*) FILTER (WHERE status = 'caught')::INTEGER AS caught,
           count(*) FILTER (WHERE status = 'missed')::INTEGER AS missed,
           count(*) FILTER (WHERE status = 'spurious')::INTEGER AS spurious,
           round(count(*) FILTER (WHERE status = 'caught')::DOUBLE
                 / count(*) FILTER (WHERE status <> 'spurious'), 9) AS recall,
           round(count(*) FILTER (WHERE status = 'caught')::DOUBLE
                 / count(*) FILTER (WHERE status <> 'missed'), 9) AS precision
    FROM ({STATUS_SQL})
    """,
)
def score_contract(spark, sf_dir):
    scored = tc.score(orders_results(spark, sf_dir), tc.expected_issues(spark, EXPECTED))
    return scored.select(
        *[F.size(s).alias(s) for s in ("caught", "missed", "spurious")],
        F.round("recall", 9).alias("recall"),
        F.round("precision", 9).alias("precision"),
    )


def listed_sql(status: str) -> str:
    issue = "rule_id || '(' || coalesce(column_name, '-') || ')'"
    order = "ORDER BY rule_id, column_name NULLS FIRST"
    return f"coalesce(string_agg({issue}, ' ' {order}) FILTER (WHERE status = '{status}'), '') AS {status}"


@query("score_lists", f"SELECT {', '.join(map(listed_sql, ('caught', 'missed', 'spurious')))} FROM ({STATUS_SQL})")
def score_lists(spark, sf_dir):
    """The issues themselves, in the order of the lists."""
    scored = tc.score(orders_results(spark, sf_dir), tc.expected_issues(spark, EXPECTED))
    text = lambda i: F.concat(i["rule_id"], F.lit("("), F.coalesce(i["column_name"], F.lit("-")), F.lit(")"))
    return scored.select(*[F.array_join(F.transform(s, text), " ").alias(s) for s in ("caught", "missed", "spurious")])


@query(
    "contract_drift",
    """
    SELECT 'schema drift for dataset ''customer'', contract needs re-scoping: column ''c_phone'' removed; '
           || 'column ''c_nationkey'' added; column ''c_acctbal'' changed type: Int64 -> double' AS error,
           count(*)::BIGINT AS rows_not_tested
    FROM customer
    """,
)
def contract_drift(spark, sf_dir):
    """What a run raises on a table that no longer has the schema of its contract."""
    customer = tc.load_parquet(spark, f"{sf_dir}/customer.parquet")
    rules = approved(("min_row_count", {"min_rows": 1}), dataset="customer", columns=CUSTOMER_SNAPSHOT)
    try:
        return tc.run_contract(customer, rules)
    except tc.SchemaDriftError as drift:
        return customer.agg(F.lit(str(drift)).alias("error"), F.count("*").alias("rows_not_tested"))


@query(
    "report_summary",
    f"""
    SELECT 'orders' AS dataset, count(*)::BIGINT AS rules,
           count(*) FILTER (WHERE passed)::BIGINT AS passed_rules,
           count(*) FILTER (WHERE NOT passed)::BIGINT AS failed_rules,
           CASE WHEN bool_and(passed) THEN 'All ' || count(*) || ' rules passed.'
                WHEN NOT bool_or(passed) THEN 'All ' || count(*) || ' rules failed.'
                ELSE count(*) FILTER (WHERE passed) || ' of ' || count(*) || ' rules passed, '
                     || count(*) FILTER (WHERE NOT passed) || ' failed.' END AS summary
    FROM ({ORDERS_SQL})
    """,
)
def report_summary(spark, sf_dir):
    return tc.summary(orders_results(spark, sf_dir), "orders")


@query(
    "report_rows",
    f"""
    SELECT CASE WHEN passed THEN 'PASSED' ELSE 'FAILED' END AS section, ordinal,
           CASE rule_id WHEN 'min_row_count' THEN 'Minimum Row Count'
                        WHEN 'null_check' THEN 'Null Check'
                        WHEN 'unique_check' THEN 'Unique Check'
                        WHEN 'range_check' THEN 'Range Check'
                        WHEN 'allowed_values' THEN 'Allowed Values'
                        WHEN 'regex_match' THEN 'Regex Match'
                        WHEN 'freshness' THEN 'Freshness Check'
                        ELSE 'Type Conformance' END AS name,
           CASE WHEN severity <> 'error' THEN severity END AS tag,
           coalesce(column_name, 'min 1000 rows') AS context,
           printf('%.1f%% violation rate', violation_rate * 100) AS detail
    FROM ({ORDERS_SQL})
    """,
)
def report_rows(spark, sf_dir):
    return tc.report_rows(orders_results(spark, sf_dir), approved(*ORDERS_RULES))


@query(
    "rules_by_tag",
    f"""
    SELECT rule_id, ordinal, column_name, passed FROM ({ORDERS_SQL})
    WHERE rule_id IN ('unique_check', 'null_check')
    """,
)
def rules_by_tag(spark, sf_dir):
    chosen = tc.catalogue(spark, tags=["completeness", "uniqueness"]).select("rule_id")
    results = orders_results(spark, sf_dir).select("rule_id", "ordinal", "column_name", "passed")
    return results.join(F.broadcast(chosen), "rule_id", "left_semi")


# --- offending rows ---

VIOLATED = [
    ("range_check", {"column": "o_totalprice", "min_val": 1000.0, "max_val": 400000.0}),
    ("unique_check", {"column": "o_custkey"}),
    ("allowed_values", {"column": "o_orderstatus", "values": ["F", "O"]}),
    ("min_row_count", {"min_rows": 1}),
    ("regex_match", {"column": "o_orderpriority", "pattern": "[1-4]-.*"}),
    ("null_check", {"column": "o_orderdate"}),
]


@query(
    "violating_rows",
    """
    WITH c AS (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) > 1),
    b AS (
      SELECT o.*, concat_ws(',',
        CASE WHEN o_totalprice < 1000 OR o_totalprice > 400000 THEN '0:range_check:o_totalprice' END,
        CASE WHEN o_custkey IN (SELECT o_custkey FROM c) THEN '1:unique_check:o_custkey' END,
        CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN '2:allowed_values:o_orderstatus' END,
        CASE WHEN NOT regexp_full_match(o_orderpriority, '[1-4]-.*') THEN '4:regex_match:o_orderpriority' END,
        CASE WHEN o_orderdate IS NULL THEN '5:null_check:o_orderdate' END) AS broken
      FROM orders o
    )
    SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, broken FROM b WHERE broken <> ''
    """,
)
def violating_rows(spark, sf_dir):
    found = tc.violating_rows(table(spark, sf_dir, "orders"), approved(*VIOLATED))
    broken = F.transform("broken_rules", lambda b: F.concat_ws(":", b["ordinal"], b["rule_id"], b["column_name"]))
    return found.rows.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", F.array_join(broken, ",").alias("broken"))
