"""One query per rule and per point of its semantics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

import tablecheck as tc
from example_queries.base import approved, measured_sql, query, results_sql, rounded, table

URL_PATTERN = "https://[^/]+/.*"
EVENT_TYPES = ["view", "click", "signup", "purchase"]


def rule_query(
    name: str, source: str, rule_id: str, params: dict, count: str, *,
    derive: dict[str, tuple[Column, str]] | None = None, **shape,
):
    """A contract of one rule. ``derive`` replaces or adds columns: Spark, and SQL."""
    derive = derive or {}
    names = "".join(f", {sql} AS {column}" for column, (_, sql) in derive.items())
    column = params.get("column")
    sql = results_sql(
        f"SELECT *{names} FROM {source}",
        {"v": count},
        [measured_sql(0, rule_id, column, "v", **shape)],
    )

    @query(name, sql)
    def run(spark, sf_dir) -> DataFrame:
        df = table(spark, sf_dir, source)
        df = df.withColumns({c: expression() for c, (expression, _) in derive.items()})
        return rounded(tc.run_contract(df, approved((rule_id, params))))


# --- completeness ---

STATUS = {
    "status": (lambda: F.expr("nullif(o_orderstatus, 'P')"), "nullif(o_orderstatus, 'P')")
}
rule_query("rule_null_check", "orders", "null_check", {"column": "status"},
           "count(*) - count(status)", derive=STATUS)
rule_query("rule_null_tolerance", "orders", "null_check",
           {"column": "status", "max_null_rate": 0.5}, "count(*) - count(status)",
           derive=STATUS, max_rate=0.5)

# --- uniqueness ---

rule_query("rule_unique_check", "orders", "unique_check", {"column": "o_custkey"},
           "count(o_custkey) - count(DISTINCT o_custkey)")
rule_query("rule_unique_ignores_nulls", "customer", "unique_check", {"column": "nation"},
           "count(nation) - count(DISTINCT nation)",
           derive={"nation": (lambda: F.expr("nullif(c_nationkey, 0)"), "nullif(c_nationkey, 0)")})
rule_query("rule_unique_long_text", "documents", "unique_check", {"column": "text"},
           "count(text) - count(DISTINCT text)")

# --- validity ---

rule_query("rule_range_min", "customer", "range_check", {"column": "c_acctbal", "min_val": 0.0},
           "count(*) FILTER (WHERE c_acctbal < 0)")
rule_query("rule_range_both", "customer", "range_check",
           {"column": "c_acctbal", "min_val": 0, "max_val": 9000},
           "count(*) FILTER (WHERE c_acctbal < 0 OR c_acctbal > 9000)")
rule_query("rule_allowed_values", "events", "allowed_values",
           {"column": "event_type", "values": EVENT_TYPES},
           "count(*) FILTER (WHERE event_type NOT IN ('view', 'click', 'signup', 'purchase'))")
rule_query("rule_allowed_values_null_in_list", "events", "allowed_values",
           {"column": "event_type", "values": [*EVENT_TYPES, None]},
           "count(*) FILTER (WHERE event_type NOT IN ('view', 'click', 'signup', 'purchase'))")
rule_query("rule_regex_match", "pages", "regex_match", {"column": "url", "pattern": URL_PATTERN},
           f"count(*) FILTER (WHERE NOT regexp_full_match(url, '{URL_PATTERN}'))")
rule_query("rule_regex_alternation", "part", "regex_match",
           {"column": "p_type", "pattern": "ECONOMY|SMALL"},
           "count(*) FILTER (WHERE NOT regexp_full_match(p_type, 'ECONOMY|SMALL'))")
rule_query("rule_regex_full_not_search", "part", "regex_match",
           {"column": "p_name", "pattern": "red|blue .*"},
           "count(*) FILTER (WHERE NOT regexp_full_match(p_name, 'red|blue .*'))")

# --- freshness and volume ---

rule_query("rule_freshness", "events", "freshness",
           {"column": "ts", "max_days": 20, "as_of": "2024-01-30"},
           "count(*) FILTER (WHERE ts < DATE '2024-01-30' - INTERVAL 20 DAY)",
           severity="warning")
rule_query("rule_min_row_count", "lineitem", "min_row_count", {"min_rows": 100_000},
           "greatest(100000 - count(*), 0)", rate="greatest(100000 - n, 0)::DOUBLE / 100000")

# --- conformance of text columns ---

SIZE_TEXT = {
    "size_text": (
        lambda: F.expr(
            "CASE p_size % 10 WHEN 0 THEN p_type WHEN 1 THEN NULL ELSE CAST(p_size AS STRING) END"
        ),
        "CASE p_size % 10 WHEN 0 THEN p_type WHEN 1 THEN NULL ELSE CAST(p_size AS VARCHAR) END",
    )
}
rule_query("rule_type_int", "part", "type_conformance",
           {"column": "size_text", "expected_type": "int"},
           "count(size_text) FILTER (WHERE NOT regexp_full_match(size_text, '[+-]?[0-9]+')"
           " OR try_cast(size_text AS BIGINT) IS NULL)",
           derive=SIZE_TEXT)
PRICE_TEXT = {
    "price_text": (
        lambda: F.expr("if(o_orderpriority = '5-LOW', 'n/a', CAST(o_totalprice AS STRING))"),
        "CASE WHEN o_orderpriority = '5-LOW' THEN 'n/a' ELSE CAST(o_totalprice AS VARCHAR) END",
    )
}
rule_query("rule_type_float", "orders", "type_conformance",
           {"column": "price_text", "expected_type": "float"},
           "count(price_text) FILTER (WHERE try_cast(price_text AS DOUBLE) IS NULL)",
           derive=PRICE_TEXT)


def _date_text(spark_format: str, sql_format: str) -> dict:
    return {
        "day_text": (
            lambda: F.expr(
                "if(o_orderstatus = 'F', 'unknown', "
                f"date_format(o_orderdate, \"{spark_format}\"))"
            ),
            "CASE WHEN o_orderstatus = 'F' THEN 'unknown' "
            f"ELSE strftime(o_orderdate, '{sql_format}') END",
        )
    }


rule_query("rule_type_date", "orders", "type_conformance",
           {"column": "day_text", "expected_type": "date"},
           "count(*) FILTER (WHERE try_strptime(day_text, '%Y-%m-%d') IS NULL)",
           derive=_date_text("yyyy-MM-dd", "%Y-%m-%d"))
rule_query("rule_type_date_day_first", "orders", "type_conformance",
           {"column": "day_text", "expected_type": "date"},
           "count(*) FILTER (WHERE try_strptime(day_text, '%d/%m/%Y') IS NULL)",
           derive=_date_text("dd/MM/yyyy", "%d/%m/%Y"))
rule_query("rule_type_datetime", "orders", "type_conformance",
           {"column": "day_text", "expected_type": "datetime"},
           "count(*) FILTER (WHERE try_strptime(day_text, '%Y-%m-%dT%H:%M:%S') IS NULL)",
           derive=_date_text("yyyy-MM-dd'T'HH:mm:ss", "%Y-%m-%dT%H:%M:%S"))
rule_query("rule_type_datetime_zoned", "orders", "type_conformance",
           {"column": "day_text", "expected_type": "datetime"},
           "count(*) FILTER (WHERE day_text = 'unknown')",
           derive=_date_text("yyyy-MM-dd'T'HH:mm:ss'Z'", "%Y-%m-%dT%H:%M:%SZ"))
rule_query("rule_type_native", "lineitem", "type_conformance",
           {"column": "l_quantity", "expected_type": "int"}, "0")
