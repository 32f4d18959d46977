"""Registration of the queries and the SQL shapes they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Ratios are compared to nine digits, means and deviations to six: sums of doubles depend
# on the order in which they are added. Prices and discounts have few decimals, so a mean
# may lie exactly between two six-digit numbers; the shift keeps such a tie from being
# decided by the last bit of a sum.
RATE_DIGITS = 9
MOMENT_DIGITS = 6
MOMENT_SHIFT = "0.000000033"


def query(name: str, sql: str | None = None):
    """Register a query, with the SQL that gives the same rows."""

    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(results: DataFrame) -> DataFrame:
    return results.withColumn("violation_rate", F.round("violation_rate", RATE_DIGITS))


def approved(*rules: tuple, dataset: str = "example", columns: dict | None = None) -> dict:
    """A contract from ``(rule_id, params)`` or ``(rule_id, params, severity)`` tuples."""
    return {
        "dataset": dataset,
        "approved_at": "2026-06-12T00:00:00Z",
        "approved_by": "owner",
        "columns": columns,
        "rules": [dict(zip(("rule_id", "params", "severity"), rule)) for rule in rules],
    }


def text_or_null(value: str | None) -> str:
    return "CAST(NULL AS VARCHAR)" if value is None else "'" + value.replace("'", "''") + "'"


def measured_sql(
    ordinal: int, rule_id: str, column: str | None, count: str, rate: str | None = None,
    max_rate: float = 0.0, severity: str = "error",
) -> str:
    """One result row from the row count ``n`` and an SQL violation count, both in ``m``."""
    rate = rate or f"({count})::DOUBLE / n"
    return f"""
      SELECT {ordinal}::INTEGER AS ordinal, '{rule_id}' AS rule_id,
             {text_or_null(column)} AS column_name, ({rate}) <= {max_rate}::DOUBLE AS passed,
             round({rate}, {RATE_DIGITS}) AS violation_rate,
             ({count})::BIGINT AS violation_count, n AS row_count,
             CAST(NULL AS VARCHAR) AS error, '{severity}' AS severity
      FROM m"""


def error_sql(
    ordinal: int, rule_id: str, column: str | None, error: str, severity: str | None = "error",
    row_count: str = "CAST(NULL AS BIGINT)",
) -> str:
    return f"""
      SELECT {ordinal}::INTEGER AS ordinal, '{rule_id}' AS rule_id,
             {text_or_null(column)} AS column_name, false AS passed,
             CAST(NULL AS DOUBLE) AS violation_rate, CAST(NULL AS BIGINT) AS violation_count,
             {row_count} AS row_count, {text_or_null(error)} AS error,
             {text_or_null(severity)} AS severity
      FROM m"""


def results_sql(source: str, counts: dict[str, str], rows: list[str]) -> str:
    """Result rows over ``m``: the row count and the named violation counts of a source."""
    measures = "".join(f", ({sql})::BIGINT AS {name}" for name, sql in counts.items())
    return f"""
    WITH t AS ({source}),
         m AS (SELECT count(*)::BIGINT AS n{measures} FROM t)
    {" UNION ALL ".join(rows)}"""
