"""Tables of the session catalog, sized for profiling by their statistics."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

from tablecheck.operators.sampling import ProfilingLoad, profiling_load

# Up to catalog, schema and table; names go into SQL text.
CATALOG_NAME = r"[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*){0,2}"


def check_catalog_name(table: str) -> str:
    if not re.fullmatch(CATALOG_NAME, table):
        raise ValueError(f"invalid table name: {table!r}")
    return table


def estimate_table_rows(spark: SparkSession, table: str) -> int | None:
    """The row count that ``ANALYZE TABLE ... COMPUTE STATISTICS`` left in the catalog, without
    reading the table; None where there is none."""
    described = spark.sql(f"DESCRIBE TABLE EXTENDED {check_catalog_name(table)}")
    row = described.where("col_name = 'Statistics'").first()
    rows = re.search(r"(\d+) rows", row["data_type"]) if row else None
    return int(rows.group(1)) if rows and int(rows.group(1)) > 0 else None


def load_table_profiling(
    spark: SparkSession, *, table: str, max_rows: int, seed: int = 0, prefix: bool = False
) -> ProfilingLoad:
    """A catalog table sized for profiling, by its statistics, else by its row count."""
    estimate = estimate_table_rows(spark, table)
    return profiling_load(spark.table(table), max_rows, seed=seed, estimate=estimate, prefix=prefix)
