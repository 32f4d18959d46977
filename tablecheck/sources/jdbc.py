"""Database sources over JDBC: whole tables, queries, samples, sized for profiling.

What is read is always a relation in the FROM clause of the database. Reads are split over tasks
by ranges of a partition column, whose bounds are looked up where they are not given; without
such a column the protocol has one cursor, and one task reads it. The planner's row estimate and
block samples are PostgreSQL's; tables and queries work with any driver.
"""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tablecheck.operators.sampling import ProfilingLoad, sample_percent, uniform_sample

# Fixed value: a table name, optionally with its schema. Names go into SQL text, so nothing
# else is accepted.
TABLE_NAME = r"[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)?"

NUM_PARTITIONS = 8


def check_table_name(table: str) -> str:
    if not re.fullmatch(TABLE_NAME, table):
        raise ValueError(f"invalid table name: {table!r}")
    return table


def relation(table: str | None = None, query: str | None = None, sample_rows: int | None = None) -> str:
    """What stands in the FROM clause: a table, a subquery, or a random sample of a table."""
    match table, query, sample_rows:
        case str(), None, None:
            return check_table_name(table)
        case str(), None, int():
            drawn = f"SELECT t.* FROM {check_table_name(table)} t ORDER BY random()"
            return f"({drawn} FETCH FIRST {sample_rows} ROWS ONLY) sampled"
        case None, str(), None:
            return f"({query}) q"
        case None, str(), _:
            raise ValueError("a query decides itself how many rows it returns: no sample_rows")
    raise ValueError("a database source is exactly one of table and query")


def jdbc_options(
    url: str,
    *,
    table: str | None = None,
    query: str | None = None,
    sample_rows: int | None = None,
    partition_column: str | None = None,
    lower_bound: Any = None,
    upper_bound: Any = None,
    num_partitions: int = NUM_PARTITIONS,
    **options: Any,
) -> dict[str, str]:
    """Options of the JDBC reader; a partitioned read needs both bounds here."""
    made = {"url": url, "dbtable": relation(table, query, sample_rows)}
    if partition_column is not None:
        if sample_rows is not None:
            raise ValueError("every range of a partitioned read would draw a sample of its own")
        if lower_bound is None or upper_bound is None:
            raise ValueError("a partitioned read needs lower_bound and upper_bound")
        made |= {
            "partitionColumn": partition_column, "lowerBound": str(lower_bound),
            "upperBound": str(upper_bound), "numPartitions": str(num_partitions),
        }
    return made | {k: str(v) for k, v in options.items()}


def load_jdbc(
    spark: SparkSession, url: str, *, partition_column: str | None = None, lower_bound: Any = None,
    upper_bound: Any = None, **source: Any,
) -> DataFrame:
    """Read a table or query; the keywords are those of :func:`jdbc_options`.

    Bounds of the partition column that are not given are asked from the database.
    """
    if partition_column is not None and (lower_bound is None or upper_bound is None):
        named = {k: source.get(k) for k in ("table", "query")}
        other = {k: v for k, v in source.items() if k not in ("table", "query", "sample_rows", "num_partitions")}
        column = check_table_name(partition_column)
        ends = f"SELECT min({column}) AS low, max({column}) AS high FROM {relation(**named)}"
        low, high = _read(spark, jdbc_options(url, query=ends, **other)).first()
        lower_bound = low if lower_bound is None else lower_bound
        upper_bound = high if upper_bound is None else upper_bound
        if lower_bound is None:  # an empty table has no bounds and nothing to split
            return _read(spark, jdbc_options(url, **source))
    split = {"partition_column": partition_column, "lower_bound": lower_bound, "upper_bound": upper_bound}
    return _read(spark, jdbc_options(url, **split, **source))


def _read(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    return spark.read.format("jdbc").options(**options).load()


def estimate_row_count(spark: SparkSession, url: str, table: str, **options: Any) -> int | None:
    """PostgreSQL's estimate of a table, without reading it; None where it has none."""
    # The name is looked up as the database itself would, along its search path.
    query = f"SELECT reltuples AS rows FROM pg_class WHERE oid = to_regclass('{check_table_name(table)}')"
    found = _read(spark, jdbc_options(url, query=query, **options)).first()
    rows = int(found["rows"] or 0) if found else 0
    return rows if rows > 0 else None


def load_profiling(
    spark: SparkSession, url: str, *, table: str, max_rows: int, seed: int = 0, **options: Any
) -> ProfilingLoad:
    """A database table sized for profiling, by its planner estimate, else by its row count.

    A table that does not fit is thinned in the database by a reproducible block sample, and cut
    to ``max_rows`` uniformly, so that the sample has no prefix of the blocks.
    """
    estimate = estimate_row_count(spark, url, table, **options)
    rows = estimate
    if rows is None:
        counted = f"SELECT count(*) AS rows FROM {check_table_name(table)}"
        rows = int(_read(spark, jdbc_options(url, query=counted, **options)).first()["rows"])
    if rows <= max_rows:
        return ProfilingLoad(_read(spark, jdbc_options(url, table=table, **options)), False, estimate, "whole")
    percent = sample_percent(max_rows, rows)
    blocks = f"SELECT * FROM {table} TABLESAMPLE SYSTEM ({percent:.6f}) REPEATABLE ({int(seed)})"
    drawn = _read(spark, jdbc_options(url, query=blocks, **options))
    return ProfilingLoad(uniform_sample(drawn, max_rows, seed), True, estimate)
