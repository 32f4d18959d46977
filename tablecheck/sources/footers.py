"""Parquet files described by their footers: row counts, null counts and extremes.

Counts and extremes are aggregates that Spark's Parquet source answers from the statistics of row
groups, so no column is read, whatever the size of the table. Extremes are taken only where footers
hold them as Spark compares values: whole numbers, dates and booleans. Texts may be cut in footers,
timestamps have several forms, and not-a-number counts as largest in Spark but is left out there.
"""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tablecheck.functions.columns import quoted
from tablecheck.operators.sampling import ProfilingLoad, profiling_load
from tablecheck.sources.files import load_table

EXTREMES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DateType, T.BooleanType)
NESTED = (T.ArrayType, T.MapType, T.StructType, T.VariantType)

STATISTICS = "column_name string, row_count bigint, null_count bigint, min_value string, max_value string"


def _footer_session(spark: SparkSession) -> SparkSession:
    """A session with the settings of ``spark`` whose Parquet aggregates come from footers."""
    session = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if session.conf.isModifiable(key):
            session.conf.set(key, value)
    session.conf.set("spark.sql.sources.useV1SourceList", "")
    session.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return session


def footer_aggregate(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """One row with ``rows`` and, by the place of each column, what its footers say: ``n0``, ``min0``,
    ``max0`` and so on. Raises while it runs where a row group has no extremes, as all is null."""
    files = load_table(_footer_session(spark), path, format="parquet")
    return files.agg(F.count("*").alias("rows"), *_measures(files, columns or files.columns))


def _measures(files: DataFrame, columns: list[str]) -> list[Column]:
    made = []
    for i, name in enumerate(columns):
        if not isinstance(files.schema[name].dataType, NESTED):
            made.append(F.count(quoted(name)).alias(f"n{i}"))
        if isinstance(files.schema[name].dataType, EXTREMES):
            made += [F.min(quoted(name)).alias(f"min{i}"), F.max(quoted(name)).alias(f"max{i}")]
    return made


def footer_statistics(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A row per column: ``column_name, row_count, null_count, min_value, max_value``.

    Values are text. What footers cannot tell is null: extremes of texts, timestamps, decimals and
    floating-point numbers, and the nulls of nested columns. Where a row group has no statistics,
    the same aggregates are computed from the columns themselves.
    """
    files = load_table(spark, path, format="parquet")
    names = columns or files.columns
    try:
        found = footer_aggregate(spark, path, names).first()
    except (PySparkException, Py4JJavaError) as exc:
        if "No min/max found" not in str(exc) and "No num_nulls found" not in str(exc):
            raise
        found = files.agg(F.count("*").alias("rows"), *_measures(files, names)).first()
    # Without files there is nothing to add up, and counts from footers are null.
    told = found.asDict() | {c: 0 for c in found.asDict() if found[c] is None and not c.startswith("m")}
    text = lambda v: None if v is None else str(v).lower() if isinstance(v, bool) else str(v)
    rows = [
        (
            name, told["rows"], told["rows"] - told[f"n{i}"] if f"n{i}" in told else None,
            text(told.get(f"min{i}")), text(told.get(f"max{i}")),
        )
        for i, name in enumerate(names)
    ]
    return spark.createDataFrame(rows, STATISTICS)


def estimate_file_rows(spark: SparkSession, path: str) -> int:
    """The row count of Parquet files, from their footers."""
    return load_table(_footer_session(spark), path, format="parquet").agg(F.count("*")).first()[0] or 0


def load_file_profiling(spark: SparkSession, path: str, max_rows: int, seed: int = 0) -> ProfilingLoad:
    """Parquet files sized for profiling by the row count in their footers."""
    files = load_table(spark, path, format="parquet")
    return profiling_load(files, max_rows, seed=seed, estimate=estimate_file_rows(spark, path))
