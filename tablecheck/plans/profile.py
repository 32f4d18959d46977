"""Profile a table: what each column holds, as DataFrames.

The exact profile reads each column in a fixed number of passes: one aggregation for
everything a single pass can tell, one counting of values per column type for distinct
counts, top values and quartiles, the latter by the interval narrowing of
:mod:`tablecheck.operators.quantiles` over the counted values. ``approx=True`` does it all in the
first pass, with sketches and without any shuffle of values; only texts of 64 bytes or more
that are among the top values are looked up by a second pass over the text columns.
"""

from __future__ import annotations

import datetime
import re
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tablecheck.functions import text
from tablecheck.functions.columns import STRING_KEY_BYTES, chunks, quoted
from tablecheck.functions.types import is_fractional, is_numeric, is_string, is_temporal
from tablecheck.operators.duplicates import duplicate_rows
from tablecheck.operators.frequency import TOP_VALUES, frequencies
from tablecheck.operators.quantiles import QUARTILES, counted_quartiles
from tablecheck.operators.sampling import uniform_sample
from tablecheck.operators.schema import fingerprint

# Columns per aggregation, to keep the generated code small.
PROFILED_PER_SCAN = 40

# Sizes of the sketches: 2**n buckets for distinct counts, which gives APPROX_RSD as their
# relative standard deviation; a rank accuracy of 1/n for the quartiles; and the values
# tracked for the most frequent ones.
APPROX_LOG_BUCKETS = 12
APPROX_RSD = 0.02
APPROX_ACCURACY = 1000
APPROX_TRACKED = 1000

_TOP_TYPE = "array<struct<value:string,count:bigint>>"

_DATED = (T.DateType, T.TimestampType, T.TimestampNTZType)

# What one pass tells about a column, and the value tests on text columns. Statistics that
# a column or mode does not have are null.
_STATS = {
    "non_null_count": "bigint",
    "distinct_count": "bigint",
    "min": "string",
    "max": "string",
    "min_num": "double",
    "max_num": "double",
    "mean": "double",
    "std": "double",
    "p25": "double",
    "p50": "double",
    "p75": "double",
    "top_values": _TOP_TYPE,
}
_TESTS = {
    "values_seen": "bigint",
    "email": "bigint",
    "date": "bigint",
    "phone": "bigint",
    "int": "bigint",
    "float": "bigint",
}


class ProfileReport(NamedTuple):
    """``table`` has one row, ``columns`` one per column of the profiled table."""

    table: DataFrame
    columns: DataFrame


def profile(
    df: DataFrame,
    dataset: str,
    *,
    profiled_at: datetime.datetime | datetime.date | None = None,
    sampled: bool = False,
    hint_sample_rows: int | None = None,
    approx: bool = False,
) -> ProfileReport:
    """Profile ``df``.

    ``sampled`` says that ``df`` is itself a sample: the report is flagged and has no
    duplicate count, which a sample cannot tell. With ``hint_sample_rows`` the tests of
    single values (hints, types hidden in text) see a sample of that many rows; all other
    statistics still see every row.
    """
    return ProfileReport(
        profile_table(df, dataset, profiled_at=profiled_at, sampled=sampled),
        profile_columns(df, hint_sample_rows=hint_sample_rows, approx=approx),
    )


def redact(report: ProfileReport) -> ProfileReport:
    """A copy without values of cells. Counts, rates, minima, maxima and quartiles stay."""
    return ProfileReport(
        report.table.withColumn("redacted", F.lit(True)),
        report.columns.withColumn("top_values", F.lit(None).cast(_TOP_TYPE)),
    )


# --- table profile ---


def profile_table(
    df: DataFrame,
    dataset: str,
    *,
    profiled_at: datetime.datetime | datetime.date | None = None,
    sampled: bool = False,
) -> DataFrame:
    """One row about the whole table."""
    at = profiled_at or datetime.datetime.now(datetime.timezone.utc)
    if sampled:
        counts = df.agg(
            F.count(F.lit(1)).alias("row_count"),
            F.lit(None).cast("bigint").alias("duplicate_row_count"),
        )
    else:
        counts = duplicate_rows(df)
    return counts.select(
        F.lit(dataset).alias("dataset"),
        F.lit(at.isoformat()).cast("timestamp").alias("profiled_at"),
        F.lit(False).alias("redacted"),
        F.lit(sampled).alias("sampled"),
        "row_count",
        "duplicate_row_count",
        F.lit(fingerprint(df.schema)).alias("schema_fingerprint"),
    )


# --- column profile ---


def profile_columns(
    df: DataFrame, *, hint_sample_rows: int | None = None, approx: bool = False
) -> DataFrame:
    """One row per column, ``ordinal`` giving the column's position."""
    fields = df.schema.fields
    hints = _hint_frame(df, hint_sample_rows)
    described = df.sparkSession.createDataFrame(
        [(i, f.name, f.dataType.simpleString(), _fixed_hint(f)) for i, f in enumerate(fields)],
        "ordinal int, name string, dtype string, fixed_hint string",
    )
    scan = _scan(df, approx=approx, stats=True, tests=hints is None)
    parts = [described, *(_with_long_texts(df, scan) if approx else [scan])]
    if hints is not None:
        parts.append(_scan(hints, approx=approx, stats=False, tests=True))
    if not approx:
        parts += _exact_parts(df)
    # Every part has at most one row per column of the table and fills fields of its own, so
    # stacking and merging them needs no join and no assumption on how long a value is.
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    fields_of = [name for name in stacked.columns if name != "ordinal"]
    merged = stacked.groupBy("ordinal").agg(
        *[F.expr(f"first({name}, true) AS {name}") for name in fields_of]
    )
    return _report(merged, approx).coalesce(1).orderBy("ordinal")


def _hint_frame(df: DataFrame, rows: int | None) -> DataFrame | None:
    """The sample that the value tests read, or None where they read the table itself."""
    if rows is None:
        return None
    total = df.count()
    return uniform_sample(df, rows, seed=0) if total > rows else None


def _with_long_texts(df: DataFrame, scan: DataFrame) -> list[DataFrame]:
    """The scan, with the texts behind the digests in its lists of top values.

    The text columns are read again for the few digests that made a list.
    """
    texts = [(i, f) for i, f in enumerate(df.schema.fields) if is_string(f.dataType)]
    if not texts:
        return [scan]
    is_text = F.col("ordinal").isin([i for i, _ in texts])
    listed = scan.where(is_text).select("ordinal", F.posexplode("top_values").alias("place", "top"))
    listed = listed.select("ordinal", "place", F.col("top.value").alias("key"), F.col("top.count").alias("count"))
    pairs = [F.struct(F.lit(i).alias("ordinal"), quoted(f.name).cast("string").alias("value")) for i, f in texts]
    digested = lambda c: F.octet_length(c) >= STRING_KEY_BYTES
    values = df.select(F.inline(F.array(*pairs))).where(digested("value")).withColumn("key", F.sha2("value", 256))
    wanted = listed.where(digested("key")).select("ordinal", "key")
    found = values.join(F.broadcast(wanted), ["ordinal", "key"], "left_semi").distinct()
    whole = listed.join(found, ["ordinal", "key"], "left")
    ranked = F.sort_array(F.collect_list(F.struct("place", F.coalesce("value", "key").alias("value"), "count")))
    tops = whole.groupBy("ordinal").agg(ranked.alias("ranked")).select(
        "ordinal", F.transform("ranked", lambda t: F.struct(t["value"], t["count"])).cast(_TOP_TYPE).alias("top_values")
    )
    empty = F.size("top_values") == 0
    return [scan.withColumn("top_values", F.when(~is_text | empty, F.col("top_values"))), tops]


def _exact_parts(df: DataFrame) -> list[DataFrame]:
    """What needs more than one pass: distinct counts and top values, and quartiles."""
    parts = []
    for counted in frequencies(df):
        tops = counted.top(TOP_VALUES).groupBy("slot").agg(_listed().alias("top_values"))
        own = [counted.distinct().select("slot", "distinct_count"), tops]
        if is_numeric(counted.type):
            # the counted values are the whole distribution: the table is not read again
            own.append(counted_quartiles(counted.numbers()))
        parts += [part.withColumnRenamed("slot", "ordinal") for part in own]
    return parts


def _listed() -> Column:
    """Aggregate: the ranked values as an array."""
    ranked = "sort_array(collect_list(struct(rank, value, count)))"
    return F.expr(f"transform({ranked}, t -> struct(t.value, t.count))").cast(_TOP_TYPE)


def _scan(df: DataFrame, *, approx: bool, stats: bool, tests: bool) -> DataFrame:
    """All that one pass can tell, one row per column: ``stats`` and/or ``tests``."""
    wanted = (_pass_types(approx) if stats else {}) | (_TESTS if tests else {})
    parts = []
    for group in chunks(list(enumerate(df.schema.fields)), PROFILED_PER_SCAN):
        aggregates, rows = ["count(1) AS n"], []
        for i, f in group:
            have = (_one_pass(i, f, approx) if stats else {}) | (_value_tests(i, f) if tests else {})
            aggregates += [f"{sql} AS {name}_{i}" for name, sql in have.items()]
            rows.append(_scan_row(i, f, wanted, have, stats))
        source = df.select(*[quoted(f.name).alias(f"c{i}") for i, f in group])
        totals = source.agg(*[F.expr(sql) for sql in aggregates])
        parts.append(totals.select(F.expr(f"inline(array({', '.join(rows)}))")))
    return reduce(DataFrame.union, parts)


def _pass_types(approx: bool) -> dict[str, str]:
    later = () if approx else ("distinct_count", "top_values", "p25", "p50", "p75")
    return {name: type_ for name, type_ in _STATS.items() if name not in later}


def _scan_row(i: int, f: T.StructField, wanted: dict, have: dict, stats: bool) -> str:
    """SQL of the struct that turns the aggregates of one column into a row."""

    def shown(name: str) -> str:
        source = f"{name}_{i}"
        if name in ("min", "max") and isinstance(f.dataType, _DATED):
            return _iso_text(source)
        if name in ("min_num", "max_num"):
            source = f"{name[:3]}_{i}"
            return source if "min" in have and is_numeric(f.dataType) else "NULL"
        if name in ("p25", "p50", "p75") and "quartiles" in have:
            return f"quartiles_{i}[{int(name[1:]) // 25 - 1}]"
        if name == "top_values" and name in have:
            return f"transform(filter({source}, t -> t.item IS NOT NULL), t -> struct(CAST(t.item AS STRING), t.count))"
        return source if name in have else "NULL"

    cells = [f"'ordinal', {i}"] + (["'row_count', n"] if stats else [])
    cells += [f"'{name}', CAST({shown(name)} AS {type_})" for name, type_ in wanted.items()]
    return f"named_struct({', '.join(cells)})"


def _one_pass(i: int, f: T.StructField, approx: bool) -> dict[str, str]:
    """SQL aggregates over ``c<i>``."""
    c = f"c{i}"
    stats = {"non_null_count": f"count({c})"}
    if is_numeric(f.dataType):
        if is_fractional(f.dataType):
            # NaN counts for the mean but is neither the minimum nor the maximum
            number = f"CASE WHEN NOT isnan({c}) THEN {c} END"
            stats["min"] = f"coalesce(min({number}), min({c}))"
            stats["max"] = f"coalesce(max({number}), max({c}))"
        else:
            stats |= {"min": f"min({c})", "max": f"max({c})"}
        stats["mean"] = f"avg(CAST({c} AS DOUBLE))"
        stats["std"] = f"stddev_samp(CAST({c} AS DOUBLE))"
        if approx:
            shares = ", ".join(f"{q}D" for q in QUARTILES)
            stats["quartiles"] = (
                f"percentile_approx(CAST({c} AS DOUBLE), array({shares}), {APPROX_ACCURACY})"
            )
    elif is_temporal(f.dataType) and not isinstance(f.dataType, T.CalendarIntervalType):
        stats |= {"min": f"min({c})", "max": f"max({c})"}
    if approx and _is_hashable(f.dataType):
        hashed = f"CASE WHEN {c} IS NOT NULL THEN xxhash64({c}) END"
        distinct = f"hll_sketch_estimate(hll_sketch_agg({hashed}, {APPROX_LOG_BUCKETS}))"
        stats["distinct_count"] = f"least({distinct}, count({c}))"
    if approx and _is_sketchable(f.dataType):
        # long texts by their digests, so that no sketch holds more than short ones
        key = f"CASE WHEN octet_length({c}) < {STRING_KEY_BYTES} THEN {c} ELSE sha2({c}, 256) END"
        tracked = key if is_string(f.dataType) else c
        stats["top_values"] = f"approx_top_k({tracked}, {TOP_VALUES}, {APPROX_TRACKED})"
    return stats


def _is_hashable(data_type: T.DataType) -> bool:
    """Types whose values have a hash."""
    return not re.search("map<|variant|interval$", data_type.simpleString())


def _is_sketchable(data_type: T.DataType) -> bool:
    """Types that the sketches behind ``approx`` accept."""
    plain = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
    return isinstance(data_type, plain) or is_string(data_type)


def _value_tests(i: int, f: T.StructField) -> dict[str, str]:
    """SQL aggregates: how many values of a text column pass each test."""
    if not is_string(f.dataType):
        return {}
    c = f"c{i}"
    return {
        "values_seen": f"count({c})",
        "email": f"count_if({text.is_email(c)})",
        "date": text.dates_read(c),
        "phone": f"count_if({text.is_phone(c)})",
        "int": f"count({text.as_integer(c)})",
        "float": f"count({text.as_float(c)})",
    }


def _iso_text(value: str) -> str:
    """SQL: a date or timestamp as ISO 8601; six fraction digits, and only if not zero."""
    shown = f"replace(CAST({value} AS STRING), ' ', 'T')"
    fraction = f"rpad(substring_index({shown}, '.', -1), 6, '0')"
    return (
        f"CASE WHEN contains({shown}, '.')"
        f" THEN concat(substring_index({shown}, '.', 1), '.', {fraction}) ELSE {shown} END"
    )


def _or(name: str, otherwise: Column, approx: bool) -> Column:
    return F.col(name) if approx else F.coalesce(name, otherwise).alias(name)


def _fixed_hint(f: T.StructField) -> str | None:
    """The hint that the type or the name of the column gives without its values."""
    if is_temporal(f.dataType):
        return "date"
    return "id" if re.search(text.ID_NAME_PATTERN, f.name) else None


def _report(base: DataFrame, approx: bool) -> DataFrame:
    """Turn counts into the reported ratios, hints and types."""
    missing = [name for name in _STATS if name not in base.columns]
    base = base.withColumns({name: F.lit(None).cast(_STATS[name]) for name in missing})

    def rate(test: str) -> Column:
        return F.when(F.col("values_seen") > 0, F.col(test) / F.col("values_seen"))

    rates = base.withColumns({test: rate(test) for test in _TESTS if test != "values_seen"})
    passes = {t: F.col(t) >= text.MATCH_THRESHOLD for t in _TESTS if t != "values_seen"}
    hint = F.coalesce(
        F.col("fixed_hint"),
        F.when(passes["email"], "email")
        .when(passes["date"], "date")
        .when(passes["phone"], "phone"),
    )
    hidden = (("int", "Int64"), ("float", "Float64"), ("date", "Date"))
    return rates.select(
        "ordinal",
        "name",
        "dtype",
        F.expr("CASE WHEN row_count > 0 THEN (row_count - non_null_count) / row_count END").alias(
            "null_rate"
        ),
        F.expr("CASE WHEN non_null_count > 0 THEN distinct_count / non_null_count END").alias(
            "uniqueness_ratio"
        ),
        "min",
        "max",
        "min_num",
        "max_num",
        F.expr("CASE WHEN mean IS NOT NULL THEN struct(mean, std, p25, p50, p75) END").alias(
            "numeric"
        ),
        # what the sketches cannot measure stays null
        _or("top_values", F.array().cast(_TOP_TYPE), approx),
        hint.alias("semantic_hint"),
        F.coalesce(*[F.when(passes[t], name) for t, name in hidden]).alias("inferred_dtype"),
        F.coalesce(*[F.when(passes[t], F.col(t)) for t, _ in hidden]).alias("inferred_match_rate"),
        "row_count",
        "non_null_count",
        _or("distinct_count", F.lit(0), approx),
    )
