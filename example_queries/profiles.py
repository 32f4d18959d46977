"""Profiles: table statistics, column statistics, hints, hidden types, suggestions."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, functions as F

import tablecheck as tc
from tablecheck.functions.text import EMAIL_PATTERN, PHONE_PATTERN
from tablecheck.plans.profile import APPROX_RSD
from example_queries.base import MOMENT_DIGITS, MOMENT_SHIFT, RATE_DIGITS, query, table


def moment(column: str) -> Column:
    return F.round(F.col(column) + float(MOMENT_SHIFT), MOMENT_DIGITS)


def moment_sql(sql: str) -> str:
    return f"round({sql} + {MOMENT_SHIFT}::DOUBLE, {MOMENT_DIGITS})"


# --- duplicate rows ---


def duplicates_sql(source: str) -> str:
    return f"""
    WITH t AS ({source})
    SELECT (SELECT count(*) FROM t)::BIGINT AS row_count,
           ((SELECT count(*) FROM t) - (SELECT count(*) FROM (SELECT DISTINCT * FROM t)))::BIGINT
             AS duplicate_row_count"""


PART_ROWS = "SELECT p_name, p_brand, p_type, p_size FROM part"


@query(
    "profile_table",
    f"SELECT 'part' AS dataset, false AS redacted, false AS sampled, * FROM ({duplicates_sql(PART_ROWS)})",
)
def profile_table(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_name", "p_brand", "p_type", "p_size")
    return tc.profile_table(part, "part").drop("profiled_at", "schema_fingerprint")


# The columns of part as names and Spark's JSON names of their types.
PART_SCHEMA = [["p_partkey", "long"], ["p_name", "string"], ["p_brand", "string"], ["p_type", "string"], ["p_size", "integer"], ["p_retailprice", "double"]]
PART_FINGERPRINT = hashlib.blake2b(json.dumps(PART_SCHEMA).encode(), digest_size=8).hexdigest()


@query(
    "profile_table_whole",
    f"""SELECT 'part' AS dataset, false AS redacted, false AS sampled, *,
               '{PART_FINGERPRINT}' AS schema_fingerprint FROM ({duplicates_sql("SELECT * FROM part")})""",
)
def profile_table_whole(spark, sf_dir):
    return tc.profile_table(table(spark, sf_dir, "part"), "part").drop("profiled_at")


@query("duplicate_rows_lineitem", duplicates_sql("SELECT * FROM lineitem"))
def duplicate_rows_lineitem(spark, sf_dir):
    return tc.duplicate_rows(table(spark, sf_dir, "lineitem"))


@query("duplicate_rows_long_text", duplicates_sql("SELECT text, lang FROM documents"))
def duplicate_rows_long_text(spark, sf_dir):
    return tc.duplicate_rows(table(spark, sf_dir, "documents").select("text", "lang"))


@query("duplicate_rows_documents", duplicates_sql("SELECT * FROM documents"))
def duplicate_rows_documents(spark, sf_dir):
    return tc.duplicate_rows(table(spark, sf_dir, "documents"))


VERY_WIDE = [f"shift{i}" for i in range(24)]


@query(
    "duplicate_rows_very_wide",
    duplicates_sql(
        "SELECT event_type, date_trunc('month', ts) AS month, "
        + ", ".join(f"date_trunc('month', ts) + INTERVAL {i} HOUR AS {c}" for i, c in enumerate(VERY_WIDE))
        + " FROM events"
    ),
)
def duplicate_rows_very_wide(spark, sf_dir):
    month = "date_trunc('month', ts)"
    shifted = [F.expr(f"{month} + INTERVAL {i} HOUR AS {c}") for i, c in enumerate(VERY_WIDE)]
    return tc.duplicate_rows(table(spark, sf_dir, "events").select("event_type", F.expr(f"{month} AS month"), *shifted))


WIDE = 18


@query(
    "duplicate_rows_wide",
    duplicates_sql(
        "SELECT "
        + ", ".join(f"nullif(p_size, {i}) AS s{i}, nullif(p_brand, 'Brand#{i}') AS b{i}"
                    for i in range(WIDE // 2))
        + " FROM part"
    ),
)
def duplicate_rows_wide(spark, sf_dir):
    columns = [
        F.expr(sql)
        for i in range(WIDE // 2)
        for sql in (f"nullif(p_size, {i}) AS s{i}", f"nullif(p_brand, 'Brand#{i}') AS b{i}")
    ]
    return tc.duplicate_rows(table(spark, sf_dir, "part").select(*columns))


# --- column statistics ---


def column_sql(source: str, ordinal: int, name: str, dtype: str, kind: str) -> str:
    """The profile of one column: ``kind`` is number, time, text or other."""
    number, time = kind == "number", kind == "time"
    if time:
        bounds = [f"strftime({f}({name}), '%Y-%m-%dT%H:%M:%S')" for f in ("min", "max")]
    else:
        bounds = ["CAST(NULL AS VARCHAR)"] * 2
    ranks = (
        f"(SELECT list(x ORDER BY x) FROM (SELECT {name}::DOUBLE AS x FROM t WHERE {name} IS NOT NULL))"
    )

    def summary(sql: str) -> str:
        return moment_sql(sql) if number else "CAST(NULL AS DOUBLE)"

    def quartile(q: float) -> str:
        # the row of rank q * (n - 1), rounded half up; lists count from 1
        position = f"floor({q}::DOUBLE * (count({name}) - 1) + 0.5::DOUBLE)::BIGINT + 1"
        return f"{ranks}[{position}]" if number else "CAST(NULL AS DOUBLE)"

    return f"""
    (WITH t AS ({source})
    SELECT {ordinal}::INTEGER AS ordinal, '{name}' AS name, '{dtype}' AS dtype,
           round((count(*) - count({name}))::DOUBLE / count(*), {RATE_DIGITS}) AS null_rate,
           round(count(DISTINCT {name})::DOUBLE / count({name}), {RATE_DIGITS}) AS uniqueness_ratio,
           {bounds[0]} AS min_time, {bounds[1]} AS max_time,
           {f"min({name})::DOUBLE" if number else "CAST(NULL AS DOUBLE)"} AS min_num,
           {f"max({name})::DOUBLE" if number else "CAST(NULL AS DOUBLE)"} AS max_num,
           {summary(f"avg({name}::DOUBLE)")} AS mean,
           {summary(f"stddev_samp({name}::DOUBLE)")} AS std,
           {quartile(0.25)} AS p25, {quartile(0.5)} AS p50, {quartile(0.75)} AS p75,
           count(*)::BIGINT AS row_count, count({name})::BIGINT AS non_null_count,
           count(DISTINCT {name})::BIGINT AS distinct_count
    FROM t)"""


def flat(columns: DataFrame, temporal: list[str]) -> DataFrame:
    """The statistics of a column profile without nested fields."""
    time = F.col("name").isin(temporal)
    return columns.select(
        "ordinal", "name", "dtype",
        F.round("null_rate", RATE_DIGITS).alias("null_rate"),
        F.round("uniqueness_ratio", RATE_DIGITS).alias("uniqueness_ratio"),
        F.when(time, F.col("min")).alias("min_time"),
        F.when(time, F.col("max")).alias("max_time"),
        "min_num", "max_num",
        moment("numeric.mean").alias("mean"),
        moment("numeric.std").alias("std"),
        "numeric.p25", "numeric.p50", "numeric.p75",
        "row_count", "non_null_count", "distinct_count",
    )


def profile_query(name: str, source: str, kinds: list[tuple[str, str, str]]):
    sql = " UNION ALL ".join(
        column_sql(f"SELECT * FROM {source}", i, *column) for i, column in enumerate(kinds)
    )

    @query(name, sql)
    def run(spark, sf_dir):
        temporal = [column for column, _, kind in kinds if kind == "time"]
        return flat(tc.profile_columns(table(spark, sf_dir, source)), temporal)


profile_query("profile_columns_customer", "customer", [
    ("c_custkey", "bigint", "number"), ("c_name", "string", "text"),
    ("c_nationkey", "int", "number"), ("c_acctbal", "double", "number"),
    ("c_mktsegment", "string", "text"),
])
profile_query("profile_columns_orders", "orders", [
    ("o_orderkey", "bigint", "number"), ("o_custkey", "bigint", "number"),
    ("o_orderstatus", "string", "text"), ("o_totalprice", "double", "number"),
    ("o_orderdate", "timestamp_ntz", "time"), ("o_orderpriority", "string", "text"),
])
profile_query("profile_columns_lineitem", "lineitem", [
    ("l_orderkey", "bigint", "number"), ("l_partkey", "bigint", "number"),
    ("l_suppkey", "bigint", "number"), ("l_linenumber", "int", "number"),
    ("l_quantity", "double", "number"), ("l_extendedprice", "double", "number"),
    ("l_discount", "double", "number"), ("l_tax", "double", "number"),
    ("l_returnflag", "string", "text"), ("l_linestatus", "string", "text"),
    ("l_shipdate", "timestamp_ntz", "time"),
])
profile_query("profile_columns_documents", "documents", [
    ("doc_id", "bigint", "number"), ("text", "string", "text"), ("lang", "string", "text"),
    ("source", "string", "text"), ("n_chars", "bigint", "number"),
])


# The sketches are estimates, so the query reports whether they are close: distinct counts
# within five times their relative standard deviation, quartiles within one per cent of the
# ranks.
@query(
    "profile_approx",
    " UNION ALL ".join(
        f"""
        SELECT '{c}' AS name, count({c})::BIGINT AS non_null_count,
               {moment_sql(f"avg({c}::DOUBLE)") if number else "CAST(NULL AS DOUBLE)"} AS mean,
               true AS distinct_close, {"true" if number else "CAST(NULL AS BOOLEAN)"} AS median_close
        FROM orders"""
        for c, number in (
            ("o_orderkey", True), ("o_custkey", True), ("o_orderstatus", False),
            ("o_totalprice", True), ("o_orderdate", False), ("o_orderpriority", False),
        )
    ),
)
def profile_approx(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    numbers = ["o_orderkey", "o_custkey", "o_totalprice"]
    near = tc.order_statistics(orders, numbers, (0.49, 0.51))
    names = F.array(*[F.lit(c) for c in numbers])
    bounds = near.groupBy(names[F.col("slot")].alias("name")).agg(
        F.min("value").alias("low"), F.max("value").alias("high")
    )
    exact = tc.distinct_counts(orders).select(
        F.col("column_name").alias("name"), F.col("distinct_count").alias("exact_count")
    )
    profiled = tc.profile_columns(orders, approx=True)
    off = F.abs(F.col("distinct_count") - F.col("exact_count")) / F.col("exact_count")
    return (
        profiled.join(F.broadcast(exact), "name")
        .join(F.broadcast(bounds), "name", "left")
        .select(
            "name", "non_null_count",
            moment("numeric.mean").alias("mean"),
            (off <= 5 * APPROX_RSD).alias("distinct_close"),
            F.col("numeric.p50").between(F.col("low"), F.col("high")).alias("median_close"),
        )
    )


EMPTY_ORDERS = "o_totalprice + o_custkey < 0"


@query(
    "profile_empty",
    " UNION ALL ".join(
        f"""
        SELECT '{c}' AS name, count(*)::BIGINT AS row_count, count(DISTINCT {c})::BIGINT AS distinct_count,
               NULL::DOUBLE AS null_rate, NULL::DOUBLE AS uniqueness_ratio, NULL::DOUBLE AS mean, min({c})::VARCHAR AS "min",
               0 AS listed, {hint} AS semantic_hint
        FROM orders WHERE {EMPTY_ORDERS}"""
        for c, hint in (
            ("o_orderkey", "NULL"), ("o_custkey", "NULL"), ("o_orderstatus", "NULL"),
            ("o_totalprice", "NULL"), ("o_orderdate", "'date'"), ("o_orderpriority", "NULL"),
        )
    ),
)
def profile_empty(spark, sf_dir):
    """The profile of a table in which no row is left."""
    profiled = tc.profile_columns(table(spark, sf_dir, "orders").where(EMPTY_ORDERS))
    return profiled.select(
        "name", "row_count", "distinct_count", "null_rate", "uniqueness_ratio", F.col("numeric.mean").alias("mean"),
        "min", F.size("top_values").alias("listed"), "semantic_hint",
    )


# --- order statistics ---

SKEWED = {
    # a third of the values are one value, the others span many magnitudes and both signs
    "skewed": "CASE WHEN l_orderkey % 3 = 0 THEN 7.0D ELSE "
    "(l_extendedprice - 30000) * power(10.0D, l_linenumber * 2) END",
    "mostly_null": "CASE WHEN l_quantity > 45 THEN l_tax END",
    "price": "l_extendedprice",
}


@query(
    "profile_quantiles",
    "WITH t AS (SELECT "
    + ", ".join(f"{sql.replace('.0D', '.0::DOUBLE')} AS {name}" for name, sql in SKEWED.items())
    + " FROM lineitem) "
    + " UNION ALL ".join(
        f"""
        SELECT '{name}' AS column_name, q::DOUBLE AS q, x AS value
        FROM (SELECT {name} AS x, row_number() OVER (ORDER BY {name}) - 1 AS k,
                     count(*) OVER () AS n FROM t WHERE {name} IS NOT NULL),
             (VALUES (0.0), (0.25), (0.5), (0.75), (0.99)) AS qs(q)
        WHERE k = floor(q::DOUBLE * (n - 1) + 0.5::DOUBLE)
        """
        for name in SKEWED
    ),
)
def profile_quantiles(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(
        *[F.expr(sql).alias(name) for name, sql in SKEWED.items()]
    )
    names = F.array(*[F.lit(name) for name in SKEWED])
    stats = tc.order_statistics(df, list(SKEWED), (0.0, 0.25, 0.5, 0.75, 0.99))
    return stats.select(names[F.col("slot")].alias("column_name"), "q", "value")


# --- frequencies ---


def top_sql(source: str, column: str, k: int = 5) -> str:
    return f"""
        SELECT '{column}' AS column_name,
               row_number() OVER (ORDER BY n DESC, v)::INTEGER AS rank,
               CAST(v AS VARCHAR) AS value, n AS count
        FROM (SELECT {column} AS v, count(*)::BIGINT AS n FROM {source}
              WHERE {column} IS NOT NULL GROUP BY 1)
        QUALIFY rank <= {k}"""


PART_COLUMNS = ["p_name", "p_brand", "p_type", "p_size", "p_partkey"]


@query("profile_top_values", " UNION ALL ".join(top_sql("part", c) for c in PART_COLUMNS))
def profile_top_values(spark, sf_dir):
    return tc.top_values(table(spark, sf_dir, "part"), PART_COLUMNS)


@query(
    "profile_top_long_texts",
    """
    SELECT 'text' AS column_name, rank, value, n AS count
    FROM (SELECT text AS value, count(*)::BIGINT AS n,
                 row_number() OVER (ORDER BY count(*) DESC, left(text, 48), sha256(text))::INTEGER AS rank
          FROM documents GROUP BY text)
    WHERE rank <= 5
    """,
)
def profile_top_long_texts(spark, sf_dir):
    return tc.top_values(table(spark, sf_dir, "documents"), ["text"])


@query("top_values_many", " UNION ALL ".join(top_sql("lineitem", c, 5000) for c in ("l_orderkey", "l_partkey", "l_shipdate")))
def top_values_many(spark, sf_dir):
    return tc.top_values(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_partkey", "l_shipdate"], k=5000)


TOP_ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"]


@query(
    "profile_top_values_orders",
    " UNION ALL ".join(f"SELECT column_name AS name, rank, value, count, NULL::VARCHAR AS inferred_dtype FROM ({top_sql('orders', c)})" for c in TOP_ORDERS),
)
def profile_top_values_orders(spark, sf_dir):
    """The lists in a column profile of the whole table; prices, written differently, are left out."""
    profiled = tc.profile_columns(tc.load_table(spark, f"{sf_dir}/orders.parquet"))
    listed = profiled.select("name", "inferred_dtype", F.posexplode("top_values").alias("place", "top"))
    rows = listed.select("name", (F.col("place") + 1).alias("rank"), "top.value", "top.count", "inferred_dtype")
    return rows.where("name != 'o_totalprice'")


APPROX_TEXTS = {"letters": "repeat(lang, 40)", "kind": "if(doc_id % 3 = 0, repeat('third ', 20), repeat('other ', 20))"}


@query(
    "profile_approx_texts",
    """
    SELECT 'letters' AS name, repeat(lang, 40) AS value, count(*)::BIGINT AS count FROM documents GROUP BY 2
    UNION ALL
    SELECT 'kind', CASE WHEN doc_id % 3 = 0 THEN repeat('third ', 20) ELSE repeat('other ', 20) END, count(*)::BIGINT
    FROM documents GROUP BY 2
    """,
)
def profile_approx_texts(spark, sf_dir):
    """Long texts in the lists of an approximate profile."""
    texts = table(spark, sf_dir, "documents").select(*[F.expr(sql).alias(name) for name, sql in APPROX_TEXTS.items()])
    return tc.profile_columns(texts, approx=True).select("name", F.inline("top_values"))


LINEITEM_COLUMNS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
]


@query(
    "profile_distinct",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*)::BIGINT AS row_count,"
        f" count({c})::BIGINT AS non_null_count, count(DISTINCT {c})::BIGINT AS distinct_count"
        " FROM lineitem"
        for c in LINEITEM_COLUMNS
    ),
)
def profile_distinct(spark, sf_dir):
    return tc.distinct_counts(table(spark, sf_dir, "lineitem"), LINEITEM_COLUMNS)


# --- semantic hints and hidden types ---

CONTACTS = {
    "customer_id": ("CAST(c_custkey AS STRING)",) * 2,
    "contact": ("if(c_custkey % 10 = 0, 'none', concat('user', c_custkey, '@example.com'))",
                "CASE WHEN c_custkey % 10 = 0 THEN 'none' ELSE 'user' || c_custkey || '@example.com' END"),
    "line": ("concat('+1-555-', lpad(CAST(c_custkey AS STRING), 7, '0'))",
             "'+1-555-' || lpad(CAST(c_custkey AS VARCHAR), 7, '0')"),
    "since": ("CAST(date_add(DATE '2020-01-01', CAST(c_nationkey AS INT)) AS STRING)",
              "CAST(CAST(DATE '2020-01-01' + c_nationkey AS DATE) AS VARCHAR)"),
    "suffix": ("substr(c_name, 10)", "substr(c_name, 10)"),
    "balance": ("CAST(c_acctbal AS STRING)", "CAST(c_acctbal AS VARCHAR)"),
    "few_numbers": ("if(c_nationkey < 12, c_mktsegment, '1')",
                    "CASE WHEN c_nationkey < 12 THEN c_mktsegment ELSE '1' END"),
    "c_mktsegment": ("c_mktsegment", "c_mktsegment"),
}


def contacts(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        *[F.expr(sql).alias(name) for name, (sql, _) in CONTACTS.items()]
    )


CONTACTS_SQL = "SELECT " + ", ".join(
    f"{sql.replace('STRING', 'VARCHAR')} AS {name}" for name, (_, sql) in CONTACTS.items()
) + " FROM customer"


def rates_sql(name: str) -> str:
    """The match rates of one text column."""
    def full(pattern: str) -> str:
        return f"regexp_full_match({name}, '{pattern}')"

    date = " , ".join(
        f"count(*) FILTER (WHERE {full(shape)} AND try_strptime({name}, '{fmt}') IS NOT NULL)"
        for shape, fmt in (
            (r"\d{4}-\d{2}-\d{2}", "%Y-%m-%d"), (r"\d{4}/\d{2}/\d{2}", "%Y/%m/%d"),
            (r"\d{2}-\d{2}-\d{4}", "%d-%m-%Y"), (r"\d{2}/\d{2}/\d{4}", "%d/%m/%Y"),
        )
    )
    int_ = f"{full('[+-]?[0-9]+')} AND try_cast({name} AS BIGINT) IS NOT NULL"
    float_ = (
        full(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?")
        + f" AND try_cast({name} AS DOUBLE) IS NOT NULL"
    )
    return f"""
        SELECT '{name}' AS name,
               count(*) FILTER (WHERE {full(EMAIL_PATTERN)})::DOUBLE / count({name}) AS email,
               greatest({date})::DOUBLE / count({name}) AS date,
               count(*) FILTER (WHERE {full(PHONE_PATTERN)})::DOUBLE / count({name}) AS phone,
               count(*) FILTER (WHERE {int_})::DOUBLE / count({name}) AS int,
               count(*) FILTER (WHERE {float_})::DOUBLE / count({name}) AS float
        FROM ({CONTACTS_SQL})"""


RATES_SQL = " UNION ALL ".join(rates_sql(name) for name in CONTACTS)
HINT_SQL = """CASE WHEN regexp_matches(name, '(^|[_-])id$') THEN 'id'
                   WHEN email >= 0.8 THEN 'email' WHEN date >= 0.8 THEN 'date'
                   WHEN phone >= 0.8 THEN 'phone' END"""


@query("profile_hints", f"SELECT name, {HINT_SQL} AS semantic_hint FROM ({RATES_SQL})")
def profile_hints(spark, sf_dir):
    return tc.profile_columns(contacts(spark, sf_dir)).select("name", "semantic_hint")


@query(
    "profile_hints_native",
    """
    SELECT 'event_id' AS name, 'id' AS semantic_hint, count(event_id)::BIGINT AS non_null_count FROM events
    UNION ALL SELECT 'ts', 'date', count(ts)::BIGINT FROM events
    UNION ALL SELECT 'user_id', 'id', count(user_id)::BIGINT FROM events
    UNION ALL SELECT 'event_type', NULL, count(event_type)::BIGINT FROM events
    UNION ALL SELECT 'value', NULL, count(value)::BIGINT FROM events
    UNION ALL SELECT 'props', NULL, count(props)::BIGINT FROM events
    """,
)
def profile_hints_native(spark, sf_dir):
    profiled = tc.profile_columns(table(spark, sf_dir, "events"))
    return profiled.select("name", "semantic_hint", "non_null_count")


@query(
    "profile_inferred",
    f"""
    SELECT name,
           CASE WHEN int >= 0.8 THEN 'Int64' WHEN float >= 0.8 THEN 'Float64'
                WHEN date >= 0.8 THEN 'Date' END AS inferred_dtype,
           round(CASE WHEN int >= 0.8 THEN int WHEN float >= 0.8 THEN float
                      WHEN date >= 0.8 THEN date END, 9) AS inferred_match_rate
    FROM ({RATES_SQL})
    """,
)
def profile_inferred(spark, sf_dir):
    return tc.profile_columns(contacts(spark, sf_dir)).select(
        "name", "inferred_dtype", F.round("inferred_match_rate", 9).alias("inferred_match_rate")
    )


@query(
    "profile_hint_sample",
    f"""
    SELECT name, {HINT_SQL} AS semantic_hint,
           (SELECT count(*) FROM customer)::BIGINT AS row_count
    FROM ({RATES_SQL})
    """,
)
def profile_hint_sample(spark, sf_dir):
    # the hints see 100 rows, the counts see all
    profiled = tc.profile_columns(contacts(spark, sf_dir), hint_sample_rows=100)
    return profiled.select("name", "semantic_hint", "row_count")


# --- redaction and sampled tables ---


@query(
    "profile_redacted",
    """
    SELECT 'o_totalprice' AS name, true AS hidden, round(min(o_totalprice), 6) AS min_num,
           round(max(o_totalprice), 6) AS max_num FROM orders
    UNION ALL
    SELECT 'o_orderstatus', true, NULL, NULL
    """,
)
def profile_redacted(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_totalprice", "o_orderstatus")
    report = tc.redact(tc.profile(orders, "orders"))
    return report.columns.select(
        "name", F.col("top_values").isNull().alias("hidden"),
        F.round("min_num", 6).alias("min_num"), F.round("max_num", 6).alias("max_num"),
    )


ORDERS_NUMBERS = ("o_orderkey", "o_custkey", "o_totalprice")
ORDERS_COLUMNS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")


def _redacted_sql(column: str) -> str:
    number = column in ORDERS_NUMBERS
    least, most = (f"round({f}({column})::DOUBLE, 6)" if number else "NULL::DOUBLE" for f in ("min", "max"))
    return f"""SELECT '{column}' AS name, true AS hidden, {least} AS min_num, {most} AS max_num,
                      round((count(*) - count({column}))::DOUBLE / count(*), {RATE_DIGITS}) AS null_rate FROM orders"""


@query("profile_redacted_whole", " UNION ALL ".join(_redacted_sql(c) for c in ORDERS_COLUMNS))
def profile_redacted_whole(spark, sf_dir):
    report = tc.redact(tc.profile(table(spark, sf_dir, "orders"), "orders"))
    return report.columns.select(
        "name", F.col("top_values").isNull().alias("hidden"), F.round("min_num", 6).alias("min_num"),
        F.round("max_num", 6).alias("max_num"), F.round("null_rate", RATE_DIGITS).alias("null_rate"),
    )


DISTINCT_WHOLE = (
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus", "l_shipdate",
)


@query(
    "distinct_counts_lineitem",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) AS row_count, count({c}) AS non_null_count,"
        f" count(DISTINCT {c}) AS distinct_count FROM lineitem"
        for c in DISTINCT_WHOLE
    ),
)
def distinct_counts_lineitem(spark, sf_dir):
    """Keys and dates in bitmaps, other columns by value."""
    return tc.distinct_counts(table(spark, sf_dir, "lineitem"), list(DISTINCT_WHOLE))


@query(
    "profile_sampled",
    """
    SELECT 'orders' AS dataset, true AS sampled, count(*)::BIGINT AS row_count,
           CAST(NULL AS BIGINT) AS duplicate_row_count FROM orders
    """,
)
def profile_sampled(spark, sf_dir):
    profiled = tc.profile_table(table(spark, sf_dir, "orders"), "orders", sampled=True)
    return profiled.select("dataset", "sampled", "row_count", "duplicate_row_count")


# --- suggestions ---


def suggested_sql(ordinal: int, column: str, rule_id: str, param: str, value: str, when: str) -> str:
    return f"""
    SELECT {ordinal}::INTEGER AS ordinal, '{column}' AS column_name, '{rule_id}' AS rule_id,
           '{param}' AS param, {value} AS value
    FROM orders HAVING {when}"""


def _orders_suggestions() -> str:
    parts = []
    for i, c in enumerate(
        ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
    ):
        parts.append(suggested_sql(i, c, "null_check", "column", f"'{c}'", f"count(*) = count({c})"))
    for i, c in ((0, "o_orderkey"), (1, "o_custkey"), (3, "o_totalprice")):
        for param, value in (("column", f"'{c}'"), ("min_val", "'0.0'")):
            parts.append(suggested_sql(i, c, "range_check", param, value, f"min({c}) >= 0"))
    for i, c in ((2, "o_orderstatus"), (5, "o_orderpriority")):
        listed = (
            f"(SELECT '[\"' || string_agg(v, '\",\"' ORDER BY n DESC, v) || '\"]' FROM "
            f"(SELECT {c} AS v, count(*) AS n FROM orders GROUP BY 1))"
        )
        few = f"count(DISTINCT {c}) <= 5"
        parts.append(suggested_sql(i, c, "allowed_values", "column", f"'{c}'", few))
        parts.append(suggested_sql(i, c, "allowed_values", "values", listed, few))
    return " UNION ALL ".join(parts)


@query("suggest_rules", _orders_suggestions())
def suggest_rules(spark, sf_dir):
    suggested = tc.suggest_rules(tc.profile_columns(table(spark, sf_dir, "orders")))
    return suggested.select(
        "ordinal", "column_name", "rule_id", F.explode("params").alias("param", "value")
    )


SUGGESTED_CONTACTS = f"""
    SELECT name AS column_name, 'regex_match' AS rule_id, 'pattern' AS param,
           '{EMAIL_PATTERN}' AS value
    FROM ({RATES_SQL}) WHERE {HINT_SQL} = 'email'
    UNION ALL
    SELECT name, 'type_conformance', 'expected_type',
           CASE WHEN int >= 0.8 THEN 'int' WHEN float >= 0.8 THEN 'float' ELSE 'date' END
    FROM ({RATES_SQL}) WHERE int >= 0.8 OR float >= 0.8 OR date >= 0.8
    UNION ALL
    SELECT name, 'unique_check', 'column', name FROM ({RATES_SQL}) WHERE {HINT_SQL} = 'id'
"""


@query("suggest_rules_text", SUGGESTED_CONTACTS)
def suggest_rules_text(spark, sf_dir):
    suggested = tc.suggest_rules(tc.profile_columns(contacts(spark, sf_dir)))
    params = suggested.select(
        "column_name", "rule_id", F.explode("params").alias("param", "value")
    )
    return params.where(
        "rule_id = 'unique_check' OR (rule_id IN ('regex_match', 'type_conformance')"
        " AND param <> 'column')"
    )
