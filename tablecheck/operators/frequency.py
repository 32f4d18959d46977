"""How often each value of each column occurs, and what follows from it.

Columns of one type are counted together: one scan of just these columns and one shuffle of
``(column, value, count)``. Counting starts in the map tasks, so a value that fills a third
of the table leaves each task as one row, and long texts travel as digests (see
:func:`tablecheck.functions.columns.bounded_key`).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tablecheck.functions.columns import (
    bounded_key,
    chunks,
    is_digested,
    quoted,
    string_order,
)
from tablecheck.functions.types import is_string

# Fixed value: how many of the most frequent values a profile shows.
TOP_VALUES = 5

# Up to this many values per column Spark cuts the lists of all columns in the tasks, in one
# plan; beyond, the list of each column is cut by a limit of its own.
WINDOW_TOP_VALUES = 1000

# Columns of one type counted together; more are counted in several scans.
COLUMNS_PER_SCAN = 40


class Frequencies:
    """Value counts of some columns of one type, as a lazy DataFrame.

    ``frame`` has one row per column and distinct value (null included): ``slot`` is the
    number the column was given, ``v`` the value or its digest, ``cnt`` the number of rows.
    """

    def __init__(self, df: DataFrame, columns: list[tuple[int, T.StructField]]):
        self.df = df
        self.columns = columns
        self.type = columns[0][1].dataType
        pairs = [F.struct(F.lit(slot).alias("slot"), _key(f).alias("v")) for slot, f in columns]
        # also for one column: a slot that is a literal would be folded into each reader, in
        # other ways, and they would no longer share the shuffle
        values = df.select(F.inline(F.array(*pairs)))
        self.frame = values.groupBy("slot", "v").agg(F.count(F.lit(1)).alias("cnt"))
        # Rows of a non-null value. One expression over value and count, so that neither a
        # filter on it moves below the aggregation nor the count is pruned: all readers
        # keep the same aggregation and share its shuffle.
        self.valued = F.when(F.col("v").isNotNull(), F.col("cnt"))

    def key(self, name: str) -> Column:
        """What stands in ``v`` for the value of a row of the table."""
        return next(_key(f) for _, f in self.columns if f.name == name)

    def distinct(self) -> DataFrame:
        """``slot, row_count, non_null_count, distinct_count``; no row where the table is
        empty."""
        return self.frame.groupBy("slot").agg(
            F.sum("cnt").alias("row_count"),
            F.coalesce(F.sum(self.valued), F.lit(0)).alias("non_null_count"),
            F.count_if(self.valued > 0).alias("distinct_count"),
        )

    def numbers(self) -> DataFrame:
        """``slot, v, cnt`` of the non-null values of numeric columns, as doubles."""
        # Both depend on the count: else the tests for null that a join or a bound puts on them
        # would move below the aggregation, which then was no longer the one that others share.
        slot = F.when(self.valued > 0, F.col("slot")).alias("slot")
        value = F.when(self.valued > 0, F.col("v").cast("double")).alias("v")
        return self.frame.where(self.valued > 0).select(slot, value, "cnt")

    def surplus(self) -> DataFrame:
        """One row, also for an empty table: ``n`` rows and per column the surplus copies
        ``s<slot>`` (three equal values are two surplus ones; nulls are none)."""
        slots = [slot for slot, _ in self.columns]
        n = F.sum(F.when(F.col("slot") == slots[0], F.col("cnt")))
        extra = [F.sum(F.when(F.col("slot") == s, self.valued - 1)) for s in slots]
        return self.frame.agg(
            F.coalesce(n, F.lit(0)).alias("n"),
            *[F.coalesce(e, F.lit(0)).alias(f"s{s}") for s, e in zip(slots, extra)],
        )

    def top(self, k: int) -> DataFrame:
        """``slot, rank, value, count``: the k most frequent values per column, ties in
        ascending order: texts by :func:`string_order`.

        Each task keeps its own k best per column, so only those rows are exchanged.
        """
        v = F.col("v")
        text = F.hex(v) if isinstance(self.type, T.BinaryType) else v.cast("string")
        # maps have no order of their own
        ties = [text if isinstance(self.type, T.MapType) else v]
        order = [F.desc("cnt"), *(string_order(v) if is_string(self.type) else ties)]
        values = self.frame.where(self.valued > 0)
        if k > WINDOW_TOP_VALUES:
            each = [values.where(F.col("slot") == slot) for slot, _ in self.columns]
            values = reduce(DataFrame.union, [part.orderBy(*order).limit(k) for part in each])
        best = (
            values.withColumn("rank", F.row_number().over(Window.partitionBy("slot").orderBy(*order)))
            .where(F.col("rank") <= k)
            .select("slot", "rank", text.alias("key"), F.col("cnt").alias("count"))
        )
        if not is_string(self.type):
            return best.withColumnRenamed("key", "value")

        # The whole text behind a digest: read the text columns again and keep the values
        # that made the list. The broadcast keys are at most k per column, of fixed size; the
        # texts found are as few, but of any length, so they are joined without a hint.
        pairs = [
            F.struct(F.lit(slot).alias("slot"), quoted(f.name).alias("value"))
            for slot, f in self.columns
        ]
        long_values = (
            self.df.select(F.inline(F.array(*pairs)))
            .where(is_digested(F.col("value"), self.type))
            .withColumn("key", bounded_key(F.col("value"), self.type))
        )
        wanted = best.where(is_digested(F.col("key"), self.type)).select("slot", "key")
        found = long_values.join(F.broadcast(wanted), ["slot", "key"], "left_semi").distinct()
        return best.join(found, ["slot", "key"], "left").select(
            "slot", "rank", F.coalesce("value", "key").alias("value"), "count"
        )


def _key(f: T.StructField):
    key = bounded_key(quoted(f.name), f.dataType)
    kind = _kind(f.dataType)
    return key if f.dataType.simpleString() == kind else key.cast(kind)


def countable(df: DataFrame) -> DataFrame:
    """``df`` with the types that have no equality, VARIANT and calendar intervals, as text."""
    plain = {
        f.name: F.to_json(quoted(f.name)) if isinstance(f.dataType, T.VariantType) else quoted(f.name).cast("string")
        for f in df.schema.fields
        if isinstance(f.dataType, (T.VariantType, T.CalendarIntervalType))
    }
    return df.select(*[plain[c].alias(c) if c in plain else quoted(c) for c in df.columns]) if plain else df


def _kind(data_type: T.DataType) -> str:
    """The type under which a column is counted: integers of any width meet in one."""
    if isinstance(data_type, T.IntegralType):
        return "bigint"
    return "string" if is_string(data_type) else data_type.simpleString()


def frequencies(
    df: DataFrame, columns: list[str] | None = None, slots: list[int] | None = None
) -> list[Frequencies]:
    """Value counts of the given columns (default all), numbered as given or by ``slots``."""
    df = countable(df)
    by_name = {f.name: f for f in df.schema.fields}
    names = columns or df.columns
    kinds: dict[str, list] = {}
    for slot, name in zip(slots or range(len(names)), names):
        kinds.setdefault(_kind(by_name[name].dataType), []).append((slot, by_name[name]))
    return [
        Frequencies(df, group) for same in kinds.values() for group in chunks(same, COLUMNS_PER_SCAN)
    ]


def named(parts: list[DataFrame], names: list[str]) -> DataFrame:
    """Stack the parts, with ``column_name`` in the place of ``slot``."""
    name = F.array(*[F.lit(c) for c in names])[F.col("slot")]
    stacked = reduce(DataFrame.union, parts)
    return stacked.withColumn("slot", name).withColumnRenamed("slot", "column_name")


def top_values(df: DataFrame, columns: list[str] | None = None, k: int = TOP_VALUES) -> DataFrame:
    """``column_name, rank, value, count``: the k most frequent non-null values per column,
    most frequent first. Values equally frequent come in ascending order; texts by their first
    48 characters, then by the SHA-256 of the whole text.
    """
    parts = [counted.top(k) for counted in frequencies(df, columns)]
    return named(parts, columns or df.columns)
