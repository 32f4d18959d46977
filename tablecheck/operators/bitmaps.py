"""Distinct values of whole numbers, dates and timestamps, counted in bitmaps.

A value is one bit of a word of 64: what is grouped, first in the reading tasks, is the number of
the word, and what is exchanged are the word and its bits. Keys that lie close together, as ids and
dates do, travel 64 to a row; values that lie apart cost a row each, as they would by themselves,
so there is nothing to choose by the data. The bits of all tasks are joined by OR, and their
number is the number of distinct values. Copies beyond the first are what is left of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tablecheck.functions.columns import chunks, quoted
from tablecheck.operators.frequency import COLUMNS_PER_SCAN, Frequencies, frequencies, named

WORD_BITS = 6


def has_bits(data_type: T.DataType) -> bool:
    """Whether the values of a type are whole numbers, days or microseconds."""
    return isinstance(data_type, (T.IntegralType, T.DateType, T.TimestampType))


def _whole(column: Column, data_type: T.DataType) -> Column:
    if isinstance(data_type, T.DateType):
        return F.unix_date(column).cast("bigint")
    if isinstance(data_type, T.TimestampType):
        return F.unix_micros(column)
    return column.cast("bigint")


class Bitmaps:
    """Bitmaps of some columns, as a lazy DataFrame.

    ``frame`` has one row per column and word that occurs (the null one included): ``slot``,
    ``word``, ``bits`` and ``cnt``, the number of rows. Answers as :class:`Frequencies` does.
    """

    def __init__(self, df: DataFrame, columns: list[tuple[int, T.StructField]]):
        self.columns = columns
        pairs = [F.struct(F.lit(slot).alias("slot"), _whole(quoted(f.name), f.dataType).alias("v")) for slot, f in columns]
        values = df.select(F.inline(F.array(*pairs)))
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("v").bitwiseAND(F.lit((1 << WORD_BITS) - 1)).cast("int"))
        words = values.select("slot", F.shiftright("v", WORD_BITS).alias("word"), bit.alias("bit"))
        self.frame = words.groupBy("slot", "word").agg(F.count(F.lit(1)).alias("cnt"), F.bit_or("bit").alias("bits"))
        # No bits, no value: one expression, so that all readers keep the same aggregation.
        self.valued = F.when(F.col("bits").isNotNull(), F.col("cnt"))

    def distinct(self) -> DataFrame:
        """``slot, row_count, non_null_count, distinct_count``; no row where the table is empty."""
        return self.frame.groupBy("slot").agg(
            F.sum("cnt").alias("row_count"),
            F.coalesce(F.sum(self.valued), F.lit(0)).alias("non_null_count"),
            F.coalesce(F.sum(F.bit_count("bits").cast("bigint")), F.lit(0)).alias("distinct_count"),
        )

    def surplus(self) -> DataFrame:
        """One row, also for an empty table: ``n`` rows and per column the surplus copies ``s<slot>``."""
        slots = [slot for slot, _ in self.columns]
        n = F.sum(F.when(F.col("slot") == slots[0], F.col("cnt")))
        extra = [F.sum(F.when(F.col("slot") == s, self.valued - F.bit_count("bits"))) for s in slots]
        return self.frame.agg(
            F.coalesce(n, F.lit(0)).alias("n"),
            *[F.coalesce(e, F.lit(0)).alias(f"s{s}") for s, e in zip(slots, extra)],
        )


def distinct_values(df: DataFrame, columns: list[str] | None = None) -> list[Bitmaps | Frequencies]:
    """What counts the distinct values of the given columns (default all): bitmaps where there are
    bits, value counts elsewhere. Slots number the columns as given."""
    names = columns or df.columns
    by_name = {f.name: f for f in df.schema.fields}
    slots = list(enumerate(names))
    dense = [(slot, by_name[name]) for slot, name in slots if has_bits(by_name[name].dataType)]
    parts: list[Bitmaps | Frequencies] = [Bitmaps(df, group) for group in chunks(dense, COLUMNS_PER_SCAN)]
    rest = [(slot, name) for slot, name in slots if not has_bits(by_name[name].dataType)]
    if rest:
        parts += frequencies(df, [name for _, name in rest], [slot for slot, _ in rest])
    return parts


def distinct_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``column_name, row_count, non_null_count, distinct_count`` per column, exact."""
    return named([part.distinct() for part in distinct_values(df, columns)], columns or df.columns)
