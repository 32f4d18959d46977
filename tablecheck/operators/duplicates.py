"""Rows that occur more than once, in two stages.

All rows are first counted by a 64-bit hash, which is cheap and travels in sixteen bytes. The hashes
that occur twice set bits of a filter of fixed size; only rows that pass it are identified by their
full key, a SHA-256 of all values, and counted again. Rows that pass by chance count as what they
are, single ones. So a table without duplicates is read once, and hashed with SHA-256 nowhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tablecheck.functions.columns import quoted, row_key
from tablecheck.functions.types import is_string

# The filter: this many words of 64 bits, as rows of a number and its bits.
FILTER_WORDS_LOG2 = 18

_WORD, _BIT, _BITS = "__filter_word", "__filter_bit", "__filter_bits"


def _is_hashed(data_type: T.DataType) -> bool:
    """Types whose equal values surely have equal hashes; rows are told apart by the others later."""
    plain = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BinaryType)
    return isinstance(data_type, plain) or is_string(data_type)


def _word(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - FILTER_WORDS_LOG2)


def _bit(h: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), h.bitwiseAND(F.lit(63)).cast("int"))


def _surplus(df: DataFrame) -> DataFrame:
    """One row ``row_count, duplicate_row_count`` by the full keys of all rows."""
    keys = df.select(*[key.alias(f"k{i}") for i, key in enumerate(row_key(df.schema))])
    copies = keys.groupBy(*keys.columns).agg(F.count(F.lit(1)).alias("cnt"))
    return copies.agg(
        F.coalesce(F.sum("cnt"), F.lit(0)).alias("row_count"),
        F.coalesce(F.sum(F.col("cnt") - 1), F.lit(0)).alias("duplicate_row_count"),
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row ``row_count, duplicate_row_count``: rows beyond the first of each kind.

    Nulls equal each other. Grouping is by hash and then by :func:`row_key`, so whole texts and
    wide rows are not shuffled.
    """
    hashed = [quoted(f.name) for f in df.schema.fields if _is_hashed(f.dataType)]
    if not hashed:
        return _surplus(df)
    # Zeros of both signs are one value to a grouping; the hash of Spark takes them as one too.
    h = F.xxhash64(*hashed)
    # Hashes come out of a generator: conditions on a projected expression of all columns would be
    # rewritten for every combination of their names, which wide tables do not survive.
    counts = df.select(F.inline(F.array(F.struct(h.alias("h"))))).groupBy("h").agg(F.count(F.lit(1)).alias("cnt"))
    # Whether a hash is repeated depends on its count: no filter moves below the aggregation,
    # and both readers share it.
    repeated = counts.where("cnt > 1").select(_word(F.col("h")).alias(_WORD), _bit(F.col("h")).alias("bit"))
    # At most 2 ** FILTER_WORDS_LOG2 rows of two numbers, whatever the table.
    bits = repeated.groupBy(_WORD).agg(F.bit_or("bit").alias(_BITS))

    columns = [quoted(c) for c in df.columns]
    rows = df.select(*columns, F.inline(F.array(F.struct(_word(h).alias(_WORD), _bit(h).alias(_BIT)))))
    rows = rows.join(F.broadcast(bits), _WORD)
    passed = rows.where(F.col(_BITS).bitwiseAND(F.col(_BIT)) != 0).select(*columns)
    total = counts.agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("row_count")).select("row_count", F.lit(0).cast("bigint").alias("duplicate_row_count"))
    extra = _surplus(passed).select(F.lit(0).cast("bigint").alias("row_count"), "duplicate_row_count")
    both = total.union(extra)
    return both.agg(F.sum("row_count").alias("row_count"), F.sum("duplicate_row_count").alias("duplicate_row_count"))
