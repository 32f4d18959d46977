"""Column references and the keys by which values are grouped."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from tablecheck.functions.types import is_fractional, is_string

# A string of this many bytes or more is grouped by its first characters and its SHA-256 (64
# hex characters), so that group keys are bounded, however long the text is. Shorter strings
# are their own key and can never equal such a key, which is longer.
STRING_KEY_BYTES = 64
BINARY_KEY_BYTES = 32

# A digested string starts with this many of its characters, so that keys sort like values.
STRING_KEY_PREFIX = 48


def chunks(items: list, size: int) -> list[list]:
    return [items[i : i + size] for i in range(0, len(items), size)]


def sql_name(name: str) -> str:
    """The name as SQL text."""
    return "`" + name.replace("`", "``") + "`"


def quoted(name: str) -> Column:
    """The column with exactly this name, dots and blanks included."""
    return F.col(sql_name(name))


def bounded_key(column: Column, data_type: T.DataType) -> Column:
    """A grouping key for ``column`` whose size does not grow with the value.

    Equal values have equal keys and different values have different ones (for long
    strings and binaries: up to a SHA-256 collision).
    """
    if is_string(data_type):
        return F.when(F.octet_length(column) < STRING_KEY_BYTES, column).otherwise(
            F.concat(F.left(column, F.lit(STRING_KEY_PREFIX)), F.sha2(column, 256))
        )
    if isinstance(data_type, T.BinaryType):
        return F.when(F.octet_length(column) < BINARY_KEY_BYTES, column).otherwise(
            F.unhex(F.sha2(column, 256))
        )
    return column


def is_digested(column: Column, data_type: T.DataType) -> Column:
    """Whether :func:`bounded_key` replaced the value by its digest."""
    limit = STRING_KEY_BYTES if is_string(data_type) else BINARY_KEY_BYTES
    return F.octet_length(column) >= limit


def string_order(key: Column) -> list[Column]:
    """One order of string keys, whatever their length: by the first characters of the value,
    then by the SHA-256 of all of it."""
    digest = F.when(F.octet_length(key) < STRING_KEY_BYTES, F.sha2(key, 256)).otherwise(F.right(key, F.lit(64)))
    return [F.left(key, F.lit(STRING_KEY_PREFIX)), digest]


def _is_atomic(data_type: T.DataType) -> bool:
    return not isinstance(data_type, (T.ArrayType, T.MapType, T.StructType))


def _as_netstring(column: Column, data_type: T.DataType) -> Column:
    if isinstance(data_type, T.BinaryType):
        text = F.hex(column)
    elif isinstance(data_type, T.TimestampType):
        # as an instant: the text of a session zone can be the same for two
        text = F.unix_micros(column).cast("string")
    elif isinstance(data_type, T.VariantType):
        text = F.to_json(column)
    elif is_fractional(data_type):
        # -0.0 and 0.0 are one value to a grouping, so they must be one text here
        text = F.when(column == 0, F.lit(0.0).cast(data_type)).otherwise(column).cast("string")
    else:
        text = column.cast("string")
    length_prefixed = F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)
    return F.coalesce(length_prefixed, F.lit("n"))


def row_key(schema: T.StructType) -> list[Column]:
    """Columns that identify a whole row; nulls equal each other.

    A row of any width becomes one 32-byte digest of its length-prefixed values (nested columns
    stay beside it), so that the shuffle carries the digest instead of the row. Texts count byte
    by byte, whatever their collation.
    """
    atomic = [_as_netstring(quoted(f.name), f.dataType) for f in schema.fields if _is_atomic(f.dataType)]
    nested = [quoted(f.name) for f in schema.fields if not _is_atomic(f.dataType)]
    return [F.unhex(F.sha2(F.concat(*atomic), 256)), *nested] if atomic else nested
