"""Type families: the coarse classes in which two column types count as the same."""

from __future__ import annotations

import re

from pyspark.sql import types as T

# Every type name a contract snapshot may hold, by family. Snapshots come
# from different engines, so bigint and Int64 must meet in one family.
FAMILIES = {
    "integer": (
        "tinyint", "smallint", "int", "integer", "bigint", "byte", "short", "long",
        "int8", "int16", "int32", "int64", "int128",
        "uint8", "uint16", "uint32", "uint64", "uint128",
    ),
    "float": (
        "float", "double", "real", "float16", "float32", "float64",
        "decimal", "dec", "numeric",
    ),
    "temporal": (
        "date", "datetime", "time", "duration",
        "timestamp", "timestamp_ntz", "timestamp_ltz", "interval",
    ),
    "boolean": ("boolean", "bool"),
    "string": ("string", "str", "utf8", "varchar", "char", "character", "categorical", "enum"),
}

_FAMILY_OF = {name: fam for fam, names in FAMILIES.items() for name in names}


def family(type_name: str) -> str:
    """Family of a type name; a name outside every family stands for itself."""
    lowered = type_name.strip().lower()
    base = re.split(r"[(<\s]", lowered, maxsplit=1)[0]
    return _FAMILY_OF.get(base, lowered)


def family_of(data_type: T.DataType) -> str:
    return family(data_type.simpleString())


def is_numeric(data_type: T.DataType) -> bool:
    return isinstance(data_type, T.NumericType)


def is_temporal(data_type: T.DataType) -> bool:
    return family_of(data_type) == "temporal"


def is_string(data_type: T.DataType) -> bool:
    return family_of(data_type) == "string"


def is_fractional(data_type: T.DataType) -> bool:
    """Float or double: the types that can hold NaN."""
    return isinstance(data_type, (T.FloatType, T.DoubleType))
