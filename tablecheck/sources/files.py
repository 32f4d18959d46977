"""CSV and Parquet sources. Paths may be files, directories or globs."""

from __future__ import annotations

from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, types as T


def load_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    sampling_ratio: float | None = None,
    multi_line: bool = True,
) -> DataFrame:
    """CSV with a header line. Without a schema the types are inferred, ISO dates as dates,
    which reads the files once more; ``sampling_ratio`` infers from part of the lines.

    Fields in double quotes may hold commas, doubled quotes and line breaks. A file that may
    have line breaks in fields is read by one task; ``multi_line=False`` splits large files,
    where no field has any. A line with too few or too many fields fails the read.
    """
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"')
    reader = reader.option("multiLine", multi_line).option("mode", "FAILFAST")
    if schema is not None:
        return reader.schema(schema).csv(path)
    if sampling_ratio is not None:
        reader = reader.option("samplingRatio", sampling_ratio)
    return reader.option("inferSchema", True).csv(path)


def load_parquet(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None
) -> DataFrame:
    return (spark.read if schema is None else spark.read.schema(schema)).parquet(path)


_LOADERS = {"csv": load_csv, "parquet": load_parquet}


def load_table(
    spark: SparkSession, path: str, format: str | None = None, **options: Any
) -> DataFrame:
    """Read by format, which defaults to the suffix of the path.

    The options are those of the loader: ``schema``, and for CSV ``sampling_ratio`` and
    ``multi_line``.
    ``ValueError`` for a format other than csv and parquet, ``FileNotFoundError`` where
    there is nothing at the path.
    """
    last = path.rstrip("/").rsplit("/", 1)[-1]
    suffix = "." + last.rsplit(".", 1)[-1] if "." in last else ""
    kind = format or suffix[1:]
    if kind not in _LOADERS:
        raise ValueError(f"unsupported file type '{format or suffix}' (csv or parquet only)")
    try:
        return _LOADERS[kind](spark, path, **options)
    except AnalysisException as exc:
        if exc.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"no file at '{path}'") from exc
        raise
