"""Helpers that several operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# White space of a text is blank, tab, line feed, vertical tab, form feed and carriage return.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``, else one in the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    return folder or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/intermediate"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` from a table in the shared folder: later steps survive a lost executor."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def plain_id(name: str) -> tuple[Column, Column]:
    """An id as columns ``doc_id`` and ``no_id`` without nulls.

    pandas makes doubles of a long column that holds nulls, and doubles change ids beyond 2 ** 53.
    """
    whole = F.col(name).cast("long")
    return F.coalesce(whole, F.lit(0)).alias("doc_id"), whole.isNull().alias("no_id")


def with_id(df: DataFrame, name: str = "doc_id") -> DataFrame:
    """The id again, from the columns of :func:`plain_id`."""
    return df.withColumn(name, F.when(~F.col("no_id"), F.col(name))).drop("no_id")
