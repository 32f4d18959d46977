"""Shards by a two-pass external shuffle.

First pass: every record goes to a bucket by a seeded hash of its id and text, so that a bucket
holds about ``bucket_bytes`` of text and fits in the memory of one task. Up to ``PART_BUCKETS``
neighbouring buckets are one partition of the exchange, so that partitions are far fewer than
buckets. Second pass: the task that owns a partition takes one bucket after the other, shuffles it
by Fisher and Yates (Spark's ``shuffle``) and writes it. Buckets follow one another, so a record's
rank in the whole order is the number of records in the buckets before its own plus its place
there; rank ranges are the shards, whose row counts differ by one at most (law ``rows``).

A bucket is bounded because the number of buckets follows the bytes of the input. Copies of a
text have ids of their own and spread. Rows that repeat both id and text would share a bucket;
where they have more than an eighth of its bytes, and more than one in ``HOT_SHARE`` of all, equal
rows are counted where they are read, and each bucket in turn gets its share as a number of copies,
which are made again in the task that shuffles it. Which rows are hot is a list of at most
``HOT_SHARE`` keys, so it may be broadcast.
The order is final once the files are written: readers see the files, never a second shuffle.

Defined results: a null text is null in the files and has size 1; a null id is an id like any
other; an empty table gives no rows. Extra columns are written with the others; those of rows that
repeat must have types by which Spark can group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tablecheck.llm.common import new_path, table, text_of, written

SHARDS = 16
BUCKET_BYTES = 8 << 20
PART_BUCKETS = 64
HOT_SHARE = 100_000
SEED = 7


def _size(text_col: str) -> Column:
    return (F.octet_length(text_of(text_col)) + 1).cast("long")


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """The setting while jobs run in here, then as it was."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def _repeated(docs: DataFrame, hot: DataFrame, buckets: int) -> DataFrame:
    """Hot rows as ``key, record, bucket, copies``: equal rows go round all buckets in turn."""
    equal = docs.join(F.broadcast(hot), "key").groupBy("key", "record").agg(F.count("*").alias("n"))
    turn = F.explode(F.sequence(F.lit(0).cast("long"), F.least("n", F.lit(buckets)) - 1)).alias("turn")
    dealt = equal.select("key", "record", "n", turn)
    return dealt.select(
        "key", "record", F.pmod(F.pmod("key", F.lit(buckets)) + F.col("turn"), F.lit(buckets)).cast("int").alias("bucket"),
        (F.floor(F.col("n") / F.lit(buckets)) + (F.col("turn") < F.col("n") % buckets).cast("int")).cast("long").alias("copies"),
    )


def shuffled_shards(
    docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text",
    shards: int = SHARDS, bucket_bytes: int = BUCKET_BYTES, seed: int = SEED,
) -> DataFrame:
    """Write the records in shuffled order and return them as read back from ``path``.

    Columns: those of ``docs`` in the struct ``record``, and ``shard, slot``.
    """
    spark = docs.sparkSession
    path = path or new_path(spark, "shards")
    key = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("key")
    keys = docs.select(key, _size(text_col).alias("size")).groupBy("key")
    keys = written(keys.agg(F.count("*").alias("n"), F.sum("size").alias("bytes")), "keys")
    total = keys.agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("rows")).first()
    rows, size = total["rows"] or 0, total["bytes"] or 0
    buckets = max(1, math.ceil(size / bucket_bytes))
    # At least as many partitions as the session asks for, where there are as many buckets.
    parts = max(math.ceil(buckets / PART_BUCKETS), min(buckets, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    per_part = math.ceil(buckets / parts)
    parts = math.ceil(buckets / per_part)

    hot = keys.where((F.col("n") > 1) & (F.col("bytes") > max(bucket_bytes // 8, size // HOT_SHARE))).select("key")
    records = docs.select(key, F.struct(*[F.col(c) for c in docs.columns]).alias("record"))
    own = F.pmod("key", F.lit(buckets)).cast("int").alias("bucket")
    counted = keys.select(own, F.col("n").alias("copies"), "key")
    scattered = records.select("key", "record", own, F.lit(1).cast("long").alias("copies"))
    if not hot.isEmpty():
        repeated = written(_repeated(records, hot, buckets), "repeated")
        cold = lambda df: df.join(F.broadcast(hot), "key", "left_anti")
        counted = cold(counted).select("bucket", "copies").union(repeated.select("bucket", "copies"))
        scattered = cold(scattered).unionByName(repeated)

    part = F.floor(F.col("bucket") / F.lit(per_part)).cast("int").alias("part")
    held = counted.groupBy("bucket").agg(F.sum("copies").alias("held")).withColumn("part", part)
    # One row per partition: where its ranks start, and the rows of each of its buckets.
    sums = held.groupBy("part").agg(
        F.sum("held").alias("all"), F.map_from_entries(F.collect_list(F.struct("bucket", "held"))).alias("held")
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("part", "held", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("start"))

    scattered = scattered.withColumn("part", part).repartition(parts, "part")
    owned = scattered.join(sums.hint("merge"), "part")
    earlier = F.aggregate(
        F.map_entries("held"), F.col("start"), lambda n, e: n + F.when(e["key"] < F.col("bucket"), e["value"]).otherwise(0)
    )
    owned = owned.select("part", "bucket", earlier.alias("offset"), "key", "record", "copies")
    owned = owned.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    whole = owned.groupBy("part", "bucket", "offset").agg(
        F.shuffle(F.array_sort(F.collect_list(F.struct("key", "record")), _by_key), F.lit(seed)).alias("records")
    )
    placed = whole.select("offset", F.posexplode("records").alias("place", "kept"))
    rank = F.col("offset") + F.col("place")
    # The first ``more`` shards hold one row more than the others.
    few, more = divmod(rows, shards)
    cut = F.lit(more * (few + 1))
    shard = F.when(rank < cut, F.floor(rank / F.lit(few + 1))).otherwise(
        F.lit(more) + F.floor((rank - cut) / F.lit(max(few, 1)))
    ).cast("int")
    start = F.col("shard") * F.lit(few) + F.least(F.col("shard"), F.lit(more))
    placed = placed.select(shard.alias("shard"), rank.alias("rank"), F.col("kept.record").alias("record"))
    placed = placed.withColumn("slot", (F.col("rank") - start).cast("long")).drop("rank")
    # Buckets are sorted and collected one after the other, not all of a partition at once.
    with _setting(spark, "spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "1"):
        placed.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(placed.schema).parquet(path)


def _by_key(a: Column, b: Column) -> Column:
    return F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards, from the files written."""
    files = shuffled_shards(table(spark, sf_dir, "documents"))
    return files.select(
        F.col("record.doc_id").alias("doc_id"),
        (F.octet_length(F.coalesce("record.text", F.lit(""))) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("record.text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
