"""Exact duplicates by an extendible-hash index on shared files.

Texts are equal when they are identical after each run of white space becomes one blank; a
null text counts as empty. Every distinct text is one entry of the index, found by its 64-bit key.

1. ``records`` reads the texts once and writes id, key and digest; all later steps that need no
   text read these.
2. ``directory`` maps the first bits of a key to a bucket. It starts with one cell for each
   expected bucket and doubles while a bucket would hold more than ``capacity`` keys; buckets
   that do not need the last bits are shared by several cells.
3. Every text travels to the task that owns its bucket. The owner groups the bucket's texts by
   key and compares whole bytes; that alone decides ``keep_id`` and ``group_size``. Entries whose
   keys collide are chained by ``link``.

The directory is broadcast. It has at most 2 ** MOST_DEPTH cells, as the capacity grows with the
number of keys beyond MOST_BUCKETS buckets; a bucket that colliding keys keep overfull at that
depth stays so, as a longer chain. Keys with many rows are counted by key and text in the tasks
that read them, so that a group of copies sends an owner one row per text; as each of them
holds more than 1 / HOT_KEYS of all rows, their list has at most HOT_KEYS keys and is broadcast.

Defined results: of equal texts the row with the smallest ``doc_id`` stays, ids that are null
count as larger than all others; of rows that repeat both id and text one stays. Extra columns
are ignored here and returned by :func:`deduplicated`. An empty table has an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tablecheck.llm.common import SPACES, table, text_of, written

CAPACITY = 256
KEY_BITS = 64
MOST_BUCKETS = 1 << 17
MOST_DEPTH = 20
HOT_ROWS = 100
HOT_KEYS = 100_000


def normalised(name: str) -> Column:
    return F.regexp_replace(text_of(name), SPACES, " ")


def _key(text: Column, bits: int) -> Column:
    """The first bits of a 64-bit hash; fewer than 64 only to provoke collisions in tests."""
    key = F.xxhash64(text)
    return key if bits == KEY_BITS else F.shiftleft(F.shiftright(key, 64 - bits), 64 - bits)


def _prefix(key: Column, depth: int) -> Column:
    """The first ``depth`` bits of a key; a shift by 64 would be no shift."""
    return F.shiftrightunsigned(key, 64 - depth) if depth else F.lit(0).cast("long")


def records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key_bits: int = KEY_BITS) -> DataFrame:
    """``doc_id, key, digest`` of every row, as a table in the shared folder."""
    text = docs.select(F.col(id_col).alias("doc_id"), normalised(text_col).alias("whole"))
    key, digest = _key(F.col("whole"), key_bits), F.sha2("whole", 256)
    return written(text.select("doc_id", key.alias("key"), digest.alias("digest")), "records")


def directory(keys: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, int]:
    """Rows ``cell, bucket, local_depth``, one for each prefix of the global depth, and that depth."""
    fine = written(keys.groupBy(_prefix(F.col("key"), MOST_DEPTH).alias("cell")).agg(F.count("*").alias("held")), "cells")
    total = fine.agg(F.sum("held")).first()[0] or 0
    capacity = max(capacity, math.ceil(total / MOST_BUCKETS))
    depth = min(MOST_DEPTH, max(0, math.ceil(math.log2(max(1, total) / capacity))))

    def cells(depth: int) -> DataFrame:
        cell = F.shiftrightunsigned("cell", MOST_DEPTH - depth)
        return fine.groupBy(cell.alias("cell")).agg(F.sum("held").alias("held"))

    while depth < MOST_DEPTH and not cells(depth).where(F.col("held") > capacity).isEmpty():
        depth += 1  # the directory doubles
    at = cells(depth).select(
        "cell", "held", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("local_depth")
    )
    shift = (F.lit(depth) - F.col("local_depth")).cast("int")
    at = at.withColumn("bucket", F.call_function("shiftrightunsigned", F.col("cell"), shift))
    sizes = at.groupBy("local_depth", "bucket").agg(F.sum("held").alias("held"))
    fits = sizes.where((F.col("held") <= capacity) | (F.col("local_depth") == depth))
    chosen = (
        at.select("cell", "local_depth", "bucket")
        .join(fits.select("local_depth", "bucket"), ["local_depth", "bucket"])
        .groupBy("cell")
        .agg(F.min(F.struct("local_depth", "bucket")).alias("least"))
    )
    return written(chosen.select("cell", "least.bucket", "least.local_depth"), "directory"), depth


def build_index(
    docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    capacity: int = CAPACITY, key_bits: int = KEY_BITS, hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """The index of ``docs`` as a table in the shared folder; ``found`` are the records of ``docs``."""
    keys = written(found.groupBy("key").agg(F.count("*").alias("copies")), "keys")
    cells, depth = directory(keys, capacity)
    rows = keys.agg(F.sum("copies")).first()[0] or 0
    hot = keys.where(F.col("copies") > max(hot_rows, rows // HOT_KEYS)).select("key")

    text = docs.select(F.col(id_col).alias("doc_id"), normalised(text_col).alias("whole"))
    text = text.withColumn("key", _key(F.col("whole"), key_bits))
    cold = text.join(F.broadcast(hot), "key", "left_anti").select(
        "key", "whole", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size")
    )
    counted = text.join(F.broadcast(hot), "key", "left_semi").groupBy("key", "whole").agg(
        F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")
    )
    sent = cold.unionByName(counted).withColumn("cell", _prefix(F.col("key"), depth))
    sent = sent.join(F.broadcast(cells), "cell").drop("cell")
    # From here on the owners work alone: all groups lie within a bucket, nothing is exchanged.
    owned = sent.repartition("bucket", "local_depth")
    entries = owned.groupBy("bucket", "local_depth", "key", "whole").agg(
        F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")
    )
    digested = entries.withColumn("digest", F.sha2("whole", 256)).drop("whole")
    chain = Window.partitionBy("bucket", "local_depth", "key").orderBy("digest")
    return written(digested.withColumn("link", F.row_number().over(chain) - 1), "index")


def _entry(index: DataFrame) -> DataFrame:
    return index.select("key", "digest", "keep_id", "group_size", "bucket", "link")


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    capacity: int = CAPACITY, key_bits: int = KEY_BITS, hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256 and its place in the index."""
    keyed = records(docs, id_col, text_col, key_bits)
    index = build_index(docs, keyed, id_col, text_col, capacity, key_bits, hot_rows)
    # Counted before the join, so that the join alone deals out a large group and can split it.
    rows = keyed.groupBy("doc_id", "key", "digest").agg(F.count("*").cast("int").alias("rows"))
    found = rows.join(_entry(index), ["key", "digest"])
    each = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("rows"))))
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return each.select("doc_id", "keep_id", "group_size", stays.alias("kept"), F.col("digest").alias("text_sha256"), "bucket", "link")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    index = build_index(docs, records(docs, id_col, text_col), id_col, text_col)
    rows = docs.select(F.col(id_col).alias("id"), normalised(text_col).alias("whole"), F.struct("*").alias("row"))
    keyed = rows.select("id", _key(F.col("whole"), KEY_BITS).alias("key"), F.sha2("whole", 256).alias("digest"), "row")
    kept = keyed.join(_entry(index), ["key", "digest"]).where(F.col("id").eqNullSafe(F.col("keep_id")))
    return kept.dropDuplicates(["key", "digest"]).select("row.*")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicates of all documents."""
    return exact_duplicates(table(spark, sf_dir, "documents")).drop("bucket", "link")


SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS whole FROM documents
), g AS (
  SELECT whole, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY whole
)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.whole) AS text_sha256
FROM t JOIN g USING (whole)
"""
