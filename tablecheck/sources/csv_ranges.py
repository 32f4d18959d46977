"""CSV files whose quoted fields hold line breaks, read by many tasks.

A line break ends a record where the quotes before it are even in number. A first scan counts the
quotes per byte range; one row per range is summed up to whether a field is open where the range
starts. With that a second scan cuts each range into records on its own, in the tasks that read it.
Only what crosses the ends of ranges is exchanged: at most two pieces of a record per range.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

RANGE = ["file", "start"]

# Pieces of records: WHOLE ones, ENDs of a record of an earlier range, BEGINnings of one that goes
# on in the next, and ranges that lie within one record and hold its MIDDLE.
WHOLE, END, MIDDLE, BEGIN = range(4)
PIECES = "file string, start long, kind int, head boolean, record string"


def _pieces(whole: bool):
    """Cut the lines of ranges into pieces; give the whole records, or else the others."""

    def joined(lines: list, ends: np.ndarray) -> pa.Array:
        offsets = pa.array(np.concatenate([[0], ends]), pa.int64())
        text = pa.concat_arrays(lines)
        return pc.binary_join(pa.LargeListArray.from_arrays(offsets, text), pa.scalar("\n", pa.large_string()))

    def table(of: tuple, kinds: list[int], heads: list[bool], records: pa.Array) -> pa.RecordBatch:
        n = len(kinds)
        columns = [pa.array([of[0]] * n, pa.string()), pa.array([of[1]] * n, pa.int64()), pa.array(kinds, pa.int32())]
        return pa.RecordBatch.from_arrays([*columns, pa.array(heads, pa.bool_()), records.cast(pa.string())], ["file", "start", "kind", "head", "record"])

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, odd, fresh, held = None, 0, True, []  # the range, its state, nothing ended yet, lines not ended

        def rest() -> Iterator[pa.RecordBatch]:
            if held and not whole:
                lines = sum(map(len, held))
                kind = MIDDLE if fresh and opened else BEGIN
                yield table(now, [kind], [fresh and now[1] == 0], joined(held, np.array([lines])))

        opened = False
        for batch in batches:
            files, starts = batch.column("file"), batch.column("start").to_numpy()
            opens = batch.column("opened")
            lines = batch.column("line").cast(pa.large_string())
            if not len(lines):
                continue
            other = pc.not_equal(files[1:], files[:-1]).to_numpy(zero_copy_only=False) | (starts[1:] != starts[:-1])
            bounds = [0, *(np.flatnonzero(other) + 1), len(lines)]
            for low, high in zip(bounds, bounds[1:]):
                of = (files[low].as_py(), int(starts[low]))
                if of != now:
                    yield from rest()
                    now, fresh, held = of, True, []
                    opened = opens[low].as_py()
                    odd = int(opened)
                run = lines[low:high]
                upto = odd + np.cumsum(pc.count_substring(run, '"').to_numpy())
                odd = int(upto[-1]) % 2
                ends = np.flatnonzero(upto % 2 == 0) + 1
                if not len(ends):
                    held.append(run)
                    continue
                before = sum(map(len, held))
                records = joined([*held, run[: ends[-1]]], ends + before)
                held = [run[ends[-1] :]] if ends[-1] < len(run) else []
                first = fresh and opened
                if whole:
                    skip = int(fresh and (opened or of[1] == 0))  # an end, or the header
                    if len(records) > skip:
                        n = len(records) - skip
                        yield table(of, [WHOLE] * n, [False] * n, records[skip:])
                elif first:
                    yield table(of, [END], [False], records[:1])
                fresh = False
        yield from rest()

    return cut


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """``record``: the records of the files without their header, as text.

    A record is one row, so it is held by one task. One row of nine bytes is broadcast for each range
    (``spark.sql.files.maxPartitionBytes``) that starts within a field: 7 MB for 100 TB in ranges of 128 MB.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("line")
    )
    counted = F.octet_length("line") - F.octet_length(F.replace("line", F.lit('"')))
    quotes = F.when(F.col("line").contains('"'), counted).otherwise(0)
    in_file = Window.partitionBy("file").orderBy("start")
    held = lines.groupBy(*RANGE).agg(F.sum(quotes).alias("held"))
    before = F.sum("held").over(in_file.rowsBetween(Window.unboundedPreceding, -1))
    name = F.xxhash64(*RANGE).alias("name")
    opened = held.withColumn("before", before).where(F.col("before") % 2 == 1).select(name, F.lit(True).alias("opened"))
    known = lines.withColumn("name", name).join(F.broadcast(opened), "name", "left")
    known = known.select(*RANGE, F.coalesce("opened", F.lit(False)).alias("opened"), "line")

    whole = known.mapInArrow(_pieces(True), PIECES).select("record")
    pieces = known.mapInArrow(_pieces(False), PIECES)
    begun = F.sum((F.col("kind") == BEGIN).cast("long")).over(Window.partitionBy("file").orderBy("start", "kind"))
    crossing = pieces.withColumn("number", begun).groupBy("file", "number").agg(
        F.array_sort(F.collect_list(F.struct("start", "kind", "record"))).alias("pieces"), F.bool_or("head").alias("head")
    ).where(~F.col("head")).select(F.array_join("pieces.record", "\n").alias("record"))
    returned = F.col("record").endswith("\r")
    found = whole.unionByName(crossing).select(F.when(returned, F.expr("left(record, length(record) - 1)")).otherwise(F.col("record")).alias("record"))
    return found.where(F.col("record") != "")


def load_csv_ranges(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """As ``load_csv`` with ``multi_line=True``, but each file is read by as many tasks as its size asks
    for (``spark.sql.files.maxPartitionBytes``).

    Quotes stand only around whole fields, and doubled within them, as RFC 4180 says; a lone quote
    within a bare field would shift all records after it. Lines end with LF or CRLF. The schema
    is given, in the order of the columns. A record with too few or too many fields fails the read.
    """
    ddl = schema if isinstance(schema, str) else schema.toDDL()
    options = {"quote": '"', "escape": '"', "multiLine": "true", "mode": "FAILFAST"}
    return csv_records(spark, path).select(F.from_csv("record", ddl, options).alias("row")).select("row.*")
