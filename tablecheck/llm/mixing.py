"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight and a schedule: multipliers at evenly spaced times between the start
(0) and the end (1) of training, linear in between. The integral of the schedule up to time t,
scaled so that it ends at the target of the source, is its cumulative token demand. The
documents of a source stand in a seeded order; the word at which a document starts, looked up
in the inverse of that demand, is the time at which the mix reads it: its training position.
A source whose target exceeds its size is read again from its start. The mix is the documents
range-sorted by position.

Targets: sources in the order of their code points, null last, take the weights in turn and
share ``share`` times all words; no source gets more than ``most`` times its size, and the
excess is shared again by weight among the others. That is one water level: with sources
ordered by size per weight, those below the level are filled and the rest get weight x level.

Running sums never put a source into one task: the seeded order is cut into buckets of about
``bucket_rows`` rows, buckets are summed first, and rows only within their bucket. The tables
of sources and buckets are as long as their names say.

Defined results: a null text has no words; rows repeated with the same id and text stand next
to each other in the order; a document with no words is taken 0 times and stands where the
next document starts, and a document the mix does not reach has no position. An empty table
has an empty result. Extra columns are kept by :func:`mixed`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tablecheck.llm.common import SPACES, WORD, table, text_of, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
# Multipliers of the weight at the start, the middle and the end, in turn like the weights.
SCHEDULES = ((1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.5, 1.0, 1.5))
SEED = 11
BUCKET_ROWS = 10_000


def words(name: str) -> Column:
    return F.regexp_count(text_of(name), F.lit(WORD)).cast("long")


def _order(id_col: str, text_col: str, seed: int) -> Column:
    """The place of a row in the seeded order, as 32 hexadecimal digits."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string"), F.md5(text_of(text_col))))


def _key(order: Column, source: Column) -> Column:
    """Names rows of one order and one source; a null source is not an empty one."""
    return F.concat(order, F.coalesce(F.concat(F.lit(":"), source.cast("string")), F.lit("")))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``source, source_size`` with ``target`` and ``slot``, its place in the turn of weights."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    slot = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.col("slot"))
    cap = F.col("source_size") * F.lit(float(most))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, rest, every = (
        by_level.rowsBetween(Window.unboundedPreceding, -1),
        by_level.rowsBetween(0, Window.unboundedFollowing),
        by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing),
    )
    total = F.sum("source_size").over(every)
    left = F.lit(float(share)) * total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = left / F.sum("weight").over(rest)
    shared = (
        sizes.withColumn("slot", slot).withColumn("weight", weight).withColumn("cap", cap)
        .withColumn("level", level)
        .withColumn("open", F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level")))
        .withColumn("level", F.first("open", ignorenulls=True).over(every))
    )
    target = F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    return shared.select("source", "source_size", "slot", target.alias("target"))


def _time(start: Column, target: Column, slot: Column, schedules) -> Column:
    """The time at which the cumulative demand of a source reaches ``start`` words."""
    at = F.lit(None).cast("double")
    for k, knots in enumerate(schedules):
        step = 1.0 / (len(knots) - 1)
        areas = [step * (a + b) / 2 for a, b in zip(knots, knots[1:])]
        wanted = start / target * F.lit(sum(areas))
        found, done = F.lit(1.0), sum(areas)
        for i in reversed(range(len(areas))):
            done -= areas[i]
            slope = (knots[i + 1] - knots[i]) / step
            rest = wanted - F.lit(done)
            root = F.sqrt(F.greatest(F.lit(knots[i] ** 2) + F.lit(2 * slope) * rest, F.lit(0.0)))
            inside = F.lit(i * step) + F.lit(2.0) * rest / (F.lit(knots[i]) + root)
            found = F.when(rest >= 0, inside).otherwise(found)
        at = F.when(slot == k, found).otherwise(at)
    return at


def curriculum(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights=WEIGHTS, share: float = SHARE, most: int = MOST, schedules=SCHEDULES,
    seed: int = SEED, bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """One row per document: its order, size, source_size, target, start, and what the mix takes.

    ``taken_k`` words are read at ``position_k`` in the k-th pass over the source, and
    ``taken`` is their sum. ``whole_k`` is 1 if the pass reads the document when texts are kept
    whole, else 0: the document in which the target falls is read where that ends the source
    nearer to its target than leaving it. ``order`` names the row for :func:`mixed`.
    """
    slim = written(
        docs.select(
            F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
            words(text_col).alias("size"), _order(id_col, text_col, seed).alias("order"),
        ),
        "sizes",
    )
    buckets = max(1, math.ceil(slim.count() / bucket_rows))
    place = F.conv(F.substring("order", 1, 8), 16, 10).cast("long")
    cut = slim.withColumn("bucket", F.floor(place * buckets / F.lit(2.0**32)).cast("long"))
    summed = written(cut.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "buckets")
    sizes = summed.groupBy("source").agg(F.sum("words").alias("source_size"))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = summed.withColumn("ahead", F.coalesce(F.sum("words").over(ahead), F.lit(0)))
    level = targets(sizes, weights, share, most)
    starts = starts.join(level.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
    starts = starts.select(F.col("source").alias("of"), F.col("bucket").alias("at"), "ahead", "source_size", "slot", "target")
    within = Window.partitionBy("source", "bucket").orderBy("order", "doc_id", "size")
    inside = F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = cut.withColumn("inside", inside - F.col("size")).join(
        starts, F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("at"))
    )
    rows = rows.withColumn("start", F.col("ahead") + F.col("inside"))
    quota, size, zero = F.floor("target"), F.col("size"), F.lit(0).cast("long")
    made = {}
    for k in range(most):
        begins = F.col("start") + F.col("source_size") * k
        made[f"taken_{k}"] = F.greatest(zero, F.least(size, quota - begins))
        nearer = (F.col("target") - begins) * 2 >= size
        made[f"whole_{k}"] = F.when((begins < quota) & (size > 0) & nearer, 1).otherwise(0)
        made[f"position_{k}"] = F.when(
            (begins < quota) & (F.col("target") > 0), _time(begins, F.col("target"), F.col("slot"), schedules)
        )
    rows = rows.withColumns(made)
    taken = sum((F.col(f"taken_{k}") for k in range(1, most)), F.col("taken_0"))
    return rows.withColumn("taken", taken).select(
        "doc_id", "source", "order", "size", "source_size", "target", "start", "taken", *made
    )


def mixed(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights=WEIGHTS, share: float = SHARE, most: int = MOST, schedules=SCHEDULES,
    seed: int = SEED, bucket_rows: int = BUCKET_ROWS, position_col: str | None = None, whole: bool = False,
) -> DataFrame:
    """The mix itself: rows of ``docs``, repeated as often as they are read, sorted by position.

    Where a source ends at its target within a document, the words up to there are read, joined
    by one blank; all other texts are whole and unchanged. With ``whole`` all texts are: that
    document is read whole or not at all, whichever ends the source nearer to its target.
    """
    plan = curriculum(docs, id_col, text_col, source_col, weights, share, most, schedules, seed, bucket_rows)
    taken = [F.when(F.col(f"whole_{k}") == 1, F.col("size")).otherwise(0) if whole else F.col(f"taken_{k}") for k in range(most)]
    reads = F.array(*[F.struct(t.cast("long").alias("taken"), F.col(f"position_{k}").alias("position")) for k, t in enumerate(taken)])
    # Rows of one id, text and source take the reads in turn, in the order of their other columns.
    plan = plan.select(_key(F.col("order"), F.col("source")).alias("key"), "size", F.struct("start", reads.alias("reads")).alias("read"))
    plan = plan.where("size > 0").groupBy("key", "size").agg(F.sort_array(F.collect_list("read")).alias("turns"))
    others = [c for c in docs.columns if c not in (id_col, text_col, source_col)]
    rest = F.to_json(F.struct(*[F.col(f"`{c}`") for c in others])) if others else F.lit("")
    key = _key(_order(id_col, text_col, seed), F.col(source_col))
    rows = docs.select(key.alias("key"), rest.alias("rest"), F.struct("*").alias("row"))
    rows = rows.withColumn("turn", F.row_number().over(Window.partitionBy("key").orderBy("rest"))).join(plan, "key")
    rows = rows.select("key", "size", "row", F.explode(F.get("turns", F.col("turn") - 1)["reads"]).alias("read"))
    rows = rows.where("read.taken > 0").orderBy("read.position", "key")
    full = F.col(f"row.{text_col}")
    first = F.slice(F.split(F.trim(F.regexp_replace(full, SPACES, " ")), " "), F.lit(1), F.col("read.taken").cast("int"))
    text = F.when(F.col("read.taken") < F.col("size"), F.array_join(first, " ")).otherwise(full)
    columns = [(text if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in docs.columns]
    return rows.select(*columns, *([F.col("read.position").alias(position_col)] if position_col else []))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents, one row per document, range-sorted by first position."""
    plan = curriculum(table(spark, sf_dir, "documents"))
    rows = plan.select("doc_id", "size", "source_size", "target", "taken", F.round("position_0", 9).alias("position"))
    return rows.orderBy(F.col("position").asc_nulls_last(), "doc_id")


def _time_sql() -> str:
    cases = []
    for k, knots in enumerate(SCHEDULES):
        step = 1.0 / (len(knots) - 1)
        areas = [step * (a + b) / 2 for a, b in zip(knots, knots[1:])]
        whens, done = [], sum(areas)
        for i in reversed(range(len(areas))):
            done -= areas[i]
            rest = f"(begins / target * {sum(areas)!r}::DOUBLE - {done!r}::DOUBLE)"
            slope = (knots[i + 1] - knots[i]) / step
            root = f"sqrt(greatest({knots[i] ** 2!r}::DOUBLE + {2 * slope!r}::DOUBLE * {rest}, 0.0::DOUBLE))"
            whens.append(f"WHEN {rest} >= 0 THEN {i * step!r}::DOUBLE + 2.0::DOUBLE * {rest} / ({knots[i]!r}::DOUBLE + {root})")
        cases.append(f"WHEN slot = {k} THEN CASE {' '.join(whens)} ELSE 1.0::DOUBLE END")
    return f"CASE {' '.join(cases)} END"


SQL = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size,
         md5(concat_ws(':', '{SEED}', doc_id::VARCHAR, md5(coalesce(text, '')))) AS k
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, 2.0::DOUBLE * sum(size)::DOUBLE AS cap,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS slot
  FROM d GROUP BY source
), w AS (SELECT *, [5.0, 2.0, 1.0][slot + 1]::DOUBLE AS weight FROM s),
l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE
      - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
      / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w
), f AS (
  SELECT min_by(level, cap / weight) AS level FROM l WHERE level * weight <= cap
), t AS (
  SELECT w.*, least(cap, coalesce(f.level * weight, cap)) AS target FROM w LEFT JOIN f ON true
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.slot,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS begins
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (greatest(0, least(size, floor(target) - begins))
        + greatest(0, least(size, floor(target) - begins - source_size)))::BIGINT AS taken,
       CASE WHEN begins < floor(target) AND target > 0 THEN round({_time_sql()}, 9) END AS position
FROM r
"""
