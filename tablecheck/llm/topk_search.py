"""Exact top-k search with block-at-a-time pruning.

Vectors are documents whose terms are the components, as whole numbers floor(scale x). They are
kept in blocks of ``BLOCK_ROWS`` with a forward index (the numbers of each row) and, for each
term, its largest and smallest value. Rows stand in order of coarse directions before blocks are cut,
so that a block holds rows that are alike. The bound of a block for a query sums, term by term, the
most that any of its rows can score: weight x largest, or x smallest where the weight is
negative. A second bound holds too, query x centre + length x radius, and the smaller one counts.
Each query visits blocks in falling order of their bounds and stops as soon as the
bound of the next is below its k-th best score; rows that tie with it are still seen. Scores are
whole numbers and exact: products of doubles where these hold them, else of 64-bit integers;
vectors whose scores could leave 64 bits raise ``OverflowError``.

Blocks stand in groups, queries in lists, and every group meets every list in one task: a grid
whose cells have a fixed size. One group is searched first; the k-th best score that a query has
there is a floor for the others, which return only what reaches it. A cell returns up to k rows
for each query, and these are merged by query.

Defined results: a vector that is null, empty, or holds null or non-finite components takes no
part, nor does one with a null id; shorter vectors count as filled up with zeros. Ties go to the
smaller id, and of rows that repeat an id the better ones come first; a query is not compared
with rows of its own id, and queries that repeat an id have one result, that of their first
vector in order. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tablecheck.llm.common import table, written

K = 10
SCALE = 1024
EVERY = 100
BLOCK_ROWS = 128
GROUP_ROWS = 8192
LIST_ROWS = 16384
SEED = 3
# No score: below all that fit.
NONE = -(1 << 63)

BEST = "query_id long, vec_id long, score long"


def whole_vectors(rows: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """``vec_id`` and ``terms``, whole numbers; without vectors that take no part."""
    value = lambda x: x.cast("double")
    bad = lambda x: x.isNull() | F.isnan(value(x)) | (F.abs(value(x)) == float("inf"))
    kept = rows.where(F.col(id_col).isNotNull() & (F.size(vector_col) > 0) & ~F.exists(vector_col, bad))
    return kept.select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.transform(vector_col, lambda x: F.floor(value(x) * F.lit(float(scale))).cast("long")).alias("terms"),
    )


def _matrix(terms: Iterable, width: int = 0) -> np.ndarray:
    rows = [np.asarray(t, dtype=np.int64) for t in terms]
    width = max([width, *map(len, rows)])
    out = np.zeros((len(rows), width), dtype=np.int64)
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


def _alike(rows: np.ndarray, ids: np.ndarray, size: int) -> np.ndarray:
    """An order of the rows by the pivot they are most alike, then by id."""
    by_id = np.argsort(ids, kind="stable")
    unit = rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1)
    pivots = unit[by_id[::size]]
    return by_id[np.argsort(np.argmax(unit @ pivots.T, axis=1)[by_id], kind="stable")]


class Blocks:
    """Forward indexes of document ranges, with the term maxima and minima of each range."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, size: int):
        order = _alike(rows.astype(np.float64), ids, size)
        self.ids, self.rows, self.size = ids[order], rows[order], size
        parts = [self.rows[c : c + size] for c in range(0, len(ids), size)]
        self.most, self.least = np.array([p.max(axis=0) for p in parts]), np.array([p.min(axis=0) for p in parts])
        self.centre = np.array([p.mean(axis=0) for p in parts])
        self.radius = np.array([np.linalg.norm(p - c, axis=1).max() for p, c in zip(parts, self.centre)])
        self.scored = 0  # blocks scored, added up over queries

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        by_term = np.maximum(queries, 0) @ self.most.T + np.minimum(queries, 0) @ self.least.T
        length = np.linalg.norm(queries.astype(np.float64), axis=1)[:, None]
        reach = length * (np.linalg.norm(self.centre, axis=1) + self.radius)
        # The margin is far above the rounding of these doubles.
        by_ball = queries @ self.centre.T + length * self.radius + 1 + 1e-9 * reach
        return np.where(by_ball < by_term, np.ceil(by_ball).astype(by_term.dtype), by_term)

    def search(
        self, query_ids: np.ndarray, queries: np.ndarray, k: int, floors: np.ndarray | None = None
    ) -> tuple[np.ndarray, np.ndarray]:
        """For each query the k best ids and scores, without those below its floor; ``NONE`` where
        there are fewer."""
        reach = (np.abs(queries.astype(np.float64)) @ np.abs(self.rows.astype(np.float64)).max(axis=0)).max()
        if reach >= 2.0**62:
            raise OverflowError("scores of these vectors may not fit into 64 bits: use a smaller scale")
        rows = self.rows
        if reach < 2.0**52:  # doubles are exact here, and their products much faster
            rows, queries = rows.astype(np.float64), queries.astype(np.float64)
        bounds = self.bounds(queries).astype(np.int64)
        visits = np.argsort(~bounds, axis=1, kind="stable")
        best = np.full((len(queries), k), NONE)
        found = np.full((len(queries), k), -1, dtype=np.int64)
        floors = np.full(len(queries), NONE) if floors is None else floors
        active = np.arange(len(queries))
        for turn in range(bounds.shape[1]):
            block = visits[active, turn]
            open_ = bounds[active, block] >= np.maximum(best[active, -1], floors[active])
            active, block = active[open_], block[open_]
            if not len(active):
                break
            self.scored += len(active)
            for b in np.unique(block):
                who, low = active[block == b], b * self.size
                ids = self.ids[low : low + self.size]
                scores = (queries[who] @ rows[low : low + self.size].T).astype(np.int64)
                scores[(ids[None, :] == query_ids[who, None]) | (scores < floors[who, None])] = NONE
                scores = np.concatenate([best[who], scores], axis=1)
                names = np.concatenate([found[who], np.broadcast_to(ids, (len(who), len(ids)))], axis=1)
                # The complement falls where the number rises, and no number is too small for it.
                order = np.lexsort((names, ~scores), axis=1)[:, :k]
                best[who] = np.take_along_axis(scores, order, axis=1)
                found[who] = np.take_along_axis(names, order, axis=1)
        return found, best


def _cell(k: int, block_rows: int):
    def search(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        names = [c.split()[0] for c in BEST.split(", ")]
        if not len(vectors) or not len(queries):
            return pd.DataFrame(columns=names)
        rows = _matrix(vectors["terms"])
        wanted = _matrix(queries["terms"], rows.shape[1])
        rows = _matrix(vectors["terms"], wanted.shape[1])
        ids = queries["vec_id"].to_numpy()
        blocks = Blocks(vectors["vec_id"].to_numpy(), rows, block_rows)
        found, best = blocks.search(ids, wanted, k, queries["floor"].to_numpy(np.int64))
        real = best != NONE
        return pd.DataFrame({"query_id": np.repeat(ids, k)[real.ravel()], "vec_id": found[real], "score": best[real]})

    return search


def top_k(
    vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K,
    scale: int = SCALE, block_rows: int = BLOCK_ROWS, group_rows: int = GROUP_ROWS, list_rows: int = LIST_ROWS,
) -> DataFrame:
    """For each row of ``queries`` its k best rows of ``vectors``: query_id, rank, vec_id, score."""
    rows = written(whole_vectors(vectors, id_col, vector_col, scale), "vectors")
    asked = whole_vectors(queries, id_col, vector_col, scale).groupBy("vec_id").agg(F.min("terms").alias("terms"))
    asked = written(asked, "queries")
    groups, lists = max(1, math.ceil(rows.count() / group_rows)), max(1, math.ceil(asked.count() / list_rows))
    # Groups are ranges of scattered places, so rows that repeat an id spread like all others.
    group = F.pmod(F.xxhash64(F.lit(SEED), "vec_id", "terms"), F.lit(groups)).cast("int")
    part = F.pmod(F.xxhash64(F.lit(SEED), "vec_id"), F.lit(lists)).cast("int")
    each_list = F.explode(F.sequence(F.lit(0), F.lit(lists - 1))).alias("list")
    left = rows.select("vec_id", "terms", group.alias("group"), each_list)

    def searched(low: int, high: int, asked: DataFrame) -> DataFrame:
        """The queries, which have a ``floor``, in the groups from ``low`` to ``high``."""
        each_group = F.explode(F.sequence(F.lit(low), F.lit(high))).alias("group")
        right = asked.select("vec_id", "terms", "floor", part.alias("list"), each_group)
        here = left.where(F.col("group").between(low, high)).groupBy("group", "list")
        return here.cogroup(right.groupBy("group", "list")).applyInPandas(_cell(k, block_rows), BEST)

    found = searched(0, 0, asked.withColumn("floor", F.lit(NONE)))
    if groups > 1:
        found = written(found, "first")
        floors = found.groupBy(F.col("query_id").alias("vec_id")).agg(F.count("*").alias("n"), F.min("score").alias("least"))
        floors = floors.where(F.col("n") >= k).select("vec_id", "least")
        bounded = asked.join(floors, "vec_id", "left").withColumn("floor", F.coalesce("least", F.lit(NONE)))
        found = found.union(searched(1, groups - 1, bounded))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best vectors for every hundredth one."""
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where(F.col("vec_id") % EVERY == 0))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS terms FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.terms, v.terms)::BIGINT AS score
  FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM p
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
