import math

from tablecheck.llm import topk_search
from llm_fixtures import rng  # noqa: F401

SCHEMA = "vec_id long, embedding array<float>, label int, score string, rank string, terms string"


def expected(rows, queries, k):
    def terms(v):
        return [math.floor(1024 * x) for x in v]

    def usable(i, v):
        return i is not None and v and all(x is not None and math.isfinite(x) for x in v)

    known = [(i, terms(v)) for i, v in rows if usable(i, v)]
    out = []
    asked = {}
    for i, v in sorted((i, terms(v)) for i, v in queries if usable(i, v)):
        asked.setdefault(i, v)
    for i, v in asked.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in known if j != i)
        out += [(i, rank, j, -s) for rank, (s, j) in enumerate(scored[:k], 1)]
    return sorted(out)


def search(spark, rows, queries, **options):
    frame = lambda r: spark.createDataFrame([(*x, 1, "a", "b", "c") for x in r], SCHEMA)
    return sorted(map(tuple, topk_search.top_k(frame(rows), frame(queries), **options).collect()))


def vectors(rng, n, width=8):
    import struct

    single = lambda x: struct.unpack("f", struct.pack("f", x))[0]
    return [(i, [single(rng.gauss(0, 1)) for _ in range(width)]) for i in range(n)]


def test_against_brute_force(spark, rng):
    rows = vectors(rng, 500)
    queries = rows[::25]
    want = expected(rows, queries, 10)
    assert search(spark, rows, queries) == want
    assert search(spark, rows, queries, block_rows=16, group_rows=100, list_rows=7) == want


def test_ties_and_few_rows(spark, rng):
    rows = [(i, [0.5, -0.25]) for i in range(30)]
    assert search(spark, rows, rows[:3], block_rows=4) == expected(rows, rows[:3], 10)
    assert search(spark, rows[:4], rows[:2]) == expected(rows[:4], rows[:2], 10)


def test_rows_that_take_no_part(spark):
    rows = [
        (0, [1.0, 2.0]), (1, None), (2, []), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]),
        (None, [9.0, 9.0]), (6, [3.0]), (7, [1.0, 1.0, 5.0]), (8, [-1.0, -1.0]), (8, [2.0, 2.0]), (0, [1.0, 3.0]),
    ]
    assert search(spark, rows, rows) == expected(rows, rows, 10)


def test_empty_tables(spark, rng):
    rows = vectors(rng, 5)
    assert search(spark, [], []) == []
    assert search(spark, rows, []) == []
    assert search(spark, [], rows) == []


def test_blocks_below_the_bound_are_not_scored(rng):
    import numpy as np

    ids, rows = np.arange(100), np.zeros((100, 2), dtype=np.int64)
    rows[:10] = 1000
    blocks = topk_search.Blocks(ids, rows, 10)
    seen = []

    class Watched(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, slice):
                seen.append(key.start)
            return super().__getitem__(key)

    blocks.ids = ids.view(Watched)
    found, best = blocks.search(np.array([-1]), np.array([[1, 1]]), 10)
    assert seen == [0] and sorted(found[0]) == list(range(10)) and set(best[0]) == {2000}


def test_scores_beyond_doubles_are_exact(spark):
    rows = [(1, [200000000.0, 1.0]), (2, [200000000.0, 3.0]), (3, [-200000000.0, 1.0]), (4, [200000000.0, 2.0])]
    assert search(spark, rows, rows, scale=1) == [
        (i, rank, j, -s)
        for i, (x, y) in rows
        for rank, (s, j) in enumerate(sorted((-(int(x) * int(a) + int(y) * int(b)), j) for j, (a, b) in rows if j != i), 1)
    ]


def test_scores_beyond_64_bits_raise():
    import numpy as np
    import pytest

    big = np.array([[3_000_000_000, 1], [3_000_000_000, 2]])
    with pytest.raises(OverflowError, match="smaller scale"):
        topk_search.Blocks(np.arange(2), big, 2).search(np.array([0]), big[:1], 1)


def test_alike_rows_are_mostly_pruned_and_random_ones_are_not(rng):
    import numpy as np

    random = np.random.default_rng(5)
    centres = random.normal(size=(40, 16)) * 1024
    near = (centres[random.integers(0, 40, 4000)] + random.normal(size=(4000, 16)) * 30).astype(np.int64)
    far = (random.normal(size=(4000, 16)) * 1024).astype(np.int64)
    for rows, low, high in ((near, 0.01, 0.2), (far, 0.2, 1.0)):
        blocks = topk_search.Blocks(np.arange(4000), rows, 64)
        found, best = blocks.search(np.arange(0, 4000, 40), rows[::40], 10)
        scores = rows[::40] @ rows.T
        scores[np.arange(100), np.arange(0, 4000, 40)] = topk_search.NONE
        order = np.lexsort((np.broadcast_to(np.arange(4000), scores.shape), ~scores), axis=1)[:, :10]
        assert (found == order).all() and (best == np.take_along_axis(scores, order, axis=1)).all()
        assert low <= blocks.scored / (100 * len(blocks.radius)) <= high


def test_floors_keep_ties(rng):
    import numpy as np

    rows = np.array([[5], [4], [4], [3], [4]])
    found, best = topk_search.Blocks(np.arange(5), rows, 2).search(np.array([-1]), np.array([[1]]), 4, np.array([4]))
    assert found.tolist() == [[0, 1, 2, 4]] and best.tolist() == [[5, 4, 4, 4]]
    found, best = topk_search.Blocks(np.arange(5), rows, 2).search(np.array([-1]), np.array([[1]]), 2, np.array([5]))
    assert found.tolist() == [[0, -1]] and best.tolist() == [[5, topk_search.NONE]]
