"""Near duplicates by an LSH forest of MinHash signatures.

A document is the set of its distinct word shingles, hashed to 64 bits. Documents with equal
sets are one node, the smallest id among them. The signature of a node, 16 x 8 smallest hashes,
is 16 labels of 8 values: the trees of the forest. Each tree is one sorted order of all nodes,
and its neighbours with the longest common prefix are the candidates of a node: the next few
nodes that share a prefix of two values at least. So the depth at which a tree is read follows
the region: two values where nodes are sparse, all eight where they crowd. Where even the last
neighbour shares three values the region is crowded: there a node may have more neighbours at
full depth than a tree shows it. So nodes of crowded regions that are not in a large component,
and the middles of large ones, are also compared with the middles of the large components in
their region, the nodes most like the consensus of its sketches. What is then still outside the
component that has most of a region is compared with all nodes of the region, on the full sets
and in cells of bounded size that return links only, one for each component.

Candidates whose sketches (one byte for each signature value) are far below the threshold go
first. The others are confirmed on the full sets of shingles: first neighbours next to each
other, then all that still join different components. A link that would join what is joined
already is not needed for components and is not confirmed.

The sorted orders are range-partitioned by label and node, so a crowded region is spread over
tasks like any other; the few nodes at the ends of the partitions are paired in one more task.
Nodes, candidates, links and components are tables in the shared folder.

Defined results: a document without words (or null) has 0 shingles and is linked with nothing;
so is a document with a null id, which stays. Rows that repeat an id are one document. An empty
table gives no rows. Extra columns are ignored, or kept by :func:`deduplicated`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from tablecheck.llm.common import plain_id, table, with_id, written
from tablecheck.llm.components import components
from tablecheck.llm.hashing import chunks, shingle_sets

SHINGLE, PERCENT = 5, 80
TREES, DEPTH = 16, 8
NEIGHBOURS = 3
LEAST_PREFIX, CROWDED_PREFIX = 2, 3
CHAIN_TREES = 4
HUB_NODES, HUB_SAMPLE, HUBS = 16, 256, 8
CELL_NODES = 512
_FACTORS = np.random.Generator(np.random.Philox(key=29)).integers(1, 1 << 63, TREES * DEPTH, dtype=np.uint64) | np.uint64(1)

_LABELS = (
    f"transform(sequence(0, {TREES - 1}), t -> struct(t AS tree, substring(signature, t * {4 * DEPTH} + 1, {4 * DEPTH}) AS label))"
)
SIGNATURES = "doc_id long, no_id boolean, n_shingles long, digest binary, signature binary, sketch binary"
NEAR = "a long, b long, next boolean, tree int, label binary, node long, n long, crowded boolean"


def signature(shingles: np.ndarray) -> np.ndarray:
    out = np.full(len(_FACTORS), np.iinfo(np.uint64).max, dtype=np.uint64)
    for low in range(0, len(shingles), 4096):
        np.minimum(out, (shingles[low : low + 4096, None] * _FACTORS).min(axis=0), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)


def _texts(batches: Iterable[pd.DataFrame]) -> Iterator[list[tuple]]:
    """Rows (id, whether it is none, lower-cased bytes of the text), in bounded lists; only A-Z are lower-cased."""
    rows = ((i, x, (t or "").encode().lower()) for b in batches for i, x, t in zip(b["doc_id"], b["no_id"], b["text"]))
    return chunks(rows)


def _signed(size: int):
    def sign(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for chunk in _texts(batches):
            rows = []
            for (doc_id, no_id, _), shingles in zip(chunk, shingle_sets([r[2] for r in chunk], size)):
                if not len(shingles):
                    rows.append((doc_id, no_id, 0, None, None, None))
                    continue
                values = signature(shingles)
                digest = hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
                sketch = (values & np.uint32(255)).astype(np.uint8).tobytes()
                rows.append((doc_id, no_id, len(shingles), digest, values.astype(">u4").tobytes(), sketch))
            names = [c.split()[0] for c in SIGNATURES.split(", ")]
            yield pd.DataFrame(rows, columns=names)

    return sign


def _full_sets(size: int):
    """Rows doc_id, text, digest to doc_id, digest, shingles, for the rows whose set has that digest."""

    def build(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = ((i, d, (t or "").encode().lower()) for b in batches for i, d, t in zip(b["doc_id"], b["digest"], b["text"]))
        for chunk in chunks(rows):
            found = []
            for (doc_id, digest, _), shingles in zip(chunk, shingle_sets([r[2] for r in chunk], size)):
                if hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() == bytes(digest):
                    found.append((doc_id, bytes(digest), _packed(shingles)))
            yield pd.DataFrame(found, columns=["node", "digest", "shingles"])

    return build


def _packed(shingles: np.ndarray) -> bytes:
    return shingles.astype("<u8").tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype="<u8")


def _neighbours(percent: int, take_ends: bool):
    """Sorted rows tree, label, node, n to candidate pairs, and to the rows at both ends."""

    def pairs(rows: pd.DataFrame, fresh: int) -> pd.DataFrame:
        """Pairs whose second row is among the last ``fresh`` rows."""
        labels = np.frombuffer(b"".join(rows["label"]), dtype=np.uint8).reshape(len(rows), -1, 4)
        tree, node, n = (rows[c].to_numpy() for c in ("tree", "node", "n"))
        out = []
        for step in range(1, min(NEIGHBOURS, len(rows) - 1) + 1):
            same = (labels[step:] == labels[:-step]).all(axis=2)
            prefix = np.cumprod(same, axis=1).sum(axis=1)
            both = tree[step:] == tree[:-step]
            both &= np.arange(step, len(rows)) >= len(rows) - fresh
            small, large = np.minimum(n[step:], n[:-step]), np.maximum(n[step:], n[:-step])
            near = both & (prefix >= LEAST_PREFIX) & (small * 100 >= percent * large)
            a, b = node[:-step][near], node[step:][near]
            out.append(pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "next": (step == 1) & (tree[step:][near] < CHAIN_TREES)}))
            if step == NEIGHBOURS:
                at = np.flatnonzero(both & (prefix >= CROWDED_PREFIX))
                for rows_at in (at, at + step):
                    out.append(pd.DataFrame({"tree": tree[rows_at], "label": rows["label"].to_numpy()[rows_at], "node": node[rows_at], "crowded": True}))
        return pd.concat([_near(o) for o in out]) if out else pd.DataFrame()

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, first = None, None
        for batch in batches:
            if not len(batch):
                continue
            rows = batch if last is None else pd.concat([last, batch], ignore_index=True)
            if first is None or len(first) < NEIGHBOURS:
                first = batch.head(NEIGHBOURS) if first is None else pd.concat([first, batch]).head(NEIGHBOURS)
            yield _near(pairs(rows, len(batch)))
            last = rows.tail(NEIGHBOURS).reset_index(drop=True)
        if take_ends and last is not None:
            yield _near(pd.concat([first, last]).drop_duplicates(["tree", "node"]))

    return run


def _near(rows: pd.DataFrame) -> pd.DataFrame:
    names = [c.split()[0] for c in NEAR.split(", ")]
    whole = dict.fromkeys(("a", "b", "tree", "node", "n"), "Int64") | dict.fromkeys(("next", "crowded"), "boolean")
    return rows.reindex(columns=names).astype(whole).astype({"label": object}).replace({"label": {np.nan: None}})


def _agreeing():
    @F.pandas_udf("int")
    def agreeing(x: pd.Series, y: pd.Series) -> pd.Series:
        a, b = (np.frombuffer(b"".join(s), dtype=np.uint8).reshape(-1, TREES * DEPTH) for s in (x, y))
        return pd.Series((a == b).sum(axis=1), dtype="int32")

    return agreeing


def _likely(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sketches agree as often as similar sets do, but for five deviations."""
    share, size = percent / 100, TREES * DEPTH
    least = int(size * (share - 5 * (share * (1 - share) / size) ** 0.5))

    sketches = nodes.select("node", "sketch")
    both = pairs.join(sketches.withColumnsRenamed({"node": "a", "sketch": "x"}), "a")
    both = both.join(sketches.withColumnsRenamed({"node": "b", "sketch": "y"}), "b")
    return both.where(_agreeing()("x", "y") >= least).drop("x", "y")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets are similar."""

    @F.pandas_udf("boolean")
    def similar(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(x, y):
            a, b = _unpacked(p), _unpacked(q)
            common = len(np.intersect1d(a, b, assume_unique=True))
            out.append(100 * common >= percent * (len(a) + len(b) - common))
        return pd.Series(out, dtype=bool)

    both = pairs.select("a", "b").join(sets.withColumnsRenamed({"node": "a", "shingles": "x"}), "a")
    both = both.join(sets.withColumnsRenamed({"node": "b", "shingles": "y"}), "b")
    return both.where(similar("x", "y")).select("a", "b")


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs whose nodes are not in the same component."""
    root = lambda side: roots.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}"))
    joined = pairs.join(root("a"), "a", "left").join(root("b"), "b", "left")
    apart = F.coalesce("root_a", "a") != F.coalesce("root_b", "b")
    return joined.where(apart).drop("root_a", "root_b")


def _consensus(rows: pd.DataFrame) -> pd.DataFrame:
    """The most frequent value at each place of the sketches of a component."""
    values = np.frombuffer(b"".join(rows["sketch"]), dtype=np.uint8).reshape(len(rows), -1)
    counts = np.zeros((values.shape[1], 256), dtype=np.int64)
    np.add.at(counts, (np.broadcast_to(np.arange(values.shape[1]), values.shape), values), 1)
    return pd.DataFrame({"root": rows["root"].head(1), "middle": [counts.argmax(axis=1).astype(np.uint8).tobytes()]})


def _hubs(members: DataFrame) -> DataFrame:
    """The middle of each component, as ``root, hub``: of each share of its nodes the one that
    is most like the consensus of a sample of the component."""
    drawn = F.pmod(F.xxhash64("node"), F.lit(1 << 20)) / F.lit(float(1 << 20)) < F.lit(float(HUB_SAMPLE)) / F.col("size")
    middles = members.where(drawn).select("root", "sketch").groupBy("root").applyInPandas(_consensus, "root long, middle binary")
    likeness = _agreeing()("sketch", "middle")
    scored = members.join(written(middles, "middles"), "root").select("root", "node", likeness.alias("likeness"))
    share = F.pmod(F.xxhash64(F.lit(1), "node"), F.lit(HUBS)).alias("share")
    best = scored.groupBy("root", share).agg(F.max(F.struct("likeness", (-F.col("node")).alias("last"))).alias("best"))
    return written(best.select("root", (-F.col("best.last")).alias("hub")), "hubs")


def _large(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Nodes of large components: node, root, size, sketch."""
    members = roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
    sizes = written(members.groupBy("root").agg(F.count("*").alias("size")).where(F.col("size") >= HUB_NODES), "sizes")
    members = members.join(sizes, "root").join(nodes.select("node", "sketch"), "node")
    return written(members.dropDuplicates(["node"]), "members")


def _cell(percent: int):
    """Loose nodes and members that share a cell, with their full sets, to links: for each loose
    node one to every component it is similar to a member of."""

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        members, loose = rows[~rows["loose"]], rows[rows["loose"]]
        sets = [_unpacked(s) for s in members["shingles"]]
        sizes, found = np.array([len(s) for s in sets], dtype=np.int64), []
        if len(sets) and len(loose):
            whole, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
            order = np.argsort(whole, kind="stable")
            whole, owner = whole[order], owner[order]
            nodes, roots = members["node"].to_numpy(), members["root"].to_numpy()
            for node, root, packed in zip(loose["node"], loose["root"], loose["shingles"]):
                own = _unpacked(packed)
                low, high = np.searchsorted(whole, own, "left"), np.searchsorted(whole, own, "right")
                hits = np.concatenate([owner[a:b] for a, b in zip(low, high)])
                common = np.bincount(hits, minlength=len(sets))
                like = (100 * common >= percent * (sizes + len(own) - common)) & (roots != root)
                _, first = np.unique(roots[like], return_index=True)
                found += [(min(node, other), max(node, other)) for other in nodes[like][first]]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return compare


def _exhaustive(crowds: DataFrame, sets: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """All links in crowded regions that join components: nodes outside the component that has
    most of a region are compared with all nodes of it, in cells of bounded size."""
    region = ["tree", "prefix"]
    rows = crowds.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rows = written(rows.select(*region, "node", "root"), "crowded")
    counts = rows.groupBy(*region, "root").agg(F.count("*").alias("held"))
    sizes = counts.groupBy(*region).agg(F.sum("held").alias("size"), F.max(F.struct("held", "root")).alias("most"))
    parts = lambda n: F.ceil(n / F.lit(float(CELL_NODES))).cast("int")
    sizes = sizes.select(
        *region, F.col("most.root").alias("main"), parts(F.col("size")).alias("across"),
        parts(F.col("size") - F.col("most.held")).alias("down"),
    )
    rows = rows.join(written(sizes.where("down > 0"), "regions"), region)
    share = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    cell = [*region, "column", "line"]
    members = rows.withColumn("column", share(F.col("across"))).withColumn("line", every(F.col("down")))
    loose = rows.where("root != main").withColumn("line", share(F.col("down"))).withColumn("column", every(F.col("across")))
    columns = [*cell, "node", "root"]
    both = members.select(*columns, F.lit(False).alias("loose")).union(loose.select(*columns, F.lit(True).alias("loose")))
    return both.join(sets, "node").groupBy(*cell).applyInPandas(_cell(percent), "a long, b long").distinct()


def _roots(docs: DataFrame, nodes: DataFrame, size: int, percent: int) -> DataFrame:
    """``node, root`` of the components of all nodes that have links."""
    forest = nodes.select("node", F.col("n_shingles").alias("n"), F.explode(F.expr(_LABELS)).alias("at"))
    forest = forest.select(F.col("at.tree").alias("tree"), F.col("at.label").alias("label"), "node", "n")
    order = ["tree", "label", "node"]
    ordered = forest.repartitionByRange(*order).sortWithinPartitions(*order)
    near = written(ordered.mapInPandas(_neighbours(percent, True), NEAR), "near")
    ends = near.where("n is not null").select(*order, "n").orderBy(*order).coalesce(1)
    across = written(ends.mapInPandas(_neighbours(percent, False), NEAR), "near-ends")
    near = near.where("n is null").union(across)

    pairs = near.where("a is not null").groupBy("a", "b").agg(F.max("next").alias("next"))
    pairs = written(_likely(pairs, nodes, percent), "pairs")
    crowds = near.where("crowded").select("tree", F.substring("label", 1, 4 * CROWDED_PREFIX).alias("prefix"), "node")
    crowds = written(crowds.distinct(), "crowds")
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).union(crowds.select("node"))
    wanted = nodes.join(wanted.distinct(), "node").select(F.col("node").alias("doc_id"), "digest")
    texts = docs.join(wanted, "doc_id").select("doc_id", "digest", "text")
    sets = texts.mapInPandas(_full_sets(size), "node long, digest binary, shingles binary")
    # Texts that share their smallest id are one node with several sets, all of which are compared.
    sets = written(sets.dropDuplicates(["node", "digest"]).drop("digest"), "sets")

    first = written(_confirmed(pairs.where("next"), sets, percent), "links")
    roots = components(first)
    fresh = _confirmed(_apart(pairs.where("not next"), roots), sets, percent)
    roots = components(written(fresh, "links"), roots)
    if crowds.isEmpty():
        return roots

    members = _large(nodes, roots)
    places = _hubs(members).join(nodes.select(F.col("node").alias("hub"), F.explode(F.expr(_LABELS)).alias("at")), "hub")
    places = places.select(F.col("at.tree").alias("tree"), F.substring("at.label", 1, 4 * CROWDED_PREFIX).alias("prefix"), "hub")
    places = written(places, "places")
    loose = crowds.join(members.select("node"), "node", "left_anti").select("tree", "prefix", "node")
    found = loose.union(places).join(places, ["tree", "prefix"]).where("node != hub")
    found = found.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    fresh = _confirmed(_likely(_apart(found, roots), nodes, percent), sets, percent)
    roots = components(written(fresh, "links"), roots)
    return components(written(_exhaustive(crowds, sets, roots, percent), "links"), roots)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Documents are linked when 100 x common shingles >= ``percent`` x shingles of either.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    plain = slim.select(*plain_id("doc_id"), "text")
    signed = with_id(written(plain.mapInPandas(_signed(size), SIGNATURES), "signatures"))
    linked = signed.where("doc_id is not null and digest is not null")
    nodes = linked.groupBy("digest").agg(
        F.min("doc_id").alias("node"), F.first("n_shingles").alias("n_shingles"),
        F.first("signature").alias("signature"), F.first("sketch").alias("sketch"),
    )
    nodes = written(nodes, "nodes")
    roots = _roots(slim, nodes, size, percent)
    # A row that repeats an id with another text joins the two nodes.
    own = nodes.select(F.col("digest"), F.col("node"))
    at = linked.select("doc_id", "digest").join(own, "digest").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    twice = at.groupBy("a").agg(F.min("b").alias("low"), F.max("b").alias("high")).where("low != high")
    twice = twice.select(F.col("low").alias("a"), F.col("high").alias("b"))
    roots = components(written(twice, "links"), roots)
    classes = own.join(roots, "node", "left").select("digest", F.coalesce("root", "node").alias("component_id"))
    rows = signed.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest"))
    rows = rows.join(classes, "digest", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return rows.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicated(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT
) -> DataFrame:
    """The rows of ``docs`` that stay, one document of each component, with all their columns."""
    found = near_duplicates(docs, id_col, text_col, size, percent)
    gone = found.where("not kept").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among all documents: shingles of three words, 85 percent."""
    return near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)
