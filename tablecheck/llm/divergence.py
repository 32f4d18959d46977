"""Audit of how far the sources of a language differ in their terms.

Texts are read once. A task cuts a chunk of them into terms and sorts these by 64-bit hashes with the
place packed below, so that equal terms of a group meet in the order of their documents. Neighbours
are compared by all their bytes, and terms that share a hash are sorted by their bytes. What leaves
the task are rows ``group, term, occurrences, documents``, summed there again before they are
shuffled, so that a hot source or a very frequent term is one row per task. Only terms that enough
documents of a language hold are kept.

Shares are integers: ``p = 1 + floor(scale * (count + 1) / (N + V))`` by long division in base
1000, which holds for counts up to 9e15, and ``f = floor((p - q) ** 2 / q)``.

Divergence of two sources is the sum of f over all V kept terms of the language, of which most occur
in neither. It is put together from four parts: terms of both sources (joined by term, summed in
the tasks), terms of one only (from a histogram of its counts, less the former) and of neither.

Defined results: null texts, languages and sources are empty words; texts without terms add nothing
but their group is there; rows that repeat count each, whatever their ids. A language with one source
has no pairs, and without kept terms the value of a pair is 0. An empty table gives no rows. Extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tablecheck.llm.common import table, text_of, written
from tablecheck.llm.hashing import LONG_WORD, chunks, mixed, span_hashes, spans

# Terms are runs of letters and of bytes beyond ASCII, of which A to Z are lower-cased.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
SEPARATES = np.ones(256, dtype=bool)
SEPARATES[ord("a") : ord("z") + 1] = SEPARATES[0x80:] = False
LEAST_DOCUMENTS = 3
SCALE = 1_000_000_000
TOP = 200
HASH_BITS = 64
CHUNK_BYTES, BATCH_ROWS = 4 << 20, 1 << 16

COUNTS = "group long, term string, held long, docs long"


def share(count: Column, total: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / total), where count < total, without large products."""
    rest, out = count + 1, F.lit(0).cast("long")
    for _ in range(3):
        scaled = rest * 1000
        rest = F.pmod(scaled, total)
        out = out * 1000 + F.call_function("div", scaled, total)
    return out + 1


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def grouped(docs: DataFrame, lang_col: str, source_col: str) -> tuple[DataFrame, int]:
    """The table of groups ``group, lang, source``, and the seed that numbers them apart."""
    pairs = docs.select(text_of(lang_col).alias("lang"), text_of(source_col).alias("source")).distinct()
    seed = 0
    while True:
        groups = written(pairs.select(F.xxhash64(F.lit(seed), "lang", "source").alias("group"), "lang", "source"), "groups")
        if groups.groupBy("group").count().where("count > 1").isEmpty():
            return groups, seed
        seed += 1


def _same_terms(whole: np.ndarray, starts: np.ndarray, sizes: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Whether each term in this order is the same bytes as the one ahead of it."""
    words = np.ndarray(len(whole) - 8, dtype="<u8", buffer=whole, strides=(1,))
    start, size = starts[order], sizes[order]
    same = size[1:] == size[:-1]
    at = np.flatnonzero(same)
    for done in range(0, LONG_WORD, 8):
        at = at[size[at] > done]
        if not len(at):
            return same
        over = np.maximum(8 - (size[at] - done), 0).astype(np.uint64) * np.uint64(8)
        equal = (words[start[at] + done] ^ words[start[at + 1] + done]) << over == 0
        same[at[~equal]] = False
        at = at[equal]
    for i in at[size[at] > LONG_WORD].tolist():
        a, b, n = start[i], start[i + 1], size[i]
        same[i] = whole[a : a + n].tobytes() == whole[b : b + n].tobytes()
    return same


def counted_terms(groups: np.ndarray, texts: list[bytes], bits: int) -> Iterator[pa.RecordBatch]:
    """Rows ``group, term, held, docs`` of texts, each of which is a document of a group."""
    whole = LOWER[np.frombuffer(b" ".join(texts) + b" " * 9, dtype=np.uint8)]
    starts, ends = spans(SEPARATES[whole])
    if not len(starts):
        return
    sizes = ends - starts
    doc = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)]))
    doc = np.repeat(np.arange(len(texts)), np.diff(doc))
    group = groups[doc]
    # The upper bits of the hash, and below them the place.
    below = np.uint64(max(64 - bits, len(starts).bit_length()))
    places = (np.uint64(1) << below) - np.uint64(1)
    hashes = mixed(span_hashes(whole, starts, ends) ^ mixed(group.view(np.uint64)))
    key = np.sort((hashes & ~places) | np.arange(len(starts), dtype=np.uint64))
    order, key = (key & places).astype(np.int64), key >> below
    alike = key[1:] == key[:-1]
    same = alike & (group[order][1:] == group[order][:-1])
    at = np.flatnonzero(same)
    same[at] = _same_terms(whole, starts, sizes, order)[at]
    if (alike & ~same).any():  # several terms with one hash: sort these by group, bytes and place
        mixed_up = np.flatnonzero(np.isin(key, key[1:][alike & ~same]))
        rows = [(k, g, whole[a:b].tobytes(), i) for k, g, a, b, i in zip(*(
            c.tolist() for c in (key[mixed_up], group[order[mixed_up]], starts[order[mixed_up]], ends[order[mixed_up]], order[mixed_up])
        ))]
        order[mixed_up] = [row[3] for row in sorted(rows)]
        same = alike & (group[order][1:] == group[order][:-1]) & _same_terms(whole, starts, sizes, order)
    first = np.flatnonzero(np.concatenate([[True], ~same]))
    # In the order of places the first of equal terms stands for the document.
    once = np.concatenate([[True], ~same | (doc[order][1:] != doc[order][:-1])])
    held, docs = np.diff(np.append(first, len(order))), np.add.reduceat(once.astype(np.int64), first)
    for low in range(0, len(first), BATCH_ROWS):
        part = slice(low, low + BATCH_ROWS)
        which = order[first[part]]
        offsets = np.concatenate([[0], np.cumsum(sizes[which])])
        data = whole[np.repeat(starts[which] - offsets[:-1], sizes[which]) + np.arange(offsets[-1])]
        terms = pa.StringArray.from_buffers(len(which), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data))
        columns = [pa.array(group[which]), terms, pa.array(held[part]), pa.array(docs[part])]
        yield pa.RecordBatch.from_arrays(columns, names=["group", "term", "held", "docs"])


def _counted(bits: int):
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((g, t) for b in batches for g, t in zip(b.column("group").to_pylist(), b.column("text").cast(pa.binary()).to_pylist()))
        for chunk in chunks(rows, CHUNK_BYTES):
            yield from counted_terms(np.array([g for g, _ in chunk], dtype=np.int64), [t for _, t in chunk], bits)

    return count


def kept_terms(counts: DataFrame, groups: DataFrame, least: int) -> DataFrame:
    """``lang`` and its kept terms, with their occurrences in the language."""
    rows = counts.join(groups.select("group", "lang"), "group").groupBy("lang", "term")
    return rows.agg(F.sum("held").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= least).drop("docs")


def term_counts(
    docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text",
    least: int = LEAST_DOCUMENTS, bits: int = HASH_BITS,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables of groups, of counts by group and term, and of kept terms by language.

    Fewer bits of a hash are only to provoke collisions in tests.
    """
    groups, seed = grouped(docs, lang_col, source_col)
    group = F.xxhash64(F.lit(seed), text_of(lang_col), text_of(source_col))
    counts = docs.select(group.alias("group"), text_of(text_col).alias("text")).mapInArrow(_counted(bits), COUNTS)
    counts = counts.groupBy("group", "term").agg(F.sum("held").alias("held"), F.sum("docs").alias("docs"))
    counts = written(counts, "term_counts")
    return groups, counts, written(kept_terms(counts, groups, least), "kept_terms")


def divergence(
    docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text",
    least: int = LEAST_DOCUMENTS, top: int = TOP, bits: int = HASH_BITS,
) -> DataFrame:
    """Rows lang, source, part (``pair`` or ``term``), item, value, rank."""
    groups, counts, kept = term_counts(docs, lang_col, source_col, text_col, least, bits)
    key = ["lang", "term"]
    rows = counts.join(groups, "group").join(kept, key).select(*key, "source", "held", "total")
    rows = written(rows, "group_terms")
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("n_lang"))
    sizes = rows.groupBy("lang", "source").agg(F.sum("held").alias("n"), F.count("*").alias("types"))
    # Every group, with the size of its share for no occurrence; no kept terms, no shares.
    groups = groups.drop("group").join(langs, "lang", "left").join(sizes, ["lang", "source"], "left")
    groups = groups.na.fill(0, ["v", "n_lang", "n", "types"])
    none = F.when(F.col("v") > 0, share(F.lit(0).cast("long"), F.greatest(F.col("n") + F.col("v"), F.lit(1))))
    groups = written(groups.withColumn("none", none), "group_sizes")

    shared = rows.join(groups.select("lang", "source", "n", "v", "n_lang", "none"), ["lang", "source"])
    shared = shared.withColumn("p", share(F.col("held"), F.col("n") + F.col("v")))
    return _pairs(shared, groups).unionByName(_terms(shared, top))


def _pairs(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Each source against each other of its language."""
    sides = rows.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "none")).alias("of"))
    both = sides.where(F.size("of") > 1).select("lang", "of", F.explode("of").alias("a")).select("lang", "a", F.explode("of").alias("b"))
    both = both.where("a.source != b.source")
    # What both have, less what the sums over each alone count for these terms.
    gain = distance(F.col("a.p"), F.col("b.p")) - distance(F.col("a.p"), F.col("b.none")) - distance(F.col("a.none"), F.col("b.p"))
    both = both.groupBy("lang", F.col("a.source").alias("source"), F.col("b.source").alias("item")).agg(
        F.sum(gain).alias("gain"), F.count("*").alias("both")
    )
    levels = rows.groupBy("lang", "source", "p").agg(F.count("*").alias("terms"))
    rest = groups.select("lang", F.col("source").alias("item"), "none")
    alone = levels.join(rest, "lang").where("source != item")
    own = alone.groupBy("lang", "source", "item").agg(F.sum(F.col("terms") * distance(F.col("p"), F.col("none"))).alias("own"))
    theirs = alone.groupBy("lang", F.col("item").alias("source"), F.col("source").alias("item")).agg(
        F.sum(F.col("terms") * distance(F.col("none"), F.col("p"))).alias("theirs")
    )
    one = groups.select("lang", "source", "v", F.col("none").alias("p0"), "types")
    other = groups.select("lang", F.col("source").alias("item"), F.col("none").alias("q0"), F.col("types").alias("item_types"))
    pairs = one.join(other, "lang").where("source != item")
    for part in (both, own, theirs):
        pairs = pairs.join(part, ["lang", "source", "item"], "left")
    zero = [F.coalesce(c, F.lit(0)) for c in ("gain", "own", "theirs", "both")]
    neither = F.col("v") - F.col("types") - F.col("item_types") + zero[3]
    value = zero[0] + zero[1] + zero[2] + F.coalesce(neither * distance(F.col("p0"), F.col("q0")), F.lit(0))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return pairs.select(
        "lang", "source", F.lit("pair").alias("part"), "item", value.cast("long").alias("value")
    ).withColumn("rank", F.row_number().over(order))


def _terms(rows: DataFrame, top: int) -> DataFrame:
    """The terms that each group has most too many of."""
    q = share(F.col("total"), F.col("n_lang") + F.col("v"))
    more = rows.withColumn("q", q).where("p > q")
    more = more.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return more.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of all sources of all documents, and the terms that stand for it."""
    return divergence(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), t AS (
  SELECT id, lang, source, unnest(terms) AS term FROM d
), k AS (
  SELECT lang, term, count(*) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 3
), l AS (
  SELECT lang, count(*) AS v, sum(total) AS n FROM k GROUP BY lang
), g AS (
  SELECT DISTINCT lang, source FROM d
), c AS (
  SELECT lang, source, term, count(*) AS held FROM t SEMI JOIN k USING (lang, term) GROUP BY lang, source, term
), n AS (
  SELECT lang, source, sum(held) AS n FROM c GROUP BY lang, source
), a AS (
  SELECT g.lang, g.source, k.term, coalesce(c.held, 0) AS held,
         1 + (1000000000::HUGEINT * (coalesce(c.held, 0) + 1)) // (coalesce(n.n, 0) + l.v)::HUGEINT AS p,
         1 + (1000000000::HUGEINT * (k.total + 1)) // (l.n + l.v)::HUGEINT AS q
  FROM g JOIN l USING (lang) JOIN k USING (lang) LEFT JOIN c USING (lang, source, term) LEFT JOIN n USING (lang, source)
), s AS (
  SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // y.p) AS value
  FROM a x JOIN a y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
), r AS (
  SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
  LEFT JOIN s ON s.lang = x.lang AND s.source = x.source AND s.item = y.source
  UNION ALL
  SELECT lang, source, 'term', term, (((p - q) * (p - q)) // q)::BIGINT FROM a WHERE held > 0 AND p > q
)
SELECT lang, source, part, item, value,
       row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
FROM r QUALIFY part = 'pair' OR rank <= 200
"""
