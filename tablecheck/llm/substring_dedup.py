"""Repeated passages, found by difference-cover anchors.

A window is ``window`` consecutive words. A word goes if a window that covers it has the words
of a window that starts earlier: in a document with a smaller id, or earlier in the same one.

The positions 0, 1, 3 and 9 modulo 13 are a difference cover: for any two positions there is
one shift below 13 that takes both of them onto it. So of two equal windows of 20 words both
have, at the same place inside, an anchor of 20 - 13 + 1 = 8 words that starts on the cover, and
only anchors (4 of 13 positions) are hashed and exchanged. Where an anchor is found again, it
extends to the windows around it: only windows that hold a repeated anchor are compared, by a
64-bit hash of all their words, and the earliest of equal windows stays.

Texts are read once and written as blocks of whole documents of about ``BLOCK_BYTES``; anchors
and windows of a block refer to words of the block and are exchanged as arrays, one for each
part of the hash range. A hash that a block has many times is sent once and resolved within the
block, so a passage that a third of all documents share costs one entry per block.

Defined results: a null text has no words, and its digest is that of an empty text; rows that
repeat an id are one document, in which windows are ordered by their start; null ids are one id
larger than all others. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from tablecheck.llm.common import plain_id, table, with_id, written
from tablecheck.llm.hashing import chunks, window_hashes, word_hashes

WINDOW = 20
PERIOD, COVER = 13, (0, 1, 3, 9)
BLOCK_BYTES = 2 << 20
PART_ENTRIES = 250_000

BLOCKS = "block long, ids binary, none binary, counts binary, words binary, n_words long"
ENTRIES = "part int, block long, entries binary"
ANSWERS = "block long, found binary"
RESULT = "doc_id long, no_id boolean, n_words long, n_removed long, kept string, kept_sha256 string"


def _packed(*arrays: np.ndarray) -> bytes:
    return zstandard.compress(b"".join(a.tobytes() for a in arrays), 1)


def _unpacked(data: bytes, *kinds: str) -> list[np.ndarray]:
    """Arrays of equal length of the given kinds."""
    raw = zstandard.decompress(data)
    n = len(raw) // sum(np.dtype(k).itemsize for k in kinds)
    out, at = [], 0
    for kind in kinds:
        out.append(np.frombuffer(raw, dtype=kind, count=n, offset=at))
        at += n * np.dtype(kind).itemsize
    return out


def _blocked(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows doc_id, text to blocks: ids, words of each document, and the words themselves."""
    number = TaskContext.get().partitionId() << 33
    rows = ((i, x, (t or "").encode().split()) for b in batches for i, x, t in zip(b["doc_id"], b["no_id"], b["text"]))
    rows = ((i, x, len(w), b" ".join(w)) for i, x, w in rows)
    for chunk in chunks(rows, BLOCK_BYTES):
        ids, none = np.array([r[0] for r in chunk], dtype=np.int64), np.array([r[1] for r in chunk], dtype=bool)
        counts = np.array([r[2] for r in chunk], dtype=np.int64)
        words = zstandard.compress(b"\n".join(r[3] for r in chunk), 3)
        row = (number, ids.tobytes(), none.tobytes(), counts.tobytes(), words, counts.sum())
        yield pd.DataFrame([row], columns=["block", "ids", "none", "counts", "words", "n_words"])
        number += 1


class Block:
    """The words of a block as hashes, with the document and the position of each word."""

    def __init__(self, ids: bytes, none: bytes, counts: bytes, words: bytes):
        self.ids, self.counts = np.frombuffer(ids, dtype=np.int64), np.frombuffer(counts, dtype=np.int64)
        self.none = np.frombuffer(none, dtype=bool)
        self.texts = zstandard.decompress(words).split(b"\n")
        self.hashes, self.first = word_hashes(self.texts)
        self.doc = np.repeat(np.arange(len(self.ids)), self.counts)
        self.place = np.arange(len(self.hashes)) - self.first[self.doc]
        self.left = self.counts[self.doc] - self.place

    def anchors(self, window: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and words of the anchors on the cover."""
        size = window - PERIOD + 1
        at = np.flatnonzero(np.isin(self.place % PERIOD, COVER) & (self.left >= size))
        return window_hashes(self.hashes, size)[at] if len(at) else np.zeros(0, np.uint64), at

    def windows(self, window: int, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and first words of the windows that hold a repeated anchor."""
        marks = np.zeros(len(self.hashes) + 1, dtype=np.int64)
        np.add.at(marks, np.maximum(repeated - PERIOD + 1, self.first[self.doc[repeated]]), 1)
        np.add.at(marks, repeated + 1, -1)
        at = np.flatnonzero((np.cumsum(marks)[:-1] > 0) & (self.left >= window))
        return window_hashes(self.hashes, window)[at] if len(at) else np.zeros(0, np.uint64), at


def _own_repeats(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each distinct hash the index of its first entry, and whether it has others."""
    _, first, counts = np.unique(hashes, return_index=True, return_counts=True)
    return first, counts > 1


def _repeated(block: Block, window: int, found: Iterable[bytes] | None) -> np.ndarray:
    """Words at which repeated anchors start: known from the block itself, or found elsewhere."""
    hashes, at = block.anchors(window)
    _, inverse, counts = np.unique(hashes, return_inverse=True, return_counts=True)
    own = at[counts[inverse] > 1] if len(at) else at
    return np.unique(np.concatenate([own, _words(found)]))


def _words(found: Iterable[bytes] | None) -> np.ndarray:
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *(_unpacked(f, "<u4")[0] for f in (() if found is None else found))]).astype(np.int64)


def _earliest(block: Block, hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each distinct window its earliest entry in the block; and the words of all later ones."""
    if not len(at):
        return np.zeros(0, dtype=np.int64), at
    order, lead, first, later = _in_order(hashes, block.ids[block.doc[at]], block.none[block.doc[at]], block.place[at])
    return order[first], at[order][later]


def _in_order(hashes: np.ndarray, ids: np.ndarray, none: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
    """Windows by hash and start, the earliest of each, which are such, and which start later than theirs.

    No id is larger than all ids."""
    order = np.lexsort((place, ids, none, hashes))
    first = np.concatenate([[True], hashes[order][1:] != hashes[order][:-1]])
    lead = order[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
    later = (ids[order] != ids[lead]) | (none[order] != none[lead]) | (place[order] != place[lead])
    return order, lead, first, later


def _by_part(hashes: np.ndarray, parts: int, block: int, pack) -> list[tuple]:
    """Rows part, block, entries: ``pack(i)`` packs the entries i, sorted by hash."""
    part = ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
    order = np.lexsort((hashes, part))
    cuts = np.flatnonzero(np.diff(part[order])) + 1
    return [(int(part[i[0]]), block, pack(i)) for i in np.split(order, cuts) if len(i)]


def _anchor_entries(window: int, parts: int):
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for number, ids, none, counts, words in zip(*(batch[c] for c in ("block", "ids", "none", "counts", "words"))):
                hashes, at = Block(ids, none, counts, words).anchors(window)
                first, others = _own_repeats(hashes, at)
                hashes, at = hashes[first], at[first]
                rows = _by_part(hashes, parts, number, lambda i: _packed(hashes[i], at[i].astype("<u4"), others[i]))  # noqa: B023
                yield pd.DataFrame(rows, columns=["part", "block", "entries"])

    return run


def _anchor_answers(rows: pd.DataFrame) -> pd.DataFrame:
    """All entries of a part to the words, by block, whose anchors other blocks have too."""
    hashes, at, known, source = _joined(rows, "<u8", "<u4", "?")
    _, inverse, counts = np.unique(hashes, return_inverse=True, return_counts=True)
    return _answers(rows, source, at, (counts[inverse] > 1) & ~known)


def _window_answers(rows: pd.DataFrame) -> pd.DataFrame:
    """All entries of a part to the words, by block, whose windows start earlier elsewhere."""
    hashes, at, ids, none, place, source = _joined(rows, "<u8", "<u4", "<i8", "?", "<u4")
    order, _, _, after = _in_order(hashes, ids, none, place)
    later = np.zeros(len(order), dtype=bool)
    later[order] = after
    return _answers(rows, source, at, later)


def _joined(rows: pd.DataFrame, *kinds: str) -> list[np.ndarray]:
    each = [_unpacked(e, *kinds) for e in rows["entries"]]
    source = np.repeat(np.arange(len(each)), [len(e[0]) for e in each])
    return [np.concatenate(c) for c in zip(*each)] + [source]


def _answers(rows: pd.DataFrame, source: np.ndarray, at: np.ndarray, chosen: np.ndarray) -> pd.DataFrame:
    blocks, out = rows["block"].to_numpy(), []
    which = np.flatnonzero(chosen)
    for i in np.split(which, np.flatnonzero(np.diff(source[which])) + 1):
        if len(i):
            out.append((blocks[source[i[0]]], _packed(np.sort(at[i]))))
    return pd.DataFrame(out, columns=["block", "found"])


def _window_entries(window: int, parts: int):
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for number, ids, none, counts, words, found in zip(*(batch[c] for c in ("block", "ids", "none", "counts", "words", "anchors"))):
                block = Block(ids, none, counts, words)
                hashes, at = block.windows(window, _repeated(block, window, found))
                lead, _ = _earliest(block, hashes, at)
                hashes, at = hashes[lead], at[lead]
                doc, place = block.doc[at], block.place[at].astype("<u4")
                rows = _by_part(  # noqa: B023
                    hashes, parts, number,
                    lambda i: _packed(hashes[i], at[i].astype("<u4"), block.ids[doc[i]], block.none[doc[i]], place[i]),
                )
                yield pd.DataFrame(rows, columns=["part", "block", "entries"])

    return run


def _kept(window: int):
    """Blocks with all answers to rows doc_id, n_words, n_removed, kept."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for ids, none, counts, words, anchors, found in zip(*(batch[c] for c in ("ids", "none", "counts", "words", "anchors", "windows"))):
                block = Block(ids, none, counts, words)
                hashes, at = block.windows(window, _repeated(block, window, anchors))
                gone = np.concatenate([_earliest(block, hashes, at)[1], _words(found)])
                marks = np.zeros(len(block.hashes) + window + 1, dtype=np.int64)
                np.add.at(marks, gone, 1)
                np.add.at(marks, gone + window, -1)
                covered = np.cumsum(marks)[: len(block.hashes)] > 0
                rows = []
                for doc_id, no_id, n, low, text in zip(block.ids.tolist(), block.none.tolist(), block.counts, block.first, block.texts):
                    mask = covered[low : low + n]
                    removed = int(mask.sum())
                    if removed:
                        text = b" ".join(w for w, c in zip(text.split(b" "), mask) if not c)
                    rows.append((doc_id, no_id, int(n), removed, text.decode(), hashlib.sha256(text).hexdigest()))
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in RESULT.split(", ")])

    return run


def _asked(entries: DataFrame, answer) -> DataFrame:
    """Answers of all parts, gathered by block, as a table in the shared folder."""
    answers = entries.groupBy("part").applyInPandas(answer, ANSWERS)
    return written(answers.groupBy("block").agg(F.collect_list("found").alias("found")), "answers")


def without_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
    part_entries: int = PART_ENTRIES,
) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, the kept words and their SHA-256."""
    if window < PERIOD:
        raise ValueError(f"window must be at least {PERIOD}")
    slim = docs.select(*plain_id(id_col), F.col(text_col).alias("text"))
    blocks = written(slim.mapInPandas(_blocked, BLOCKS), "blocks")
    words = blocks.agg(F.sum("n_words")).first()[0] or 0
    parts = max(1, math.ceil(words * len(COVER) / PERIOD / part_entries))

    entries = blocks.mapInPandas(_anchor_entries(window, parts), ENTRIES)
    anchors = _asked(entries, _anchor_answers).withColumnRenamed("found", "anchors")
    marked = blocks.join(anchors, "block", "left")
    entries = marked.mapInPandas(_window_entries(window, parts), ENTRIES)
    windows = _asked(entries, _window_answers).withColumnRenamed("found", "windows")
    rows = marked.join(windows, "block", "left")
    return with_id(rows.mapInPandas(_kept(window), RESULT))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents without passages that start earlier elsewhere."""
    return without_repeats(table(spark, sf_dir, "documents")).drop("kept")


SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT doc_id, words, unnest(range(1, greatest(len(words) - 18, 1))) AS pos FROM w
), h AS (
  SELECT doc_id, pos, array_to_string(list_slice(words, pos, pos + 19), ' ') AS whole FROM s
), f AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY whole ORDER BY doc_id, pos) AS n FROM h
), g AS (
  SELECT DISTINCT doc_id, pos + o AS pos FROM f, (SELECT unnest(range(0, 20)) AS o) WHERE n > 1
), e AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM w
), k AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS kept FROM e ANTI JOIN g USING (doc_id, pos) GROUP BY doc_id
), r AS (
  SELECT doc_id, count(*) AS gone FROM g GROUP BY doc_id
)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(gone, 0)::BIGINT AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN r USING (doc_id) LEFT JOIN k USING (doc_id)
"""
