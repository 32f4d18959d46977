"""Packing documents into sequences, shortest pack first over the histogram of lengths.

Documents are tokenized, end with one separator id and are cut into pieces of the sequence
length and one rest. The task that tokenizes counts its pieces per length, so a piece is known
by its task, its length and its rank there; the pieces are a table in the shared folder. From
here on only the histogram of lengths matters: at most ``length`` numbers, whatever the size of
the corpus. Lengths are placed longest first, each into the pack that is shortest so far, and
packs with equal contents are one pattern with a count. Patterns go back to the documents by
rank: the n-th piece of a length belongs to the n-th place that the patterns have for it.

The token ids are those of the ``tokenizers`` library for the given JSON file of a byte-level
BPE; the merges are run by ``tiktoken`` on the same vocabulary, which is several times as fast.
Special tokens that occur in a text get their ids, as in that library.

Defined results: a null text is empty and packs as its separator alone; repeated rows are packed
as often as they occur, null ids included; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tablecheck.llm.common import plain_id, table, with_id, written

LENGTH = 1024
SEPARATOR = 0
TOKENIZER = "byte_bpe_50k.json"
# Runs of white space, as Unicode defines it.
LONG_BLANKS = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{1000,}")

PIECES = (
    "doc_id long, no_id boolean, doc_tokens long, start long, length long, ids binary, ids_crc32 long, task int, rank long"
)
_ENCODERS: dict[str, object] = {}


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str):
    """The tokenizer of a byte-level BPE file; one for each Python worker."""
    if path not in _ENCODERS:
        import json

        import tiktoken

        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        special = {t["content"]: t["id"] for t in model.get("added_tokens", [])}
        # Byte-level vocabularies write bytes that do not print as characters from 256 on.
        shown = [b for b in range(256) if chr(b).isprintable() and not chr(b).isspace() and b != 0xAD]
        hidden = [b for b in range(256) if b not in set(shown)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        ranks = {
            bytes(byte_of[c] for c in token): rank
            for token, rank in model["model"]["vocab"].items()
            if token not in special
        }
        # The split of byte-level BPE into words.
        pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        encoding = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        found = re.compile("|".join(map(re.escape, special))) if special else None
        _ENCODERS[path] = (encoding, found)
    return _ENCODERS[path]


def token_ids(text: str, path: str) -> np.ndarray:
    """The ids of a text, with special tokens found in it, as unsigned 32-bit numbers."""
    encoding, special = encoder(path)
    if LONG_BLANKS.search(text):
        return np.concatenate([_ids(encoding, special, part) for part in _parts(text)]).astype("<u4")
    return _ids(encoding, special, text)


def _ids(encoding, special, text: str | bytes) -> np.ndarray:
    if isinstance(text, bytes):
        return np.array(encoding._encode_single_piece(text), dtype="<u4")
    if special is not None and special.search(text):
        return np.array(encoding.encode(text, allowed_special="all"), dtype="<u4")
    return np.asarray(encoding.encode_to_numpy(text, disallowed_special=()), dtype="<u4")


def _parts(text: str) -> Iterator[str | bytes]:
    """A text around its long runs of white space, and these as bytes.

    The split into words looks behind each run for what follows, and gives up on very long ones.
    What it finds is known: a run is a word of its own, but for its last character where a word
    follows, which is read together with that.
    """
    done = 0
    for run in LONG_BLANKS.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        yield text[done : run.start()]
        yield text[run.start() : end].encode()
        done = end
    yield text[done:]


def _cut(path: str, length: int, separator: int):
    """Rows of documents to rows of pieces, ranked within this task by length."""

    def cut(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, seen = TaskContext.get().partitionId(), np.zeros(length + 1, dtype=np.int64)
        for batch in batches:
            rows = []
            for doc_id, no_id, text in zip(batch["doc_id"], batch["no_id"], batch["text"]):
                ids = np.append(token_ids(text or "", path), np.uint32(separator))
                for start in range(0, len(ids), length):
                    piece = ids[start : start + length].astype("<u4").tobytes()
                    n = len(piece) // 4
                    rows.append((doc_id, no_id, len(ids), start, n, piece, zlib.crc32(piece), task, seen[n]))
                    seen[n] += 1
                if len(rows) >= 2000:
                    yield _frame(rows)
                    rows = []
            if rows:
                yield _frame(rows)

    return cut


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = [c.split()[0] for c in PIECES.split(", ")]
    return pd.DataFrame(rows, columns=names)


def pieces(docs: DataFrame, path: str, length: int = LENGTH, separator: int = SEPARATOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of all documents, as a table in the shared folder."""
    slim = docs.select(*plain_id(id_col), F.col(text_col).alias("text"))
    return with_id(written(slim.mapInPandas(_cut(path, length, separator), PIECES), "pieces"))


def packs(histogram: dict[int, int], length: int = LENGTH) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths of their pieces) with counts, shortest pack first."""
    open_packs: dict[int, list[list]] = defaultdict(list)  # by space left: [pattern, count]
    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        for space in range(length, size - 1, -1):
            if not left:
                break
            waiting, open_packs[space] = open_packs.pop(space, []), []
            for pattern, count in waiting:
                used = min(left, count)
                left -= used
                if used:
                    open_packs[space - size].append([(*pattern, size), used])
                if count > used:
                    open_packs[space].append([pattern, count - used])
        # A new pack is the shortest as long as it has room for more of this size.
        many = length // size
        for pieces_each, count in ((many, left // many), (left % many, 1)):
            if pieces_each and count:
                open_packs[length - size * pieces_each].append([(size,) * pieces_each, count])
    return [(pattern, count) for group in open_packs.values() for pattern, count in group]


def segments(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """Where the pieces of a length go, by rank: (length, from rank, to rank, sequence, offset)."""
    rows, first, dealt = [], 0, defaultdict(int)
    for pattern, count in patterns:
        offset = 0
        for size in pattern:
            rows.append((size, dealt[size], dealt[size] + count, first, offset))
            dealt[size] += count
            offset += size
        first += count
    return rows


def placed(cut: DataFrame, length: int = LENGTH) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``."""
    counts = written(cut.groupBy("length", "task").agg(F.count("*").alias("held")), "lengths")
    histogram = {r["length"]: r["held"] for r in counts.groupBy("length").agg(F.sum("held").alias("held")).collect()}
    rows = segments(packs(histogram, length))
    spark = cut.sparkSession
    ahead = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.select("length", "task", F.coalesce(F.sum("held").over(ahead), F.lit(0)).alias("ahead"))
    rows = rows or [(0, 0, 0, 0, 0)]
    frame = pd.DataFrame(rows, columns=["length", "first", "past", "sequence", "place"])
    # Every length splits at most one pattern, so there are few places whatever the corpus.
    places = F.broadcast(spark.createDataFrame(frame))
    rank = cut.join(ranked, ["length", "task"]).withColumn("rank", F.col("rank") + F.col("ahead"))
    found = rank.join(places, "length").where((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("past")))
    return found.withColumn("sequence_id", F.col("sequence") + F.col("rank") - F.col("first")).withColumn("offset", F.col("place"))


def packed(
    docs: DataFrame, path: str | None = None, length: int = LENGTH, separator: int = SEPARATOR,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), ids_crc32,
    doc_tokens, sequence_id, offset."""
    cut = pieces(docs, path or tokenizer_path(), length, separator, id_col, text_col)
    columns = ["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return placed(cut, length).select(*columns)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens."""
    return packed(table(spark, sf_dir, "documents")).drop("ids")
