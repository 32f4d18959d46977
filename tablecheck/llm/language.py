"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. The vector of a trigram binds the vectors of its
letters, permuted (rotated) by their place, by multiplication; a text is the bundle (sum) of its
trigrams, and a language is the bundle of its labelled texts. A text gets the language whose
prototype has the largest cosine with its bundle. Word ends are a letter of their own, and all
that is not a letter is a word end. Prototypes are centred on the trigrams that all languages
share: each is compared after the mean of the prototypes is taken off both sides.

Prototypes are learned from a sample of labelled rows, at most about ``rows_per_language`` for
each language, drawn by a hash of the id; rows whose crc32 of the id leaves 2 modulo 4 are held
out. Bundles are sums of whole numbers below 2 ** 24, so results do not depend on batches. The
model is one vector per language and is sent to every task.

Defined results: a text that is null or has no letters is ``und`` with score 0; without any
labelled text all others are ``und`` too; ties go to the language that sorts first. A null id
counts as an empty id. Other columns are ignored, or kept by :func:`accepted`.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tablecheck.llm.common import table

DIMENSIONS = 1024
ROWS_PER_LANGUAGE = 2000
SEED = 5
UNKNOWN = "und"
MIN_SCORE = 0.05
# The least cosine expected of n trigrams in a learned language is about this times the root of n.
LEAST_SCORE = 0.0148
CHUNK_ROWS, CHUNK_CHARS = 512, 2_000_000

_LETTERS: dict[str, np.ndarray] = {}
_VECTORS: dict[tuple[int, int], np.ndarray] = {}


def _is_letter() -> np.ndarray:
    """For each code point, whether it is a letter."""
    if "all" not in _LETTERS:
        _LETTERS["all"] = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return _LETTERS["all"]


def letter_vector(code: int, dimensions: int, seed: int = SEED) -> np.ndarray:
    if (code, dimensions) not in _VECTORS:
        if len(_VECTORS) > 20_000:
            _VECTORS.clear()
        bits = np.random.Generator(np.random.Philox(key=[seed, code])).integers(0, 2, dimensions)
        _VECTORS[code, dimensions] = (2 * bits - 1).astype(np.float32)
    return _VECTORS[code, dimensions]


def bundles(texts: list[str], dimensions: int = DIMENSIONS) -> np.ndarray:
    """One bundle of trigram vectors for each text; zeros where there is no letter."""
    codes = [np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4") for t in texts]
    doc = np.repeat(np.arange(len(texts)), [len(c) + 2 for c in codes])
    end = np.zeros(1, dtype="<u4")
    letters = np.concatenate([x for c in codes for x in (end, c, end)])
    letters = np.where(_is_letter()[letters], letters, 0).astype(np.int64)
    # Runs of other characters become one word end.
    keep = np.ones(len(letters), dtype=bool)
    keep[1:] = (letters[1:] != 0) | (letters[:-1] != 0) | (doc[1:] != doc[:-1])
    letters, doc = letters[keep], doc[keep]
    found = np.flatnonzero(np.bincount(letters))
    lut = np.zeros(found[-1] + 1, dtype=np.int64)
    lut[found] = np.arange(len(found))
    k, at = len(found), lut[letters]
    grams = (at[:-2] * k + at[1:-1]) * k + at[2:]
    inside = (doc[:-2] == doc[2:]) & (letters[1:-1] != 0)
    grams, doc = grams[inside], doc[:-2][inside]
    if not len(grams):
        return np.zeros((len(texts), dimensions), dtype=np.float32)
    if k**3 <= 1 << 23:  # as np.unique, but without sorting
        kinds = np.flatnonzero(np.bincount(grams, minlength=k**3))
        column = np.zeros(k**3, dtype=np.int64)
        column[kinds] = np.arange(len(kinds))
        column = column[grams]
    else:
        kinds, column = np.unique(grams, return_inverse=True)
    vectors = np.stack([letter_vector(int(c), dimensions) for c in found])
    first, second = np.roll(vectors, 2, axis=1), np.roll(vectors, 1, axis=1)
    out = np.zeros((len(texts), dimensions), dtype=np.float32)
    step = 16_384  # kinds of trigrams at once: bounds memory where a chunk has many
    for low in range(0, len(kinds), step):
        part = kinds[low : low + step]
        bound = first[part // (k * k)] * second[part // k % k] * vectors[part % k]
        here = (column >= low) & (column < low + step)
        counts = np.bincount(doc[here] * len(part) + column[here] - low, minlength=len(texts) * len(part))
        out += counts.reshape(len(texts), len(part)).astype(np.float32) @ bound
    return out


def _chunks(texts: Iterable[str]) -> Iterator[list[str]]:
    """Lists of texts, bounded by rows and by characters."""
    chunk, chars = [], 0
    for text in texts:
        if chunk and (len(chunk) == CHUNK_ROWS or chars + len(text) > CHUNK_CHARS):
            yield chunk
            chunk, chars = [], 0
        chunk.append(text)
        chars += len(text)
    if chunk:
        yield chunk


def _bundled(dimensions: int):
    """Rows of lang, text to one summed bundle for each language in the task."""

    def bundle(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = iter(batch["lang"])
            for chunk in _chunks(t or "" for t in batch["text"]):
                rows = bundles(chunk, dimensions)
                for lang, row in zip(islice(langs, len(chunk)), rows.astype(np.float64)):
                    sums[lang] = sums[lang] + row if lang in sums else row
        if sums:
            yield pd.DataFrame({"lang": list(sums), "bundle": [v.tolist() for v in sums.values()]})

    return bundle


def held_out(id_col: str) -> Column:
    key = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    return key % 4 == 2


def prototypes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    dimensions: int = DIMENSIONS, rows_per_language: int = ROWS_PER_LANGUAGE,
) -> tuple[list[str], np.ndarray]:
    """Languages in order of their codes, and their prototypes."""
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col))
    labelled = labelled.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    held = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not held:
        return [], np.zeros((0, dimensions))
    share = F.lit(0.0)
    for lang, count in held.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, rows_per_language / count))).otherwise(share)
    draw = F.pmod(F.xxhash64(F.lit(SEED), "doc_id", "text"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    sample = labelled.where(draw < share).select("lang", "text").repartition(8)
    summed = sample.mapInPandas(_bundled(dimensions), "lang string, bundle array<double>").collect()
    sums = {lang: np.zeros(dimensions) for lang in held}
    for row in summed:
        sums[row["lang"]] += np.array(row["bundle"])
    langs = sorted(lang for lang, v in sums.items() if v.any())
    return langs, np.array([sums[lang] for lang in langs]).reshape(len(langs), dimensions)


def _predicted(langs: list[str], model: np.ndarray):
    """Rows doc_id, text to doc_id, lang_pred, score."""
    unit = model / np.maximum(np.linalg.norm(model, axis=1, keepdims=True), 1e-12)
    mean = unit.mean(axis=0) if len(langs) > 1 else np.zeros(model.shape[1])
    centred = unit - mean
    centred /= np.maximum(np.linalg.norm(centred, axis=1, keepdims=True), 1e-12)

    def predict(chunk: list[str]) -> tuple[list[str], np.ndarray]:
        rows = bundles(chunk, model.shape[1]).astype(np.float64)
        length = np.linalg.norm(rows, axis=1)
        if not langs:
            return [UNKNOWN] * len(chunk), np.zeros(len(chunk))
        rows /= np.maximum(length, 1e-12)[:, None]
        plain = rows @ unit.T
        rows -= mean
        rows /= np.maximum(np.linalg.norm(rows, axis=1), 1e-12)[:, None]
        best = np.argmax(np.round(rows @ centred.T, 12), axis=1)
        score = np.where(length > 0, np.clip(plain[np.arange(len(best)), best], 0, 1), 0.0)
        return [langs[b] if n > 0 else UNKNOWN for b, n in zip(best, length)], score

    def run(batches: Iterable[tuple[pd.Series, ...] | pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            names, scores = [], []
            for chunk in _chunks(t or "" for t in texts):
                name, score = predict(chunk)
                names += name
                scores.append(score)
            yield pd.DataFrame({"lang_pred": names, "score": np.concatenate(scores) if scores else np.zeros(0)})

    return run


def _language_of(text_col: str, langs: list[str], model: np.ndarray) -> Column:
    """The struct lang_pred, score of a text."""
    run = _predicted(langs, model)

    @F.pandas_udf("lang_pred string, score double")
    def language(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from run(texts)

    return language(F.col(text_col))


def identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    found = _language_of(text_col, *prototypes(docs, id_col, text_col, lang_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), found.alias("language"))
    return rows.select("doc_id", held_out("doc_id").alias("held_out"), "language.lang_pred", "language.score")


def accepted(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    min_score: float = MIN_SCORE,
) -> DataFrame:
    """Rows whose text is in one of the languages learned, with all their columns.

    A text is left out below ``min_score``, unless it is so short that its score may be as low in
    a learned language: fewer trigrams have a smaller cosine, and the noise of a cosine is
    1 / root of the dimensions. Up to 40 letters every text with a language stays.
    """
    found = _language_of(text_col, *prototypes(docs, id_col, text_col, lang_col))
    rows = docs.select(F.struct("*").alias("row"), found.alias("language"))
    # A trigram for each letter in its middle; counted only where the score is low.
    trigrams = F.regexp_count(F.col(f"row.`{text_col}`"), F.lit(r"\p{L}"))
    short = F.lit(LEAST_SCORE) * F.sqrt(trigrams) - F.lit(3 / DIMENSIONS**0.5)
    score = F.col("language.score")
    taken = (F.col("language.lang_pred") != UNKNOWN) & ((score >= min_score) | (score >= short))
    return rows.where(taken).select("row.*")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    return identified(table(spark, sf_dir, "documents"))
