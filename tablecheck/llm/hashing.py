"""Hashes of the words of texts, many texts at once."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np

SLICE = 1 << 20
_MULTIPLIER = 0x9E3779B97F4A7C15
_KEY = np.uint64(0x243F6A8885A308D3)
# Words beyond this are hashed one by one, so a very long one takes no step for each of its parts.
LONG_WORD = 128
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def spans(space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of other bytes start and end, in bytes of which the last is a space."""
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edges = np.concatenate([[0], edges])
    starts, ends = edges[0::2], edges[1::2]
    return starts[: len(ends)], ends


def span_hashes(whole: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes; at least eight bytes follow the last one."""
    hashes = mixed(_KEY ^ (ends - starts).astype(np.uint64))
    at = np.ndarray(len(whole) - 8, dtype="<u8", buffer=whole, strides=(1,))
    short = np.flatnonzero(ends - starts <= LONG_WORD)
    for done in range(0, LONG_WORD, 8):
        short = short[ends[short] - starts[short] > done]
        if not len(short):
            break
        low = starts[short] + done
        # Bytes of the part that belong to the word; the rest is cleared.
        over = np.maximum(8 - (ends[short] - low), 0).astype(np.uint64) * np.uint64(8)
        part = (at[low] << over) >> over
        hashes[short] = mixed(hashes[short] ^ part) * np.uint64(_MULTIPLIER)
    for i in np.flatnonzero(ends - starts > LONG_WORD):
        word = whole[starts[i] : ends[i]].tobytes()
        hashes[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
    return hashes


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of all texts in order, and the words before each text.

    A word is taken eight bytes at a time, and each part goes through a full mix with what came
    before; so words of equal length up to eight bytes never share a hash, and others by chance only.
    """
    whole = np.frombuffer(b" ".join(texts) + b" " * 9, dtype=np.uint8)
    bounds = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
    starts, ends = spans(_SPACE[whole])
    return span_hashes(whole, starts, ends), np.searchsorted(starts, bounds)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of ``size`` words; runs that cross texts are for the caller to leave out."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.full(n, size, dtype=np.uint64)
    for i in range(size):
        total = (total + words[i : i + n]) * np.uint64(_MULTIPLIER)
        total ^= total >> np.uint64(29)
    return mixed(total)


def shingle_sets(texts: list[bytes], size: int) -> Iterator[np.ndarray]:
    """For each text the sorted hashes of its distinct runs of ``size`` words.

    A text with fewer words has one, of all its words; a text without words has none.
    """
    words, first = word_hashes(texts)
    runs = window_hashes(words, size)
    for a, b in zip(first, first[1:]):
        if b - a >= size:
            yield np.unique(runs[a : b - size + 1])
        else:
            yield window_hashes(words[a:b], b - a) if b > a else np.zeros(0, dtype=np.uint64)


def chunks(rows: Iterable[tuple], most: int = SLICE, column: int = -1) -> Iterator[list[tuple]]:
    """Rows in lists of bounded bytes in the given column."""
    chunk, size = [], 0
    for row in rows:
        if chunk and size + len(row[column]) > most:
            yield chunk
            chunk, size = [], 0
        chunk.append(row)
        size += len(row[column]) + 1
    if chunk:
        yield chunk
