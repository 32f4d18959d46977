"""Repeated byte strings, found by suffix arrays of shards that are merged by binary search.

A byte goes if a string of ``window`` bytes that covers it also starts in a document with a smaller
id. Documents are read once into blocks of whole documents, which are cut into shards of bounded
size (a long document into several, overlapping by ``window - 1`` bytes). Each shard gets

* its suffixes in order of their first ``window`` bytes, by Larsson and Sadakane's refinement: sorted
  by a few bytes, then only the groups that are still tied by the rank of what follows, which
  doubles the depth each time until it is ``window``. What is tied then is one string.

Within the shard all windows of a string but those of the smallest id go, and one of these leads:
only leads are compared with other shards. So a passage in a third of all documents is one entry per
shard.

Leads travel in fragments. The anchor of a window is the place in it whose 16 bytes have the
smallest hash, so equal windows have equal anchors at equal places, and neighbouring windows
mostly share one. Equal windows also share what stands beside the anchor, either ``half`` bytes ahead
of it or as many behind, so each block first sends two keys of an anchor, one of each side: sorted
runs of a few bits each, which a task merges to find the keys that several blocks have. A key that
meets another by chance costs time only. Of the windows on a side with such a key, fragments are
sent, the text around the anchor with a mask of the leads in it, and compared by all their bytes.
Fragments are dealt to parts by splitters, which are quantiles of the anchors of at most
``SAMPLE_BLOCKS`` blocks; an anchor that fills several ranges by itself is hot, and its windows are
dealt to these ranges by their hash.

Defined results: a null text has no bytes; ids that are null are one id larger than all others;
rows that repeat an id are one document and never remove each other's bytes. Matches never cross
documents. An empty table gives no rows. Extra columns are ignored. What is left of a text need
not be valid UTF-8, so it is binary.
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
from tablecheck.llm.hashing import chunks, mixed

WINDOW, LEAST_WINDOW, MOST_WINDOW = 50, 24, 64
GRAM = 16
# Ranks and places of a shard are packed with 21 bits each.
SHARD_BYTES, BITS = 1_500_000, 21
MOST_FIRST = 16
LANE = 256
PART_BYTES = 8 << 20
# Bits of a key beside its part, and bytes of a key and of a fragment, about.
KEY_BITS, KEY_BYTES, FRAGMENT_BYTES = 28, 4, 80
SAMPLE_BLOCKS, SAMPLE_ANCHORS, MOST_RANGES = 256, 1024, 4096

BLOCKS = "block long, ids binary, none binary, counts binary, text binary, leads binary, anchors binary, gone binary, twins binary, n_anchors long"
KEYS = "part long, block long, upper binary, lower binary"
ENTRIES = "part long, block long, entries binary"
SHARED = "part long, block long, shared binary, n_shared long"
ANSWERS = "block long, found binary"
RESULT = "doc_id long, no_id boolean, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"

_MASK = np.uint64((1 << BITS) - 1)
_SHIFT = np.uint64(BITS)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays, of any lengths and kinds, as bytes."""
    head = np.array([len(a.tobytes()) for a in arrays], dtype="<i8").tobytes()
    return zstandard.compress(head + b"".join(a.tobytes() for a in arrays), 1)


def _unpacked(data: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.decompress(data)
    sizes = np.frombuffer(raw, dtype="<i8", count=len(kinds))
    ends = 8 * len(kinds) + np.cumsum(sizes)
    return [np.frombuffer(raw, dtype=k, count=n // np.dtype(k).itemsize, offset=e - n) for k, n, e in zip(kinds, sizes, ends)]


def _words(text: np.ndarray, past: int = 80) -> np.ndarray:
    """The eight bytes from each place on, as little-endian numbers, with zeros behind the text."""
    padded = np.concatenate([text, np.zeros(past + 8, dtype=np.uint8)])
    return np.ascontiguousarray(np.ndarray(len(text) + past, dtype="<u8", buffer=padded, strides=(1,)))


def _letters(text: np.ndarray) -> tuple[np.ndarray, int, int]:
    """Numbers, in order, of the few bytes from each place on; how many bytes and bits these take."""
    used = np.flatnonzero(np.bincount(text, minlength=256))
    code = np.zeros(256, dtype=np.uint32)
    code[used] = np.arange(len(used), dtype=np.uint32)
    bits = max(1, (len(used) - 1).bit_length()) if len(used) else 1
    width = min(3, BITS // bits)
    single = np.concatenate([code[text], np.zeros(MOST_FIRST + width, dtype=np.uint32)])
    n = len(text) + MOST_FIRST
    several = np.zeros(n, dtype=np.uint32)
    for i in range(width):
        several <<= np.uint32(bits)
        several |= single[i : i + n]
    # Most strings of letters do not occur, so those that do take fewer bits.
    occurs = np.zeros(1 << (bits * width), dtype=bool)
    occurs[several] = True
    numbers = np.cumsum(occurs, dtype=np.uint32) - np.uint32(1)
    return numbers[several].astype(np.uint64), width, max(1, int(numbers[-1]).bit_length())


def sorted_suffixes(text: np.ndarray, depth: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts of suffixes in order of their first ``depth`` bytes, or of all; and which differ in these from the one ahead.

    Where a suffix ends it is the smaller one; within ``depth`` bytes of the end of the text some may be tied with longer ones.
    """
    n = len(text)
    if n + MOST_FIRST >= 1 << BITS:
        raise ValueError(f"a shard has less than {(1 << BITS) - MOST_FIRST} bytes")
    # As many bytes as fit beside the place.
    numbers, width, bits = _letters(text)
    steps = min((64 - BITS) // bits, MOST_FIRST // width)
    reached = steps * width
    key = np.zeros(n, dtype=np.uint64)
    for i in range(0, reached, width):
        key <<= np.uint64(bits)
        key |= numbers[i : i + n]
    key = np.sort((key << _SHIFT) | np.arange(n, dtype=np.uint64))
    order = (key & _MASK).astype(np.int64)
    # Ranks are places of the first of a group, above those of the ends: the sooner a suffix ends
    # the smaller it is.
    rank = np.zeros(n + reached, dtype=np.uint32)
    rank[n:] = np.arange(reached, 0, -1)
    at, heads = np.arange(n), np.ones(n, dtype=bool)
    while True:
        upper = key >> _SHIFT
        head = np.ones(len(at), dtype=bool)
        head[1:] = upper[1:] != upper[:-1]
        heads[at] = head
        tied = ~head
        tied[:-1] |= ~head[1:]
        if not tied.any() or reached == depth:
            return order, heads
        first = np.flatnonzero(head)
        rank[order[at]] = np.repeat(at[first], np.diff(np.append(first, len(at)))) + (MOST_FIRST + 1)
        at = at[tied]
        suffixes = order[at]
        # At the last step what follows overlaps what has been compared.
        further = reached if depth is None else min(reached, depth - reached)
        follows = rank[np.minimum(suffixes + further, len(rank) - 1)].astype(np.uint64)
        key = np.sort((rank[suffixes].astype(np.uint64) << np.uint64(2 * BITS)) | (follows << _SHIFT) | suffixes.astype(np.uint64))
        order[at] = (key & _MASK).astype(np.int64)
        reached += further


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of suffixes in order; where one ends it is the smaller one."""
    return sorted_suffixes(text)[0]


def common_prefixes(words: np.ndarray, order: np.ndarray, most: int = WINDOW, some: bool = False) -> np.ndarray:
    """For each place in the order the bytes shared with the suffix ahead, counted up to ``most``.

    With ``some`` they are counted only where ``most`` is still possible by the first and the last
    eight bytes of it, and are 0 elsewhere.
    """
    n = len(order)
    ahead = np.full(n, -1, dtype=np.int64)
    ahead[order[1:]] = order[:-1]
    if some:
        last = words[most - 8 : n + most - 8] == words[np.maximum(ahead, 0) + (most - 8)]
        at = np.flatnonzero(last & (ahead >= 0))
        at = at[words[at] == words[ahead[at]]]
        possible = np.full(n, -1, dtype=np.int64)
        possible[at] = ahead[at]
        ahead = possible
    shared = np.zeros(n, dtype=np.int64)
    starts = np.arange(0, n, LANE)
    known = np.zeros(len(starts), dtype=np.int64)
    for step in range(min(LANE, n)):
        i = starts + step
        i = i[i < n]
        known = np.maximum(known[: len(i)] - 1, 0)
        other = ahead[i]
        known[other < 0] = 0
        active = np.flatnonzero(other >= 0)
        active = active[known[active] < most]
        while len(active):
            h = known[active]
            differ = words[i[active] + h] ^ words[other[active] + h]
            same = np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)).astype(np.int64) >> 3
            known[active] = h + same
            active = active[(same == 8) & (known[active] < most)]
        # Behind the text there are zeros, which are no part of it.
        known = np.minimum(known, np.minimum(most, n - np.maximum(i, other)))
        shared[i] = known
    return shared[order]


def _id_ranks(ids: np.ndarray, none: np.ndarray) -> np.ndarray:
    """The place of each id among the distinct ones; none comes last."""
    order = np.lexsort((ids, none))
    changed = (ids[order][1:] != ids[order][:-1]) | (none[order][1:] != none[order][:-1])
    ranks = np.empty(len(ids), dtype=np.int64)
    ranks[order] = np.concatenate([[0], np.cumsum(changed)]) if len(ids) else order
    return ranks


def own_repeats(text: np.ndarray, doc_rank: np.ndarray, left: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Of a shard: starts of windows that lead, that go, and of twins beside their leads.

    ``doc_rank`` and ``left`` hold the rank of the document and the bytes left in it at each place.
    """
    order, head = sorted_suffixes(text, window)
    inside = left >= window
    tied = ~head
    tied[:-1] |= ~head[1:]
    order, string = order[tied], np.cumsum(head[tied])
    order, string = order[inside[order]], string[inside[order]]
    if not len(order):
        none = np.zeros(0, dtype=np.int64)
        return np.flatnonzero(inside), none, none, none
    first = np.flatnonzero(np.concatenate([[True], string[1:] != string[:-1]]))
    size = np.diff(np.append(first, len(order)))
    least = np.repeat(np.minimum.reduceat(doc_rank[order], first), size)
    stays = doc_rank[order] == least
    # The first of those that stay leads its string.
    staying, its_string = order[stays], np.repeat(np.arange(len(first)), size)[stays]
    lead = np.concatenate([[True], its_string[1:] != its_string[:-1]])
    leader = staying[np.maximum.accumulate(np.where(lead, np.arange(len(lead)), 0))]
    inside[order] = False
    inside[staying[lead]] = True
    return np.flatnonzero(inside), order[~stays], staying[~lead], leader[~lead]


def _shards(n: int, window: int) -> Iterator[tuple[int, int]]:
    """Where the shards of a block start and end; each window is whole in one of them."""
    for low in range(0, max(n - window + 1, 1), SHARD_BYTES):
        yield low, min(n, low + SHARD_BYTES + window - 1)


def _blocked(window: int):
    """Rows doc_id, no_id, text to blocks with the results of their shards."""

    def block(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 33
        rows = ((i, x, (t or "").encode()) for b in batches for i, x, t in zip(b["doc_id"], b["no_id"], b["text"]))
        for chunk in chunks(rows, SHARD_BYTES):
            ids = np.array([r[0] for r in chunk], dtype=np.int64)
            none = np.array([r[1] for r in chunk], dtype=bool)
            counts = np.array([len(r[2]) for r in chunk], dtype=np.int64)
            whole = b"".join(r[2] for r in chunk)
            text, ranks = np.frombuffer(whole, dtype=np.uint8), _id_ranks(ids, none)
            ends = np.cumsum(counts)
            lead, gone, twins = np.zeros(len(text), dtype=bool), np.zeros(len(text), dtype=bool), []
            for low, high in _shards(len(text), window):
                held = np.maximum(np.minimum(ends, high) - np.maximum(ends - counts, low), 0)
                left = np.repeat(np.minimum(ends, high), held) - np.arange(low, high)
                found = own_repeats(text[low:high], np.repeat(ranks, held), left, window)
                lead[low + found[0]] = True
                gone[low + found[1]] = True
                twins.append([low + found[2], low + found[3]])
            twins = [np.concatenate(t).astype("<i8") for t in zip(*twins)]
            at, first = anchors_of(text, lead, window)
            anchor = np.zeros(len(text), dtype=bool)
            anchor[at] = True
            row = (
                number, ids.tobytes(), none.tobytes(), counts.tobytes(), zstandard.compress(whole, 3), _packed(np.packbits(lead)),
                _packed(np.packbits(anchor), (at - first).astype("u1")), _packed(np.packbits(gone)), _packed(*twins), len(at),
            )
            yield pd.DataFrame([row], columns=[c.split()[0] for c in BLOCKS.split(", ")])
            number += 1

    return block


def _bits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(_unpacked(data, "u1")[0], count=n).astype(bool)


def _window_hashes(words: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    total = np.zeros(len(at), dtype=np.uint64)
    for step in _steps(window):
        total ^= words[at + step]
        total *= _ODD
        total ^= total >> np.uint64(29)
    return mixed(total)


def _steps(window: int) -> list[int]:
    """Places of eight-byte words that cover a window."""
    return [*range(0, window - 8, 8), window - 8]


def anchors(text: np.ndarray, window: int) -> np.ndarray:
    """For each window of a shard the place of its 16 bytes with the smallest hash, the first of equal ones."""
    words = _words(text)
    n = max(0, len(text) - GRAM + 1)
    gram = mixed(words[:n] ^ mixed(words[8 : n + 8]))
    least = (gram & ~_MASK) | np.arange(n, dtype=np.uint64)
    span, reached = window - GRAM + 1, 1
    while reached < span:
        step = min(reached, span - reached)
        least = np.minimum(least[:-step], least[step:]) if len(least) > step else least[:0]
        reached += step
    return (least & _MASK).astype(np.int64)


def anchors_of(block: np.ndarray, lead: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct anchors of all leads of a block, and the first lead of each; both ascend."""
    at, first = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for low, high in _shards(len(block), window):
        starts = np.flatnonzero(lead[low : min(high, low + SHARD_BYTES)])
        if len(starts):
            at.append(low + anchors(block[low:high], window)[starts])
            first.append(low + starts)
    at, first = np.concatenate(at), np.concatenate(first)
    changes = np.ones(len(at), dtype=bool)
    changes[1:] = at[1:] != at[:-1]
    return at[changes], first[changes]


def masks_of(lead: np.ndarray, at: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Masks of the leads of each anchor: bit i stands for the window that starts i bytes ahead of it."""
    if not len(at):
        return np.zeros(0, dtype=np.uint64)
    starts = np.flatnonzero(lead)
    since = np.searchsorted(starts, first)
    own = np.repeat(at, np.diff(np.append(since, len(starts))))
    return np.bitwise_or.reduceat(np.uint64(1) << (own - starts).astype(np.uint64), since)


def _unpacked_fragments(n: int, leads: bytes, packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Anchors of a block in order of their places, and masks of their leads."""
    bits, ahead = _unpacked(packed, "u1", "u1")
    at = np.flatnonzero(np.unpackbits(bits, count=n))
    return at, masks_of(_bits(leads, n), at, at - ahead)


def fragments(block: np.ndarray, lead: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of all leads of a block, masks of the leads of each, and the 16 bytes, in suffix order."""
    at, first = anchors_of(block, lead, window)
    return _in_suffix_order(block, at, masks_of(lead, at, first))


def _in_suffix_order(block: np.ndarray, at: np.ndarray, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    key = _grams(block, at)
    high, low = key.view(">u8").reshape(-1, 2).T
    order = np.lexsort((low, high))
    return at[order], masks[order], key[order]


def _sides(masks: np.ndarray, window: int) -> tuple[np.uint64, np.ndarray, np.ndarray]:
    """Bits of the windows with half of the rest ahead of the anchor; anchors with such windows, and with others."""
    half = np.uint64((window - GRAM) // 2)
    behind = (np.uint64(1) << half) - np.uint64(1)
    return behind, np.flatnonzero(masks & ~behind), np.flatnonzero(masks & behind)


def side_keys(text: np.ndarray, at: np.ndarray, masks: np.ndarray, window: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of a block, in order, the part above ``KEY_BITS`` bits; and the key of each anchor's sides.

    The window of a set bit holds all bytes of the key of its side.
    """
    half = (window - GRAM) // 2
    _, ahead, behind = _sides(masks, window)
    words = _words(text)
    hashes = np.concatenate([
        _window_hashes(words, at[ahead] - half, GRAM + half), mixed(_window_hashes(words, at[behind], GRAM + half) + _ODD)
    ])
    part = ((hashes >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    return np.unique((part << np.uint64(KEY_BITS)) | (hashes & np.uint64((1 << KEY_BITS) - 1)), return_inverse=True)


def shared_masks(masks: np.ndarray, shared: np.ndarray, window: int) -> np.ndarray:
    """What is left of masks where only some of the sides, in the order of their keys, are shared."""
    low, ahead, behind = _sides(masks, window)
    left = np.zeros(len(masks), dtype=np.uint64)
    which = ahead[shared[: len(ahead)]]
    left[which] |= masks[which] & ~low
    which = behind[shared[len(ahead) :]]
    left[which] |= masks[which] & low
    return left


def _grams(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(text[at[:, None] + np.arange(GRAM)]).view(f"S{GRAM}").ravel()


def _windows(masks: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of the fragment, and bytes ahead of its anchor, of all windows in the masks."""
    bits = np.arange(window - GRAM + 1, dtype=np.uint64)
    return np.nonzero((masks[:, None] >> bits) & np.uint64(1))


def _parts(text: np.ndarray, at: np.ndarray, masks: np.ndarray, key: np.ndarray, splitters: np.ndarray, subs: int, window: int):
    """Part, fragment and mask of what is sent: the windows of hot anchors are dealt to several parts."""
    low, high = np.searchsorted(splitters, key, side="left"), np.searchsorted(splitters, key, side="right")
    hot = high - low > 1
    which = np.flatnonzero(~hot)
    parts, fragment, mask = [_anchor_parts(key[which], splitters, subs)], [which], [masks[which]]
    which = np.flatnonzero(hot)
    if len(which):
        own, ahead = _windows(masks[which], window)
        own = which[own]
        draw = _window_hashes(_words(text), at[own] - ahead, window)
        ranges = (high - low)[own].astype(np.uint64)
        to = (low[own] + 1 + (draw % ranges).astype(np.int64)) * subs + (draw // ranges % np.uint64(subs)).astype(np.int64)
        order = np.lexsort((own, to))
        to, own, bits = to[order], own[order], np.uint64(1) << ahead[order].astype(np.uint64)
        first = np.flatnonzero(np.concatenate([[True], (to[1:] != to[:-1]) | (own[1:] != own[:-1])]))
        parts.append(to[first])
        fragment.append(own[first])
        mask.append(np.bitwise_or.reduceat(bits, first))
    return np.concatenate(parts), np.concatenate(fragment), np.concatenate(mask)


def _reach(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes from the first window of a mask, and from the last one, to the anchor."""
    last = np.bitwise_count((mask & (~mask + np.uint64(1))) - np.uint64(1)).astype(np.int64)
    spread = mask.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        spread |= spread >> np.uint64(shift)
    return np.bitwise_count(spread).astype(np.int64) - 1, last


def _cut_texts(text: bytes, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return np.frombuffer(b"".join(text[a:b] for a, b in zip(low.tolist(), high.tolist())), dtype=np.uint8)


def _by_part(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each part with the places that have it, in order."""
    order = np.argsort(part, kind="stable")
    for i in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
        if len(i):
            yield int(part[i[0]]), i


def _anchor_parts(key: np.ndarray, splitters: np.ndarray, subs: int) -> np.ndarray:
    """An anchor lies between two splitters; where there are more parts than ranges a hash deals."""
    part = np.searchsorted(splitters, key, side="right")
    return part if subs == 1 else part * subs + (_gram_hashes(key) % np.uint64(subs)).astype(np.int64)


def _gram_hashes(key: np.ndarray) -> np.ndarray:
    first, second = key.view("<u8").reshape(-1, 2).T
    return mixed(first ^ mixed(second))


def _slices(key: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Each part of sorted keys with their slice."""
    part = key >> np.uint64(KEY_BITS)
    bounds = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
    for low, high in zip(bounds, bounds[1:]):
        if high > low:
            yield int(part[low]), slice(low, high)


def _key_runs(window: int, parts: int):
    """Rows part, block, and the keys of the block in that part, in order."""

    def send(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for number, raw, leads, packed in zip(batch["block"], batch["text"], batch["leads"], batch["anchors"]):
                text = np.frombuffer(zstandard.decompress(raw), dtype=np.uint8)
                key, _ = side_keys(text, *_unpacked_fragments(len(text), leads, packed), window, parts)
                rest = key & np.uint64((1 << KEY_BITS) - 1)
                runs = []
                for part, i in _slices(key):
                    # The upper bits of a sorted run differ little, and the lower ones cannot be made smaller.
                    upper = np.diff(rest[i] >> np.uint64(16), prepend=np.uint64(0)).astype("<u2")
                    runs.append((part, number, _packed(upper), rest[i].astype("<u2").tobytes()))
                yield pd.DataFrame(runs, columns=["part", "block", "upper", "lower"])

    return send


def _merge_keys(rows: pd.DataFrame) -> pd.DataFrame:
    """The runs of a part to bits, by block, of the keys that other blocks have too."""
    runs = []
    for upper, lower in zip(rows["upper"], rows["lower"]):
        upper = np.cumsum(_unpacked(upper, "<u2")[0], dtype=np.uint32)
        runs.append((upper << np.uint32(16)) | np.frombuffer(lower, dtype="<u2"))
    key, of = merged(runs)
    same = key[1:] == key[:-1]
    shared = np.zeros(len(key), dtype=bool)
    shared[of[1:][same]] = True
    shared[of[:-1][same]] = True
    each = zip(rows["part"], rows["block"], np.split(shared, np.cumsum([len(r) for r in runs])[:-1]))
    found = [(part, block, np.packbits(bits).tobytes(), int(bits.sum())) for part, block, bits in each if bits.any()]
    return pd.DataFrame(found, columns=["part", "block", "shared", "n_shared"])


def _fragment_runs(window: int, splitters: np.ndarray, subs: int, parts: int):
    """Rows part, block, and the fragments of the block in that part; ``parts`` is the number of those of keys."""

    def send(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ("block", "ids", "none", "counts", "text", "leads", "anchors", "shared")
        for batch in batches:
            for number, ids, none, counts, raw, leads, packed, answers in zip(*(batch[c] for c in names)):
                whole = zstandard.decompress(raw)
                text = np.frombuffer(whole, dtype=np.uint8)
                at, masks = _unpacked_fragments(len(text), leads, packed)
                key, of = side_keys(text, at, masks, window, parts)
                bits, shared = {a["part"]: a["shared"] for a in answers}, np.zeros(len(key), dtype=bool)
                for part, i in _slices(key):
                    if part in bits:
                        shared[i] = np.unpackbits(np.frombuffer(bits[part], dtype=np.uint8), count=i.stop - i.start)
                masks = shared_masks(masks, shared[of], window)
                at, masks = at[masks > 0], masks[masks > 0]
                key = _grams(text, at)
                part, which, mask = _parts(text, at, masks, key, splitters, subs, window)
                doc = np.searchsorted(np.cumsum(np.frombuffer(counts, dtype=np.int64)), at[which], side="right")
                ids, none = np.frombuffer(ids, dtype=np.int64)[doc], np.frombuffer(none, dtype=bool)[doc]
                ahead, last = _reach(mask)
                low, high = at[which] - ahead, at[which] - last + window
                rows = []
                for to, i in _by_part(part):
                    rows.append((to, number, _packed(ids[i], none[i], at[which[i]], mask[i], _cut_texts(whole, low[i], high[i]))))
                yield pd.DataFrame(rows, columns=["part", "block", "entries"])

    return send


def _anchor_sample(window: int):
    def sample(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for raw, leads, packed in zip(batch["text"], batch["leads"], batch["anchors"]):
                text = np.frombuffer(zstandard.decompress(raw), dtype=np.uint8)
                _, masks, key = _in_suffix_order(text, *_unpacked_fragments(len(text), leads, packed))
                # Evenly by the windows of the anchors: these are what fills a part.
                held = np.cumsum(np.bitwise_count(masks).astype(np.int64))
                if len(held):
                    few = min(SAMPLE_ANCHORS, int(held[-1]))
                    taken = np.searchsorted(held, (np.arange(few) * held[-1]) // few, side="right")
                    yield pd.DataFrame({"anchors": [key[taken].tobytes()]})

    return sample


def splitters_of(blocks: DataFrame, window: int, ranges: int) -> np.ndarray:
    """Anchors between which the ranges lie, from a bounded sample of blocks."""
    if ranges < 2:
        return np.zeros(0, dtype=f"S{GRAM}")
    chosen = [r[0] for r in blocks.select("block").orderBy(F.xxhash64("block"), "block").limit(SAMPLE_BLOCKS).collect()]
    few = blocks.where(F.col("block").isin(chosen)).select("text", "leads", "anchors")
    found = np.concatenate([np.frombuffer(bytes(r[0]), dtype=f"S{GRAM}") for r in few.mapInPandas(_anchor_sample(window), "anchors binary").collect()])
    found.sort()
    return found[(np.arange(1, ranges) * len(found)) // ranges]


def merged(runs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted runs as one, by a sort that merges runs it finds; and where each element came from."""
    whole = np.concatenate(runs)
    of = np.argsort(whole, kind="stable")
    return whole[of], of


def _by_hash(hashes: np.ndarray) -> np.ndarray:
    """Places in order of their hashes: sorted by the upper bits with the place packed below, which is
    several times as fast as sorting places, then by all bits where the upper ones are not enough."""
    low = np.uint64(max(1, len(hashes).bit_length()))
    places = np.arange(len(hashes), dtype=np.uint64)
    mask = (np.uint64(1) << low) - np.uint64(1)
    packed = np.sort((hashes & ~mask) | places)
    order = (packed & mask).astype(np.int64)
    found, upper = hashes[order], packed >> low
    mixed_up = np.flatnonzero((upper[1:] == upper[:-1]) & (found[1:] != found[:-1]))
    if len(mixed_up):
        again = np.flatnonzero(np.isin(upper, upper[mixed_up]))
        order[again] = order[again][np.lexsort((found[again], upper[again]))]
    return order


def _same_strings(words: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows in an order that has equal ones next to each other, and which of them start a string."""
    hashes = _window_hashes(words, at, window)
    order = _by_hash(hashes)
    alike = hashes[order][1:] == hashes[order][:-1]
    same = alike.copy()
    for step in _steps(window):
        word = words[at[order] + step]
        same &= word[1:] == word[:-1]
    if (alike & ~same).any():  # different strings with one hash may be mixed: sort by all bytes
        columns = [words[at + step] for step in _steps(window)]
        order = np.lexsort(columns)
        same = np.logical_and.reduce([c[order][1:] == c[order][:-1] for c in columns])
    return order, np.concatenate([[True], ~same])


def _merge_windows(window: int):
    """The fragments of a part to the windows, by block, that start in a document with a smaller id elsewhere."""

    def answer(rows: pd.DataFrame) -> pd.DataFrame:
        none_found = pd.DataFrame({"block": np.zeros(0, dtype=np.int64), "found": np.zeros(0, dtype=object)})
        if len(rows) < 2:
            return none_found
        runs = [_unpacked(e, "<i8", "?", "<i8", "<u8", "u1") for e in rows["entries"]]
        ids, none, at, mask, text = (np.concatenate(c) for c in zip(*runs))
        source = np.repeat(np.arange(len(runs)), [len(r[0]) for r in runs])
        ahead, last = _reach(mask)
        ends = np.cumsum(ahead - last + window)
        place = ends - (window - last)  # of the anchor in the text
        own, back = _windows(mask, window)
        order, head = _same_strings(_words(text), place[own] - back, window)
        rank = _id_ranks(ids, none)[own][order]
        first = np.flatnonzero(head)
        least = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(order))))
        later = order[rank > least]
        later = later[np.argsort(source[own[later]], kind="stable")]
        blocks, found = rows["block"].to_numpy(), []
        for i in np.split(later, np.flatnonzero(np.diff(source[own[later]])) + 1):
            if len(i):
                found.append((blocks[source[own[i[0]]]], _packed(np.sort(at[own[i]] - back[i]))))
        return pd.DataFrame(found, columns=["block", "found"]) if found else none_found

    return answer


def _kept(window: int):
    def keep(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in RESULT.split(", ")]
        for batch in batches:
            for ids, none, counts, raw, gone, twins, found in zip(*(batch[c] for c in ("ids", "none", "counts", "text", "gone", "twins", "found"))):
                text = np.frombuffer(zstandard.decompress(raw), dtype=np.uint8)
                n, counts = len(text), np.frombuffer(counts, dtype=np.int64)
                starts = _bits(gone, n)
                for part in () if found is None else found:
                    starts[_unpacked(part, "<i8")[0]] = True
                twin, lead = _unpacked(twins, "<i8", "<i8")
                starts[twin[starts[lead]]] = True
                marks = np.zeros(n + window + 1, dtype=np.int32)
                at = np.flatnonzero(starts)
                marks[at] += 1
                marks[at + window] -= 1
                covered = np.cumsum(marks)[:n] > 0
                rows, low = [], 0
                for doc_id, no_id, size in zip(np.frombuffer(ids, dtype=np.int64).tolist(), np.frombuffer(none, dtype=bool).tolist(), counts.tolist()):
                    mask, part = covered[low : low + size], text[low : low + size]
                    removed = int(mask.sum())
                    spans = int(mask[:1].sum() + (mask[1:] & ~mask[:-1]).sum())
                    kept = part[~mask].tobytes() if removed else part.tobytes()
                    rows.append((doc_id, no_id, size, removed, spans, kept, hashlib.sha256(kept).hexdigest()))
                    low += size
                yield pd.DataFrame(rows, columns=names)

    return keep


def without_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, part_bytes: int = PART_BYTES
) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, the kept bytes and their SHA-256."""
    if not LEAST_WINDOW <= window <= MOST_WINDOW:
        raise ValueError(f"window must be from {LEAST_WINDOW} to {MOST_WINDOW}")
    slim = docs.select(*plain_id(id_col), F.col(text_col).cast("string").alias("text"))
    blocks = written(slim.mapInPandas(_blocked(window), BLOCKS), "blocks")
    leading = blocks.where("n_anchors > 0")
    key_parts = max(1, math.ceil(2 * KEY_BYTES * (blocks.agg(F.sum("n_anchors")).first()[0] or 0) / part_bytes))
    runs = leading.select("block", "text", "leads", "anchors").mapInPandas(_key_runs(window, key_parts), KEYS)
    shared = runs.groupBy("part").applyInPandas(_merge_keys, SHARED).groupBy("block")
    shared = written(shared.agg(F.collect_list(F.struct("part", "shared")).alias("shared"), F.sum("n_shared").alias("n_shared")), "shared")

    parts = max(1, math.ceil(FRAGMENT_BYTES * (shared.agg(F.sum("n_shared")).first()[0] or 0) / part_bytes))
    ranges = min(parts, MOST_RANGES)
    splitters, subs = splitters_of(blocks, window, ranges), math.ceil(parts / ranges)
    sent = leading.select("block", "ids", "none", "counts", "text", "leads", "anchors").join(shared.drop("n_shared"), "block")
    entries = sent.mapInPandas(_fragment_runs(window, splitters, subs, key_parts), ENTRIES)
    answers = entries.groupBy("part").applyInPandas(_merge_windows(window), ANSWERS)
    answers = written(answers.groupBy("block").agg(F.collect_list("found").alias("found")), "answers")
    rows = blocks.select("block", "ids", "none", "counts", "text", "gone", "twins").join(answers, "block", "left")
    return with_id(rows.mapInPandas(_kept(window), RESULT))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without byte strings that also start in a document with a smaller id."""
    return without_repeats(table(spark, sf_dir, "documents")).drop("kept")


# Bytes as pairs of hexadecimal digits.
SQL = """
WITH t AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents
), c AS (
  SELECT doc_id, base, substring(x, 2 * base + 1, 610) AS part, length(x) // 2 - base AS rest
  FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2, 256)) AS base FROM t)
), w AS (
  SELECT doc_id, base + o AS pos, substring(part, 2 * o + 1, 100) AS string
  FROM (SELECT *, unnest(range(0, greatest(least(rest - 49, 256), 0))) AS o FROM c)
), m AS (
  SELECT string, min(doc_id) AS least FROM w GROUP BY string HAVING min(doc_id) < max(doc_id)
), s AS (
  SELECT doc_id, pos FROM w JOIN m USING (string) WHERE least < doc_id
), n AS (
  SELECT doc_id, pos, lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS ahead FROM s
), i AS (
  SELECT doc_id, pos, sum((ahead IS NULL OR pos > ahead + 50)::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS span FROM n
), r AS (
  SELECT doc_id, span, min(pos) AS low, max(pos) + 50 AS high FROM i GROUP BY doc_id, span
), g AS (
  SELECT doc_id, sum(high - low) AS gone, count(*) AS spans, max(high) AS past FROM r GROUP BY doc_id
), p AS (
  SELECT doc_id, low, coalesce(lag(high) OVER (PARTITION BY doc_id ORDER BY low), 0) AS since FROM r
), k AS (
  SELECT doc_id, string_agg(substring(x, 2 * since + 1, 2 * (low - since)), '' ORDER BY low) AS kept FROM p JOIN t USING (doc_id) GROUP BY doc_id
)
SELECT t.doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed,
       coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, '') || substring(x, 2 * coalesce(past, 0) + 1))) AS kept_sha256
FROM t LEFT JOIN g USING (doc_id) LEFT JOIN k USING (doc_id)
"""
