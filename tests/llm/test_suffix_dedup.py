import hashlib
import time

import numpy as np
import pytest

from tablecheck.llm import suffix_dedup
from llm_fixtures import awkward, documents, rng, words  # noqa: F401


def expected(rows, window=50):
    docs = [((i is None, i or 0), (t or "").encode()) for i, t, *_ in rows]
    least = {}
    for key, text in docs:
        for at in range(len(text) - window + 1):
            string = text[at : at + window]
            least[string] = min(least.get(string, key), key)
    out = []
    for key, text in docs:
        mask = np.zeros(len(text), dtype=bool)
        for at in range(len(text) - window + 1):
            if least[text[at : at + window]] < key:
                mask[at : at + window] = True
        kept = bytes(b for b, m in zip(text, mask) if not m)
        spans = sum(1 for i in range(len(text)) if mask[i] and (i == 0 or not mask[i - 1]))
        out.append((None if key[0] else key[1], len(text), int(mask.sum()), spans, kept, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def found(df, **options):
    rows = suffix_dedup.without_repeats(df, **options).collect()
    return sorted(((*r[:4], bytes(r[4]), r[5]) for r in rows), key=repr)


def passages(rng, n=120, letters="abcdefghij"):
    shared = [" ".join(words(rng, k, letters)) for k in (6, 9, 10, 11, 14, 40, 120)]
    rows = []
    for i in range(n):
        text = " ".join(words(rng, rng.randint(0, 50), letters))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(shared)
            at, low = rng.randint(0, len(text)), rng.randint(0, 20)
            text = text[:at] + (p[low : rng.randint(low, len(p))] if rng.random() < 0.5 else p) + text[at:]
        rows.append((rng.randint(0, n), text, "en", "s"))
    return rows


@pytest.mark.parametrize("letters", ["abcdefghij", "ab", "é漢🙂x", "\x00a"])
def test_suffix_array(rng, letters):
    data = "".join(rng.choice(letters) for _ in range(3000)).encode() + b"abc" * 100
    text = np.frombuffer(data, dtype=np.uint8)
    order = suffix_dedup.suffix_array(text)
    assert order.tolist() == sorted(range(len(data)), key=lambda i: data[i:])
    shared = suffix_dedup.common_prefixes(suffix_dedup._words(text), order, 50)
    for (a, b), n in zip(zip(order, order[1:]), shared[1:]):
        assert n == next((k for k in range(50) if max(a, b) + k >= len(data) or data[a + k] != data[b + k]), 50)


def test_places_by_hash(rng):
    for bits in (3, 20, 64):
        hashes = np.array([rng.getrandbits(bits) << (64 - bits) for _ in range(3000)], dtype=np.uint64)
        order = suffix_dedup._by_hash(hashes)
        assert sorted(order.tolist()) == list(range(3000)) and (np.diff(hashes[order].astype(object)) >= 0).all()
    near = np.array([rng.randint(0, 50) for _ in range(3000)], dtype=np.uint64)
    assert near[suffix_dedup._by_hash(near)].tolist() == sorted(near.tolist())


def test_merged_runs(rng):
    runs = [np.array(sorted("".join(rng.choice("ab\x00") for _ in range(4)) for _ in range(rng.randint(0, 9))), dtype="S4") for _ in range(7)]
    whole, of = suffix_dedup.merged(runs)
    flat = np.concatenate(runs)
    assert whole.tolist() == sorted(flat.tolist()) and flat[of].tolist() == whole.tolist()


def test_passages(documents, rng):
    rows = passages(rng)
    assert found(documents(rows, 5)) == expected(rows)
    assert found(documents(rows, 1)) == expected(rows)
    assert found(documents(rows), part_bytes=2000) == expected(rows)
    assert found(documents(rows), window=24) == expected(rows, 24)
    assert found(documents(rows), window=64) == expected(rows, 64)


def test_every_length_and_partition(documents, rng):
    """Repeats of one byte less, exactly and one more than a window, in documents of other partitions."""
    for length in (49, 50, 51):
        passage = "".join(rng.choice("abcdefghijklmnop") for _ in range(length))
        rows = [(i, "".join(rng.choice("qrstuv") for _ in range(i)) + passage + "w" * (i % 3), "en", "s") for i in range(12)]
        assert found(documents(rows, 12)) == expected(rows)


@pytest.mark.parametrize("letters", ["ab", "é漢", "\x00b"])
def test_few_letters(documents, rng, letters):
    rows = [(i, "".join(rng.choice(letters) for _ in range(rng.randint(0, 200))), "en", "s") for i in range(60)]
    rows += [(100 + i, letters[0] * 7 * i, "en", "s") for i in range(40)]
    assert found(documents(rows)) == expected(rows)


def test_small_shards_and_hot_anchors(documents, rng, monkeypatch):
    """Documents longer than a shard; one anchor in every document, with other bytes around it."""
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 300)
    rows = passages(rng, 40)
    line = "the very same words in all documents"
    for i in range(60):
        text = "".join(rng.choice("xy") for _ in range(8)) + line + "".join(rng.choice("xy") for _ in range(9))
        rows.append((200 + i, text, "en", "s"))
    assert found(documents(rows)) == expected(rows)
    assert found(documents(rows), part_bytes=1000) == expected(rows)
    monkeypatch.setattr(suffix_dedup, "MOST_RANGES", 4)
    assert found(documents(rows), part_bytes=500) == expected(rows)


def test_hot_windows_are_dealt_to_parts(rng):
    line = b"the same words !"
    text = b"".join(bytes(rng.choices(b"xy", k=40)) + line + bytes(rng.choices(b"xy", k=40)) for _ in range(50))
    text = np.frombuffer(text, dtype=np.uint8)
    at, masks, key = suffix_dedup.fragments(text, np.arange(len(text)) + 50 <= len(text), 50)
    splitters = np.array(sorted([key[0], *[line] * 6, key[-1]]), dtype="S16")
    part, which, mask = suffix_dedup._parts(text, at, masks, key, splitters, 2, 50)
    hot = key[which] == line
    assert not hot.any() or len(set(part[hot])) > 4
    whole = np.zeros(len(masks), dtype=np.uint64)
    np.add.at(whole, which, mask)  # every window once
    assert (whole == masks).all()


@pytest.mark.parametrize("letters", ["abcdefghij", "ab", "é漢🙂x", "\x00a", "".join(map(chr, range(1, 200)))])
def test_suffixes_by_their_first_bytes(rng, letters):
    """Sorted as deep as a window and no deeper: what is tied then is one string."""
    some = "".join(rng.choice(letters) for _ in range(70))
    data = "".join(rng.choice((some, some[3:], rng.choice(letters))) for _ in range(200)).encode()
    text = np.frombuffer(data, dtype=np.uint8)
    for depth in (24, 50, 64):
        order, head = suffix_dedup.sorted_suffixes(text, depth)
        whole = order <= len(data) - depth
        strings, string = [data[i : i + depth] for i in order[whole]], np.cumsum(head)[whole]
        assert sorted(order.tolist()) == list(range(len(data))) and strings == sorted(strings)
        assert [a == b for a, b in zip(strings, strings[1:])] == (string[1:] == string[:-1]).tolist()


def _shared_windows(a: bytes, b: bytes, window=50, parts=3):
    """Starts of the windows of a that are sent after its keys have met those of b."""
    both = []
    for data in (a, b):
        text = np.frombuffer(data, dtype=np.uint8)
        lead = np.arange(len(text)) + window <= len(text)
        at, first = suffix_dedup.anchors_of(text, lead, window)
        masks = suffix_dedup.masks_of(lead, at, first)
        both.append((at, masks, *suffix_dedup.side_keys(text, at, masks, window, parts)))
    (at, masks, key, of), (_, _, other, _) = both
    masks = suffix_dedup.shared_masks(masks, np.isin(key, other)[of], window)
    own, ahead = suffix_dedup._windows(masks, window)
    return set((at[own] - ahead).tolist())


def test_only_what_may_be_shared_is_sent(rng, monkeypatch):
    """Anchors that both texts have send nothing where no side of them is in both; no shared window is left out."""

    def noise(n, letters=b"abcdefgh"):
        return bytes(rng.choices(letters, k=n))

    line = noise(32)
    assert not _shared_windows(*(b"".join(noise(60, letters) + line for _ in range(20)) for letters in (b"ijkl", b"mnop")))
    for key_bits in (28, 17, 3):  # few bits: keys also meet by chance
        monkeypatch.setattr(suffix_dedup, "KEY_BITS", key_bits)
        for window in (24, 50, 51, 64):
            passage = noise(window + 20)
            a, b = (b"".join(noise(30) + passage[rng.randint(0, 12) : rng.randint(len(passage) - 12, len(passage))] for _ in range(9)) for _ in "ab")
            shared = {i for i in range(len(a) - window + 1) if a[i : i + window] in b}
            assert shared and shared <= _shared_windows(a, b, window)


def test_equal_hashes(documents, rng, monkeypatch):
    """All windows with one hash: all their bytes decide."""
    rows = passages(rng, 40)
    want = expected(rows)
    text = np.frombuffer("".join(t for _, t, *_ in rows).encode(), dtype=np.uint8)
    at = np.arange(len(text) - 50)
    monkeypatch.setattr(suffix_dedup, "_window_hashes", lambda words, at, window: np.zeros(len(at), dtype=np.uint64))
    order, head = suffix_dedup._same_strings(suffix_dedup._words(text), at, 50)
    strings = [bytes(text[i : i + 50]) for i in at[order]]
    assert head.tolist() == [True, *(a != b for a, b in zip(strings, strings[1:]))] and head.sum() == len(set(strings))
    assert want


def test_awkward_rows(documents, awkward):
    rows = [(i, t[:700] if t else t, *rest) for i, t, *rest in awkward]
    assert found(documents(rows)) == expected(rows)
    got = {r[0]: r for r in found(documents(awkward))}
    assert got[7][1:4] == (300_000, 0, 0) and got[6][1:4] == (300_003, 0, 0)


def test_ids_above_double_precision(documents):
    text = "a passage of more than fifty bytes that is in every one of these rows"
    rows = [(i, text, "en", "s") for i in (2**53 + 1, 2**53 + 3, 2**63 - 1, None)]
    assert found(documents(rows, 1)) == expected(rows)
    assert [r[2] for r in found(documents(rows, 1))].count(0) == 1


def test_long_repeats_take_linear_time():
    text = np.frombuffer(b"a" * 400_000 + b"b" + b"xyz" * 100_000, dtype=np.uint8)
    began = time.time()
    doc = np.zeros(len(text), dtype=np.int64)
    lead, gone, twins, leads = suffix_dedup.own_repeats(text, doc, len(text) - np.arange(len(text)), 50)
    assert not len(gone) and len(lead) + len(twins) == len(text) - 49 and time.time() - began < 20


def test_empty_table(documents):
    assert found(documents([])) == []
