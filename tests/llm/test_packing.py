import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tablecheck.llm import packing
from llm_fixtures import awkward, documents, rng  # noqa: F401

SAMPLES = [
    "", " ", "It's  we'll THEY'VE 123abc 45.6", "ünï ©ode 漢字 ​　x", "a\n\n b\t\r\n c   ", "<|endoftext|> and <|endoftext|>",
    "don’t '''s 'S ñandú 🙂🙂", "\x00\x01 end ", "x" * 5000, "٣٤ Ⅷ ½", " leading and trailing ",
]


@pytest.fixture(scope="module")
def reference():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(packing.tokenizer_path())


def test_ids_are_those_of_tokenizers(reference, spark):
    texts = SAMPLES + [r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for text in texts:
        want = reference.encode(text, add_special_tokens=False).ids
        assert packing.token_ids(text, packing.tokenizer_path()).tolist() == want


def check(df, rows, reference, length=1024):
    got = packing.packed(df, length=length).collect()
    pieces = defaultdict(list)
    for r in got:
        assert r["length"] * 4 == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(bytes(r["ids"]))
        pieces[r["doc_id"], r["doc_tokens"]].append((r["start"], np.frombuffer(bytes(r["ids"]), dtype="<u4").tolist()))
    want = Counter()
    for i, text, *_ in rows:
        ids = [*reference.encode(text or "", add_special_tokens=False).ids, 0]
        for start in range(0, len(ids), length):
            want[i, start, tuple(ids[start : start + length])] += 1
    assert Counter((i, start, tuple(ids)) for (i, _), parts in pieces.items() for start, ids in parts) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= length
    assert sorted(sequences) == list(range(len(sequences)))
    return sequences


def test_awkward_rows(documents, awkward, reference):
    check(documents(awkward), awkward, reference)
    check(documents(awkward), awkward, reference, length=16)


def test_little_padding(documents, rng, reference):
    rows = [(i, "word " * rng.randint(0, 300), "en", "s") for i in range(600)] + [(1000 + i, "same text", "en", "s") for i in range(300)]
    sequences = check(documents(rows, 5), rows, reference, length=128)
    used = sum(size for parts in sequences.values() for _, size in parts)
    assert used / (128 * len(sequences)) > 0.97


def test_shortest_pack_first():
    assert packing.packs({}) == []
    assert sorted(packing.packs({6: 2, 4: 1, 3: 2, 1: 5}, 10)) == sorted([((6, 4), 1), ((6, 3), 1), ((3, 1, 1, 1, 1, 1), 1)])
    assert sorted(packing.packs({3: 7}, 10)) == [((3,), 1), ((3, 3, 3), 2)]
    histogram = {size: 1 + size % 7 for size in range(1, 1025)}
    patterns = packing.packs(histogram)
    placed = Counter()
    for pattern, count in patterns:
        assert sum(pattern) <= 1024 and count > 0
        for size in pattern:
            placed[size] += count
    assert placed == histogram


def test_empty_table(documents):
    assert packing.packed(documents([])).count() == 0


@pytest.mark.parametrize("blank", [" ", "\n", "\t ", "　", "\r\n"])
def test_long_runs_of_white_space(blank, reference):
    for n in (999, 1000, 1001, 3000):
        for text in (blank * n, "a" + blank * n, blank * n + "b", f"a{blank * n}b{blank * n}!", f"a{blank * n}1<|endoftext|>{blank * n}'s"):
            assert packing.token_ids(text, packing.tokenizer_path()).tolist() == reference.encode(text, add_special_tokens=False).ids


def test_very_long_blanks():
    ids = packing.token_ids("a" + " " * 10_000_000 + "b", packing.tokenizer_path())
    assert len(ids) == len(packing.token_ids("a" + " " * 999_999 + "b", packing.tokenizer_path())) + 9_000_001


def test_ids_above_double_precision(documents):
    rows = [(i, "some text", "en", "s") for i in (2**53 + 1, 2**53 + 3, 2**63 - 1, None)]
    assert {r["doc_id"] for r in packing.packed(documents(rows, 1)).collect()} == {2**53 + 1, 2**53 + 3, 2**63 - 1, None}
