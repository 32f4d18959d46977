import hashlib
import re

from tablecheck.llm import substring_dedup
from llm_fixtures import awkward, documents, rng, words  # noqa: F401


def expected(rows, window=20):
    docs = sorted(((i is None, i or 0), re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, *_ in rows)
    first = {}
    for key, text in docs:
        for at in range(len(text) - window + 1):
            seen = first.setdefault(tuple(text[at : at + window]), (key, at))
            if (key, at) < seen:
                first[tuple(text[at : at + window])] = (key, at)
    out = []
    for key, text in docs:
        gone = set()
        for at in range(len(text) - window + 1):
            if first[tuple(text[at : at + window])] != (key, at):
                gone.update(range(at, at + window))
        kept = " ".join(w for i, w in enumerate(text) if i not in gone)
        out.append((None if key[0] else key[1], len(text), len(gone), kept, hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df, **options):
    return sorted(map(tuple, substring_dedup.without_repeats(df, **options).collect()), key=repr)


def test_passages(documents, rng):
    passages = [words(rng, n) for n in (19, 20, 21, 33, 60, 200)]
    rows = []
    for i in range(120):
        text = words(rng, rng.randint(0, 80))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            low = rng.randint(0, len(p) - 19)
            at = rng.randint(0, len(text))
            text[at:at] = p[low : rng.randint(low + 15, len(p))] if rng.random() < 0.5 else p
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(text), "en", "s"))
    rng.shuffle(rows)
    assert found(documents(rows)) == expected(rows)
    assert found(documents(rows, 7), part_entries=100) == expected(rows)
    assert found(documents(rows), window=13) == expected(rows, 13)


def test_every_offset_and_length(documents, rng):
    """Whatever the places modulo the period, a repeat of exactly one window is found."""
    for length in (19, 20, 21):
        passage, rows = words(rng, length), []
        for i in range(14):
            rows.append((2 * i, " ".join(words(rng, i) + passage + words(rng, 9)), "en", "s"))
        assert found(documents(rows, 14)) == expected(rows)


def test_few_letters(documents, rng):
    """Many anchors that are equal while the windows around them are not."""
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 90))), "en", "s") for i in range(150)]
    rows += [(1000 + i, "a " * i, "en", "s") for i in range(60)]
    assert found(documents(rows)) == expected(rows)


def test_small_blocks(documents, rng, monkeypatch):
    rows = [(i, " ".join(words(rng, 30, "ab")[:10] + ["the", "same"] * 30), "en", "s") for i in range(40)]
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", 300)
    assert found(documents(rows)) == expected(rows)


def test_awkward_rows(documents, awkward):
    assert found(documents(awkward)) == expected(awkward)


def test_empty_table(documents):
    assert found(documents([])) == []


def test_words_that_polynomials_take_as_equal(documents):
    """The first 1024 letters of the Thue-Morse order and their complement, and other such pairs."""
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    a, b = "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)
    rest = " ".join(f"w{i}" for i in range(19))
    rows = [(1, f"{a} {rest} x y {b} {rest}", "en", "s"), (2, f"{b[:64]} {rest}", "en", "s"), (3, f"{a[:64]} {rest}", "en", "s")]
    got = found(documents(rows))
    assert got == expected(rows) and [r[2] for r in got] == [0, 0, 0]


def test_word_hashes_differ():
    words_of = [bytes([x]) * n for x in (1, 65, 255) for n in (1, 2, 7, 8, 9, 15, 16, 17, 127, 128, 129, 300)] + [b"ab\x00", b"ab"]
    hashes, first = substring_dedup.word_hashes([b" ".join(words_of), b"", b" ", words_of[0]])
    assert len(set(hashes.tolist())) == len(words_of) and hashes[0] == hashes[-1]
    assert first.tolist() == [0, len(words_of), len(words_of), len(words_of), len(words_of) + 1]


def test_ids_above_double_precision(documents, rng):
    text = " ".join(words(rng, 30))
    rows = [(i, text, "en", "s") for i in (2**53 + 3, 2**53 + 1, 2**63 - 1, None)]
    got = found(documents(rows, 1))
    assert got == expected(rows) and [r[0] for r in got if not r[2]] == [2**53 + 1]
