import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tablecheck.llm import divergence
from llm_fixtures import awkward, documents, rng, words  # noqa: F401

LETTERS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected(rows, least=3, top=200):
    held, docs = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LETTERS))
        held[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    out = []
    for lang in docs:
        kept = [t for t, n in docs[lang].items() if n >= least]
        groups = {s: c for (g, s), c in held.items() if g == lang}
        whole = sum(groups.values(), Counter())

        def share(counts):
            total = sum(counts[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // total for t in kept}

        q, p = share(whole), {s: share(c) for s, c in groups.items()}
        for s in groups:
            far = {o: sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept) for o in groups if o != s}
            more = {t: (p[s][t] - q[t]) ** 2 // q[t] for t in kept if groups[s][t] and p[s][t] > q[t]}
            for part, values, limit in (("pair", far, None), ("term", more, top)):
                order = sorted(values, key=lambda i: (-values[i], i.encode()))[:limit]
                out += [(lang, s, part, item, values[item], rank) for rank, item in enumerate(order, 1)]
    return sorted(out)


def found(df, **options):
    return sorted(map(tuple, divergence.divergence(df, **options).collect()))


@pytest.fixture()
def rows(rng):
    out = []
    for i in range(250):
        source = rng.choice("aaabcd")
        text = words(rng, rng.randint(0, 60), "abcé" if source in "ab" else "abdX")
        out.append((i, rng.choice([" ", "-", "9", "\n"]).join(text), rng.choice(["en", "de", None]), source))
    return out


def test_brute_force(documents, rows):
    assert found(documents(rows)) == expected(rows)
    assert found(documents(rows), least=1, top=5) == expected(rows, 1, 5)


def test_collisions_are_split(documents, rows):
    """Six bits for hundreds of terms: every digest stands for several."""
    assert found(documents(rows), bits=6) == expected(rows)
    assert found(documents(rows), bits=6, least=1, top=3) == expected(rows, 1, 3)


def test_texts_are_read_once(spark, documents, rows):
    from pyspark.sql import functions as F

    seen = spark.sparkContext.accumulator(0)

    def same(text):
        seen.add(1)
        return text

    df = documents(rows).withColumn("text", F.udf(same, "string")("text"))
    assert found(df) == expected(rows) and seen.value == len(rows)


@pytest.mark.parametrize("bits", [64, 6, 1])
def test_terms_of_all_lengths(rng, bits):
    """Terms of one to three parts of a hash and beyond, that differ in their last byte; none runs across texts."""
    terms = [letter * n + end for n in (0, 1, 6, 7, 8, 15, 16, 127, 128, 129, 300) for letter in "aé" for end in "xyZ"]
    texts = ["".join(rng.choice(terms) + rng.choice(["", " ", "-7\x00"]) for _ in range(rng.randint(0, 40))) for _ in range(60)]
    groups = np.array([rng.choice([-(2**63), -1, 5]) for _ in texts])
    held, docs = Counter(), Counter()
    for group, text in zip(groups.tolist(), texts):
        own = Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(LETTERS)))
        held.update({(group, t): n for t, n in own.items()})
        docs.update({(group, t): 1 for t in own})
    got = [tuple(r.values()) for b in divergence.counted_terms(groups, [t.encode() for t in texts], bits) for r in b.to_pylist()]
    assert sorted(got) == sorted((*k, n, docs[k]) for k, n in held.items())
    assert not list(divergence.counted_terms(groups[:2], [b"", b"1 2"], bits))


def test_ties_at_the_last_place(documents):
    rows = [(i, "ab cd ef gh ij kl", "en", "a") for i in range(3)] + [(i, "zz", "en", "b") for i in range(5, 9)]
    got = found(documents(rows), top=4)
    assert got == expected(rows, top=4) and [r[3] for r in got if r[:3] == ("en", "a", "term")] == ["ab", "cd", "ef", "gh"]


def test_groups_without_terms(documents):
    rows = [(1, None, "en", "a"), (2, "12 34", "en", "b"), (3, "one", "en", None), (4, "x", "fr", "a"), (4, "x", "fr", "b")]
    assert found(documents(rows)) == expected(rows)
    assert [r[4] for r in found(documents(rows))] == [0] * 8


def test_awkward_rows(documents, awkward):
    assert found(documents(awkward)) == expected(awkward)
    assert found(documents(awkward * 3)) == expected(awkward * 3)


def test_large_counts(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(8 * 10**15, 9 * 10**15), (0, 7), (6, 7)], "n long, total long")
    got = [r[0] for r in df.select(divergence.share(F.col("n"), F.col("total"))).collect()]
    assert got == [1 + 10**9 * (n + 1) // t for n, t in ((8 * 10**15, 9 * 10**15), (0, 7), (6, 7))]


def test_empty_table(documents):
    assert found(documents([])) == []
