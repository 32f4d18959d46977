from collections import Counter, defaultdict

import pytest

from tablecheck.llm import near_dedup
from tablecheck.llm.components import components
from llm_fixtures import awkward, documents, rng, words  # noqa: F401

SF_DIR = "/root/testdata/sf0.001"


def shingles(text, size):
    found = bytes((text or "").encode()).lower().split()
    return frozenset(tuple(found[i : i + size]) for i in range(max(1, len(found) - size + 1))) if found else frozenset()


def expected(rows, size, percent):
    """Components of all links, by counting common shingles."""
    sets = [(i, shingles(t, size)) for i, t, *_ in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    posting = defaultdict(list)
    for at, (i, own) in enumerate(sets):
        if i is None:
            continue
        for other, common in Counter(x for s in own for x in posting[s]).items():
            j, its = sets[other]
            if 100 * common >= percent * (len(own) + len(its) - common):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
        for s in own:
            posting[s].append(at)
    return sorted([(i, len(s), None if i is None else root(i), i is None or root(i) == i) for i, s in sets], key=repr)


def found(df, size, percent):
    return sorted(map(tuple, near_dedup.near_duplicates(df, size=size, percent=percent).collect()), key=repr)


def edited(rng, text, changes):
    text = list(text)
    for _ in range(changes):
        text[rng.randrange(len(text))] = f"new{rng.randrange(10**6)}"
    return text


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
def test_near_copies(documents, rng, size, percent):
    rows, i = [], 0
    passage = words(rng, 60)
    for _ in range(25):
        base = words(rng, rng.randint(3, 200))
        if rng.random() < 0.4:
            base += passage
        for changes in (0, 0, 1, 1, 2, 4, 8):
            rows.append((i, " ".join(edited(rng, base, changes)), "en", "s"))
            i += 1
    rng.shuffle(rows)
    df = documents(rows)
    assert found(df, size, percent) == expected(rows, size, percent)
    kept = near_dedup.deduplicated(df, size=size, percent=percent)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r[0] for r in expected(rows, size, percent) if r[3])


def test_one_large_group(documents, rng):
    """Copies that differ from one text by a few words, mostly less alike among each other."""
    base = words(rng, 160)
    rows = [(i, " ".join(edited(rng, base, rng.randint(0, 5))), "en", "s") for i in range(1, 600)]
    rows.append((0, " ".join(base), "en", "s"))
    assert found(documents(rows, 6), 3, 85) == expected(rows, 3, 85)


def test_awkward_rows(documents, awkward):
    assert found(documents(awkward), 3, 85) == expected(awkward, 3, 85)
    kept = near_dedup.deduplicated(documents(awkward), size=3, percent=85)
    stays = [r[0] for r in expected(awkward, 3, 85) if r[3]]
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted(stays, key=repr)


def test_empty_table(documents):
    assert found(documents([]), 3, 85) == []
    assert near_dedup.deduplicated(documents([])).count() == 0


def test_table(spark):
    df = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    assert found(df, 3, 85) == expected(rows, 3, 85)


def test_components(spark, rng):
    nodes, links = 400, []
    for _ in range(380):
        links.append((rng.randrange(nodes), rng.randrange(nodes)))
    links += [(1000 + i, 1001 + i) for i in range(150)] + [(5000, 6000 + i) for i in range(100)]
    parent = {n: n for link in links for n in link}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: root(n) for n in parent if root(n) != n}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_texts_that_share_an_id(documents, rng):
    """Both texts of an id keep their links, whichever set comes first."""
    rows = []
    for i in range(20):
        for k in (1, 2):
            text = words(rng, 60)
            rows += [(10 * i, " ".join(text), "en", "s"), (10 * i + k, " ".join(text[:-1]), "en", "s")]
    assert found(documents(rows), 3, 85) == expected(rows, 3, 85)
    assert {r[2] for r in expected(rows, 3, 85)} == {10 * i for i in range(20)}


def test_ids_above_double_precision(documents, rng):
    base = words(rng, 60)
    rows = [(2**53 + 2 * i + 1, " ".join(base[:-1] + [f"w{i}"]), "en", "s") for i in range(12)]
    rows += [(2**63 - 1, " ".join(base), "en", "s"), (None, " ".join(base), "en", "s")]
    got = {r["doc_id"]: (r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(documents(rows, 1)).collect()}
    assert set(got) == {r[0] for r in rows}
    assert {c for i, (c, _) in got.items() if i is not None} == {2**53 + 1} and got[None] == (None, True)
