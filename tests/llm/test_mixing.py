import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tablecheck.llm import mixing
from llm_fixtures import awkward, documents, rng  # noqa: F401


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets(sizes, weights=(5, 2, 1), share=1.5):
    """By sharing again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    got, left, open_ = dict.fromkeys(names, 0.0), share * sum(sizes.values()), set(names)
    while open_ and left > 1e-9:
        total, part = sum(weight[s] for s in open_), left
        left = 0.0
        for s in list(open_):
            got[s] += part * weight[s] / total
            if got[s] >= 2 * sizes[s]:
                left += got[s] - 2 * sizes[s]
                got[s] = 2.0 * sizes[s]
                open_.discard(s)
    return got


@pytest.fixture()
def corpus(rng):
    return [
        (i, " ".join(["w"] * rng.randint(0, 40)) or None, "en", "hot" if i % 3 == 0 else rng.choice(["b", "c", "é", "z", None]))
        for i in range(400)
    ]


def test_targets_and_taken(documents, corpus):
    rows = mixing.curriculum(documents(corpus), bucket_rows=30).collect()
    sizes = defaultdict(int)
    for _, text, _, source in corpus:
        sizes[source] += size(text)
    wanted, taken = targets(sizes), defaultdict(int)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(wanted[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert len(rows) == len(corpus)
    for source, target in wanted.items():
        assert abs(taken[source] - target) <= 1


def test_reruns_agree(documents, corpus):
    plans = [mixing.curriculum(documents(corpus, n), bucket_rows=b).drop("start") for n, b in ((1, 50), (5, 7), (3, 10_000))]
    assert plans[0].exceptAll(plans[1]).isEmpty() and plans[1].exceptAll(plans[2]).isEmpty()


def test_positions_follow_the_schedule(documents):
    rows = [(i, "w " * 10, "en", f"s{i % 3}") for i in range(3000)]
    plan = mixing.curriculum(documents(rows)).select("source", F.explode(F.array("position_0", "position_1")).alias("t"))
    first = {r["source"]: r["share"] for r in plan.where("t is not null").groupBy("source").agg(F.avg((F.col("t") < 0.5).cast("int")).alias("share")).collect()}
    # Integrals of the schedules over the first half: 0.625, 0.5 and 0.375 of the whole.
    assert first["s0"] == pytest.approx(0.625, abs=0.01)
    assert first["s1"] == pytest.approx(0.5, abs=0.01)
    assert first["s2"] == pytest.approx(0.375, abs=0.01)


def test_mix_reads_what_is_taken(documents, corpus):
    df = documents(corpus)
    mix = mixing.mixed(df, position_col="position")
    assert mix.columns == [*df.columns, "position"]
    got = defaultdict(int)
    for r in mix.collect():
        got[r["doc_id"]] += size(r["text"])
    plan = {r["doc_id"]: r["taken"] for r in mixing.curriculum(df).collect() if r["taken"]}
    assert got == plan
    positions = [r["position"] for r in mix.collect()]
    assert positions == sorted(positions)


def test_awkward_rows(documents, awkward):
    rows = mixing.curriculum(documents(awkward)).collect()
    assert len(rows) == len(awkward)
    assert sorted(r["size"] for r in rows) == sorted(size(t) for _, t, *_ in awkward)
    assert mixing.mixed(documents(awkward)).count() > 0


def test_empty_tables(documents):
    assert mixing.curriculum(documents([])).count() == 0
    assert mixing.mixed(documents([])).count() == 0
    without_words = mixing.curriculum(documents([(1, None, "en", "a"), (2, " ", "en", None)])).collect()
    assert [(r["taken"], r["target"], r["position_0"]) for r in without_words] == [(0, 0.0, None)] * 2


def test_whole_mix(documents, corpus):
    """Every text of the mix is unchanged, and no source is further from its target than half a document."""
    df = documents(corpus)
    plan = {r["doc_id"]: r for r in mixing.curriculum(df).collect()}
    assert any(0 < r["taken_0"] < r["size"] or 0 < r["taken_1"] < r["size"] for r in plan.values())
    texts, got, count = {i: t for i, t, *_ in corpus}, defaultdict(int), defaultdict(int)
    for r in mixing.mixed(df, whole=True).collect():
        assert r["text"] == texts[r["doc_id"]]
        got[r["source"]] += size(r["text"])
        count[r["doc_id"]] += 1
    assert count == {i: r["whole_0"] + r["whole_1"] for i, r in plan.items() if r["whole_0"] + r["whole_1"]}
    for i, r in plan.items():
        for k in (0, 1):
            # Only the document in which the target falls may differ from what is taken.
            assert r[f"taken_{k}"] not in (0, r["size"]) or r[f"whole_{k}"] == (r[f"taken_{k}"] > 0)
    for source in {r["source"] for r in plan.values()}:
        of = [r for r in plan.values() if r["source"] == source]
        assert abs(got[source] - of[0]["target"]) <= max(r["size"] for r in of) / 2


def test_rows_that_repeat_id_and_text(documents):
    """They keep their source and other columns, and each takes its own reads."""
    same = [(1, "one two", "en", "a"), (1, "one two", "de", "a"), (1, "one two", "en", "b"), (1, "one two", "en", None), (1, "one two", "en", "")]
    df = documents([*same, *[(i, "x y", "en", "c") for i in range(2, 30)]])
    for whole in (False, True):
        plan, mix = mixing.curriculum(df).collect(), mixing.mixed(df, whole=whole).collect()
        wanted, got, langs = defaultdict(int), defaultdict(int), defaultdict(int)
        for r in plan:
            wanted[r["source"]] += 2 * (r["whole_0"] + r["whole_1"]) if whole else r["taken"]
        for r in mix:
            got[r["source"]] += size(r["text"])
            langs[r["doc_id"], r["source"], r["lang"]] += 1
        assert got == {s: n for s, n in wanted.items() if n}
        assert langs[1, "a", "en"] and langs[1, "a", "de"]
