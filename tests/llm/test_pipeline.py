from collections import Counter

import pytest

import corpus_pipeline
from tablecheck.llm import exact_dedup, near_dedup
from tablecheck.llm.common import written
from test_exact_dedup import expected as exact_groups
from test_near_dedup import expected as near_groups
from llm_fixtures import awkward, documents  # noqa: F401

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    made = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF_DIR), name)
        made.append((name, docs))
    return dict(made)


def rows(df):
    return [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in df.collect()]


def test_columns(stages):
    columns = stages["documents"].columns
    assert all(df.columns == columns for name, df in stages.items() if name != "pack")


def test_each_stage_on_its_input(stages):
    first, known = rows(stages["documents"]), rows(stages["language_id"])
    assert set(known) <= set(first)
    assert {r for r in first if any(c.isalpha() for c in r[1] or "")} <= set(known)
    exact = rows(stages["exact_duplicates"])
    assert sorted(r[0] for r in exact) == sorted(g[0] for g in exact_groups(known) if g[3])
    near = rows(stages["near_duplicates"])
    assert sorted(r[0] for r in near) == sorted(g[0] for g in near_groups(exact, 5, 80) if g[3])
    mixed = Counter(r[0] for r in rows(stages["mix"]))
    assert set(mixed) <= {r[0] for r in near} and max(mixed.values()) <= 2
    packed = stages["pack"].groupBy("sequence_id").sum("length").collect()
    assert max(r[1] for r in packed) <= 1024
    pieces = stages["pack"].where("start = 0").groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in pieces} == mixed


def test_run(spark, stages):
    got = corpus_pipeline.run(spark, SF_DIR).drop("sequence_id", "offset")
    want = stages["pack"].drop("sequence_id", "offset")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_awkward_rows_and_empty_table(spark, documents, awkward, monkeypatch):
    for source in (awkward, []):
        docs = documents(source)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF_DIR)
            assert out.columns == docs.columns
            docs = written(out, "stage")
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR).count() >= 0
    assert exact_dedup.deduplicated(documents([])).count() == near_dedup.deduplicated(documents([])).count() == 0


def test_mix_keeps_texts_whole(spark, documents):
    # One document per source: most targets fall inside it.
    docs = documents([(i, f"w{i}  x\t" * 50, "en", f"s{i}") for i in range(9)])
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    mixed = corpus_pipeline.mix(spark, docs, SF_DIR).collect()
    assert mixed and all(r["text"] == texts[r["doc_id"]] for r in mixed)
