import zlib
from collections import Counter

from pyspark.sql import functions as F

from tablecheck.llm import sharding
from llm_fixtures import awkward, documents  # noqa: F401


def check(df, rows, shards=16, **options):
    files = sharding.shuffled_shards(df, shards=shards, **options).collect()
    assert len(files) == len(rows)
    got = Counter((r["record"]["doc_id"], r["record"]["text"]) for r in files)
    assert got == Counter((i, t) for i, t, *_ in rows)
    slots = {}
    for r in files:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(slots.get(k, [])) for k in range(shards)]
    assert max(counts) - min(counts) <= 1
    return files


def test_awkward_rows(documents, awkward):
    df = documents(awkward)
    files = check(df, awkward, bucket_bytes=1000)
    assert set(files[0]["record"].asDict()) == set(df.columns)


def test_even_and_shuffled(documents):
    rows = [(i, "the same" if i % 3 == 0 else f"text {i}", "en", "s") for i in range(1000)]
    files = check(documents(rows), rows, bucket_bytes=500)
    order = [r["record"]["doc_id"] for r in sorted(files, key=lambda r: (r["shard"], r["slot"]))]
    rising = sum(a < b for a, b in zip(order, order[1:]))
    assert 400 < rising < 600
    # Copies of a text spread over all shards.
    copies = Counter(r["shard"] for r in files if r["record"]["text"] == "the same")
    assert len(copies) == 16 and max(copies.values()) < 60


def test_one_bucket_and_few_rows(documents):
    rows = [(i, "t", "en", "s") for i in range(5)]
    check(documents(rows), rows)
    check(documents(rows), rows, shards=2)


def test_empty_table(documents):
    assert sharding.shuffled_shards(documents([])).count() == 0


def test_rows_that_repeat_id_and_text_are_split(spark, documents, monkeypatch):
    monkeypatch.setattr(sharding, "PART_BUCKETS", 1)
    rows = [(1, "once more " * 5, "en", "s")] * 6000 + [(1, "once more " * 5, "de", "s")] * 3000
    rows += [(i, f"text {i} " * 5, "en", "s") for i in range(3000)] + [(None, None, "en", "s")] * 3000
    df = documents(rows)
    check(df, rows, bucket_bytes=20_000)
    files = sharding.shuffled_shards(df, bucket_bytes=20_000).groupBy(F.input_file_name()).agg(F.count("*").alias("n"))
    held = [r["n"] for r in files.collect()]
    assert len(held) >= 4 and max(held) < 15000 / 3
    assert spark.conf.get("spark.sql.objectHashAggregate.sortBased.fallbackThreshold") == "128"


def test_only_one_repeated_row(documents):
    rows = [(7, "the same", "en", "s")] * 1000
    check(documents(rows), rows, bucket_bytes=500)
    check(documents(rows), rows)


def test_fewer_partitions_than_buckets(documents, monkeypatch):
    rows = [(i, f"text {i}", "en", "s") for i in range(3000)]
    monkeypatch.setattr(sharding, "PART_BUCKETS", 5)
    one, two = (sorted((r["shard"], r["slot"], r["record"]["doc_id"]) for r in check(documents(rows), rows, bucket_bytes=300)) for _ in "ab")
    assert one == two


def test_query(spark):
    rows = sharding.op7_sharding(spark, "/root/testdata/sf0.001")
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in rows.collect():
        assert (r["size"], r["text_crc32"]) == (len(texts[r["doc_id"]]) + 1, zlib.crc32(texts[r["doc_id"]]))
        assert (r["law"], r["grown_shard"]) == ("rows", None)
