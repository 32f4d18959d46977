import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from tablecheck.llm import exact_dedup
from llm_fixtures import awkward, documents, rng  # noqa: F401


def expected(rows):
    groups = defaultdict(list)
    for i, text, *_ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(i)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep, seen = min(known, default=None), False
        for i in ids:
            kept, seen = i == keep and not seen, seen or i == keep
            out.append((i, keep, len(ids), kept, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted(map(tuple, df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr)


def build(df, **options):
    found = exact_dedup.records(df, key_bits=options.get("key_bits", 64))
    return exact_dedup.build_index(df, found, **options)


def test_groups(documents, awkward):
    assert found(exact_dedup.exact_duplicates(documents(awkward))) == expected(awkward)


def test_colliding_keys_chain(documents, rng):
    rows = [(i, f"text {i % 40}", "en", "s") for i in range(100)]
    df = documents(rows)
    assert found(exact_dedup.exact_duplicates(df, key_bits=2, capacity=5)) == expected(rows)
    index = build(df, key_bits=2, capacity=5)
    assert index.select("key").distinct().count() <= 4
    assert index.agg(F.max("link")).first()[0] > 5


def test_buckets_split(documents):
    rows = [(i, f"text {i}", "en", "s") for i in range(300)]
    index = build(documents(rows), capacity=16)
    held = index.groupBy("local_depth", "bucket").count().collect()
    assert all(r["count"] <= 16 for r in held)
    # A bucket at depth d holds exactly the keys with its d leading bits.
    for r in index.collect():
        assert (r["key"] & (2**64 - 1)) >> (64 - r["local_depth"]) == r["bucket"]


def test_hot_group(documents):
    rows = [(i, "the same" if i % 3 else f"text {i}", "en", "s") for i in range(300)]
    assert found(exact_dedup.exact_duplicates(documents(rows))) == expected(rows)
    for hot_rows in (0, 3):
        assert found(exact_dedup.exact_duplicates(documents(rows), capacity=16, hot_rows=hot_rows)) == expected(rows)


def test_hot_texts_with_one_key(documents):
    rows = [(i, "the same" if i % 3 else f"text {i % 9}", "en", "s") for i in range(300)]
    df = documents(rows)
    assert found(exact_dedup.exact_duplicates(df, key_bits=1, capacity=2, hot_rows=5)) == expected(rows)


def test_an_owner_writes_whole_buckets(documents):
    rows = [(i, f"text {i}", "en", "s") for i in range(300)]
    index = build(documents(rows), capacity=16)
    named = index.withColumn("file", F.input_file_name())
    files = named.groupBy("local_depth", "bucket").agg(F.countDistinct("file").alias("files"))
    assert files.agg(F.max("files")).first()[0] == 1
    assert files.count() > 16


def test_directory_is_bounded(documents, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MOST_BUCKETS", 8)
    rows = [(i, f"text {i}", "en", "s") for i in range(300)]
    df = documents(rows)
    cells, depth = exact_dedup.directory(exact_dedup.records(df).groupBy("key").count(), capacity=1)
    assert depth < 8 and cells.count() <= 2**depth
    assert found(exact_dedup.exact_duplicates(df, capacity=1)) == expected(rows)


def test_rows_that_stay(documents, awkward):
    df = documents(awkward)
    kept = exact_dedup.deduplicated(df)
    assert kept.columns == df.columns
    stays = {(i, h) for i, _, _, k, h in expected(awkward) if k}
    digest = F.sha2(exact_dedup.normalised("text"), 256)
    assert sorted(map(tuple, kept.select("doc_id", digest).collect()), key=repr) == sorted(stays, key=repr)


def test_empty_table(documents):
    assert exact_dedup.exact_duplicates(documents([])).count() == 0
    assert exact_dedup.deduplicated(documents([])).count() == 0
