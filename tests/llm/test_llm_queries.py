"""The registered queries: columns of their contracts, all rows, and brute force where SQL has no form."""

import pytest

import test_near_dedup
from tablecheck.llm import queries

SF_DIR = "/root/testdata/sf0.001"
CONTRACTS = {
    "op1_topk_search": ["query_id", "rank", "vec_id", "score"],
    "op2_language": ["doc_id", "held_out", "lang_pred", "score"],
    "op3_near_dedup": ["doc_id", "n_shingles", "component_id", "kept"],
    "op4_substring_dedup": ["doc_id", "n_words", "n_removed", "kept_sha256"],
    "op5_html_text": ["page_id", "url", "text", "n_chars"],
    "op6_warc": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    "op7_sharding": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op8_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    "op9_exact_dedup": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
    "op10_mixing": ["doc_id", "size", "source_size", "target", "taken"],
    "op11_divergence": ["lang", "source", "part", "item", "value", "rank"],
    "op12_fill_middle": ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"],
    "op13_suffix_dedup": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
}
LONGS = "query_id vec_id score n_shingles n_words n_removed n_chars payload_bytes refers_to size text_crc32 slot start length ids_crc32 doc_tokens sequence_id offset group_size taken source_size value n prefix_chars middle_chars n_bytes n_spans".split()


@pytest.mark.parametrize("name", list(CONTRACTS))
def test_columns_and_rows(spark, name):
    result = queries.QUERIES[name](spark, SF_DIR)
    types = dict(result.dtypes)
    assert set(CONTRACTS[name]) <= set(types)
    for column in set(CONTRACTS[name]) & set(LONGS):
        assert types[column] == ("double" if (name, column) == ("op2_language", "score") else "bigint")
    table = {"op1": "embeddings", "op5": "pages", "op6": "pages"}.get(name.split("_")[0], "documents")
    key = CONTRACTS[name][0]
    if key == "lang":
        return
    there = {r[0] for r in spark.read.parquet(f"{SF_DIR}/{table}.parquet").select("vec_id" if key == "query_id" else key).collect()}
    found = {r[0] for r in result.select(key).collect()}
    assert found == ({i for i in there if i % 100 == 0} if key == "query_id" else there)


def test_all_are_registered():
    assert {*CONTRACTS, "pipeline"} == set(queries.QUERIES)


def test_near_dedup_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    got = sorted(map(tuple, queries.QUERIES["op3_near_dedup"](spark, SF_DIR).collect()), key=repr)
    assert got == test_near_dedup.expected(rows, 3, 85)


def test_language_query(spark):
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    rows = [r for r in queries.QUERIES["op2_language"](spark, SF_DIR).collect() if r["held_out"]]
    assert sum(r["lang_pred"] == langs[r["doc_id"]] for r in rows) >= 0.95 * len(rows)
