import base64
import gzip
import hashlib
from pathlib import Path

from tablecheck.llm import common, warc

SCHEMA = "page_id long, url string, html string, size string, sha string, response_id string, type string"


def expected(rows, least=0):
    out = []
    for i, _, text in rows:
        payload = (text or "").encode()
        same = [j for j, _, t in rows if (t or "").encode() == payload and j is not None]
        last = max(same, default=None)
        revisit = last is not None and last != i and len(payload) >= least
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        out.append((i, len(payload), digest, "revisit" if revisit else "response", last if revisit else None))
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], SCHEMA).repartition(3)


def through(spark, rows, least=0):
    path = common.new_path(spark, "warc-test")
    warc.write_archives(frame(spark, rows), path, least_bytes=least)
    return path, warc.captures(warc.read_archives(spark, path)).collect()


ROWS = [
    (1, "http://a/1", "<p>same</p>"), (2, "http://a/2", "<p>same</p>"), (3, None, "<p>same</p>"), (4, "http://a/4", None),
    (5, "http://a/5", ""), (6, "u\r\nWARC-Type: response", "ends with blank lines\r\n\r\n\r\n\r\n"), (7, "", "\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\nxxxxx"),
    (8, "ü", "ünï 漢字 \x00 🙂"), (9, "l", "x" * 300_000), (None, "n", "<p>same</p>"), (None, "n", "only here"), (10, "a", "twice"), (10, "a", "twice"),
]


def test_round_trip(spark):
    _, rows = through(spark, ROWS)
    got = []
    for r in rows:
        answer = r["response"]
        refers = answer["refers_to"] and int(answer["refers_to"].rsplit(":", 1)[1])
        got.append((r["page_id"], r["metadata"]["payload_bytes"], r["metadata"]["payload_digest"], answer["type"], refers))
        if answer["type"] == "response":
            assert (answer["payload_bytes"], answer["payload_digest"]) == (r["metadata"]["payload_bytes"], r["metadata"]["payload_digest"])
    assert sorted(got, key=repr) == expected(ROWS)
    texts = sorted(bytes(r["response"]["payload"]).decode() for r in rows if r["response"]["type"] == "response")
    kept = [(t or "") for (i, _, t) in ROWS if (i, "response") in {(g[0], g[3]) for g in got}]
    assert set(texts) == set(kept) | {"<p>same</p>"}


def test_least_size(spark):
    _, rows = through(spark, ROWS, least=6)
    got = sorted(((r["page_id"], r["metadata"]["payload_bytes"], r["metadata"]["payload_digest"], r["response"]["type"],
                   r["response"]["refers_to"] and int(r["response"]["refers_to"].rsplit(":", 1)[1])) for r in rows), key=repr)
    assert got == expected(ROWS, 6)


def test_files_are_warc(spark):
    path, _ = through(spark, ROWS)
    folder = Path(path.removeprefix("file:"))
    kinds = []
    for file in folder.glob("part-*"):
        data = gzip.decompress(file.read_bytes())
        at = 0
        while at < len(data):
            assert data[at:].startswith(b"WARC/1.1\r\n")
            head = data[at : data.index(b"\r\n\r\n", at)].decode()
            fields = dict(line.split(": ", 1) for line in head.split("\r\n")[1:])
            at += len(head.encode()) + 4 + int(fields["Content-Length"])
            assert data[at : at + 4] == b"\r\n\r\n"
            at += 4
            kinds.append(fields["WARC-Type"])
    assert sorted(set(kinds)) == ["metadata", "request", "response", "revisit"]
    assert kinds.count("request") == kinds.count("metadata") == len(ROWS)


def test_empty_table(spark):
    assert through(spark, [])[1] == []


def test_query(spark):
    rows = warc.op6_warc(spark, "/root/testdata/sf0.001")
    pages = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    assert sorted(map(tuple, rows.collect()), key=repr) == expected(pages)


def test_ids_above_double_precision(spark, tmp_path):
    schema = "page_id long, url string, html string"
    rows = [(i, "u", "<p>same</p>") for i in (2**53 + 1, 2**53 + 3, 2**63 - 1)] + [(None, "u", "<p>other</p>")]
    warc.write_archives(spark.createDataFrame(rows, schema).coalesce(1), str(tmp_path / "a"))
    got = warc.captures(warc.read_archives(spark, str(tmp_path / "a"))).collect()
    assert {r["page_id"] for r in got} == {r[0] for r in rows}
    assert {r["response"]["refers_to"] for r in got} == {None, f"urn:capture:{2**63 - 1}"}
