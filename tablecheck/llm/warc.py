"""WARC archives: written from pages, read back and assembled to captures.

Every page is a transaction of three records: the request, the response or revisit, and a
metadata record with the size and digest of the whole payload. Records of a transaction name
the request through WARC-Concurrent-To. Of pages with equal payloads the one with the largest
id is the response and the others are revisits of it, which carry no payload.

Archives are written by Spark's text writer, whose line separator is the blank lines that end
a WARC record, and read back as whole files, whose size is bounded by the records that a file
may hold. Records are cut by their Content-Length, so payloads may hold
anything. Captures are assembled by joins on the identifier of the request.

Equal payloads are found by their SHA-1 and size, counted in the tasks that read the pages; only
payloads that occur twice are looked up again. Payloads of hot groups are written once.

Defined results: a null html is an empty payload; a null url is an empty target; a null id is
smaller than all others and revisits like them; rows that repeat the largest id of a payload
are all responses. An empty table writes no records. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from tablecheck.llm.common import new_path, table, text_of

LEAST_BYTES = 0
FILE_ROWS = 3 * 4000
DATE = "2026-01-01T00:00:00Z"
END = "\r\n\r\n"

RECORDS = (
    "record_id string, concurrent_to string, type string, target_uri string, refers_to string,"
    " page_id long, headers map<string,string>, payload binary, payload_bytes long, payload_digest string"
)


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(kind: str, record_id: str, fields: list[tuple[str, str]], block: bytes) -> str:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}"]
    lines += [f"{name}: {value}" for name, value in fields if value]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines) + END + block.decode()


def _one_line(url: str | None) -> str:
    return " ".join((url or "").split())


def _written_records(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows page_id, url, html, response_id to the text of three records each."""
    task, number = TaskContext.get().partitionId(), 0
    for batch in batches:
        out, size = [], 0
        for page, url, html, response in zip(batch["page_id"], batch["url"], batch["html"], batch["response_id"]):
            page = page or ""
            name, number = f"urn:capture:{page}:{task}.{number}", number + 1
            target, payload = _one_line(url), (html or "").encode()
            uri = [("WARC-Target-URI", target)]
            asked = f"GET {target or '/'} HTTP/1.1{END}".encode()
            out.append(_record("request", f"{name}:request", [*uri, ("Content-Type", "application/http; msgtype=request")], asked))
            joined = [*uri, ("WARC-Concurrent-To", f"<{name}:request>")]
            digest = _digest(payload)
            answer = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}{END}".encode()
            fields = [*joined, ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}")]
            if response is None:
                out.append(_record("response", f"{name}:response", fields, answer + payload))
            else:
                fields += [
                    ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                    ("WARC-Refers-To", f"<urn:capture:{response}>"),
                ]
                out.append(_record("revisit", f"{name}:revisit", fields, answer))
            about = f"payloadBytes: {len(payload)}\r\npayloadDigest: sha1:{digest}\r\n".encode()
            out.append(_record("metadata", f"{name}:metadata", [*joined, ("Content-Type", "application/warc-fields")], about))
            size += len(payload)
            if size > 8 << 20:
                yield pd.DataFrame({"value": out})
                out, size = [], 0
        if out:
            yield pd.DataFrame({"value": out})


def write_archives(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    least_bytes: int = LEAST_BYTES,
) -> None:
    """Write the transactions of all pages as gzipped WARC files under ``path``."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), text_of(html_col).alias("html"))
    keyed = rows.withColumns({"sha": F.sha1("html"), "size": F.octet_length("html")})
    groups = keyed.groupBy("sha", "size").agg(F.max("page_id").alias("response_id"), F.count("*").alias("copies"))
    shared = groups.where((F.col("copies") > 1) & (F.col("size") >= least_bytes)).drop("copies")
    marked = keyed.join(shared, ["sha", "size"], "left")
    own = F.col("response_id").isNull() | F.col("page_id").eqNullSafe(F.col("response_id"))
    marked = marked.withColumn("response_id", F.when(~own, F.col("response_id")))
    # As text: pandas makes doubles of a long column that holds nulls.
    marked = marked.withColumns({name: F.col(name).cast("string") for name in ("page_id", "response_id")})
    texts = marked.select("page_id", "url", "html", "response_id").mapInPandas(_written_records, "value string")
    writer = texts.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", FILE_ROWS)
    writer.text(path)


def parsed(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive."""
    at = 0
    while (end := data.find(b"\r\n\r\n", at)) >= 0:
        lines = data[at:end].decode().split("\r\n")
        headers = dict(line.split(": ", 1) for line in lines[1:] if ": " in line)
        start = end + 4
        length = int(headers["Content-Length"])
        yield headers, data[start : start + length]
        at = start + length + 4


def _bare(name: str | None) -> str | None:
    return name.strip("<>") if name else None


def _page(name: str | None) -> int | None:
    page = name.split(":")[2] if name else ""
    return int(page) if page else None


def _row(headers: dict[str, str], block: bytes) -> tuple:
    kind, name = headers["WARC-Type"], _bare(headers["WARC-Record-ID"])
    payload, size = None, None
    digest = headers.get("WARC-Payload-Digest", "").removeprefix("sha1:") or None
    if kind == "response":
        payload = block[block.index(b"\r\n\r\n") + 4 :]
        size, digest = len(payload), _digest(payload)
    elif kind == "metadata":
        about = dict(line.split(": ", 1) for line in block.decode().split("\r\n") if line)
        size, digest = int(about["payloadBytes"]), about["payloadDigest"].removeprefix("sha1:")
    return (
        name, _bare(headers.get("WARC-Concurrent-To")), kind, headers.get("WARC-Target-URI"),
        _bare(headers.get("WARC-Refers-To")), _page(name), headers, payload, size, digest,
    )


def _read_records(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.strip().split()[0] for c in RECORDS.replace("map<string,string>", "map").split(",")]
    for batch in batches:
        for content in batch["content"]:
            rows, size = [], 0
            for headers, block in parsed(gzip.decompress(content)):
                rows.append(_row(headers, block))
                size += len(block)
                if size > 8 << 20:
                    yield _records(rows, names)
                    rows, size = [], 0
            if rows:
                yield _records(rows, names)


def _records(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    whole = ("page_id", "payload_bytes")
    columns = {n: [r[i] for r in rows] for i, n in enumerate(names)}
    return pd.DataFrame({n: pd.array(c, dtype="Int64") if n in whole else pd.Series(c, dtype=object) for n, c in columns.items()})


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per WARC record."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInPandas(_read_records, RECORDS)


def captures(records: DataFrame) -> DataFrame:
    """One row per transaction: page_id and the structs request, response, metadata."""
    request = records.where("type = 'request'").select(F.col("record_id").alias("capture"), "page_id", "target_uri", F.col("headers").alias("asked"))
    answer = records.where("type in ('response', 'revisit')").select(
        F.col("concurrent_to").alias("capture"), F.col("record_id").alias("answer_id"), "type", "refers_to",
        "payload", F.col("payload_bytes").alias("found_bytes"), F.col("payload_digest").alias("found_digest"),
    )
    metadata = records.where("type = 'metadata'").select(
        F.col("concurrent_to").alias("capture"), F.col("record_id").alias("metadata_id"), "payload_bytes", "payload_digest"
    )
    rows = request.join(answer, "capture").join(metadata, "capture")
    return rows.select(
        "page_id",
        F.struct(F.col("capture").alias("record_id"), "target_uri", F.col("asked").alias("headers")).alias("request"),
        F.struct(
            F.col("answer_id").alias("record_id"), "type", "refers_to", "payload",
            F.col("found_bytes").alias("payload_bytes"), F.col("found_digest").alias("payload_digest"),
        ).alias("response"),
        F.struct(F.col("metadata_id").alias("record_id"), "payload_bytes", "payload_digest").alias("metadata"),
    )


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to WARC archives, read back and assembled."""
    path = new_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    rows = captures(read_archives(spark, path))
    revisited = F.regexp_extract("response.refers_to", r"^urn:capture:(\d+)$", 1).try_cast("long")
    return rows.select(
        "page_id",
        F.coalesce("response.payload_bytes", "metadata.payload_bytes").alias("payload_bytes"),
        F.coalesce("response.payload_digest", "metadata.payload_digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        F.when(F.col("response.type") == "revisit", revisited).alias("refers_to"),
    )
