"""WARC archives with segmented records, written and read back.

Writing: a record per page, HTTP response with chunked transfer framing. A block above
`segment_bytes` is split: the first segment is the response record, the others are
`continuation` records with the origin's identifier and their number, the last with the
total length. Pages of equal payloads of `revisit_bytes` or more have one response, that
of the largest page_id; the others are revisit records without a payload.

Reading: a task parses whole archives. Records in one piece are decoded there; segments
are first counted by (origin, number), so repeated records don't pile up, then gathered by
origin identifier, ordered, checked against the total length and freed of the framing.

Defined cases: a null html is an empty payload; a null url has no target; rows that repeat
a page_id and payload are all responses (there is no larger page_id) and give a row each;
pages whose equal payloads all have a null page_id are responses; a record that can't be
put together has null payload columns and says why in `problem`.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, store

REVISIT_BYTES = 1000
SEGMENT_BYTES = 16 << 10
CHUNK_BYTES = 4 << 10
ARCHIVE_BYTES = 64 << 20
_SPACE = uuid.UUID("6f1c1c1e-52a7-4d0c-9a35-2f5f3c0f7f11")
_DATE = "2024-01-01T00:00:00Z"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, origin string, number int, total long, block binary, problem string"
PARSED = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("block", pa.binary()), ("problem", pa.string())])


def framed(payload: bytes, chunk: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer coding."""
    parts = []
    for i in range(0, len(payload), chunk):
        own = payload[i : i + chunk]
        parts += [b"%x\r\n" % len(own), own, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def unframed(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk has another length than it says")
        out.append(body[at : at + size])
        at += size + 2


def payload_of(block: bytes) -> bytes:
    head, _, body = block.partition(b"\r\n\r\n")
    return unframed(body) if b"\r\ntransfer-encoding: chunked" in head.lower() else body


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}:{digest}')}>"


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"


def records(page_id: int | None, url: str | None, payload: bytes, digest: str, original: int | None, segment_bytes: int):
    """The records of one page; `original` is the page that it revisits."""
    own = record_id(page_id, digest)
    target = " ".join(url.split()) if url else None
    common_fields = [("WARC-Date", _DATE), ("WARC-Target-URI", target), ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()), ("X-Page-Id", page_id)]
    http = ("Content-Type", "application/http; msgtype=response")
    if original is not None:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        fields = [("WARC-Type", "revisit"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), *common_fields, ("WARC-Profile", profile), ("WARC-Refers-To", record_id(original, digest)), ("X-Refers-To-Page", original), ("X-Payload-Bytes", len(payload)), http]
        yield _record(fields, b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n\r\n")
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nTransfer-Encoding: chunked\r\n\r\n" + framed(payload)
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    yield _record([("WARC-Type", "response"), ("WARC-Record-ID", own), *common_fields, ("WARC-Segment-Number", 1 if len(parts) > 1 else None), http], parts[0])
    for i, part in enumerate(parts[1:], 2):
        yield _record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", _DATE), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", i), ("WARC-Segment-Total-Length", len(block) if i == len(parts) else None)], part)


def parse(stream):
    """(fields, block) of each record."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError("not at a record's begin")
        fields: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            k, _, v = line.decode().partition(":")
            fields[k.strip().lower()] = v.strip()
        block = stream.read(int(fields["content-length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record has another length than it says")
        yield fields, block


def decoded(block: bytes, digest: str | None) -> tuple[int | None, str | None, str | None]:
    """Payload length, SHA-1 and what is wrong."""
    try:
        payload = payload_of(block)
    except ValueError as e:
        return None, None, f"framing: {e}"
    found = hashlib.sha1(payload).hexdigest()
    if digest and found != digest:
        return None, None, "the payload has another digest"
    return len(payload), found, None


def _hex(fields: dict[str, str]) -> str | None:
    value = fields.get("warc-payload-digest", "")
    return base64.b32decode(value[5:]).hex() if value.startswith("sha1:") else None


def _int(value: str | None) -> int | None:
    return None if value is None else int(value)


def row_of(fields: dict[str, str], block: bytes) -> tuple:
    kind, digest, number = fields["warc-type"], _hex(fields), _int(fields.get("warc-segment-number"))
    page = _int(fields.get("x-page-id"))
    if kind == "continuation":
        return None, None, None, None, None, fields["warc-segment-origin-id"], number, _int(fields.get("warc-segment-total-length")), block, None
    if kind == "revisit":
        return page, _int(fields.get("x-payload-bytes")), digest, kind, _int(fields.get("x-refers-to-page")), None, None, None, None, None
    if number is not None:
        return page, None, digest, kind, None, fields["warc-record-id"], number, None, block, None
    size, found, wrong = decoded(block, digest)
    return page, size, found, kind, None, None, None, None, None, wrong


def write(pages: DataFrame, folder: str, segment_bytes: int = SEGMENT_BYTES, revisit_bytes: int = REVISIT_BYTES, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Archives of all pages; a row for each, with its address and records."""
    spark = pages.sparkSession
    common.text_batches(spark)
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    long = rows.where(F.octet_length("html") >= revisit_bytes)
    # one row per payload that repeats; a written table, so that the join is chosen by its size
    equal = long.groupBy("digest").agg(F.max("page_id").alias("original"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("equal_digest"), "original")
    equal, _ = common.saved(equal, "payloads")
    joined = rows.join(equal, (F.col("digest") == F.col("equal_digest")) & (F.octet_length("html") >= revisit_bytes), "left")
    original = F.when(~F.col("page_id").eqNullSafe(F.col("original")), F.col("original"))
    joined = joined.select("page_id", "url", "html", "digest", original.alias("original"))

    def run(batches):
        out, size, n, address = None, 0, 0, None
        done = []
        for b in batches:
            for page, target, text, digest, first in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for record in records(page, target, text.encode(), digest, first, segment_bytes):
                    if out is None:
                        (address, out), size, n = store.create(folder, ".warc.gz"), 0, 0
                    data = gzip.compress(record, 1)
                    out.write(data)
                    size, n = size + len(data), n + 1
                    if size >= ARCHIVE_BYTES:
                        out.close()
                        done.append((address, n))
                        out = None
        if out is not None:
            out.close()
            done.append((address, n))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64())], ["path", "n_records"])

    return common.saved(joined.mapInArrow(common.lean(run), "path string, n_records long"), "archives")[0]


def _table(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), PARSED, strict=True)], schema=PARSED)


def read(archives: DataFrame) -> DataFrame:
    """Every record of the archives, segments put together: page_id, payload_bytes,
    payload_digest, record_type, refers_to, problem."""
    files = archives.count()

    def parsed(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                rows, held = [], 0
                with store.opened(path) as raw, gzip.GzipFile(fileobj=io.BufferedReader(raw, 1 << 20)) as stream:
                    for fields, block in parse(stream):
                        rows.append(row_of(fields, block))
                        held += len(rows[-1][8] or b"")
                        if len(rows) >= 1000 or held >= 8 << 20:
                            yield _table(rows)
                            rows, held = [], 0
                if rows:
                    yield _table(rows)

    found, _ = common.saved(archives.select("path").repartition(max(1, files)).mapInArrow(common.lean(parsed), RECORD), "records")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem"]
    whole = found.where("origin IS NULL").select(*columns)
    once = found.where("origin IS NOT NULL").groupBy("origin", "number").agg(*(F.first(c, True).alias(c) for c in ("page_id", "payload_digest", "record_type", "total", "block")), F.count("*").alias("copies"))
    gathered = once.groupBy("origin").agg(F.max("page_id").alias("page_id"), F.max("payload_digest").alias("payload_digest"), F.max("record_type").alias("record_type"), F.max("total").alias("total"), F.max(F.when(F.col("number") == 1, F.col("copies"))).alias("copies"), F.array_sort(F.collect_list(F.struct("number", "block"))).alias("parts"))

    def put_together(batches):
        for b in batches:
            rows = []
            for x in b.to_pylist():
                numbers = [p["number"] for p in x["parts"]]
                block = b"".join(p["block"] for p in x["parts"])
                if numbers != list(range(1, len(numbers) + 1)):
                    size, digest, wrong = None, None, f"segments {numbers}"
                elif x["total"] != len(block):
                    size, digest, wrong = None, None, f"{len(block)} bytes of {x['total']}"
                else:
                    size, digest, wrong = decoded(block, x["payload_digest"])
                rows += [(x["page_id"], size, digest, x["record_type"], None, wrong)] * (x["copies"] or 1)
            kinds = [PARSED.field(c).type for c in columns]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)], columns)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, problem string"
    return whole.unionByName(gathered.mapInArrow(common.lean(put_together), schema))


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
m AS (SELECT d, max(page_id) AS first FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to, NULL::VARCHAR AS problem
FROM p LEFT JOIN m USING (d)
"""
