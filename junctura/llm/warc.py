"""WARC archives: writing with revisits, segments and chunked framing, and reading back.

Writing. Of records with equal payloads of at least ``least`` bytes, that with the smallest id is the response; the others
become revisits that refer to it. Payloads are put in HTTP messages with chunked transfer framing; messages longer than
``segment`` bytes are cut, the rest following in continuation records. A record is a row, so Spark writes the archives as gzip files
whose rows end in the blank lines that end a record.

Reading. Files are read whole, one at a time in a task, and cut into records by their lengths (archives are bounded by
``per_file`` records). Whole records are decoded at once. Segments are grouped by the identifier of their origin, ordered by segment
number, joined, checked against the total length that the last one states, and decoded; a group holds the segments of one message.

Defined cases: a null payload is empty; a null id is written as none, is never a revisit and comes back null; rows of one id and payload
are all responses where that id is the smallest; a null url is left out; control characters in urls are percent-encoded; other
columns are ignored; an empty table gives no records; a message that lacks segments, has another length or digest, or bad
framing comes back with ``complete`` false and no payload.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, lean, shared_dir, ship, table

SEGMENT, CHUNK, LEAST, PER_FILE = 16_384, 4_096, 100, 20_000
_DATE = "2024-01-01T00:00:00Z"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
_FIELDS = "record_id string, record_type string, url string, refers_to string, digest string, origin string, segment int, total long"


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = [b"%x\r\n%s\r\n" % (len(c), c) for c in (payload[i : i + size] for i in range(0, len(payload), size))]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes | None:
    """The payload in chunked framing, or None where the framing is broken."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9A-Fa-f]{1,15}", size):
            return None
        n, at = int(size, 16), end + 2
        if n == 0:
            return b"".join(out)
        if body[at + n : at + n + 2] != b"\r\n":
            return None
        out.append(body[at : at + n])
        at += n + 2


def payload_of(message: bytes) -> bytes | None:
    """The payload of an HTTP message."""
    head, mark, body = message.partition(b"\r\n\r\n")
    if not mark:
        return None
    return dechunked(body) if re.search(rb"(?im)^transfer-encoding:.*\bchunked\s*$", head) else body


def _header(fields: list[tuple[str, object]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + "\r\n").encode("utf-8", "surrogatepass")


def records_of(page_id: int | None, url: str | None, payload: bytes, digest: str, origin: int | None, segment: int = SEGMENT) -> list[bytes]:
    """The records of one page, without the blank lines that end each."""
    name = f"<urn:page:{'none' if page_id is None else page_id}>"
    uri = None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    common: list[tuple[str, object]] = [("WARC-Date", _DATE), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha256:{digest}")]
    kind = ("Content-Type", "application/http; msgtype=response")
    if origin is not None:
        profile = ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        refers = ("WARC-Refers-To", f"<urn:page:{origin}>")
        return [_header([("WARC-Type", "revisit"), ("WARC-Record-ID", name), *common, profile, refers, kind, ("Content-Length", len(_HTTP))]) + _HTTP]
    block = _HTTP + chunked(payload)
    if len(block) <= segment:
        return [_header([("WARC-Type", "response"), ("WARC-Record-ID", name), *common, kind, ("Content-Length", len(block))]) + block]
    # Identifiers of segmented records tell equal rows apart, as segments are grouped by them.
    name = f"<urn:page:{'none' if page_id is None else page_id}:{uuid.uuid4().hex}>"
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    out = [_header([("WARC-Type", "response"), ("WARC-Record-ID", name), *common, ("WARC-Segment-Number", 1), kind, ("Content-Length", len(parts[0]))]) + parts[0]]
    for n, part in enumerate(parts[1:], 2):
        total = ("WARC-Segment-Total-Length", len(block) if n == len(parts) else None)
        fields = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), *common[:2], ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", n), total, ("Content-Length", len(part))]
        out.append(_header(fields) + part)
    return out


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST, segment: int = SEGMENT, per_file: int = PER_FILE) -> None:
    """Writes a record for each row of ``pages`` to archives in the folder ``path``."""
    ship(pages.sparkSession)
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"").cast("binary"))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    known = durable(rows.where("page_id is not null").where(F.octet_length("payload") >= least).select("page_id", F.sha2("payload", 256).alias("digest")))
    first = durable(known.groupBy("digest").agg(F.min("page_id").alias("origin"), F.count("*").alias("n"))).where("n > 1").select("digest", "origin")
    revisits = known.join(first, "digest").where("page_id <> origin").select("page_id", "digest", "origin").distinct()
    dealt = rows.withColumn("digest", F.sha2("payload", 256)).join(durable(revisits), ["page_id", "digest"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = [b.column(b.schema.get_field_index(c)) for c in ("page_id", "url", "payload", "digest", "origin")]
            made: list[bytes] = []
            size = 0
            for i in range(b.num_rows):
                new = records_of(*(c[i].as_py() for c in columns), segment=segment)
                made += new
                size += sum(map(len, new))
                if size > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["value"])
                    made, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["value"])

    lines = dealt.mapInArrow(lean(run), "value binary").select(F.col("value").cast("string"))
    lines.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", per_file).text(path)


def parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record of one archive, plain or gzip of one or many members."""

    def pieces() -> Iterator[bytes]:
        if content[:2] != b"\x1f\x8b":
            yield content
            return
        rest = content
        while rest:
            inflate = zlib.decompressobj(31)
            while not inflate.eof:
                piece = inflate.decompress(rest, 1 << 20)
                rest = inflate.unconsumed_tail
                if not piece and not rest:
                    break
                yield piece
            rest = inflate.unused_data

    buffer, at, source = b"", 0, pieces()

    def need(n: int) -> bool:
        nonlocal buffer, at
        if len(buffer) - at >= n:
            return True
        parts, have = [buffer[at:]], len(buffer) - at
        while have < n and (piece := next(source, None)) is not None:
            parts.append(piece)
            have += len(piece)
        buffer, at = b"".join(parts), 0
        return have >= n

    while True:
        while need(1) and buffer[at : at + 1] in b"\r\n":
            at += 1
        if not need(1):
            return
        size = 512
        while (end := buffer.find(b"\r\n\r\n", at)) < 0:
            if not need(size) and buffer.find(b"\r\n\r\n", at) < 0:
                return
            size *= 2
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in buffer[at:end].decode("utf-8", "replace").split("\r\n")[1:])}
        at = end + 4
        n = int(fields.get("content-length", "0"))
        whole = need(n)
        yield fields, buffer[at : at + n] if whole else b""
        at += n


def _fields(f: dict[str, str]) -> tuple:
    number = f.get("warc-segment-number")
    total = f.get("warc-segment-total-length")
    name = f.get("warc-record-id")
    origin = f.get("warc-segment-origin-id") or (name if number else None)
    return name, f.get("warc-type"), f.get("warc-target-uri"), f.get("warc-refers-to"), f.get("warc-payload-digest", "").removeprefix("sha256:") or None, origin, int(number) if number else None, int(total) if total else None


def _result(message: bytes | None, stated: str | None, with_payload: bool) -> tuple:
    payload = payload_of(message) if message is not None else None
    digest = hashlib.sha256(payload).hexdigest() if payload is not None else None
    good = payload is not None and stated in (None, digest)
    return good, len(payload) if good else None, digest if good else None, payload if good and with_payload else None


_RESULT = "record_id string, record_type string, url string, refers_to string, complete boolean, payload_bytes long, payload_digest string"


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)


def read(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row for each response and revisit in the archives of ``path``: record_id, record_type, url, refers_to, complete,
    payload_bytes, payload_digest and, if asked for, payload. A revisit has the digest that it states, and no payload of its own."""
    ship(spark)
    files = spark.read.format("binaryFile").load(path).select("content")
    schema = _RESULT + ", payload binary" * with_payload
    names = [c.split()[0] for c in schema.split(", ")]
    types = [pa.string()] * 4 + [pa.bool_(), pa.int64(), pa.string()] + [pa.binary()] * with_payload
    cut = lambda row: row[: len(names)]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                rows, size = [], 0
                for fields, block in parse(b.column(0)[i].as_py()):
                    name, kind, url, refers, stated, origin, *_ = _fields(fields)
                    if origin is not None or kind not in ("response", "revisit"):
                        continue
                    got = (True, None, stated, None) if kind == "revisit" else _result(block, stated, with_payload)
                    rows.append(cut((name, kind, url, refers, *got)))
                    size += len(block) if with_payload else 200
                    if size > 4_000_000:
                        yield _batch(rows, names, types)
                        rows, size = [], 0
                yield _batch(rows, names, types)

    parts = [*(f.split()[0] for f in _FIELDS.split(", ")), "block"]
    part_types = [pa.string()] * 6 + [pa.int32(), pa.int64(), pa.binary()]

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                rows, size = [], 0
                for fields, block in parse(b.column(0)[i].as_py()):
                    own = _fields(fields)
                    if own[5] is not None:
                        rows.append((*own, block))
                        size += len(block)
                    if size > 4_000_000:
                        yield _batch(rows, parts, part_types)
                        rows, size = [], 0
                yield _batch(rows, parts, part_types)

    def reassemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                found = b.column(0)[i].as_py()
                numbers, total = [s["segment"] for s in found], found[-1]["total"]
                message = b"".join(s["block"] for s in found)
                head = found[0]
                good = numbers == list(range(1, len(found) + 1)) and total == len(message)
                yield _batch([cut((head["record_id"], head["record_type"], head["url"], head["refers_to"], *_result(message if good else None, head["digest"], with_payload)))], names, types)

    pieces = files.mapInArrow(lean(segments), _FIELDS + ", block binary")
    one = F.struct("segment", "record_id", "record_type", "url", "refers_to", "digest", "total", "block")
    joined = pieces.groupBy("origin").agg(F.sort_array(F.collect_list(one)).alias("parts")).select("parts").mapInArrow(lean(reassemble), schema)
    return files.mapInArrow(lean(whole), schema).union(joined)


def op10_warc(spark, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "pages"), path)
    number = lambda c: F.regexp_extract(c, r"^<urn:page:([0-9-]+)", 1).try_cast("long")
    rows = read(spark, path, with_payload=False).select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))
    rows = durable(rows)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)  # all that was asked for has been read
    originals = rows.where("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("n"))
    revisits = rows.where("record_type = 'revisit'").join(durable(originals), ["refers_to", "payload_digest"], "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    revisits = revisits.drop("payload_bytes").withColumnRenamed("n", "payload_bytes")
    return rows.where("record_type = 'response'").select(*columns).union(revisits.select(*columns))


SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
o AS (SELECT payload_digest, min(page_id) AS origin FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN page_id <> origin THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> origin THEN origin END AS refers_to FROM p LEFT JOIN o ON p.payload_digest = o.payload_digest
"""
