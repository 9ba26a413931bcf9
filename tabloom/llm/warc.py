"""WARC archives: records with segments and chunked framing, written by tasks and put together again by Spark.

A response whose block is longer than ``SEGMENT`` bytes is written as a first segment and continuation records. They
carry ``WARC-Segment-Number`` and ``WARC-Segment-Origin-ID``, and the last one ``WARC-Segment-Total-Length``. Every
record is a gzip member of its own, as the format asks for.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import files, shared_folder, stored

SEGMENT = 32 << 10
CHUNK = 8 << 10
#: Date of written records; the tables have no fetch time.
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ = 1 << 20


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """A payload in chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(c := payload[i:i + size]), c) for i in range(0, len(payload), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The payload of chunked transfer framing; extensions and trailers are passed over, broken framing raises."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk size line is missing")
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if body[at + size:at + size + 2] != b"\r\n":
            raise ValueError("chunk is shorter than its size")
        out.append(body[at:at + size])
        at += size + 2


def http_payload(block: bytes) -> bytes:
    """The payload of an HTTP response block."""
    head, _, body = block.partition(b"\r\n\r\n")
    return dechunked(body) if re.search(rb"(?im)^transfer-encoding:\s*chunked\s*$", head) else body


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One gzip member with a WARC record."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return gzip.compress(head.encode() + b"\r\n" + block + b"\r\n\r\n", 4, mtime=0)


def _one_line(value: str | None) -> str:
    return re.sub(r"\s+", "%20", value or "urn:none")


def page_records(key: str, url: str | None, payload: bytes, refers_to: int | None, segment: int) -> Iterator[bytes]:
    """The records of a page: a response, in segments if it is long, or a revisit of the record ``refers_to``."""
    common = [("WARC-Record-ID", f"<urn:page:{key}>"), ("WARC-Target-URI", _one_line(url)), ("WARC-Date", DATE),
              ("WARC-Payload-Digest", f"sha1:{sha1_base32(payload)}")]
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    if refers_to is not None:
        yield record([("WARC-Type", "revisit"), *common, ("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>"),
                      ("Content-Type", "application/http; msgtype=response")], head)
        return
    block = head + chunked(payload)
    parts = [block[i:i + segment] for i in range(0, len(block), segment)]
    http = ("Content-Type", "application/http; msgtype=response")
    yield record([("WARC-Type", "response"), *common, http, *([("WARC-Segment-Number", "1")] if len(parts) > 1 else [])], parts[0])
    for n, part in enumerate(parts[1:], 2):
        last = [("WARC-Segment-Total-Length", str(len(block)))] if n == len(parts) else []
        yield record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:page:{key}:{n}>"), ("WARC-Date", DATE), ("WARC-Segment-Number", str(n)),
                      ("WARC-Segment-Origin-ID", f"<urn:page:{key}>"), *last], part)


def read_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """``(fields, block)`` of each record of a gzip WARC stream, holding one record at a time."""
    inflate, raw, at_end = zlib.decompressobj(31), bytearray(), False
    while not at_end:
        data = stream.read(READ)
        at_end = not data
        while data:
            raw += inflate.decompress(data)
            data = inflate.unused_data if inflate.eof else b""
            if inflate.eof:
                inflate = zlib.decompressobj(31)
                yield _parsed(bytes(raw))
                raw.clear()
    if raw:
        raise ValueError("the archive ends within a record")


def _parsed(member: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = member.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = int(fields["content-length"])
    if not lines[0].startswith("WARC/") or rest[n:] != b"\r\n\r\n":
        raise ValueError("not a WARC record")
    return fields, rest[:n]


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   segment: int = SEGMENT, min_revisit_bytes: int = 0) -> DataFrame:
    """Write a record per row and return the stored list of archives ``(path, records)``.

    Of rows with equal payloads of at least ``min_revisit_bytes`` bytes, those with the smallest id are responses (one
    row, unless an id is repeated) and the others revisit it; a null id counts as larger than any. Null html is an
    empty payload. Record ids hold the page id and an ordinal, so repeated rows get records of their own. A repeated
    task writes a new file, and the list names the file of the attempt that was committed.
    """
    folder = shared_folder(pages.sparkSession, "warc")
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("html"), F.sha1(payload).alias("digest"))
    large = F.octet_length("html") >= min_revisit_bytes
    first = rows.where(large).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    rows = rows.join(first.select(F.col("digest").alias("d"), "first"), F.col("digest") == F.col("d"), "left")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        context, sink, path, n = TaskContext.get(), None, None, 0
        for b in batches:
            for page, url, html, refers in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to"))):
                if sink is None:
                    system, root = files(folder)
                    system.create_dir(root, recursive=True)
                    path = f"{folder}/part-{context.partitionId():08d}-{context.taskAttemptId()}.warc.gz"
                    sink = system.open_output_stream(files(path)[1], compression=None)
                for r in page_records(f"{'' if page is None else page}:{context.partitionId()}.{n}", url, html, refers, segment):
                    sink.write(r)
                n += 1
        if sink:
            sink.close()
            yield pa.record_batch([pa.array([path]), pa.array([n], pa.int64())], names=["path", "records"])

    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return stored(rows.select("page_id", "url", "html", refers.alias("refers_to")).mapInArrow(run, "path string, records long"), "warc-list")


def _page_of(record_id: str) -> int | None:
    """The page id in a record id or reference."""
    text = record_id.strip("<>").split(":")[2]
    return int(text) if text else None


def _measured(fields: dict[str, str], block: bytes) -> tuple[int, str]:
    """Length and digest of a response's payload; the declared digest must agree."""
    payload = http_payload(block)
    digest = sha1_base32(payload)
    if fields.get("warc-payload-digest", "sha1:" + digest) != "sha1:" + digest:
        raise ValueError(f"payload digest of {fields['warc-record-id']} differs")
    return len(payload), digest


RECORD = "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, origin string, segment int, total long, block binary"


def read_archives(archives: DataFrame) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to)`` of every record of the listed archives.

    Whole responses are decoded where they are read. Segments are grouped by the identifier of their origin, ordered
    by number and joined; numbers must run from 1 without a gap and the lengths must add up to the declared total,
    else the job fails. Revisits take the length of the response with their digest.
    """
    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = [c.split()[0] for c in RECORD.split(", ")]
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.binary()]
        for b in batches:
            for path in b.column("path").to_pylist():
                system, at = files(path)
                out, held = [], 0
                for fields, block in read_records(system.open_input_stream(at, compression=None)):
                    kind, n = fields["warc-type"], fields.get("warc-segment-number")
                    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    origin, total = fields.get("warc-segment-origin-id", fields["warc-record-id"]), fields.get("warc-segment-total-length")
                    if kind == "revisit":
                        out.append((_page_of(fields["warc-record-id"]), kind, _page_of(fields["warc-refers-to"]), None, digest, None, None, None, None))
                    elif n is None:
                        size, digest = _measured(fields, block)
                        out.append((_page_of(fields["warc-record-id"]), kind, None, size, digest, None, None, None, None))
                    else:
                        out.append((_page_of(origin), "response", None, None, digest, origin, int(n), total and int(total), block))
                        held += len(block)
                    if len(out) >= 2000 or held > 8 << 20:
                        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
                        out, held = [], 0
                if out:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    def join_segments(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for origin, page, total, digest, parts in zip(*(b.column(c).to_pylist() for c in ("origin", "page_id", "total", "digest", "parts"))):
                block = b"".join(p["block"] for p in parts)
                if [p["segment"] for p in parts] != list(range(1, len(parts) + 1)) or len(block) != total:
                    raise ValueError(f"segments of {origin} are not complete")
                size, digest = _measured({"warc-record-id": origin, "warc-payload-digest": f"sha1:{digest}"}, block)
                yield pa.record_batch([pa.array([page], pa.int64()), pa.array([size], pa.int64()), pa.array([digest])], names=["page_id", "payload_bytes", "payload_digest"])

    spread = archives.repartition(max(1, archives.count()))
    records = stored(spread.mapInArrow(scan, RECORD), "warc-records")
    parts = records.where("origin is not null").groupBy("origin").agg(
        F.max("page_id").alias("page_id"), F.max("total").alias("total"), F.max("payload_digest").alias("digest"),
        F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("parts"))
    joined = parts.mapInArrow(join_segments, "page_id long, payload_bytes long, payload_digest string")
    whole = records.where("origin is null and record_type <> 'revisit'").select("page_id", "payload_bytes", "payload_digest")
    responses = stored(whole.unionAll(joined), "warc-responses")
    sizes = responses.groupBy(F.col("payload_digest").alias("digest")).agg(F.max("payload_bytes").alias("payload_bytes"))
    revisits = records.where("record_type = 'revisit'").select("page_id", "payload_digest", "refers_to")
    revisits = revisits.join(sizes, F.col("payload_digest") == F.col("digest"))
    return responses.select("page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to")).unionAll(
        revisits.select("page_id", "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), "refers_to"))
