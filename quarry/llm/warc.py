"""WARC archives: writing page captures, and assembling transactions.

A capture is a transaction of three records: a request, a response (or a
revisit of an earlier, equal payload) and metadata. Request and metadata name
the response in ``WARC-Concurrent-To``. :func:`write_archives` writes them as
gzip members of ``.warc.gz`` files in the shared folder, :func:`read_records`
reads any such files as streams, and :func:`assemble` joins the records through
their identifiers into one nested row per capture.

A payload that occurs more than once is stored once, in the response of the
capture with the largest page id; the others are revisit records that refer to
it by ``WARC-Refers-To`` and carry its digest.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_of_bytes, file_system, shared_path, small_batches, staged

VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILE_BYTES = 256 << 20
CHUNK = 1 << 20
#: Stands for a null page id while records are planned; sorts below all others.
NO_PAGE = -(1 << 63)


def record_id(kind: str, page: int, nth: int, digest: str) -> str:
    """A record's identifier; the same for the same page, occurrence and payload, so that a task that runs again repeats it."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{kind}|{page}|{nth}|{digest}'.encode()).digest())}>"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def render(kind: str, rid: str, headers: dict[str, str], body: bytes) -> bytes:
    """One record as a gzip member."""
    head = [VERSION, f"WARC-Type: {kind}", f"WARC-Record-ID: {rid}"]
    head += [f"{k}: {_one_line(v)}" for k, v in headers.items() if v is not None]
    head.append(f"Content-Length: {len(body)}")
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + z.flush()


def _one_line(v: str) -> str:
    return v.replace("\r", "%0D").replace("\n", "%0A")


def plan(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """``(page_id, digest, best)`` per page and payload: the payload's digest
    and the page whose response holds it (null if the payload is too short to be
    revisited). Narrow: payloads aren't shuffled."""
    body = F.coalesce(F.col(f"`{html_col}`"), F.lit(""))
    rows = pages.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_PAGE)).alias("page_id"), F.sha1(body.cast("binary")).alias("digest"),
                        F.octet_length(body).cast("long").alias("bytes"))
    counted = staged(rows.distinct(), "warc-plan")
    best = staged(counted.groupBy("digest").agg(F.max("page_id").alias("best")), "warc-best")
    j = counted.join(best, "digest")
    return j.select("page_id", "digest", F.when(F.col("bytes") >= min_bytes, F.col("best")).alias("best"))


def write_archives(pages: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write ``pages`` to archives below ``path`` (by default in the shared
    checkpoint folder) and return the files, ``(file, records, bytes)``.

    A null html is an empty payload, a null url leaves out the target, a null
    page id sorts below all others and is left out of the metadata. Repeated
    rows are captures of their own; of equal rows of the largest page id the
    first is the response. A file that an interrupted attempt has left isn't in
    the result."""
    spark = pages.sparkSession
    path = path or shared_path(spark, "warc")
    fs, inner = file_system(path)
    fs.create_dir(inner, recursive=True)
    small_batches(spark)
    where = staged(plan(pages, id_col, html_col, min_bytes), "warc-where")
    body = F.coalesce(F.col(f"`{html_col}`"), F.lit(""))
    rows = pages.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_PAGE)).alias("page_id"), F.col(f"`{url_col}`").alias("url"), body.alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    # dealt and joined by page and payload: equal rows meet in one task, which numbers them
    rows = rows.repartition("page_id", "digest").join(where.select("page_id", "digest", "best"), ["page_id", "digest"])
    rows = rows.select("page_id", "url", "html", "digest", "best").sortWithinPartitions("page_id", "digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = name = None
        size = records = 0
        last, nth = None, 0
        done = []
        for whole in batches:
            for b in batches_of_bytes(whole, "html"):
                cols = [b.column(c).to_pylist() for c in ("page_id", "url", "digest", "best")]
                payloads = b.column("html").cast(pa.binary()).to_pylist()
                for page, url, hexa, best, payload in zip(*cols, payloads, strict=True):
                    nth = nth + 1 if last == (page, hexa) else 0
                    last = (page, hexa)
                    if out is None:
                        fs, inner = file_system(path)
                        name = f"pages-{uuid.uuid4().hex}.warc.gz"
                        out, size, records = fs.open_output_stream(f"{inner}/{name}"), 0, 0
                    digest = base64.b32encode(bytes.fromhex(hexa)).decode()
                    for piece in _capture(page, nth, url, digest, best, payload, date):
                        out.write(piece)
                        size, records = size + len(piece), records + 1
                    if size >= FILE_BYTES:
                        out.close()
                        done.append((f"{path}/{name}", records, size))
                        out = None
        if out is not None:
            out.close()
            done.append((f"{path}/{name}", records, size))
        if done:
            f, r, s = zip(*done, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(f), pa.array(r, pa.int64()), pa.array(s, pa.int64())], names=["file", "records", "bytes"])

    return staged(rows.mapInArrow(run, "file string, records bigint, bytes bigint"), "warc-files")


def _capture(page: int, nth: int, url: str | None, digest: str, best: int | None, payload: bytes, date: str) -> Iterator[bytes]:
    rid = record_id("response", page, nth, digest)
    page_known = page != NO_PAGE
    common = {"WARC-Target-URI": url, "WARC-Date": date}
    revisit = best is not None and (page != best or nth > 0)
    path = "/" + (url or "").partition("://")[2].partition("/")[2]
    request = f"GET {_one_line(path)} HTTP/1.1\r\nHost: {_one_line((url or '').partition('://')[2].partition('/')[0])}\r\n\r\n".encode()
    yield render("request", record_id("request", page, nth, digest),
                 common | {"WARC-Concurrent-To": rid, "Content-Type": "application/http;msgtype=request"}, request)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    about = {"WARC-Payload-Digest": f"sha1:{digest}", "Content-Type": "application/http;msgtype=response"}
    if revisit:
        yield render("revisit", rid, common | about | {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": record_id("response", best, 0, digest)}, http)
    else:
        yield render("response", rid, common | about, http + payload)
    fields = (f"page_id: {page}\r\n" if page_known else "") + f"payload_bytes: {len(payload)}\r\n"
    yield render("metadata", record_id("metadata", page, nth, digest),
                 common | {"WARC-Concurrent-To": rid, "Content-Type": "application/warc-fields"}, fields.encode())


def parse_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and body of each record of a stream of gzip
    members, or of plain records; one record is held at a time. Damage raises ``ValueError``."""
    buf = bytearray()
    first = stream.read(CHUNK)
    zipped = first[:2] == b"\x1f\x8b"
    state = {"z": zlib.decompressobj(31), "raw": first, "end": not first}

    def more() -> bool:
        while not state["end"]:
            raw = state["raw"] or stream.read(CHUNK)
            state["raw"] = b""
            if not raw:
                state["end"] = True
                break
            if not zipped:
                buf.extend(raw)
                return True
            if state["z"].eof:
                state["z"] = zlib.decompressobj(31)
            out = state["z"].decompress(raw)
            state["raw"] = state["z"].unused_data
            buf.extend(out)
            if out:
                return True
        return False

    while True:
        while (at := buf.find(b"\r\n\r\n")) < 0 and more():
            pass
        if at < 0:
            if buf.strip():
                raise ValueError("archive ends inside a record")
            return
        lines = bytes(buf[:at]).decode("utf-8").lstrip("\r\n").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        need = at + 4 + int(headers["content-length"]) + 4
        while len(buf) < need and more():
            pass
        if len(buf) < need:
            raise ValueError("archive ends inside a record")
        body = bytes(buf[at + 4:need - 4])
        del buf[:need]
        yield headers, body


_RECORD = ("file string, record_id string, type string, concurrent_to string, refers_to string, target_uri string, date string, "
           "payload_digest string, page_id bigint, payload_bytes bigint, read_digest string, payload binary")


def read_records(spark: SparkSession, files: DataFrame, with_payload: bool = True) -> DataFrame:
    """One row per record of the files in ``files.file``, a file per task at a
    time. ``payload`` is the body after the HTTP head (null if not wanted),
    ``payload_bytes`` and ``read_digest`` are taken from the bytes read."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split(" ")[0] for x in _RECORD.split(", ")]
        kinds = [pa.string()] * 8 + [pa.int64(), pa.int64(), pa.string(), pa.binary()]

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for b in batches:
            for name in b.column(0).to_pylist():
                fs, inner = file_system(name)
                rows, held = [], 0
                with fs.open_input_stream(inner) as s:
                    for h, body in parse_records(s):
                        page, data = None, body
                        if h.get("content-type", "").startswith("application/http"):
                            data = body.partition(b"\r\n\r\n")[2]
                        elif h["warc-type"] == "metadata":
                            fields = dict(x.split(": ", 1) for x in body.decode().split("\r\n") if ": " in x)
                            page = int(fields["page_id"]) if "page_id" in fields else None
                        digest = h.get("warc-payload-digest")
                        rows.append((name, h["warc-record-id"], h["warc-type"], h.get("warc-concurrent-to"), h.get("warc-refers-to"),
                                     h.get("warc-target-uri"), h.get("warc-date"), digest and digest.partition(":")[2], page, len(data),
                                     digest_of(data) if h["warc-type"] == "response" else None, data if with_payload else None))
                        held += len(body) if with_payload else 200
                        if held >= 8 << 20:
                            yield out(rows)
                            rows, held = [], 0
                if rows:
                    yield out(rows)

    n = max(1, files.count())
    return files.select("file").repartition(n).mapInArrow(run, _RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``(capture_id, response, request,
    metadata)``, by joining requests and metadata to the response or revisit
    record that their ``concurrent_to`` names, directly or through a record
    that names it (a metadata record may point at the request). A capture
    without a request or metadata has null there; of several the one with the
    smallest record id is taken. Records that lead to no response make no row.
    Repeated records (one archive read twice) count once."""
    cols = [F.col(c) for c in records.columns]
    rec = records.dropDuplicates(["record_id"])
    heads = rec.where("type IN ('response', 'revisit')").select(F.col("record_id").alias("capture_id"), F.struct(*cols).alias("response"))
    rest = rec.where("type IN ('request', 'metadata') AND concurrent_to IS NOT NULL")
    # one hop: what a request or metadata record points at may point on
    via = rest.select(F.col("record_id").alias("_via"), F.col("concurrent_to").alias("_on"))
    rest = rest.join(via, F.col("concurrent_to") == F.col("_via"), "left").withColumn("_to", F.coalesce("_on", "concurrent_to"))

    def side(kind: str) -> DataFrame:
        one = rest.where(F.col("type") == kind).groupBy("_to").agg(F.min_by(F.struct(*cols), "record_id").alias(kind))
        return one.withColumnRenamed("_to", f"_{kind}_to")

    req, meta = side("request"), side("metadata")
    return (heads.join(req, F.col("capture_id") == F.col("_request_to"), "left")
            .join(meta, F.col("capture_id") == F.col("_metadata_to"), "left")
            .select("capture_id", "response", "request", "metadata"))


def resolve(captures: DataFrame) -> DataFrame:
    """Captures with the payload's size and digest, for revisits those of the
    response they refer to, and that response's page:
    ``(page_id, payload_bytes, payload_digest, record_type, refers_to)``."""
    flat = staged(captures.select(
        "capture_id", F.col("metadata.page_id").alias("page_id"), F.col("response.type").alias("record_type"),
        F.col("response.refers_to").alias("_ref"), F.col("response.payload_bytes").alias("_bytes"),
        F.coalesce("response.read_digest", "response.payload_digest").alias("_digest")), "warc-captures")
    held = flat.where("record_type = 'response'").select(F.col("capture_id").alias("_id"), F.col("page_id").alias("_page"),
                                                         F.col("_bytes").alias("_b"), F.col("_digest").alias("_d"))
    out = flat.join(held, F.col("_ref") == F.col("_id"), "left")
    revisit = F.col("record_type") == "revisit"
    return out.select("page_id", F.when(revisit, F.col("_b")).otherwise(F.col("_bytes")).alias("payload_bytes"),
                      F.when(revisit, F.coalesce("_d", "_digest")).otherwise(F.col("_digest")).alias("payload_digest"),
                      "record_type", F.when(revisit, F.col("_page")).alias("refers_to"))


def round_trip(pages: DataFrame, min_bytes: int = 0, **columns: str) -> DataFrame:
    """Write ``pages`` to archives, read them back, assemble and resolve."""
    files = write_archives(pages, min_bytes=min_bytes, **columns)
    records = staged(read_records(pages.sparkSession, files, with_payload=False), "warc-records")
    return resolve(assemble(records))


#: DuckDB SQL for :func:`round_trip` over a relation ``pages`` of unique rows.
ROUND_TRIP_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hexa FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS best FROM p)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         ((((('0x' || substr(hexa, ((i // 4) * 5 + 1)::INT, 5))::INT) >> (15 - 5 * (i % 4))::INT) & 31) + 1)::INT, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> best THEN best END AS refers_to
FROM m
"""
