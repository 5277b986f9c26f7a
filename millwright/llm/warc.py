"""WARC archives: write, normalise a monolithic gzip stream to one member per record with an offset index, read back.

Files go to a folder that all executors share, through whatever file system its URI names. A task writes under a name of its own
attempt and reports it in its result row, so a repeated or lost attempt leaves at most a file that nothing lists.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwright.llm.common import new_path, written

_CHUNK = 1 << 20
#: Raw bytes after which a writer starts another archive.
ARCHIVE_BYTES = 256 << 20
#: Payload bytes that the reader holds before it passes records on.
HELD_BYTES = 8 << 20
_END = b"\r\n\r\n"


def _open(path: str):
    system, inner = pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:/") else f"file://{path}")
    return system, inner


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record: a response's block is an HTTP message, a revisit's only that message's head; both state the payload's digest and length."""
    revisit = refers_to is not None
    body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}".encode() + _END + (b"" if revisit else payload)
    ident = lambda page: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{digest}:{page}')}>"
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {ident(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}",
    ]
    if url:
        lines.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url))
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if revisit:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {ident(refers_to)}",
            "WARC-Refers-To-Date: 1970-01-01T00:00:00Z", f"X-Refers-To-Page-ID: {refers_to}",
        ]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + _END + body + _END


def headers(head: bytes) -> dict[str, str]:
    pairs = (line.split(":", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:] if ":" in line)
    return {k.strip().lower(): v.strip() for k, v in pairs}


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write ``pages`` (page_id, url, html, refers_to) as gzip archives of a single member each; rows (archive, records)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, sink, gz, raw, count, path = [], None, None, 0, 0, ""
        for batch in batches:
            for page_id, url, html, refers_to in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if sink is None:
                    path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                    system, inner = _open(path)
                    system.create_dir(inner.rsplit("/", 1)[0])
                    sink, gz, raw, count = system.open_output_stream(inner, compression=None), zlib.compressobj(1, zlib.DEFLATED, 31), 0, 0
                payload = html or b""
                data = record(page_id, url, payload, payload_digest(payload), refers_to)
                sink.write(gz.compress(data))
                raw, count = raw + len(data), count + 1
                if raw >= ARCHIVE_BYTES:
                    sink.write(gz.flush())
                    sink.close()
                    done.append((path, count))
                    sink = None
        if sink is not None:
            sink.write(gz.flush())
            sink.close()
            done.append((path, count))
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], names=["archive", "records"])

    columns = [F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string").cast("binary"), F.col("refers_to").cast("long")]
    return pages.select(*columns).mapInArrow(run, "archive string, records long")


def _inflated(stream) -> Iterator[bytes]:
    """Bytes of a gzip stream of one or many members, a piece at a time."""
    unzip = zlib.decompressobj(31)
    while piece := stream.read(_CHUNK):
        while piece:
            yield unzip.decompress(piece, _CHUNK)
            while unzip.unconsumed_tail:
                yield unzip.decompress(unzip.unconsumed_tail, _CHUNK)
            piece = b""
            if unzip.eof:
                piece = unzip.unused_data
                unzip = zlib.decompressobj(31)
    yield unzip.flush()


def _records(pieces: Iterator[bytes]) -> Iterator[tuple[bytes, dict[str, str]]]:
    """Whole records (with their end mark) and headers from a stream of bytes; memory holds one record and one piece."""
    buffer = bytearray()
    need, head_at, head = 0, -1, {}
    for piece in pieces:
        buffer += piece
        while True:
            if head_at < 0:
                head_at = buffer.find(_END)
                if head_at < 0:
                    break
                head = headers(bytes(buffer[:head_at]))
                need = head_at + 4 + int(head.get("content-length", 0)) + 4
            if len(buffer) < need:
                break
            yield bytes(buffer[:need]), head
            del buffer[:need]
            head_at = -1
    if buffer.strip():
        raise ValueError("the archive ends within a record")


def normalise_archives(archives: DataFrame) -> DataFrame:
    """Rewrite each ``archive`` with a gzip member for each record, beside it, and a sidecar index (``.idx``, JSON lines).

    Returns the index: archive (the new one), offset, length, record_type, payload_digest.
    """
    names = ["archive", "offset", "length", "record_type", "payload_digest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                target = f"{archive.removesuffix('.warc.gz')}-{uuid.uuid4().hex[:8]}.members.warc.gz"
                system, inner = _open(archive)
                _, out = _open(target)
                rows, at = [], 0
                with system.open_input_stream(inner, compression=None) as source, system.open_output_stream(out, compression=None) as sink, \
                        system.open_output_stream(f"{out}.idx", compression=None) as index:
                    for data, head in _records(_inflated(source)):
                        gz = zlib.compressobj(4, zlib.DEFLATED, 31)
                        member = gz.compress(data) + gz.flush()
                        sink.write(member)
                        row = (at, len(member), head.get("warc-type", ""), head.get("warc-payload-digest", "").removeprefix("sha1:"))
                        index.write((json.dumps(dict(zip(names[1:], row, strict=True))) + "\n").encode())
                        rows.append((target, *row))
                        at += len(member)
                        if len(rows) >= 20_000:
                            yield _batch(rows, names)
                            rows = []
                yield _batch(rows, names)

    return archives.select("archive").mapInArrow(run, "archive string, offset long, length long, record_type string, payload_digest string")


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)


def read_records(index: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records at an index's byte ranges: page_id, payload_bytes, payload_digest, record_type, refers_to (and payload).

    A response's payload is measured as read back, and one that does not give its digest or stated length fails the task; a revisit
    has no payload, so its figures are those its record states. One record is held at a time, or with payloads about HELD_BYTES of them.
    """
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * with_payload
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, source = None, None
        for batch in batches:
            rows, held = [], 0
            for archive, offset, length in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if archive != opened:
                    if source is not None:
                        source.close()
                    system, inner = _open(archive)
                    opened, source = archive, system.open_input_file(inner)
                source.seek(offset)
                data = zlib.decompress(source.read(length), 31)
                head_at = data.find(_END)
                head = headers(data[:head_at])
                payload = data[data.find(_END, head_at + 4) + 4 : -4]
                digest, kind, size = head["warc-payload-digest"].removeprefix("sha1:"), head["warc-type"], int(head["x-payload-length"])
                if kind == "response":
                    if payload_digest(payload) != digest or len(payload) != size:
                        raise ValueError(f"{archive} at {offset}: the payload does not give its digest and length")
                    size = len(payload)
                number = lambda name: int(head[name]) if name in head else None
                rows.append((number("x-page-id"), size, digest, kind, number("x-refers-to-page-id"), payload if with_payload else None))
                held += len(payload) if with_payload else 0
                if held >= HELD_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(len(names))], names=names)
                    rows, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(len(names))], names=names)
        if source is not None:
            source.close()

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    return index.select("archive", "offset", "length").mapInArrow(run, schema)


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, html, refers_to: of pages with equal payloads of at least ``least_bytes``, all but the largest page_id refer to it.

    A null html is an empty payload. Rows that repeat the largest page_id are all responses, as are rows without page_id.
    The payload's length is measured in bytes. Payloads with more than a thousandth of all pages are at most a thousand: their heads are
    broadcast, and in the join of the others such pages are dealt by their own ids, so no payload meets in one task.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    keyed = rows.withColumn("__sha", F.concat_ws(":", F.sha1(payload), F.length(payload)))
    counted = keyed.where(F.length(payload) >= least_bytes).groupBy("__sha").agg(F.max("page_id").alias("__head"), F.count("*").alias("__count"))
    heads, _ = written(counted.where("__count > 1"), "heads")
    common = F.col("__count") > max(1000, (heads.agg(F.sum("__count")).first()[0] or 0) // 1000)
    hot = F.broadcast(heads.where(common).select("__sha", F.col("__head").alias("__hot")))
    dealt = keyed.join(hot, "__sha", "left")
    own = F.concat_ws(":", F.lit("own"), "page_id", F.xxhash64("url"))
    dealt = dealt.withColumn("__sha", F.when(F.col("__hot").isNull(), F.col("__sha")).otherwise(own))
    found = dealt.join(heads.where(~common).select("__sha", "__head"), "__sha", "left")
    head = F.coalesce("__hot", "__head")
    return found.select("page_id", "url", "html", F.when(F.col("page_id") < head, head).alias("refers_to"))


def archive_round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write ``pages`` to archives, normalise them, and read every record back through the index; one row per page.

    Columns but page_id, url and html are ignored; repeated rows give repeated records; an empty table gives no archive and no row.
    """
    spark = pages.sparkSession
    folder = new_path(spark, "warc")
    archives, _ = written(write_archives(with_revisits(pages, least_bytes), folder), "archives")
    n = max(1, archives.count())
    index, _ = written(normalise_archives(archives.repartition(n, "archive")), "warc-index")
    return read_records(index)


_BITS = "('0x' || substr(sha, 1 + 5 * (i // 4), 5))::BIGINT"
ORACLE = f"""
WITH sized AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(encode(coalesce(html, ''))) AS sha FROM pages),
heads AS (SELECT sha, n, max(page_id) AS head FROM sized GROUP BY sha, n),
named AS (SELECT sha, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (({_BITS} >> (15 - 5 * (i % 4))) & 31)::INTEGER, 1), '' ORDER BY i) AS digest FROM (SELECT DISTINCT sha FROM sized), range(32) AS t(i) GROUP BY sha)
SELECT s.page_id, s.n::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN s.page_id < head THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN s.page_id < head THEN head END AS refers_to FROM sized s JOIN heads USING (sha, n) JOIN named USING (sha)
"""
