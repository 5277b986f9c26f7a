"""Media columns: a Matroska writer and reader for sample payloads, and the packet tables read from such bytes.

The reader walks variable-length EBML elements: Segment, Info, Tracks, Clusters, SimpleBlocks and BlockGroups with all four kinds of
lacing (none, Xiph, fixed-size, EBML), and Cues. Each frame becomes a packet with its track, timestamp and byte range.
The writer stores 8-bit mono samples as PCM: frames of 576 samples, up to eight in a fixed-lacing block, up to seven blocks in a cluster, and
a cue for each cluster.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millwright.llm.common import slices, text_batches

# Fixed values of the EBML and Matroska formats: element ids.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
DOC_TYPE, DOC_VERSION, DOC_READ_VERSION = 0x4282, 0x4287, 0x4285
TIMESTAMP_SCALE, DURATION = 0x2AD7B1, 0x4489
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, AUDIO, RATE, CHANNELS, BIT_DEPTH = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0xE1, 0xB5, 0x9F, 0x6264
DEFAULT_DURATION = 0x23E383
CLUSTER_TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE_BLOCK = 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
SEEK_HEAD, ATTACHMENTS, CHAPTERS, TAGS = 0x114D9B74, 0x1941A469, 0x1043A770, 0x1254C367
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1

#: Elements of the levels above a cluster: the first of them ends a cluster of unknown size.
_ABOVE_CLUSTER = {EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES, SEEK_HEAD, ATTACHMENTS, CHAPTERS, TAGS}

FRAME, LACED, SAMPLE_RATE = 576, 8, 8000
#: A block's timestamp in its cluster is a signed 16-bit number of samples.
BLOCKS_A_CLUSTER = 32767 // (FRAME * LACED)
PADDING = b"\xff"


def padded(text: bytes | None) -> bytes:
    """A text's bytes and as many 255s as bring them to a positive multiple of the frame size."""
    text = text or b""
    return text + PADDING * (max(1, -(-len(text) // FRAME)) * FRAME - len(text))


# -- writer


def _size(n: int, width: int = 0) -> bytes:
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def _element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + _size(len(body)) + body


def _uint(ident: int, n: int) -> bytes:
    return _element(ident, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


_HEAD = _element(EBML, _element(DOC_TYPE, b"matroska") + _uint(DOC_VERSION, 4) + _uint(DOC_READ_VERSION, 2))
_TRACKS = _element(TRACKS, _element(TRACK_ENTRY, _uint(TRACK_NUMBER, 1) + _uint(TRACK_UID, 1) + _uint(TRACK_TYPE, 2) + _uint(DEFAULT_DURATION, FRAME * 1_000_000_000 // SAMPLE_RATE)
    + _element(CODEC_ID, b"A_PCM/INT/LIT") + _element(AUDIO, _element(RATE, struct.pack(">d", SAMPLE_RATE)) + _uint(CHANNELS, 1) + _uint(BIT_DEPTH, 8))))
#: Timestamps count frames' ticks: 1/8000 second, 125 000 ns.
_SCALE = 1_000_000_000 // SAMPLE_RATE


def write_samples(payload: bytes) -> bytes:
    """A Matroska file of one PCM track that holds ``payload`` (8-bit samples, a multiple of the frame size)."""
    frames = len(payload) // FRAME
    head = _element(INFO, _uint(TIMESTAMP_SCALE, _SCALE) + _element(DURATION, struct.pack(">d", len(payload)))) + _TRACKS
    body, cues, at = [head], [], len(head)
    for first in range(0, frames, LACED * BLOCKS_A_CLUSTER):
        blocks = [_uint(CLUSTER_TIMESTAMP, first * FRAME)]
        for k in range(first, min(first + LACED * BLOCKS_A_CLUSTER, frames), LACED):
            n = min(LACED, frames - k)
            blocks.append(_simple_block(1, (k - first) * FRAME, n, payload[k * FRAME : (k + n) * FRAME]))
        cluster = _element(CLUSTER, b"".join(blocks))
        cues.append((first * FRAME, at))
        body.append(cluster)
        at += len(cluster)
    body.append(_element(CUES, b"".join(_element(CUE_POINT, _uint(CUE_TIME, t) + _element(CUE_POSITIONS, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER, p))) for t, p in cues)))
    return _HEAD + _element(SEGMENT, b"".join(body))


def _simple_block(track: int, relative: int, frames: int, data: bytes) -> bytes:
    laced = frames > 1
    return _element(SIMPLE_BLOCK, _size(track) + struct.pack(">hB", relative, 0x80 | (0x04 if laced else 0)) + (bytes([frames - 1]) if laced else b"") + data)


# -- reader


@dataclass(frozen=True)
class Packet:
    track: int
    timestamp_ns: int
    offset: int
    size: int
    lacing: int
    keyframe: bool


@dataclass
class Movie:
    packets: list[Packet] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    tracks: dict[int, dict] = field(default_factory=dict)
    scale: int = 1_000_000
    errors: list[str] = field(default_factory=list)


def _number(data: bytes, at: int, keep_mark: bool = False) -> tuple[int, int, bool]:
    """A variable-length number at ``at``: value, next place, and whether all its bits are set (an unknown size)."""
    first = data[at]
    width = 9 - first.bit_length()
    if width > 8 or at + width > len(data):
        raise ValueError(f"no variable-length number at byte {at}")
    raw = int.from_bytes(data[at : at + width], "big")
    value = raw & ((1 << 7 * width) - 1)
    return (raw if keep_mark else value), at + width, value == (1 << 7 * width) - 1


def _elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(id, first byte, end) of the elements of a parent. A segment of unknown size goes to its parent's end, a cluster to the first
    element of a level above."""
    while at < end:
        ident, at, _ = _number(data, at, keep_mark=True)
        size, at, open_ended = _number(data, at)
        stop = at + size
        if open_ended:
            stop = _cluster_end(data, at, end) if ident == CLUSTER else end
        if stop > end:
            raise ValueError(f"an element runs beyond its parent at byte {at}")
        yield ident, at, stop
        at = stop


def _cluster_end(data: bytes, at: int, end: int) -> int:
    while at < end:
        ident, body, _ = _number(data, at, keep_mark=True)
        if ident in _ABOVE_CLUSTER:
            return at
        size, body, _ = _number(data, body)
        at = body + size
    return end


def _lace_sizes(data: bytes, at: int, end: int, lacing: int) -> tuple[int, list[int]]:
    """Place of the first frame and all frames' sizes of a block from its lacing head on."""
    if not lacing:
        return at, [end - at]
    frames, at = data[at] + 1, at + 1
    if lacing == 2:
        if (end - at) % frames:
            raise ValueError("fixed-size lacing that does not divide its block")
        return at, [(end - at) // frames] * frames
    sizes: list[int] = []
    for k in range(frames - 1):
        if lacing == 1:
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            size, at = size + data[at], at + 1
        else:
            start = at
            raw, at, _ = _number(data, at)
            size = raw if not k else sizes[-1] + raw - ((1 << 7 * (at - start) - 1) - 1)
        sizes.append(size)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("laced frames run beyond their block")
    return at, sizes


def parse(data: bytes) -> Movie:
    """Packets, cues and tracks of a Matroska file; what is damaged ends the parse with a message in ``errors``."""
    movie = Movie()
    try:
        for ident, at, end in _elements(data, 0, len(data)):
            if ident == SEGMENT:
                _segment(data, at, end, movie)
    except (ValueError, IndexError) as wrong:
        movie.errors.append(str(wrong))
    return movie


def _whole(data: bytes, at: int, end: int) -> int:
    return int.from_bytes(data[at:end], "big")


def _segment(data: bytes, base: int, end: int, movie: Movie) -> None:
    for ident, start, stop in _elements(data, base, end):
        if ident in (INFO, TRACKS, CUES, CLUSTER):
            _part(data, start, stop, base, movie)


def _part(data: bytes, at: int, end: int, base: int, movie: Movie) -> None:
    """Elements of one Info, Tracks, Cues or Cluster."""
    clock = 0
    for ident, start, stop in _elements(data, at, end):
        if ident == TIMESTAMP_SCALE:
            movie.scale = _whole(data, start, stop)
        elif ident == TRACK_ENTRY:
            entry = {i: data[s:e] for i, s, e in _elements(data, start, stop)}
            movie.tracks[int.from_bytes(entry.get(TRACK_NUMBER, b""), "big")] = {
                "codec": entry.get(CODEC_ID, b"").decode("ascii", "replace"), "frame_ns": int.from_bytes(entry.get(DEFAULT_DURATION, b""), "big"),
            }
        elif ident == CUE_POINT:
            point = list(_elements(data, start, stop))
            time = next((_whole(data, s, e) for i, s, e in point if i == CUE_TIME), 0)
            for i, s, e in point:
                if i == CUE_POSITIONS:  # one for each track that has the time
                    where = {k: _whole(data, *place) for k, *place in _elements(data, s, e)}
                    movie.cues.append((time * movie.scale, where.get(CUE_TRACK, 0), base + where.get(CUE_CLUSTER, 0)))
        elif ident == CLUSTER_TIMESTAMP:
            clock = _whole(data, start, stop)
        elif ident == SIMPLE_BLOCK:
            _block(data, start, stop, clock, movie, None)
        elif ident == BLOCK_GROUP:
            group = list(_elements(data, start, stop))
            key = all(inner != REFERENCE_BLOCK for inner, _, _ in group)  # a block that refers to no other stands alone
            for inner, s, e in group:
                if inner == BLOCK:
                    _block(data, s, e, clock, movie, key)


def _block(data: bytes, at: int, end: int, clock: int, movie: Movie, keyframe: bool | None) -> None:
    track, at, _ = _number(data, at)
    relative, flags = struct.unpack_from(">hB", data, at)
    at += 3
    lacing = flags >> 1 & 3
    at, sizes = _lace_sizes(data, at, end, lacing)
    time = (clock + relative) * movie.scale
    key = bool(flags & 0x80) if keyframe is None else keyframe
    step = movie.tracks.get(track, {}).get("frame_ns", 0)  # of the frames that share a block's timestamp
    for k, size in enumerate(sizes):
        movie.packets.append(Packet(track, time + k * step, at, size, lacing, key))
        at += size


def samples(data: bytes, movie: Movie) -> bytes:
    return b"".join(data[p.offset : p.offset + p.size] for p in movie.packets)


# -- DataFrame operators


def _map(rows: DataFrame, columns: list[str], run, schema: str) -> DataFrame:
    return rows.select(*columns).mapInArrow(run, schema)


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (of the UTF-8 text; null as empty) and ``media``, a Matroska file of the padded bytes, for each row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = text_batches(batch)
            for i in range(0, len(texts), 500):  # media repeat the texts: small batches bound the memory
                some = texts[i : i + 500]
                media = [write_samples(padded(t)) for t in some]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, len(some)), pa.array([len(t or b"") for t in some], pa.int64()), pa.array(media, pa.binary())],
                    names=["doc_id", "n_bytes", "media"],
                )

    kind = dict(docs.select("doc_id").dtypes)["doc_id"]
    return _map(docs, ["doc_id", "text"], run, f"doc_id {kind}, n_bytes long, media binary")


def packets(media: DataFrame) -> DataFrame:
    """One row per packet of each ``media`` value: doc_id, packet, track, timestamp_ns, byte_start, byte_length, lacing, keyframe.

    Null, empty and foreign bytes have no packets; a damaged file has those before the damage.
    """
    names = ["doc_id", "packet", "track", "timestamp_ns", "byte_start", "byte_length", "lacing", "keyframe"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for i, data in enumerate(batch.column(1).to_pylist()):
                found = parse(data or b"").packets
                ids = batch.column(0).take(pa.array([i] * len(found), pa.int64()))
                rest = [list(range(len(found)))] + [[getattr(p, a) for p in found] for a in ("track", "timestamp_ns", "offset", "size", "lacing")]
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, pa.int64()) for c in rest], pa.array([p.keyframe for p in found], pa.bool_())], names=names)

    kind = dict(media.select("doc_id").dtypes)["doc_id"]
    return _map(media, ["doc_id", "media"], run, f"doc_id {kind}, packet long, track long, timestamp_ns long, byte_start long, byte_length long, lacing long, keyframe boolean")


def feature(movie: Movie, payload: bytes) -> str:
    x = np.frombuffer(payload, np.uint8).astype(np.int32) - 128
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    energy = int((x.astype(np.int64) ** 2).sum())
    last = movie.packets[-1].timestamp_ns if movie.packets else 0
    return f"packets={len(movie.packets)};cues={len(movie.cues)};last_ns={last};peak={int(np.abs(x).max()) if len(x) else 0};energy={energy};crossings={crossings}"


def describe(media: DataFrame) -> DataFrame:
    """Digests and features of what is read back from each stored file; equal texts give equal values.

    doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32 (of the last 32 bytes), media_bytes, media_sha256, feature.
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for data in batch.column(2).to_pylist():
                data = data or b""
                movie = parse(data)
                back = samples(data, movie)
                rows.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature(movie, back)))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]], names=names)

    kind = dict(media.select("doc_id").dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return _map(media, ["doc_id", "n_bytes", "media"], run, schema)


def cue_table(media: DataFrame) -> DataFrame:
    """One row per cue: doc_id, cue, timestamp_ns, track, cluster_offset."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [(i, k, *c) for i, data in enumerate(batch.column(1).to_pylist()) for k, c in enumerate(parse(data or b"").cues)]
            ids = batch.column(0).take(pa.array([f[0] for f in found], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *[pa.array([f[k] for f in found], pa.int64()) for k in range(1, 5)]], names=["doc_id", "cue", "timestamp_ns", "track", "cluster_offset"])

    kind = dict(media.select("doc_id").dtypes)["doc_id"]
    return _map(media, ["doc_id", "media"], run, f"doc_id {kind}, cue long, timestamp_ns long, track long, cluster_offset long")
