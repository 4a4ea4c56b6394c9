"""Media columns: Matroska files of 8-bit samples, and their packet tables.

``mux`` stores bytes as one PCM track: EBML header, segment information, track entry,
clusters of laced blocks, cues. ``parse`` reads any Matroska or WebM file: variable-length
element ids and sizes (unknown sizes too), clusters, simple blocks and block groups,
the lacings Xiph, EBML and fixed, cues. Its packet table has a row a frame: track,
timestamp, cluster, key frame, lacing, byte range.

Scale: everything is row-local and streams through Arrow batches; nothing is shuffled.

Times are in milliseconds: those of the file by its TimestampScale, and in a laced block
each frame is later than the one before by its track's default duration (if it has one).

Defined cases: a null or empty text is stored as 64 bytes of 0. Null media, and media
that end early or break the format, give the packets read up to that point and a text in
``error`` (null media: no packet, error "null"). So do media that end where an element does:
a parent shorter than it says, an element beyond its parent's end, and no segment are errors. Equal payloads give equal files (no
time, no random ids). Repeated rows and empty tables need nothing; only the named columns
are read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import map_batches, read, texts

# The element ids of the Matroska format.
EBML, EBML_VERSION, EBML_READ, EBML_ID_LENGTH, EBML_SIZE_LENGTH, DOC_TYPE, DOC_VERSION, DOC_READ = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIME_SCALE, MUX_APP, WRITE_APP = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4D80, 0x5741
TRACKS, TRACK, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC, LACING, AUDIO, RATE, CHANNELS, DEPTH, DURATION = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x9C, 0xE1, 0xB5, 0x9F, 0x6264, 0x23E383
CLUSTER, CLUSTER_TIME, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUES, CUE, CUE_TIME, CUE_AT, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1

#: Elements that hold others, and what ends one of unknown size.
PARENTS = frozenset((SEGMENT, INFO, TRACKS, TRACK, CLUSTER, BLOCK_GROUP, CUES, CUE, CUE_AT))
ENDS = {CLUSTER: (CLUSTER, CUES, TRACKS, INFO, SEGMENT), SEGMENT: (SEGMENT,), CUES: (CLUSTER, TRACKS, INFO, SEGMENT), TRACKS: (CLUSTER, CUES, INFO, SEGMENT), INFO: (CLUSTER, CUES, TRACKS, SEGMENT)}

SAMPLE_RATE = 8000
FRAME = 512
FRAMES_A_BLOCK = 8
BLOCKS_A_CLUSTER = 16
LACINGS = ("none", "xiph", "fixed", "ebml")


class Packet(NamedTuple):
    track: int
    timestamp: int
    cluster: int
    keyframe: bool
    lacing: str
    start: int
    size: int


# ---- writing


def _size(n: int, width: int = 0) -> bytes:
    """A variable-length number; all ones are kept for an unknown size."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def _element(code: int, body: bytes) -> bytes:
    return code.to_bytes((code.bit_length() + 7) // 8, "big") + _size(len(body)) + body


def _uint(code: int, n: int) -> bytes:
    return _element(code, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def _block(offset: int, frames: list[bytes]) -> bytes:
    """A simple block of track 1: fixed lacing for equal sizes, EBML lacing for others, none for one frame."""
    sizes = [len(f) for f in frames]
    if len(frames) == 1:
        flags, lace = 0x80, b""
    elif len(set(sizes)) == 1:
        flags, lace = 0x84, bytes([len(frames) - 1])
    else:
        lace = bytes([len(frames) - 1]) + _size(sizes[0])
        for a, b in zip(sizes[:-2], sizes[1:-1]):
            width = next(w for w in range(1, 9) if abs(b - a) < 1 << (7 * w - 1))
            lace += _size(b - a + (1 << 7 * width - 1) - 1, width)
        flags = 0x86
    return _element(SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", offset, flags) + lace + b"".join(frames))


def _ms(position: int) -> int:
    return position * 1000 // SAMPLE_RATE


_HEAD = _element(EBML, _uint(EBML_VERSION, 1) + _uint(EBML_READ, 1) + _uint(EBML_ID_LENGTH, 4) + _uint(EBML_SIZE_LENGTH, 8) + _element(DOC_TYPE, b"matroska") + _uint(DOC_VERSION, 4) + _uint(DOC_READ, 2))
_INFO = _element(INFO, _uint(TIME_SCALE, 1_000_000) + _element(MUX_APP, b"spanloom") + _element(WRITE_APP, b"spanloom"))
_TRACKS = _element(TRACKS, _element(TRACK, _uint(TRACK_NUMBER, 1) + _uint(TRACK_UID, 1) + _uint(TRACK_TYPE, 2) + _uint(DURATION, FRAME * 1_000_000_000 // SAMPLE_RATE) + _uint(LACING, 1) + _element(CODEC, b"A_PCM/INT/LIT") + _element(AUDIO, _element(RATE, struct.pack(">d", SAMPLE_RATE)) + _uint(CHANNELS, 1) + _uint(DEPTH, 8))))


def mux(payload: bytes) -> bytes:
    """The bytes as a Matroska file of unsigned 8-bit samples."""
    block, cluster = FRAME * FRAMES_A_BLOCK, FRAME * FRAMES_A_BLOCK * BLOCKS_A_CLUSTER
    parts, cues, at = [_INFO, _TRACKS], [], len(_INFO) + len(_TRACKS)
    for c in range(0, len(payload), cluster):
        base = _ms(c)
        body = _uint(CLUSTER_TIME, base)
        for b in range(c, min(c + cluster, len(payload)), block):
            body += _block(_ms(b) - base, [payload[f : f + FRAME] for f in range(b, min(b + block, len(payload)), FRAME)])
        cues.append(_element(CUE, _uint(CUE_TIME, base) + _element(CUE_AT, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER, at))))
        parts.append(_element(CLUSTER, body))
        at += len(parts[-1])
    parts.append(_element(CUES, b"".join(cues)))
    return _HEAD + _element(SEGMENT, b"".join(parts))


# ---- reading


def _number(data: bytes, at: int, keep_marker: bool = False) -> tuple[int, int, int]:
    """A variable-length number at a place: its value (-1 if unknown), its width, the place behind it."""
    if at >= len(data) or not data[at]:
        raise ValueError(f"no number at byte {at}")
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise ValueError(f"the file ends in a number at byte {at}")
    n = int.from_bytes(data[at : at + width], "big")
    if not keep_marker:
        n ^= 1 << 7 * width
        n = -1 if n == (1 << 7 * width) - 1 else n
    return n, width, at + width


def _laces(data: bytes, at: int, end: int, lacing: int) -> tuple[list[int], int]:
    """The sizes of a block's frames and the place of the first."""
    if not lacing:
        return [end - at], at
    if at >= end:
        raise ValueError(f"the block ends before its frames at byte {at}")
    n, at = data[at] + 1, at + 1
    if lacing == 2:
        if (end - at) % n:
            raise ValueError(f"fixed lacing of unequal frames at byte {at}")
        return [(end - at) // n] * n, at
    sizes: list[int] = []
    if lacing == 1:
        for _ in range(n - 1):
            size = 0
            while True:
                if at >= end:
                    raise ValueError(f"the block ends in its lacing at byte {at}")
                size, at = size + data[at], at + 1
                if data[at - 1] < 255:
                    break
            sizes.append(size)
    else:
        for i in range(n - 1):
            value, width, at = _number(data, at)
            if value < 0:
                value = (1 << 7 * width) - 1
            sizes.append(value if not i else sizes[-1] + value - ((1 << 7 * width - 1) - 1))
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError(f"frames longer than their block at byte {at}")
    return sizes, at


def parse(data: bytes | None) -> tuple[list[Packet], list[tuple[int, int, int]], str | None]:
    """The packets, the cues (time, track, cluster's place in the segment), and what is wrong."""
    packets: list[Packet] = []
    cues: list[tuple[int, int, int]] = []
    if data is None:
        return packets, cues, "null"
    uint = lambda a, b: int.from_bytes(data[a:b], "big")
    cluster, base, cue_time, cue_track, scale, number = -1, 0, 0, 0, 1_000_000, 0
    durations: dict[int, int] = {}  # default duration by track, in nanoseconds
    group: list[int] | None = None  # indexes of the packets of the block group that is open
    parents: list[tuple[int, int]] = []  # the open elements: id, end (-1 if unknown)
    at, segments = 0, 0
    try:
        while at < len(data):
            while parents and 0 <= parents[-1][1] <= at:
                if parents.pop()[0] == BLOCK_GROUP:
                    group = None
            code, _, body = _number(data, at, keep_marker=True)
            size, _, body = _number(data, body)
            while parents and parents[-1][1] < 0 and code in ENDS.get(parents[-1][0], ()):
                parents.pop()  # an element of unknown size ends where one of its own level begins
            end = body + size if size >= 0 else -1
            if (limit := next((e for _, e in reversed(parents) if e >= 0), end)) >= 0 and end > limit:
                raise ValueError(f"an element ends behind its parent at byte {at}")
            if code in PARENTS:
                if code == SEGMENT:
                    segments += 1
                elif code == CLUSTER:
                    cluster, base = cluster + 1, 0
                elif code == BLOCK_GROUP:
                    group = []
                parents.append((code, end))
                at = body
                continue
            if end < 0 or end > len(data):
                raise ValueError(f"the file ends in an element at byte {at}")
            if code == CLUSTER_TIME:
                base = uint(body, end)
            elif code in (SIMPLE_BLOCK, BLOCK):
                track, _, p = _number(data, body)
                if p + 3 > end:
                    raise ValueError(f"a block without a head at byte {at}")
                offset, flags = struct.unpack_from(">hB", data, p)
                lacing = flags >> 1 & 3
                sizes, p = _laces(data, p + 3, end, lacing)
                key = bool(flags & 0x80) if code == SIMPLE_BLOCK else True
                for i, n in enumerate(sizes):
                    if code == BLOCK and group is not None:
                        group.append(len(packets))
                    time = ((base + offset) * scale + i * durations.get(track, 0)) // 1_000_000
                    packets.append(Packet(track, time, cluster, key, LACINGS[lacing], p, n))
                    p += n
            elif code == TIME_SCALE:
                scale = uint(body, end)
            elif code == TRACK_NUMBER:
                number = uint(body, end)
            elif code == DURATION:
                durations[number] = uint(body, end)
            elif code == REFERENCE and group is not None:  # a frame that refers to others is no key frame
                for i in group:
                    packets[i] = packets[i]._replace(keyframe=False)
            elif code == CUE_TIME:
                cue_time = uint(body, end)
            elif code == CUE_TRACK:
                cue_track = uint(body, end)
            elif code == CUE_CLUSTER:
                cues.append((cue_time, cue_track, uint(body, end)))
            at = end
        if short := next((code for code, end in parents if end > len(data)), 0):
            raise ValueError(f"the file ends in its element {short:X}")
        if not segments:
            raise ValueError("no segment")
    except ValueError as e:
        return packets, cues, str(e)
    return packets, cues, None


def packet_table(media: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """id, error and the packet columns: a row a packet, one with null columns for media without any."""
    schema = "id long, packet int, track int, timestamp long, cluster int, keyframe boolean, lacing string, start long, size long, error string"

    def rows(batch: pa.RecordBatch) -> dict:
        out = []
        for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            packets, _, error = parse(data)
            out += [(key, i, *p, error) for i, p in enumerate(packets)] or [(key, *[None] * 8, error)]
        columns = list(zip(*out))
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        return {n.split()[0]: pa.array(c, k) for n, c, k in zip(schema.split(", "), columns, kinds)}

    return map_batches(media.select(F.col(id_col).cast("long").alias("id"), F.col(media_col).alias("media")), rows, schema)


def stored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and media, the padded text as a Matroska file."""

    def rows(batch: pa.RecordBatch) -> dict:
        raw = [x.encode() for x in texts(batch)]
        return {"doc_id": batch.column(0), "n_bytes": pa.array(map(len, raw), pa.int64()), "media": pa.array([mux(padded(x)) for x in raw], pa.binary())}

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), rows, "doc_id long, n_bytes long, media binary")


def padded(raw: bytes) -> bytes:
    return raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")


def features(media: DataFrame) -> DataFrame:
    """The digest columns of doc_id, n_bytes, media, all of them from the media read back."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def one(data: bytes) -> tuple:
        packets, cues, error = parse(data)
        if error:
            raise ValueError(error)
        payload = b"".join([data[p.start : p.start + p.size] for p in packets])
        samples = np.frombuffer(payload, np.uint8).astype(np.int16) - 128
        shown = {
            "packets": len(packets),
            "clusters": packets[-1].cluster + 1,
            "cues": len(cues),
            "ms": len(payload) * 1000 // SAMPLE_RATE,
            "last": packets[-1].timestamp,
            "peak": int(np.abs(samples).max()),
            "energy": int(np.square(samples, dtype=np.int64).sum() // len(samples)),
            "crossings": int(np.count_nonzero(np.diff(np.signbit(samples)))),
        }
        feature = ";".join(f"{k}={v}" for k, v in shown.items())
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature

    def rows(batch: pa.RecordBatch) -> dict:
        names = [n.split()[0] for n in schema.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        columns = zip(*[one(x) for x in batch.column(2).to_pylist()])
        return {"doc_id": batch.column(0), "n_bytes": batch.column(1)} | {n: pa.array(c, k) for n, c, k in zip(names[2:], columns, kinds)}

    return map_batches(media.select("doc_id", "n_bytes", "media"), rows, schema)


def op7_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(stored(read(spark, sf_dir, "documents")))


QUERIES = {"op7_matroska": op7_matroska}
ORACLES: dict[str, str] = {}
