"""Matroska columns: EBML elements, clusters, lacing and cues as packet tables.

The reader walks variable-length elements, skips what it doesn't know, takes
segments and clusters of unknown size, splits Xiph, EBML and fixed-size laces,
and gives each frame's track, timestamp and byte range in the stored form. The
writer stores a payload as one track of unsigned 8-bit PCM samples.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import ids_and_texts

# Element ids of the public Matroska specification (fixed values).
EBML, DOC_TYPE = 0x1A45DFA3, 0x4282
SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
SEEK_HEAD, TAGS, CHAPTERS, ATTACHMENTS = 0x114D9B74, 0x1254C367, 0x1043A770, 0x1941A469
TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, DEFAULT_DURATION = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x23E383
AUDIO, SAMPLING, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
TOP_LEVEL = {INFO, TRACKS, CLUSTER, CUES, SEEK_HEAD, TAGS, CHAPTERS, ATTACHMENTS}
LACINGS = ("none", "xiph", "fixed", "ebml")

FRAME = 512
RATE = 8000
LACE = 8
CLUSTER_FRAMES = 256


class MediaError(ValueError):
    """The bytes are not a readable Matroska file."""


# ---- reading ----------------------------------------------------------------


def read_vint(data: bytes, at: int, keep_marker: bool = False) -> tuple[int, int, bool]:
    """(value, position after it, whether all value bits are set, which means unknown)."""
    if at >= len(data) or not data[at]:
        raise MediaError(f"no variable-length integer at byte {at}")
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise MediaError("the file ends inside a variable-length integer")
    raw = int.from_bytes(data[at : at + width], "big")
    value = raw & (1 << 7 * width) - 1
    return (raw if keep_marker else value), at + width, value == (1 << 7 * width) - 1


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int, bool]]:
    """(id, first byte, byte after the last, unknown size) of the elements in a range."""
    while at < end:
        key, at, _ = read_vint(data, at, True)
        size, at, unknown = read_vint(data, at)
        stop = end if unknown else at + size
        if stop > end:
            raise MediaError(f"element {key:X} reaches beyond its parent")
        if unknown and key == CLUSTER:
            stop = _cluster_end(data, at, end)
        yield key, at, stop, unknown
        at = stop


def _cluster_end(data: bytes, at: int, end: int) -> int:
    """A cluster of unknown size ends where an element of the level above begins."""
    while at < end:
        key, body, _ = read_vint(data, at, True)
        if key in TOP_LEVEL:
            return at
        size, body, unknown = read_vint(data, body)
        if unknown:
            raise MediaError("unknown size inside a cluster")
        at = body + size
    return end


def _uint(data: bytes, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


def _float(data: bytes, a: int, b: int) -> float:
    if b - a not in (0, 4, 8):
        raise MediaError("a float has 0, 4 or 8 bytes")
    return 0.0 if a == b else struct.unpack(">f" if b - a == 4 else ">d", data[a:b])[0]


def lace_sizes(data: bytes, at: int, end: int, lacing: int) -> tuple[list[int], int]:
    """Sizes of the frames of a block and the position of the first frame."""
    if lacing == 0:
        return [end - at], at
    if at >= end:
        raise MediaError("an empty lace")
    count, at = data[at] + 1, at + 1
    if lacing == 2:
        if (end - at) % count:
            raise MediaError("a fixed-size lace doesn't divide evenly")
        return [(end - at) // count] * count, at
    sizes: list[int] = []
    for k in range(count - 1):
        if lacing == 1:
            size = 0
            while True:
                if at >= end:
                    raise MediaError("a lace header reaches beyond its block")
                size, at = size + data[at], at + 1
                if data[at - 1] != 255:
                    break
        else:
            start = at
            value, at, _ = read_vint(data, at)
            size = value if k == 0 else sizes[-1] + value - ((1 << 7 * (at - start) - 1) - 1)
        sizes.append(size)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise MediaError("a lace is longer than its block")
    return sizes, at


@dataclass
class Media:
    doc_type: str = ""
    scale: int = 1_000_000
    duration: float | None = None
    tracks: dict[int, dict] = field(default_factory=dict)
    clusters: list[int] = field(default_factory=list)
    #: (cluster, track, timestamp_ns, offset, size, keyframe, lacing, frame of the block)
    packets: list[tuple] = field(default_factory=list)
    #: (time_ns, track, byte position of the cluster)
    cues: list[tuple] = field(default_factory=list)


def parse(data: bytes) -> Media:
    """Read headers, clusters and cues of a whole file."""
    out, seen = Media(), False
    for key, a, b, _ in elements(data, 0, len(data)):
        if key == EBML:
            for k, x, y, _ in elements(data, a, b):
                if k == DOC_TYPE:
                    out.doc_type = data[x:y].rstrip(b"\0").decode("ascii", "replace")
        elif key == SEGMENT:
            seen = True
            _segment(data, a, b, out)
    if not seen:
        raise MediaError("no segment")
    return out


def _segment(data: bytes, start: int, end: int, out: Media) -> None:
    points = []
    for key, a, b, _ in elements(data, start, end):
        if key == INFO:
            for k, x, y, _ in elements(data, a, b):
                if k == TIMESTAMP_SCALE:
                    out.scale = _uint(data, x, y)
                elif k == DURATION:
                    out.duration = _float(data, x, y)
        elif key == TRACKS:
            for k, x, y, _ in elements(data, a, b):
                if k == TRACK_ENTRY:
                    _track(data, x, y, out)
        elif key == CLUSTER:
            _cluster(data, a, b, out)
        elif key == CUES:
            points.append((a, b))
    for a, b in points:
        _cues(data, a, b, start, out)


def _track(data: bytes, a: int, b: int, out: Media) -> None:
    track = {"number": 0, "type": 0, "codec": "", "frame_ns": None, "rate": None, "channels": 1, "bits": None}
    for k, x, y, _ in elements(data, a, b):
        if k == TRACK_NUMBER:
            track["number"] = _uint(data, x, y)
        elif k == TRACK_TYPE:
            track["type"] = _uint(data, x, y)
        elif k == CODEC_ID:
            track["codec"] = data[x:y].decode("ascii", "replace")
        elif k == DEFAULT_DURATION:
            track["frame_ns"] = _uint(data, x, y)
        elif k == AUDIO:
            for i, p, q, _ in elements(data, x, y):
                if i == SAMPLING:
                    track["rate"] = _float(data, p, q)
                elif i == CHANNELS:
                    track["channels"] = _uint(data, p, q)
                elif i == BIT_DEPTH:
                    track["bits"] = _uint(data, p, q)
    out.tracks[track["number"]] = track


def _cluster(data: bytes, a: int, b: int, out: Media) -> None:
    number, base = len(out.clusters), 0
    out.clusters.append(a)
    for k, x, y, _ in elements(data, a, b):
        if k == TIMESTAMP:
            base = _uint(data, x, y)
        elif k == SIMPLE_BLOCK:
            _block(data, x, y, base, number, None, out)
        elif k == BLOCK_GROUP:
            inner = {i: (p, q) for i, p, q, _ in elements(data, x, y)}
            if BLOCK in inner:
                _block(data, *inner[BLOCK], base, number, REFERENCE not in inner, out)


def _block(data: bytes, a: int, b: int, base: int, cluster: int, key: bool | None, out: Media) -> None:
    track, at, _ = read_vint(data, a)
    if at + 3 > b:
        raise MediaError("a block is too short")
    (shift,) = struct.unpack_from(">h", data, at)
    flags = data[at + 2]
    lacing = flags >> 1 & 3
    sizes, at = lace_sizes(data, at + 3, b, lacing)
    step = out.tracks.get(track, {}).get("frame_ns") or 0
    when = (base + shift) * out.scale
    for k, size in enumerate(sizes):
        out.packets.append((cluster, track, when + k * step, at, size, bool(flags & 0x80) if key is None else key, LACINGS[lacing], k))
        at += size


def _cues(data: bytes, a: int, b: int, segment: int, out: Media) -> None:
    for k, x, y, _ in elements(data, a, b):
        if k != CUE_POINT:
            continue
        when, spots = 0, []
        for i, p, q, _ in elements(data, x, y):
            if i == CUE_TIME:
                when = _uint(data, p, q)
            elif i == CUE_POSITIONS:
                spot = {j: _uint(data, m, n) for j, m, n, _ in elements(data, p, q) if j in (CUE_TRACK, CUE_CLUSTER)}
                spots.append((spot.get(CUE_TRACK, 0), segment + spot.get(CUE_CLUSTER, 0)))
        out.cues += [(when * out.scale, track, at) for track, at in spots]


def payload(data: bytes, media: Media, track: int = 1) -> bytes:
    """The frames of a track, in stored order."""
    return b"".join(data[p[3] : p[3] + p[4]] for p in media.packets if p[1] == track)


def seek(media: Media, when_ns: int, track: int = 1) -> int | None:
    """Byte position of the cluster from which to read for a time, through the cues."""
    before = [c for c in media.cues if c[1] == track and c[0] <= when_ns]
    return max(before)[2] if before else None


# ---- writing ----------------------------------------------------------------


def write_vint(value: int, width: int | None = None) -> bytes:
    need = 1
    while value >= (1 << 7 * need) - 1:
        need += 1
    width = width or need
    if width < need or width > 8:
        raise ValueError("the value doesn't fit")
    return (value | 1 << 7 * width).to_bytes(width, "big")


def element(key: int, body: bytes) -> bytes:
    return key.to_bytes((key.bit_length() + 7) // 8, "big") + write_vint(len(body)) + body


def _number(key: int, value: int) -> bytes:
    return element(key, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def lace(frames: list[bytes]) -> tuple[int, bytes]:
    """Lacing flags and body of a block: fixed for equal frames, EBML for long ones, else Xiph."""
    if len(frames) == 1:
        return 0, frames[0]
    sizes = [len(f) for f in frames]
    head = bytes([len(frames) - 1])
    if min(sizes) == max(sizes):
        return 2, head + b"".join(frames)
    if sizes[0] < 255:
        for n in sizes[:-1]:
            head += b"\xff" * (n // 255) + bytes([n % 255])
        return 1, head + b"".join(frames)
    head += write_vint(sizes[0])
    for last, n in zip(sizes, sizes[1:-1], strict=False):
        width = 1
        while not -((1 << 7 * width - 1) - 1) <= n - last <= (1 << 7 * width - 1) - 1:
            width += 1
        head += write_vint(n - last + (1 << 7 * width - 1) - 1, width)
    return 3, head + b"".join(frames)


HEADER = element(EBML, _number(0x4286, 1) + _number(0x42F7, 1) + _number(0x42F2, 4) + _number(0x42F3, 8) + element(DOC_TYPE, b"matroska") + _number(0x4287, 4) + _number(0x4285, 2))
TRACK = element(
    TRACKS,
    element(
        TRACK_ENTRY,
        _number(TRACK_NUMBER, 1) + _number(TRACK_UID, 1) + _number(TRACK_TYPE, 2) + element(CODEC_ID, b"A_PCM/INT/LIT") + _number(DEFAULT_DURATION, FRAME * 1_000_000_000 // RATE)
        + element(AUDIO, element(SAMPLING, struct.pack(">d", RATE)) + _number(CHANNELS, 1) + _number(BIT_DEPTH, 8)),
    ),
)


def mux(samples: bytes) -> bytes:
    """A file with one track of unsigned 8-bit samples: laced frames, clusters and cues."""
    frame_ms = FRAME * 1000 // RATE
    info = element(INFO, _number(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", len(samples) * 1000 / RATE)) + element(MUXING_APP, b"paperloom") + element(WRITING_APP, b"paperloom"))
    parts, at, cues = [info, TRACK], len(info) + len(TRACK), []
    for first in range(0, len(samples), FRAME * CLUSTER_FRAMES):
        base = first // FRAME * frame_ms
        body = [_number(TIMESTAMP, base)]
        for start in range(first, min(first + FRAME * CLUSTER_FRAMES, len(samples)), FRAME * LACE):
            stop = min(start + FRAME * LACE, len(samples))
            flags, laced = lace([samples[i : min(i + FRAME, stop)] for i in range(start, stop, FRAME)])
            body.append(element(SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", start // FRAME * frame_ms - base, 0x80 | flags << 1) + laced))
        cluster = element(CLUSTER, b"".join(body))
        cues.append(element(CUE_POINT, _number(CUE_TIME, base) + element(CUE_POSITIONS, _number(CUE_TRACK, 1) + _number(CUE_CLUSTER, at))))
        parts.append(cluster)
        at += len(cluster)
    parts.append(element(CUES, b"".join(cues)))
    return HEADER + element(SEGMENT, b"".join(parts))


# ---- columns ----------------------------------------------------------------


def text_payload(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes with zeros up to a positive multiple of 64, and the length before."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + bytes(max(64, -(-len(data) // 64) * 64) - len(data)), len(data)


def features(data: bytes, media: Media, samples: bytes) -> str:
    """Integers about packets and samples, as name=value pairs."""
    wave = np.frombuffer(samples, np.uint8).astype(np.int64) - 128
    signs = np.signbit(wave)
    laces = sorted({p[6] for p in media.packets})
    last = media.packets[-1]
    return (
        f"packets={len(media.packets)};clusters={len(media.clusters)};cues={len(media.cues)};lacing={'+'.join(laces)};"
        f"last_ns={last[2]};last_byte={last[3] + last[4]};sum={int(wave.sum())};energy={int((wave * wave).sum())};crossings={int(np.count_nonzero(signs[1:] != signs[:-1]))}"
    )


def media_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store each text as a Matroska file, parse the stored bytes and describe what they hold.

    Returns doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, feature for every row; null texts count as empty
    and give 64 zero bytes. Equal texts give equal values. Ids pass unchanged,
    null and repeated ones too; an empty table gives no rows.
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held, n = text_payload(text.as_py())
                stored = mux(held)
                media = parse(stored)
                back = payload(stored, media)
                rows.append((doc_id, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), features(stored, media, back)))
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return ids_and_texts(df, id_col, text_col).mapInArrow(run, schema)


PACKET_SCHEMA = "media_id long, cluster int, track long, timestamp_ns long, offset long, size long, keyframe boolean, lacing string, frame int, error string"


def packet_table(df: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """One row per frame of each Matroska file in a binary column.

    offset and size are the frame's byte range in the file. Null media give no
    row. A file that can't be read gives one row with only media_id and error,
    so no file disappears. A readable file without frames gives no row.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("media_id", pa.int64()), ("cluster", pa.int32()), ("track", pa.int64()), ("timestamp_ns", pa.int64()), ("offset", pa.int64()), ("size", pa.int64()), ("keyframe", pa.bool_()), ("lacing", pa.string()), ("frame", pa.int32()), ("error", pa.string())])
        for batch in batches:
            for key, held in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = held.as_py()
                if data is None:
                    continue
                try:
                    rows = [(key, *p, None) for p in parse(data).packets]
                except MediaError as e:
                    rows = [(key, *[None] * 8, str(e))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return df.select(F.col(id_col).cast("long").alias("media_id"), F.col(media_col).cast("binary").alias("media")).mapInArrow(run, PACKET_SCHEMA)


def media_column(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, media): each text's payload as the bytes of a Matroska file.

    Null and empty texts give the file of 64 zero bytes; null ids stay null, repeated
    rows have a file each, equal texts equal files. An empty table gives no rows.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([mux(text_payload(t.as_py())[0]) for t in batch.column(1)], pa.binary())], ["doc_id", "media"])

    return ids_and_texts(df, id_col, text_col).mapInArrow(run, "doc_id long, media binary")
