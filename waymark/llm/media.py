"""ISO media containers: writing texts as 8-bit sample tracks, and reading containers by their boxes.

The reader walks nested boxes and decodes the sample tables (stsd, mdhd, stts, stsc, stsz, stco/co64, stss). It never looks into mdat:
codec, duration and the byte ranges of keyframes all follow from the tables.
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
from pyspark.sql import functions as F

from .common import materialise, small_batches

#: Bytes of a sample (an access unit of so many 8-bit values), samples of a chunk, values a second.
UNIT = 64
CHUNK_UNITS = 64
RATE = 8000
#: Boxes that hold boxes, with the bytes before the first child.
CONTAINERS = {b"moov": 0, b"trak": 0, b"mdia": 0, b"minf": 0, b"stbl": 0, b"edts": 0, b"dinf": 0, b"udta": 0, b"moof": 0, b"traf": 0, b"mvex": 0, b"meta": 4}
MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
BATCH_DOCS = 512


def box(kind: bytes, *parts: bytes) -> bytes:
    size = 8 + sum(map(len, parts))
    head = struct.pack(">I4s", size, kind) if size < 1 << 32 else struct.pack(">I4sQ", 1, kind, size + 8)
    return head + b"".join(parts)


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def pad(raw: bytes) -> bytes:
    """Zero bytes up to a positive multiple of UNIT."""
    return raw + bytes(-len(raw) % UNIT) if raw else bytes(UNIT)


def container(payload: bytes) -> bytes:
    """A file of one audio track of raw 8-bit values. payload: a positive multiple of UNIT bytes. Depends on payload alone."""
    units = len(payload) // UNIT
    chunks = -(-units // CHUNK_UNITS)
    wide = len(payload) > 0xF0000000
    last = units - (chunks - 1) * CHUNK_UNITS
    runs = [(1, CHUNK_UNITS)] * (chunks > 1) + [(chunks, last)] * (chunks == 1 or last != CHUNK_UNITS)
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16))
    length = struct.pack(">Q", len(payload))

    def moov(first: int) -> bytes:
        places = first + np.arange(chunks, dtype=np.int64) * (UNIT * CHUNK_UNITS)
        sync = np.arange(chunks, dtype=np.int64) * CHUNK_UNITS + 1
        tables = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, units, UNIT)),
            full(b"stss", struct.pack(">I", chunks), sync.astype(">u4").tobytes()),
            full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", at, n, 1) for at, n in runs)),
            full(b"stsz", struct.pack(">II", UNIT, units)),
            full(b"co64" if wide else b"stco", struct.pack(">I", chunks), places.astype(">u8" if wide else ">u4").tobytes()),
        )
        media = box(
            b"mdia",
            full(b"mdhd", bytes(16), struct.pack(">I", RATE), length, struct.pack(">HH", 0x55C4, 0), version=1),
            full(b"hdlr", bytes(4), b"soun", bytes(12), b"samples\0"),
            box(b"minf", full(b"smhd", bytes(4)), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), tables),
        )
        track = full(b"tkhd", bytes(16), struct.pack(">II", 1, 0), length, bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), MATRIX, bytes(8), version=1, flags=7)
        movie = full(b"mvhd", bytes(16), struct.pack(">I", RATE), length, struct.pack(">IH", 0x10000, 0x100), bytes(10), MATRIX, bytes(24), struct.pack(">I", 2), version=1)
        return box(b"moov", movie, box(b"trak", track, media))

    brand = box(b"ftyp", b"isom", struct.pack(">I", 0x200), b"isomiso2mp41")
    head = 16 if len(payload) + 8 >= 1 << 32 else 8
    return brand + moov(len(brand) + len(moov(0)) + head) + box(b"mdat", payload)


@dataclass
class Track:
    codec: str = ""
    handler: str = ""
    timescale: int = 0
    duration: int = 0
    sizes: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    offsets: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    keyframes: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))  # sample numbers from 0

    def ranges(self) -> np.ndarray:
        """[keyframes, 2] offset and length in bytes."""
        return np.stack([self.offsets[self.keyframes], self.sizes[self.keyframes]], axis=1)


def walk(raw: bytes | memoryview, start: int = 0, end: int | None = None, depth: int = 0) -> Iterator[tuple[int, bytes, int, int]]:
    """(depth, kind, begin and end of its content) of every box, parents first. Raises ValueError where sizes don't add up."""
    end = len(raw) if end is None else end
    while start < end:
        if end - start < 8:
            raise ValueError("cut off box header")
        size, kind = struct.unpack_from(">I4s", raw, start)
        head = 8
        if size == 1:
            if end - start < 16:
                raise ValueError("cut off box header")
            size, head = struct.unpack_from(">Q", raw, start + 8)[0], 16
        elif size == 0:
            size = end - start
        if kind == b"uuid":
            head += 16
        if size < head or start + size > end:
            raise ValueError(f"bad size of {kind!r}")
        yield depth, kind, start + head, start + size
        if kind in CONTAINERS and depth < 16:
            yield from walk(raw, start + head + CONTAINERS[kind], start + size, depth + 1)
        start += size


def numbers(raw: bytes | memoryview, at: int, count: int, end: int, kind: str = ">u4") -> np.ndarray:
    if at + count * int(kind[-1]) > end:
        raise ValueError("cut off table")
    return np.frombuffer(raw, dtype=kind, count=count, offset=at).astype(np.int64)


def tracks(raw: bytes) -> list[Track]:
    """The tracks of a container, from its tables alone. Raises ValueError on malformed files."""
    found: list[dict] = []
    try:
        for _, kind, a, b in walk(raw):
            if kind == b"trak":
                found.append({})
            if not found:
                continue
            own, u4 = found[-1], lambda k, a=a, b=b: int(numbers(raw, a + k, 1, b)[0])
            if kind == b"mdhd":
                wide = raw[a] == 1
                own["timescale"] = u4(20 if wide else 12)
                own["duration"] = int(numbers(raw, a + 24, 1, b, ">u8")[0]) if wide else u4(16)
            elif kind == b"hdlr":
                own["handler"] = bytes(raw[a + 8 : a + 12]).decode("latin-1")
            elif kind == b"stsd":
                own["codec"] = bytes(raw[a + 12 : a + 16]).decode("latin-1") if u4(4) else ""
            elif kind == b"stsc":
                own["stsc"] = numbers(raw, a + 8, 3 * u4(4), b).reshape(-1, 3)
            elif kind == b"stsz":
                same, n = u4(4), u4(8)
                own["sizes"] = np.full(n, same, dtype=np.int64) if same else numbers(raw, a + 12, n, b)
            elif kind in (b"stco", b"co64"):
                own["chunks"] = numbers(raw, a + 8, u4(4), b, ">u4" if kind == b"stco" else ">u8")
            elif kind == b"stss":
                own["sync"] = numbers(raw, a + 8, u4(4), b) - 1
            elif kind == b"stts":
                own["stts"] = numbers(raw, a + 8, 2 * u4(4), b).reshape(-1, 2)
        return [track(own) for own in found]
    except (struct.error, IndexError) as e:
        raise ValueError(str(e)) from e


def track(own: dict) -> Track:
    """Sample offsets: each chunk's offset plus the sizes of the samples before it in its chunk."""
    sizes, chunks, runs = own.get("sizes", np.empty(0, np.int64)), own.get("chunks", np.empty(0, np.int64)), own.get("stsc", np.empty((0, 3), np.int64))
    per_chunk = np.zeros(len(chunks), dtype=np.int64)
    for first, n, _ in runs:
        per_chunk[max(0, first - 1) :] = n
    if per_chunk.sum() != len(sizes):
        raise ValueError("chunks and samples differ")
    chunk_of = np.repeat(np.arange(len(chunks)), per_chunk)
    before = np.cumsum(sizes) - sizes
    firsts = (np.cumsum(per_chunk) - per_chunk)[chunk_of]
    offsets = chunks[chunk_of] + before - before[firsts] if len(sizes) else np.empty(0, np.int64)
    sync = own.get("sync", np.arange(len(sizes)))
    if len(sync) and (sync.min() < 0 or sync.max() >= len(sizes)):
        raise ValueError("keyframe beyond the samples")
    duration = own.get("duration") or int((own.get("stts", np.empty((0, 2), np.int64)).prod(axis=1)).sum())
    return Track(own.get("codec", ""), own.get("handler", ""), own.get("timescale", 0), duration, sizes, offsets, sync)


def payload_of(raw: bytes, t: Track) -> bytes:
    """The track's samples in order; runs of adjacent samples are copied at once."""
    if not len(t.sizes):
        return b""
    ends = t.offsets + t.sizes
    if t.offsets.min() < 0 or ends.max() > len(raw):
        raise ValueError("sample beyond the file")
    cuts = np.flatnonzero(t.offsets[1:] != ends[:-1]) + 1
    return b"".join(raw[t.offsets[a] : ends[b - 1]] for a, b in zip([0, *cuts], [*cuts, len(t.sizes)], strict=True))


FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, codec string, duration_s double, keyframes long, keyframe_ranges array<struct<offset:long,length:long>>"


def features(raw: bytes | None) -> tuple:
    """The row of FEATURES; null media gives nulls, malformed media only its size, digest and the feature ``malformed``."""
    if raw is None:
        return (None,) * 10
    stored = len(raw), hashlib.sha256(raw).hexdigest()
    try:
        t = next(iter(tracks(raw)), None)
        payload = payload_of(raw, t) if t else b""
    except ValueError:
        return None, None, None, *stored, "malformed", None, None, None, None
    if t is None:
        return 0, hashlib.sha256(b"").hexdigest(), 0, *stored, "no track", None, None, 0, []
    ranges = t.ranges()
    seconds = t.duration / t.timescale if t.timescale else None
    feature = f"{t.handler}/{t.codec.strip()}/{t.timescale}/{t.duration}/{len(t.sizes)}/{len(ranges)}/{zlib.crc32(ranges.astype('<i8').tobytes()):08x}"
    return (
        len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), *stored, feature, t.codec, seconds, len(ranges),
        [{"offset": int(a), "length": int(n)} for a, n in ranges],
    )


def writing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH_DOCS):
            part = batch.slice(at, BATCH_DOCS)
            raw = [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in part.column(part.num_columns - 1)]
            media = pa.array([container(pad(x)) for x in raw], type=pa.large_binary() if sum(map(len, raw)) > 1 << 30 else pa.binary())
            own = [part.column(i) for i in range(part.num_columns - 1)]
            yield pa.record_batch([*own, pa.array(map(len, raw), type=pa.int64()), media], names=[*part.schema.names[:-1], "n_bytes", "media"])


def reading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.int64(), pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())]))]
    names = [x.split()[0] for x in FEATURES.split(", ")]
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH_DOCS):
            part = batch.slice(at, BATCH_DOCS)
            rows = [features(m.as_py()) for m in part.column(part.num_columns - 1)]
            own = [part.column(i) for i in range(part.num_columns - 1)]
            yield pa.record_batch([*own, *(pa.array(c, type=k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=[*part.schema.names[:-1], *names])


def store_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): every whole text as a container in a table that is written to the shared folder and read again.

    Null texts count as empty; equal texts give equal containers; repeated rows stay. Rows don't move between partitions.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return materialise(docs.select("doc_id", "text").mapInArrow(writing, f"doc_id {kind}, n_bytes long, media binary"), "media")


def describe(media: DataFrame) -> DataFrame:
    """Replaces the column media, which must come last, by FEATURES computed from the stored bytes."""
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in media.schema.fields[:-1])
    return media.mapInArrow(reading, f"{kept}, {FEATURES}" if kept else FEATURES)
