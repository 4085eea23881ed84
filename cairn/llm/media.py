"""Operator 10, media columns: ISO media containers, read without decoding payloads.

``write_media`` wraps a payload as one track of 8-bit samples in a container of nested boxes
(ftyp, moov with its sample tables, mdat). ``read_media`` walks the boxes of any such container,
decodes the sample tables into byte ranges, and gives codec, duration and the byte ranges of the
keyframes (sync samples); samples are located, never decoded. Both are pure functions of bytes, so
equal texts give equal media and features.

Tables understood: stsz (sizes), stsc with stco or co64 (chunks), stts (durations), stss (sync
samples; all are if it is absent), stsd (codec), mdhd (time scale). Boxes of 64-bit size, boxes that
reach to the end and unknown boxes are handled; a box that claims more than its parent holds is an
error.

Odd rows: a null or empty text is a payload of 64 zero bytes; repeated rows give repeated results;
only the id and the text are read, so other columns cannot clash. Media that are null, malformed or
without a track have null features and say why in ``error``; of several tracks the first is taken.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm.common import map_rows, text_or_empty

#: Bytes of one media sample, samples of one chunk, samples from one keyframe to the next.
UNIT, CHUNK_SAMPLES, KEY_EVERY = 64, 16, 8
TIME_SCALE = 8000
#: Fixed values of the format: boxes that hold boxes.
CONTAINERS = (b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta")


@dataclass
class Track:
    codec: str = ""
    time_scale: int = 0
    durations: list[tuple[int, int]] = field(default_factory=list)  # (samples, ticks of each)
    sizes: list[int] = field(default_factory=list)
    chunk_runs: list[tuple[int, int]] = field(default_factory=list)  # (first chunk from 1, samples in each)
    chunk_offsets: list[int] = field(default_factory=list)
    sync: list[int] | None = None  # sample numbers from 1; None: every one

    @property
    def ticks(self) -> int:
        return sum(n * ticks for n, ticks in self.durations)

    def samples(self) -> list[tuple[int, int]]:
        """(offset, size) of every sample, in order."""
        out, number, run = [], 0, 0
        if self.chunk_offsets and not self.chunk_runs:
            raise ValueError("chunks without a table of their samples")
        for chunk, offset in enumerate(self.chunk_offsets, 1):
            while run + 1 < len(self.chunk_runs) and self.chunk_runs[run + 1][0] <= chunk:
                run += 1
            for size in self.sizes[number : number + self.chunk_runs[run][1]]:
                out.append((offset, size))
                offset += size
                number += 1
        if number != len(self.sizes):
            raise ValueError(f"the chunks hold {number} samples of {len(self.sizes)}")
        return out

    def keyframes(self) -> list[tuple[int, int]]:
        """Byte ranges (start, end) from the samples that can be decoded alone."""
        samples = self.samples()
        chosen = samples if self.sync is None else [samples[i - 1] for i in self.sync]
        return [(offset, offset + size) for offset, size in chosen]


def boxes(data: memoryview, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(type, start and end of the content) of the boxes between two places."""
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            (size,), head = struct.unpack_from(">Q", data, start + 8), 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            raise ValueError(f"box {kind!r} at {start} has size {size}")
        yield kind, start + head, start + size
        start += size


def _numbers(data: memoryview, at: int, fields: int, width: str = "I") -> list[tuple[int, ...]]:
    """The entries of a table box: version and flags, a count, then rows of so many numbers."""
    (count,) = struct.unpack_from(">I", data, at + 4)
    flat = struct.unpack_from(f">{count * fields}{width}", data, at + 8)
    return list(zip(*[iter(flat)] * fields, strict=True))


def read_media(media: bytes) -> list[Track]:
    """The tracks of a container."""
    data, tracks = memoryview(media), []

    def walk(start: int, end: int, track: Track | None) -> None:
        for kind, at, stop in boxes(data, start, end):
            if kind == b"trak":
                tracks.append(Track())
                walk(at, stop, tracks[-1])
            elif kind in CONTAINERS:
                walk(at, stop, track)
            elif track is None:
                continue
            elif kind == b"mdhd":
                (track.time_scale,) = struct.unpack_from(">I", data, at + (20 if data[at] else 12))
            elif kind == b"stsd":
                track.codec = bytes(data[at + 12 : at + 16]).decode("latin-1")
            elif kind == b"stts":
                track.durations = _numbers(data, at, 2)
            elif kind == b"stss":
                track.sync = [n for (n,) in _numbers(data, at, 1)]
            elif kind == b"stsc":
                track.chunk_runs = [(first, samples) for first, samples, _ in _numbers(data, at, 3)]
            elif kind == b"stco":
                track.chunk_offsets = [n for (n,) in _numbers(data, at, 1)]
            elif kind == b"co64":
                track.chunk_offsets = [n for (n,) in _numbers(data, at, 1, "Q")]
            elif kind == b"stsz":
                size, count = struct.unpack_from(">II", data, at + 4)
                track.sizes = [size] * count if size else [n for (n,) in _numbers(data, at + 4, 1)]

    walk(0, len(data), None)
    return tracks


def stored_payload(media: bytes, track: Track) -> bytes:
    """The bytes of a track's samples, in order."""
    data = memoryview(media)
    return b"".join(data[a : a + n] for a, n in track.samples())


def _box(kind: bytes, *content: bytes) -> bytes:
    body = b"".join(content)
    if len(body) + 8 < 2**32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def _table(kind: bytes, rows: list[tuple[int, ...]], width: str = "I") -> bytes:
    flat = [n for row in rows for n in row]
    return _box(kind, struct.pack(f">II{len(flat)}{width}", 0, len(rows), *flat))


def write_media(payload: bytes, *, codec: bytes = b"raw ", time_scale: int = TIME_SCALE) -> bytes:
    """A container whose one track holds the payload in samples of UNIT bytes, unchanged."""
    if not payload or len(payload) % UNIT:
        raise ValueError(f"a payload has a positive multiple of {UNIT} bytes")
    samples = len(payload) // UNIT
    chunks = -(-samples // CHUNK_SAMPLES)
    last = samples - (chunks - 1) * CHUNK_SAMPLES
    runs = [(1, CHUNK_SAMPLES, 1)] if chunks > 1 else []
    if chunks == 1 or last != CHUNK_SAMPLES:
        runs.append((chunks, last, 1))
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    head = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom")
    ticks = samples * UNIT

    def moov(offset: int) -> bytes:
        places = [(offset + c * CHUNK_SAMPLES * UNIT,) for c in range(chunks)]
        wide = places[-1][0] >= 2**32
        entry = _box(codec, bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, (time_scale & 0xFFFF) << 16))
        stbl = _box(
            b"stbl", _box(b"stsd", struct.pack(">II", 0, 1), entry), _table(b"stts", [(samples, UNIT)]), _table(b"stsc", runs), _box(b"stsz", struct.pack(">III", 0, UNIT, samples)),
            _table(b"co64", places, "Q") if wide else _table(b"stco", places), _table(b"stss", [(n,) for n in range(1, samples + 1, KEY_EVERY)]),
        )
        data_reference = _box(b"dinf", _box(b"dref", struct.pack(">II", 0, 1), _box(b"url ", struct.pack(">I", 1))))
        minf = _box(b"minf", _box(b"smhd", bytes(8)), data_reference, stbl)
        mdia = _box(b"mdia", _box(b"mdhd", struct.pack(">IIIIIHH", 0, 0, 0, time_scale, min(ticks, 2**32 - 1), 0x55C4, 0)), _box(b"hdlr", bytes(8), b"soun", bytes(12), b"\0"), minf)
        tkhd = _box(b"tkhd", struct.pack(">IIIIII", 7, 0, 0, 1, 0, min(ticks, 2**32 - 1)), bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), matrix, bytes(8))
        mvhd = _box(b"mvhd", struct.pack(">IIIII", 0, 0, 0, time_scale, min(ticks, 2**32 - 1)), struct.pack(">IH", 0x10000, 0x100), bytes(10), matrix, bytes(24), struct.pack(">I", 2))
        return _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))

    data_head = 8 if len(payload) + 8 < 2**32 else 16
    index = moov(0)
    offset = len(head) + len(index) + data_head
    index = moov(offset)
    if len(head) + len(index) + data_head != offset:  # the wide table has come in
        index = moov(len(head) + len(index) + data_head)
    return head + index + _box(b"mdat", payload)


def feature(track: Track) -> str:
    """codec, duration as ticks/scale, sample count, and the keyframes' byte ranges."""
    ranges = track.keyframes()
    return f"{track.codec.strip()};{track.ticks}/{track.time_scale};{len(track.sizes)};" + ",".join(f"{a}-{b}" for a, b in ranges)


def payload_of(text: str) -> bytes:
    data = text.encode()
    return data + bytes(max(1, -(-len(data) // UNIT)) * UNIT - len(data))


def write_media_column(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes and the media made of each text, as a binary column."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(1).to_pylist()
            media = [write_media(payload_of(t)) for t in texts]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(media, pa.binary())], names=schema.names)

        return work

    return map_rows(docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")), ["doc_id", "text"], make, schema)


def media_features(media: DataFrame) -> DataFrame:
    """What the stored bytes say, read back by their own tables."""
    schema = T.StructType([
        media.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()),
        T.StructField("tail_crc32", T.LongType()), T.StructField("media_bytes", T.LongType()), T.StructField("media_sha256", T.StringType()), T.StructField("feature", T.StringType()),
        T.StructField("error", T.StringType()),
    ])

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for stored in batch.column(2).to_pylist():
                whole = (None, None) if stored is None else (len(stored), hashlib.sha256(stored).hexdigest())
                try:
                    track = next(iter(read_media(stored or b"")), None)
                    if track is None:
                        raise ValueError("no track")
                    payload = stored_payload(stored, track)
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), *whole, feature(track), None))
                except (ValueError, IndexError, struct.error) as error:
                    rows.append((None, None, None, *whole, None, str(error)))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=schema.names)

        return work

    return map_rows(media, ["doc_id", "n_bytes", "media"], make, schema)
