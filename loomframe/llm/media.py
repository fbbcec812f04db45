"""Media columns: ISO base media containers written and walked without decoding payloads.

`to_media` stores bytes as 8-bit samples: `ftyp`, one `mdat`, and a `moov` whose
sample tables describe 64-byte access units in chunks. `read_tracks` walks the
nested boxes of any such file (32- and 64-bit sizes, `stsz`, `stsc`, `stco` or
`co64`, `mdhd`, `stss`), each track by itself, and yields codec, duration and
keyframe byte ranges from the tables alone. Nothing is allocated that the file
does not hold: counts are held against the boxes, ranges against the file's end.
Both work on one row at a time, inside Arrow batches.

Defined results: null bytes are an empty payload, which is padded to one unit;
a track with broken tables (a box missing, a count or range beyond the file, a
keyframe that is no sample) is left out; a file without a track has codec null,
duration 0 and no ranges, as has one whose samples are in movie fragments, which
are not read; equal bytes give equal files (no times, no random ids); other
columns stay with the caller, which selects what it passes on.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT, PER_CHUNK, RATE = 64, 256, 8000
#: Fixed value: the sample entry of 8-bit unsigned samples.
CODEC = b"raw "
MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def padded(data: bytes) -> bytes:
    return data + bytes(max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def full_box(kind: bytes, *parts: bytes) -> bytes:
    return box(kind, bytes(4), *parts)


def to_media(payload: bytes) -> bytes:
    """A container of `payload`, whose length must be a positive multiple of UNIT."""
    units = len(payload) // UNIT
    chunks = -(-units // PER_CHUNK)
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isommp41")
    first = len(ftyp) + 8
    offsets = (first + np.arange(chunks, dtype=np.int64) * PER_CHUNK * UNIT).astype(">u4").tobytes()
    last = units - (chunks - 1) * PER_CHUNK
    runs = [(1, PER_CHUNK, 1)] * (chunks > 1) + [(chunks, last, 1)] * (last != PER_CHUNK or chunks == 1)
    entry = box(CODEC, bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16))
    stbl = box(
        b"stbl",
        full_box(b"stsd", struct.pack(">I", 1), entry),
        full_box(b"stts", struct.pack(">III", 1, units, UNIT)),
        full_box(b"stsc", struct.pack(">I", len(runs)), *[struct.pack(">III", *r) for r in runs]),
        full_box(b"stsz", struct.pack(">II", UNIT, units)),
        full_box(b"stco", struct.pack(">I", chunks), offsets),
    )
    dinf = box(b"dinf", full_box(b"dref", struct.pack(">I", 1), box(b"url ", b"\0\0\0\1")))
    minf = box(b"minf", full_box(b"smhd", bytes(4)), dinf, stbl)
    length = units * UNIT
    mdia = box(b"mdia", full_box(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, length, 0x55C4, 0)), full_box(b"hdlr", bytes(4), b"soun", bytes(12), b"\0"), minf)
    tkhd = box(b"tkhd", b"\0\0\0\7", struct.pack(">IIIII", 0, 0, 1, 0, length), bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), MATRIX, bytes(8))
    mvhd = full_box(b"mvhd", struct.pack(">IIIIIH", 0, 0, RATE, length, 0x10000, 0x100), bytes(10), MATRIX, bytes(24), struct.pack(">I", 2))
    return b"".join([ftyp, struct.pack(">I4s", len(payload) + 8, b"mdat"), payload, box(b"moov", mvhd, box(b"trak", tkhd, mdia))])


def boxes(data: memoryview, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, body start, body end) of the boxes from `start`; a box that overruns ends the walk."""
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1 and start + 16 <= end:
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        size = end - start if size == 0 else size
        if size < head or start + size > end:
            return
        yield kind, start + head, start + size
        start += size


class Broken(ValueError):
    """Tables that do not describe samples of the file."""


def inside(view: memoryview, span: tuple[int, int], kind: bytes) -> list[tuple[int, int]]:
    return [(at, to) for k, at, to in boxes(view, *span) if k == kind]


def numbers(view: memoryview, span: tuple[int, int], skip: int, n: int, kind: str = ">u4") -> np.ndarray:
    """`n` numbers that start `skip` bytes into a box's body."""
    if n < 0 or span[0] + skip + n * np.dtype(kind).itemsize > span[1]:
        raise Broken("a table ends before its entries")
    return np.frombuffer(view, kind, n, span[0] + skip).astype(np.int64)


def read_track(view: memoryview, trak: tuple[int, int]) -> dict:
    """codec, timescale, duration, n_samples, n_keyframes, merged keyframe ranges and the sample bytes' ranges of one track."""
    mdia = inside(view, trak, b"mdia")[0]
    stbl = inside(view, inside(view, mdia, b"minf")[0], b"stbl")[0]
    table = {k: (at, to) for k, at, to in reversed(list(boxes(view, *stbl)))}
    header = inside(view, mdia, b"mdhd")[0]
    long = view[header[0]] == 1
    scale, duration = (int(numbers(view, header, at, 1, kind)[0]) for at, kind in ([(20, ">u4"), (24, ">u8")] if long else [(12, ">u4"), (16, ">u4")]))
    codec = numbers(view, table[b"stsd"], 12, 4, "u1").astype(np.uint8).tobytes().decode("latin-1")
    fixed, n = numbers(view, table[b"stsz"], 4, 2).tolist()
    if fixed * n > len(view):
        raise Broken("more samples than bytes")
    sizes = np.full(n, fixed, np.int64) if fixed else numbers(view, table[b"stsz"], 12, n)
    where, kind = (b"co64", ">u8") if b"co64" in table else (b"stco", ">u4")
    offsets = numbers(view, table[where], 8, int(numbers(view, table[where], 4, 1)[0]), kind)
    runs = numbers(view, table[b"stsc"], 8, 3 * int(numbers(view, table[b"stsc"], 4, 1)[0])).reshape(-1, 3)
    chunks = np.diff(np.append(runs[:, 0], len(offsets) + 1))
    if n and (not len(runs) or runs[0, 0] != 1) or (chunks < 0).any() or sum(a * b for a, b in zip(chunks.tolist(), runs[:, 1].tolist(), strict=True)) != n:
        raise Broken("the chunks do not hold the samples")
    per_chunk = np.repeat(runs[:, 1], chunks)
    used = per_chunk > 0
    per_chunk, offsets = per_chunk[used], offsets[: len(per_chunk)][used]
    before = np.cumsum(sizes) - sizes
    first = np.cumsum(per_chunk) - per_chunk
    starts = before - np.repeat(before[first], per_chunk) + np.repeat(offsets, per_chunk)
    keys = numbers(view, table[b"stss"], 8, int(numbers(view, table[b"stss"], 4, 1)[0])) - 1 if b"stss" in table else np.arange(n)
    if (starts < 0).any() or (starts + sizes > len(view)).any() or (keys < 0).any() or (keys >= n).any():
        raise Broken("a sample or keyframe is not in the file")
    return {"codec": codec, "timescale": scale, "duration": duration, "n_samples": n, "n_keyframes": len(keys), "ranges": merged(starts[keys], sizes[keys]), "samples": merged(starts, sizes)}


def read_tracks(data: bytes) -> list[dict]:
    """The sound tracks of a file, in its order; see `read_track`."""
    view, out = memoryview(data), []
    for moov in inside(view, (0, len(view)), b"moov"):
        for trak in inside(view, moov, b"trak"):
            try:
                out.append(read_track(view, trak))
            except (Broken, KeyError, IndexError):  # a box is missing, or too short for what it says
                continue
    return out


def read_media(data: bytes) -> dict:
    """The first track, or what stands for none."""
    none = {"codec": None, "timescale": 0, "duration": 0, "n_samples": 0, "n_keyframes": 0, "ranges": [], "samples": []}
    return next(iter(read_tracks(data)), none)


def merged(starts: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int]]:
    """Adjoining (start, size) runs as (start, end) pairs."""
    if not len(starts):
        return []
    ends = starts + sizes
    cut = np.flatnonzero(starts[1:] != ends[:-1])
    return list(zip(starts[np.r_[0, cut + 1]].tolist(), ends[np.r_[cut, len(ends) - 1]].tolist(), strict=True))


def stored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media) of each text's UTF-8 bytes."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or b"" for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in texts], pa.int64()), pa.array([to_media(padded(x)) for x in texts], pa.binary())], ["id", "n_bytes", "media"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.encode(text_col, "UTF-8").alias("data"))
    return rows.mapInArrow(write, "id long, n_bytes long, media binary")


FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, codec string, timescale long, duration long, n_samples long, n_keyframes long, keyframe_ranges array<struct<start:long,end:long>>, feature string"


def features(media: DataFrame) -> DataFrame:
    """What the stored files say of themselves, and digests of their sample bytes."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in (x or b"" for x in batch.column(2).to_pylist()):
                m = read_media(data)
                whole, tail = hashlib.sha256(), b""
                for a, b in m["samples"]:
                    whole.update(memoryview(data)[a:b])
                    tail = (tail + data[max(a, b - UNIT) : b])[-UNIT:]
                ranges = m["ranges"]
                feature = f"{m['codec']}:{m['timescale']}:{m['duration']}:{m['n_samples']}:{m['n_keyframes']}:" + ",".join(f"{a}-{b}" for a, b in ranges)
                rows.append((sum(b - a for a, b in m["samples"]), whole.hexdigest(), zlib.crc32(tail), len(data), hashlib.sha256(data).hexdigest(), m["codec"], m["timescale"], m["duration"], m["n_samples"], m["n_keyframes"], [{"start": a, "end": b} for a, b in ranges], feature))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string()]
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]], ["id", "n_bytes", *[f.split()[0] for f in FEATURES.split(", ")]])

    return media.select("id", "n_bytes", "media").mapInArrow(read, f"id long, n_bytes long, {FEATURES}")


def tracks(media: DataFrame, id_col: str = "id", media_col: str = "media") -> DataFrame:
    """One row for each sound track of each file: (id, track, codec, timescale, duration, n_samples, n_keyframes, keyframe_ranges)."""
    schema = "codec string, timescale long, duration long, n_samples long, n_keyframes long, ranges array<struct<start:long,end:long>>"

    @F.pandas_udf(f"array<struct<{schema}>>")
    def read(files: pd.Series) -> pd.Series:
        return pd.Series([[{**{k: v for k, v in t.items() if k != "samples"}, "ranges": [{"start": a, "end": b} for a, b in t["ranges"]]} for t in read_tracks(x or b"")] for x in files], dtype=object)

    told = media.select(F.col(id_col).alias("id"), F.posexplode(read(media_col)).alias("track", "t"))
    return told.select("id", "track", "t.*").withColumnRenamed("ranges", "keyframe_ranges")
