"""Media columns: ISO media containers read by their boxes alone.

``probe`` walks the nested boxes of a file and decodes its sample tables. It gives codec, duration and
the byte ranges of keyframes; payload bytes are never decoded. ``mux`` writes bytes as 8-bit samples
of an audio track, ``payload`` reads a track's samples back.

A null or damaged file, or one whose samples are in fragments, gives nulls and a reason in ``error``, whatever
counts it claims; an empty text is stored as one frame of spaces; rows with equal bytes get equal results; a
very long one has as many samples as it takes. All other columns of the table are kept, but one named as the
new one, which is replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm import common

#: Bytes of a stored sample, samples of a chunk, a keyframe every so many samples, samples a second.
FRAME, CHUNK, GOP, RATE = 192, 64, 16, 8000
CODEC = b"raw "
#: Boxes that hold boxes.
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"moof", b"traf", b"mvex"}
UNITY = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def box(kind: bytes, *parts: bytes) -> bytes:
    size = 8 + sum(map(len, parts))
    return b"".join([struct.pack(">I4s", size, kind) if size < 1 << 32 else struct.pack(">I4sQ", 1, kind, size + 8), *parts])


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def padded(raw: bytes) -> bytes:
    """With spaces up to a positive multiple of a frame."""
    return raw + b" " * (-len(raw) % FRAME if raw else FRAME)


def mux(data: bytes) -> bytes:
    """A container whose only track has the bytes as samples of ``FRAME`` 8-bit values each."""
    n = len(data) // FRAME
    ftyp = box(b"ftyp", b"qt  ", struct.pack(">I", 0), b"qt  isom")
    chunks = -(-n // CHUNK)
    runs = [(1, CHUNK, 1)] * (n >= CHUNK) + [(n // CHUNK + 1, n % CHUNK, 1)] * (n % CHUNK > 0)
    keys = np.arange(1, n + 1, GOP, dtype=">u4")
    entry = box(CODEC, bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16))

    def moov(first: int) -> bytes:
        at = first + np.arange(chunks, dtype=np.uint64) * np.uint64(CHUNK * FRAME)
        wide = first + len(data) >= 1 << 32
        table = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, n, FRAME)),
            full(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
            full(b"stsc", struct.pack(">I", len(runs)), b"".join(struct.pack(">III", *r) for r in runs)),
            full(b"stsz", struct.pack(">II", FRAME, n)),
            full(b"co64" if wide else b"stco", struct.pack(">I", chunks), at.astype(">u8" if wide else ">u4").tobytes()),
        )
        length = struct.pack(">IQ", RATE, n * FRAME)
        media = box(
            b"mdia",
            full(b"mdhd", bytes(16), length, struct.pack(">HH", 0x55C4, 0), version=1),
            full(b"hdlr", bytes(4), b"soun", bytes(12), b"\0"),
            box(b"minf", full(b"smhd", bytes(4)), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), table),
        )
        track = box(b"trak", full(b"tkhd", bytes(16), struct.pack(">II", 1, 0), struct.pack(">Q", n * FRAME), bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), UNITY, bytes(8), version=1, flags=3), media)
        head = full(b"mvhd", bytes(16), length, struct.pack(">IHH", 0x10000, 0x100, 0), bytes(8), UNITY, bytes(24), struct.pack(">I", 2), version=1)
        return box(b"moov", head, track)

    skip = 8 if len(data) + 8 < 1 << 32 else 16
    first = len(ftyp) + len(moov(0)) + skip
    index = moov(first)
    if len(ftyp) + len(index) + skip != first:  # the offsets needed the wide form
        first = len(ftyp) + len(index) + skip
        index = moov(first)
    return b"".join([ftyp, index, box(b"mdat", data)])


def boxes(blob: memoryview, start: int, stop: int) -> Iterator[tuple[bytes, int, int]]:
    """Kind, start and end of the content of each box between two offsets."""
    while start < stop:
        if stop - start < 8:
            raise ValueError("a box is cut off")
        size, kind = struct.unpack_from(">I4s", blob, start)
        head = 8
        if size == 1:
            (size,), head = struct.unpack_from(">Q", blob, start + 8), 16
        elif size == 0:
            size = stop - start
        if size < head or start + size > stop:
            raise ValueError(f"box {kind.decode('latin1')} has a wrong size")
        yield kind, start + head, start + size
        start += size


def walk(blob: memoryview, start: int, stop: int, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """All boxes, each with its path, however deep they are nested."""
    stack = [(path, start, stop)]
    while stack:
        path, start, stop = stack.pop()
        for kind, a, b in boxes(blob, start, stop):
            yield (*path, kind), a, b
            if kind in NESTED:
                stack.append(((*path, kind), a, b))


def numbers(blob: memoryview, at: int, count: int, kind: str, stop: int) -> np.ndarray:
    if at + count * np.dtype(kind).itemsize > stop:
        raise ValueError("a sample table is cut off")
    return np.frombuffer(blob, kind, count, at).astype(np.int64)


def tracks(blob: memoryview) -> list[dict[str, Any]]:
    """For each track: handler, codec, timescale, duration, and offsets, sizes and keyframes of its samples."""
    found: list[dict[bytes, tuple[int, int]]] = []
    for kind, a, b in boxes(blob, 0, len(blob)):
        if kind == b"moof":
            raise ValueError("samples in movie fragments aren't decoded")
        if kind == b"moov":
            for inner, c, d in boxes(blob, a, b):
                if inner == b"trak":
                    found.append({p[-1]: (x, y) for p, x, y in walk(blob, c, d)})
    out = []
    for t in found:
        if not {b"mdhd", b"stsd", b"stsc", b"stsz", b"stts"} <= t.keys() or not {b"stco", b"co64"} & t.keys():
            raise ValueError("a track lacks a table")
        at, _ = t[b"mdhd"]
        timescale, duration = struct.unpack_from(">IQ", blob, at + 20) if blob[at] == 1 else struct.unpack_from(">II", blob, at + 12)
        at, stop = t[b"stsz"]
        same, n = struct.unpack_from(">II", blob, at + 4)
        if same and n * same > len(blob):
            raise ValueError("a sample lies beyond the file")
        sizes = np.full(n, same, np.int64) if same else numbers(blob, at + 12, n, ">u4", stop)
        at, stop = t.get(b"stco") or t[b"co64"]
        chunk_at = numbers(blob, at + 8, struct.unpack_from(">I", blob, at + 4)[0], ">u4" if b"stco" in t else ">u8", stop)
        at, stop = t[b"stsc"]
        runs = numbers(blob, at + 8, 3 * struct.unpack_from(">I", blob, at + 4)[0], ">u4", stop).reshape(-1, 3)
        times = np.diff(np.append(runs[:, 0], len(chunk_at) + 1))
        if (times < 0).any() or times.sum() != len(chunk_at):
            raise ValueError("the tables disagree on the number of chunks")
        each = np.repeat(runs[:, 1], times)
        if each.sum() != n:
            raise ValueError("the tables disagree on the number of samples")
        chunk = np.repeat(np.arange(len(each)), each)
        before = np.cumsum(sizes) - sizes
        first = np.cumsum(each) - each
        offsets = chunk_at[chunk] + before - before[first[chunk]] if n else np.zeros(0, np.int64)
        if n and (offsets + sizes).max() > len(blob):
            raise ValueError("a sample lies beyond the file")
        keys = np.arange(n)
        if b"stss" in t:
            at, stop = t[b"stss"]
            keys = numbers(blob, at + 8, struct.unpack_from(">I", blob, at + 4)[0], ">u4", stop) - 1
            if len(keys) and (keys.min() < 0 or keys.max() >= n):
                raise ValueError("a keyframe isn't a sample")
        at, stop = t[b"stts"]
        deltas = numbers(blob, at + 8, 2 * struct.unpack_from(">I", blob, at + 4)[0], ">u4", stop).reshape(-1, 2)
        at, _ = t[b"stsd"]
        out.append({
            "handler": bytes(blob[t[b"hdlr"][0] + 8 : t[b"hdlr"][0] + 12]).decode("latin1") if b"hdlr" in t else "",
            "codec": bytes(blob[at + 12 : at + 16]).decode("latin1"), "timescale": timescale, "duration": duration or int((deltas[:, 0] * deltas[:, 1]).sum()),
            "offsets": offsets, "sizes": sizes, "keys": keys,
        })
    return out


def payload(blob: memoryview, track: dict[str, Any]) -> bytes:
    """The track's stored bytes, in the order of its samples."""
    offsets, sizes = track["offsets"], track["sizes"]
    if not len(offsets):
        return b""
    cut = np.flatnonzero(offsets[1:] != offsets[:-1] + sizes[:-1]) + 1
    first, last = np.append(0, cut), np.append(cut, len(offsets)) - 1
    return b"".join([blob[a:b] for a, b in zip(offsets[first].tolist(), (offsets[last] + sizes[last]).tolist())])


KINDS = "struct<codec:string,handler:string,timescale:long,duration:long,seconds:double,n_samples:long,keyframes:array<struct<offset:long,length:long>>,error:string>"


def probe(blob: bytes | None) -> dict[str, Any]:
    """What is known of a file's first video track, or of its first track if it has none."""
    out: dict[str, Any] = dict.fromkeys(("codec", "handler", "timescale", "duration", "seconds", "n_samples", "keyframes", "error"))
    try:
        if blob is None:
            raise ValueError("no file")
        if not (found := tracks(memoryview(blob))):
            raise ValueError("no track")
    except (ValueError, struct.error, IndexError) as e:
        return out | {"error": str(e)}
    t = next((t for t in found if t["handler"] == "vide"), found[0])
    keys = zip(t["offsets"][t["keys"]].tolist(), t["sizes"][t["keys"]].tolist())
    return out | {k: t[k] for k in ("codec", "handler", "timescale", "duration")} | {
        "seconds": t["duration"] / t["timescale"] if t["timescale"] else None, "n_samples": len(t["sizes"]), "keyframes": [{"offset": a, "length": b} for a, b in keys],
    }


def media_columns(df: DataFrame, column: str = "content", name: str = "media") -> DataFrame:
    """Add a struct ``name`` with what ``probe`` finds in the binary ``column``; no other column changes."""
    common.small_batches(df.sparkSession)

    @F.udf(KINDS, useArrow=True)
    def found(blob):
        return probe(None if blob is None else bytes(blob))

    return df.withColumn(name, found(F.col(column)))


def stored(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``content``: every text in UTF-8, padded and stored in a container."""
    common.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([mux(padded(x.encode())) for x in b.column("text").to_pylist()], pa.binary())], ["doc_id", "content"])

    return common.with_text(docs).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, content binary")


def features(docs: DataFrame) -> DataFrame:
    """Store every text, read it back, and describe it; files aren't kept.

    ``feature`` names codec, duration, samples, keyframes, and a checksum of the keyframes' byte ranges.
    """
    common.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            rows = []
            for text in b.column("text").to_pylist():
                raw = text.encode()
                blob = mux(padded(raw))
                (track,) = tracks(memoryview(blob))
                back = payload(memoryview(blob), track)
                ranges = np.stack([track["offsets"][track["keys"]], track["sizes"][track["keys"]]], 1).astype("<i8")
                feature = f"{track['codec'].strip()};{track['handler']};{track['duration']}/{track['timescale']}s;{len(track['sizes'])} samples;{len(ranges)} keyframes;{zlib.crc32(ranges.tobytes()):08x}"
                rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(blob), hashlib.sha256(blob).hexdigest(), feature))
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(pa.array(c, pa.string() if i in (2, 5, 6) else pa.int64()) for i, c in enumerate(cols))],
                ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )

    return common.with_text(docs).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
