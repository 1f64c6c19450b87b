import hashlib
import struct
import zlib

import pytest

from tallyloom.llm import media


def test_features_of_every_text(docs, rows):
    got = sorted(tuple(r) for r in media.features(docs).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32").collect())
    want = []
    for r in rows:
        raw = (r[1] or "").encode()
        pay = raw + b" " * ((-len(raw)) % 192 or (0 if raw else 192))
        want.append((r[0], len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-16:])))
    assert got == sorted(want)


@pytest.mark.parametrize("frames", [1, 15, 16, 17, 64, 65, 128, 1000])
def test_round_trip_and_tables(frames):
    data = bytes(range(256)) * 3 * frames
    data = data[: 192 * frames]
    blob = media.mux(data)
    (t,) = media.tracks(memoryview(blob))
    assert media.payload(memoryview(blob), t) == data
    assert len(t["sizes"]) == frames and t["codec"] == "raw " and t["handler"] == "soun"
    assert t["keys"].tolist() == list(range(0, frames, 16))
    got = media.probe(blob)
    assert got["seconds"] == frames * 192 / 8000 and got["error"] is None
    first = got["keyframes"][0]
    assert blob[first["offset"] : first["offset"] + first["length"]] == data[:192]


def test_damaged_files_are_reported(spark):
    blob = media.mux(b"x" * 1920)
    at = blob.index(b"stco")
    cases = [None, b"", b"abc", blob[:-300], blob[: len(blob) // 3], blob[:at] + b"free" + blob[at + 4 :], struct.pack(">I4s", 4, b"moov"), media.box(b"ftyp", b"isom")]
    got = spark.createDataFrame([(i, x, "kept") for i, x in enumerate(cases)] + [(99, blob, "kept")], "i int, content binary, media_type string")
    out = {r["i"]: r for r in media.media_columns(got).collect()}
    assert all(out[i]["media"]["error"] and out[i]["media"]["codec"] is None for i in range(len(cases)))
    assert out[99]["media"]["codec"] == "raw " and out[99]["media_type"] == "kept"


def test_variable_sizes_and_wide_offsets():
    """A file of other make: sizes by sample, 64-bit offsets, several runs, no sync table."""
    samples = [b"a" * 5, b"b" * 7, b"c", b"d" * 9]
    body = b"".join(samples[:3]) + b"gap" + samples[3]

    def build(at):
        stbl = media.box(
            b"stbl",
            media.full(b"stsd", struct.pack(">I", 1), media.box(b"avc1", bytes(78))),
            media.full(b"stts", struct.pack(">I", 2), struct.pack(">4I", 3, 10, 1, 5)),
            media.full(b"stsc", struct.pack(">I", 2), struct.pack(">6I", 1, 3, 1, 2, 1, 1)),
            media.full(b"stsz", struct.pack(">II", 0, 4), struct.pack(">4I", 5, 7, 1, 9)),
            media.full(b"co64", struct.pack(">I", 2), struct.pack(">2Q", at, at + 16)),
        )
        mdia = media.box(b"mdia", media.full(b"mdhd", bytes(8), struct.pack(">II", 100, 0), bytes(4)), media.box(b"minf", stbl))
        return media.box(b"moov", media.box(b"trak", mdia))

    n = len(build(0)) + 16
    blob = build(n) + struct.pack(">I4sQ", 1, b"mdat", 16 + len(body)) + body
    (t,) = media.tracks(memoryview(blob))
    assert media.payload(memoryview(blob), t) == b"".join(samples)
    assert (t["codec"], t["duration"], t["keys"].tolist()) == ("avc1", 35, [0, 1, 2, 3])


def test_empty_table(none):
    assert media.features(none).count() == 0


def test_claims_beyond_the_file_and_fragments_are_reported():
    blob = media.mux(b"x" * 1920)
    at = blob.index(b"stsz") + 8
    huge = blob[:at] + struct.pack(">II", 8, 4_000_000_000) + blob[at + 8 :]
    assert "beyond" in media.probe(huge)["error"]
    at = blob.index(b"stsc") + 12
    odd = blob[:at] + struct.pack(">I", 4_000_000_000) + blob[at + 4 :]
    assert media.probe(odd)["error"]
    assert "fragments" in media.probe(blob + media.box(b"moof", media.box(b"traf")))["error"]


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, media.mux(b"x" * 192), "old", "kept")], "i int, content binary, media string, codec string")
    (row,) = media.media_columns(df).collect()
    assert row["media"]["codec"] == "raw " and row["codec"] == "kept"
