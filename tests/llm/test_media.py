"""Containers: exact round trips, tables of other writers, and damage."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from cairn.llm import media, registry


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 2047, 2048, 2049, 4096, 6144, 100_000])
def test_round_trip(n):
    data = media.padded(random.Random(n).randbytes(n))
    stored = media.mux(data)
    (track,) = media.parse(stored)
    assert media.payload(stored, track) == data and len(data) % 64 == 0 and len(data) >= 64
    at, sizes = track.keyframes()
    assert len(at) == -(-(len(data) // 64) // media.KEY_EVERY)
    assert (track.codec, track.handler, track.duration, track.timescale) == ("raw ", "soun", len(data), media.RATE)
    for a, s, k in zip(at.tolist(), sizes.tolist(), range(0, len(data), 64 * media.KEY_EVERY), strict=False):
        assert stored[a : a + s] == data[k : k + 64]


def container(sizes, chunks, stsc, sync=None, co64=False, large=False, compact=0):
    b, f = media._box, media._full
    rows = lambda fmt, xs: struct.pack(">I", len(xs)) + b"".join(struct.pack(fmt, *x) for x in xs)
    if compact:
        packed = bytes(sizes) if compact == 8 else bytes((a << 4 | c) for a, c in zip(sizes[::2], [*sizes[1::2], 0], strict=False))
        stsz = f(b"stz2", struct.pack(">I", compact), struct.pack(">I", len(sizes)), packed)
    else:
        stsz = f(b"stsz", struct.pack(">I", 0), rows(">I", [(s,) for s in sizes]))
    stbl = [f(b"stsd", struct.pack(">I", 1), b(b"avc1", bytes(78))), f(b"stts", rows(">II", [(len(sizes), 40)])), f(b"stsc", rows(">III", stsc)), stsz, f(b"co64" if co64 else b"stco", rows(">Q" if co64 else ">I", [(c,) for c in chunks]))]
    if sync is not None:
        stbl.append(f(b"stss", rows(">I", [(s,) for s in sync])))
    mdia = b(b"mdia", f(b"mdhd", struct.pack(">IIII", 0, 0, 1000, 0), bytes(4)), f(b"hdlr", bytes(4), b"vide", bytes(12)), b(b"minf", b(b"stbl", *stbl)))
    moov = b(b"moov", b(b"trak", f(b"tkhd", struct.pack(">III", 0, 0, 7), bytes(60)), mdia))
    if large:  # the same box with a 64-bit size
        moov = struct.pack(">I4sQ", 1, b"moov", len(moov) + 8) + moov[8:]
    return moov + b(b"mdat", bytes(range(200)))


@pytest.mark.parametrize("kind", [{}, {"co64": True}, {"large": True}, {"compact": 8}, {"compact": 4}])
def test_tables_of_other_writers(kind):
    sizes = [3, 5, 7, 2, 9, 1, 4]
    stsc, chunks = [(1, 2, 1), (3, 3, 1)], [100, 50, 150]
    (track,) = media.parse(container(sizes, chunks, stsc, [1, 4, 6], **kind))
    assert track.offsets.tolist() == [100, 103, 50, 57, 150, 159, 160]
    assert [x.tolist() for x in track.keyframes()] == [[100, 57, 159], [3, 2, 1]]
    assert (track.codec, track.track_id, track.duration) == ("avc1", 7, 280)
    assert media.payload(bytes(range(256)), track) == b"".join(bytes(range(o, o + s)) for o, s in zip(track.offsets.tolist(), sizes, strict=True))


def test_without_sync_table_every_sample_is_a_keyframe():
    (track,) = media.parse(container([3, 5], [100], [(1, 2, 1)]))
    assert track.keyframes()[0].tolist() == [100, 103]


def test_damage_is_reported_not_raised():
    good, rng = media.mux(media.padded(b"x" * 5000)), random.Random(5)
    for _ in range(1500):
        bad = bytearray(good)
        for _ in range(rng.randint(1, 4)):
            bad[rng.choice([rng.randrange(len(bad)), rng.randrange(len(bad) - 700, len(bad))])] = rng.randrange(256)
        try:
            for t in media.parse(bytes(bad[: rng.choice([len(bad), rng.randrange(len(bad))])])):
                assert isinstance(t.keyframes()[0], np.ndarray)
        except media.Malformed:
            pass


def test_probe_and_wrap(spark):
    df = spark.createDataFrame([(1, b"hello", "x"), (2, None, "y"), (3, b"", "z")], "id long, raw binary, MEDIA string")
    got = media.probe(media.wrap(df, "raw"), "media", "found").orderBy("id").collect()
    assert [len(r.found.tracks) for r in got] == [1, 1, 1] and got[0].found.tracks[0].codec == "raw "
    assert [(k.offset, k.size) for k in got[0].found.tracks[0].keyframes] == [(32, 64)]
    odd = media.probe(spark.createDataFrame([(1, b"not media"), (2, None), (3, b""), (4, good_cut())], "id long, v binary"), "v").orderBy("id").collect()
    assert all(r.media.error and not r.media.tracks for r in odd)
    assert media.probe(df.limit(0), "raw").count() == 0


def good_cut():
    return media.mux(media.padded(b"abc"))[:-20]


def test_query(spark, sf_dir):
    got = {r.doc_id: r for r in registry.op7_media_columns(spark, sf_dir).collect()}
    for d in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect():
        raw = (d.text or "").encode()
        data = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = got.pop(d.doc_id)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(data), hashlib.sha256(data).hexdigest())
        assert r.tail_crc32 == zlib.crc32(data[-64:]) and r.media_sha256 == hashlib.sha256(media.mux(data)).hexdigest()
    assert not got


def test_edge_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "é" * 40_000), (3, "é" * 40_000)], "doc_id long, text string")
    a, b, c, d = media.store_texts(df, keep=["doc_id"]).orderBy("doc_id").collect()
    assert a[1:] == b[1:] and c == d and a.n_bytes == 0 and a.payload_bytes == 64 and c.n_bytes == 80_000


def test_fragments():
    """A track of three samples in its tables and two fragments: defaults, sizes of their own, first-sample flags."""
    full = lambda kind, flags, *parts: media._box(kind, struct.pack(">I", flags), *parts)
    whole = media.mux(bytes(range(64)) * 3)
    trex = media._box(b"mvex", full(b"trex", 0, struct.pack(">5I", 1, 1, 10, 4, media.NOT_SYNC)))
    at = whole.index(b"moov") - 4
    moov = whole[at:]
    head = whole[:at] + struct.pack(">I", len(moov) + len(trex)) + moov[4:] + trex

    def fragment(run, body, tfhd=b"", flags=media.BASE_IS_MOOF):
        make = lambda offset: media._box(b"moof", full(b"mfhd", 0, struct.pack(">I", 1)), media._box(b"traf", full(b"tfhd", flags, struct.pack(">I", 1), tfhd), run(offset)))
        return make(len(make(0)) + 8) + media._box(b"mdat", body)

    first = fragment(lambda o: full(b"trun", media.RUN_OFFSET | media.FIRST_FLAGS, struct.pack(">IiI", 3, o, 0)), b"aaaabbbbcccc")
    second = fragment(lambda o: full(b"trun", media.RUN_OFFSET | 0x100 | 0x200 | 0x400, struct.pack(">Ii", 2, o), struct.pack(">6I", 7, 5, 0, 8, 2, media.NOT_SYNC)), b"dddddee")
    value = head + first + second
    (track,) = media.parse(value)
    assert track.n_samples == 3 + 3 + 2 and track.duration == 3 * 64 + 30 + 15
    assert media.payload(value, track) == bytes(range(64)) * 3 + b"aaaabbbbccccdddddee"
    at, sizes = track.keyframes()
    assert [value[a : a + n] for a, n in zip(at.tolist(), sizes.tolist(), strict=True)] == [bytes(range(64)), b"aaaa", b"ddddd"]
    for broken in (value[:-3], head + first.replace(b"tfhd", b"free"), head + fragment(lambda o: full(b"trun", 0, struct.pack(">I", 1 << 30)), b"")):
        with pytest.raises(media.Malformed):
            media.parse(broken)
