"""ISO media containers (ISO/IEC 14496-12): box walking and sample tables, no payload decoding.

``probe`` reads nested boxes and sample tables of each binary value, those of movie fragments too, and
stores the codec, the duration and the byte ranges of keyframes. ``mux`` stores bytes losslessly as 8-bit samples of one
raw audio track; ``payload`` reads a track's stored bytes back through its sample table.

Defined results: null or empty values, values that aren't such containers and truncated or
inconsistent tables give a row with ``error`` set and no tracks; a track without a sync table has
every sample as a keyframe; a container with no tracks gives none. Only tables that the
container's own bytes can back are expanded, so memory is bounded by the value itself. A fragmented track's
duration is that of its tables and its fragments' samples together.
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

from cairn.llm.frames import map_columns

#: Boxes that hold boxes.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta", b"mvex"}
#: How `mux` lays out its track: bytes a sample, samples a chunk, samples from one keyframe to the next, samples a second.
UNIT, CHUNK, KEY_EVERY, RATE = 64, 32, 16, 8000
MAX_DEPTH = 16

TRACK = "struct<track_id:bigint,handler:string,codec:string,timescale:bigint,duration:bigint,seconds:double,n_samples:bigint,keyframes:array<struct<offset:bigint,size:bigint>>>"


class Malformed(ValueError):
    pass


@dataclass
class Track:
    track_id: int = 0
    handler: str = ""
    codec: str = ""
    timescale: int = 0
    duration: int = 0
    sizes: np.ndarray | int = 0
    n_samples: int = 0
    offsets: np.ndarray | None = None
    sync: np.ndarray | None = None
    stsc: np.ndarray | None = None
    chunks: np.ndarray | None = None
    defaults: tuple[int, int, int] = (0, 0, 0)  # of fragments' samples: duration, size, flags
    runs: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]] = field(default_factory=list)  # offsets, sizes, whether sync, ticks

    def ranges(self, which: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and sizes of the samples numbered ``which`` (from 0), or of all."""
        sizes = np.full(self.n_samples, self.sizes, "i8") if isinstance(self.sizes, int) else self.sizes
        return (self.offsets, sizes) if which is None else (self.offsets[which], sizes[which])

    def keyframes(self) -> tuple[np.ndarray, np.ndarray]:
        return self.ranges(self.sync)


def boxes(data: memoryview, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """Kind, first content byte and end of each box from start to end."""
    while start < end:
        if end - start < 8:
            raise Malformed("box header is cut off")
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            if end - start < 16:
                raise Malformed("box header is cut off")
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            raise Malformed(f"box {kind!r} reaches beyond what holds it")
        yield kind, start + head, start + size
        start += size


def _table(data: memoryview, at: int, end: int, row: str) -> np.ndarray:
    """A full box's counted table."""
    n = struct.unpack_from(">I", data, at + 4)[0]
    kind = np.dtype(row)
    if at + 8 + n * kind.itemsize > end:
        raise Malformed("table is cut off")
    return np.frombuffer(data, kind, n, at + 8)


#: Flags of the fragment boxes, and that of a sample that isn't a keyframe (fixed values).
BASE_OFFSET, DESCRIPTION, DURATION, SIZE, FLAGS, BASE_IS_MOOF = 0x1, 0x2, 0x8, 0x10, 0x20, 0x20000
RUN_OFFSET, FIRST_FLAGS, EACH = 0x1, 0x4, (0x100, 0x200, 0x400, 0x800)
NOT_SYNC = 0x10000


def _extends(data: memoryview, at: int, end: int, tracks: list[Track]) -> None:
    """Defaults of a track's fragments (trex)."""
    own, _, duration, size, flags = struct.unpack_from(">5I", data, at + 4)
    for t in tracks:
        if t.track_id == own:
            t.defaults = duration, size, flags


def _fragment(data: memoryview, moof: int, at: int, end: int, tracks: list[Track], after: int) -> int:
    """One track's fragment (traf): its runs' samples. Returns where its data end, which is where the next track's
    begin if nothing says otherwise."""
    track, base, defaults = None, moof, (0, 0, 0)
    for kind, a, b in boxes(data, at, end):
        if kind == b"tfhd":
            flags, own = struct.unpack_from(">II", data, a)
            flags &= 0xFFFFFF
            track = next((t for t in tracks if t.track_id == own), None)
            if track is None:
                raise Malformed("a fragment's track isn't there")
            a, values, base = a + 8, list(track.defaults), moof if flags & BASE_IS_MOOF else after
            if flags & BASE_OFFSET:
                base, a = struct.unpack_from(">Q", data, a)[0], a + 8
            a += 4 * bool(flags & DESCRIPTION)
            for i, bit in enumerate((DURATION, SIZE, FLAGS)):
                if flags & bit:
                    values[i], a = struct.unpack_from(">I", data, a)[0], a + 4
            defaults, after = tuple(values), base
        elif kind == b"trun":
            if track is None:
                raise Malformed("a run without its fragment's header")
            flags, n = struct.unpack_from(">II", data, a)
            flags, a, first = flags & 0xFFFFFF, a + 8, None
            if flags & RUN_OFFSET:
                after, a = base + struct.unpack_from(">i", data, a)[0], a + 4
            if flags & FIRST_FLAGS:
                first, a = struct.unpack_from(">I", data, a)[0], a + 4
            held = [bit for bit in EACH if flags & bit]
            if a + 4 * n * len(held) > b or not held and n * max(1, defaults[1]) > len(data):
                raise Malformed("table is cut off")
            table = dict(zip(held, np.frombuffer(data, ">u4", n * len(held), a).reshape(n, len(held)).T.astype("i8"), strict=True))
            duration, sizes, kinds = (table.get(bit, np.full(n, default, "i8")) for bit, default in zip(EACH, defaults, strict=False))
            if first is not None and n:
                kinds = kinds.copy()
                kinds[0] = first
            track.runs.append((after + np.cumsum(sizes) - sizes, sizes, (kinds & NOT_SYNC) == 0, int(duration.sum())))
            after += int(sizes.sum())
    return after


def _walk(data: memoryview, start: int, end: int, tracks: list[Track], depth: int = 0) -> None:
    if depth > MAX_DEPTH:
        raise Malformed("boxes are nested too deeply")
    at_box = start
    for kind, at, to in boxes(data, start, end):
        here, at_box = at_box, to
        if kind == b"moof":
            after = here
            for inner, a, b in boxes(data, at, to):
                if inner == b"traf":
                    after = _fragment(data, here, a, b, tracks, after)
            continue
        if kind == b"trex":
            _extends(data, at, to, tracks)
            continue
        if kind == b"trak":
            tracks.append(Track())
        if kind in CONTAINERS:
            _walk(data, at, to, tracks, depth + 1)
        elif not tracks:
            continue
        elif kind == b"tkhd":
            tracks[-1].track_id = struct.unpack_from(">I", data, at + (20 if data[at] == 1 else 12))[0]
        elif kind == b"mdhd":
            tracks[-1].timescale, tracks[-1].duration = struct.unpack_from(">IQ", data, at + 20) if data[at] == 1 else struct.unpack_from(">II", data, at + 12)
        elif kind == b"hdlr" and not tracks[-1].handler:
            tracks[-1].handler = bytes(data[at + 8 : at + 12]).decode("latin-1")
        elif kind == b"stsd":
            if struct.unpack_from(">I", data, at + 4)[0]:
                tracks[-1].codec = bytes(data[at + 12 : at + 16]).decode("latin-1")
        elif kind == b"stts":
            t = _table(data, at, to, ">u4,>u4")
            if not tracks[-1].duration:
                tracks[-1].duration = int((t["f0"].astype("i8") * t["f1"].astype("i8")).sum())
        elif kind == b"stsc":
            tracks[-1].stsc = _table(data, at, to, ">u4,>u4,>u4")
        elif kind == b"stsz":
            size, n = struct.unpack_from(">II", data, at + 4)
            if size:
                if n * size > len(data):
                    raise Malformed("samples reach beyond the file")
                tracks[-1].sizes, tracks[-1].n_samples = size, n
            else:
                tracks[-1].sizes = _table(data, at + 4, to, ">u4").astype("i8")
                tracks[-1].n_samples = len(tracks[-1].sizes)
        elif kind == b"stz2":
            bits, n = data[at + 7], struct.unpack_from(">I", data, at + 8)[0]
            if bits not in (4, 8, 16) or at + 12 + (n * bits + 7) // 8 > to:
                raise Malformed("table is cut off")
            raw = np.frombuffer(data, "u1", (n * bits + 7) // 8, at + 12)
            tracks[-1].sizes = {4: lambda: np.stack([raw >> 4, raw & 15], 1).ravel()[:n], 8: lambda: raw, 16: lambda: raw.view(">u2")}[bits]().astype("i8")
            tracks[-1].n_samples = n
        elif kind in (b"stco", b"co64"):
            tracks[-1].chunks = _table(data, at, to, ">u4" if kind == b"stco" else ">u8").astype("i8")
        elif kind == b"stss":
            tracks[-1].sync = _table(data, at, to, ">u4").astype("i8") - 1


def _joined(track: Track, length: int) -> None:
    """The samples of the tables, followed by those of the fragments."""
    if not track.runs:
        return
    n = track.n_samples
    at, sizes = track.ranges()
    sync = np.arange(n) if track.sync is None else track.sync
    parts, places, ticks = [], n, 0
    for offsets, own, key, ran in track.runs:
        if len(own) and ((offsets < 0).any() or (offsets + own > length).any()):
            raise Malformed("samples reach beyond the file")
        parts.append(np.flatnonzero(key) + places)
        places, ticks = places + len(own), ticks + ran
    track.offsets, track.sizes = (np.concatenate([x, *[r[k] for r in track.runs]]).astype("i8") for k, x in enumerate((at, sizes)))
    track.sync, track.n_samples, track.duration = np.concatenate([sync, *parts]).astype("i8"), places, (track.duration if n else 0) + ticks


def _place(track: Track, length: int) -> None:
    """Sample offsets from the chunk tables."""
    n = track.n_samples
    if not n:
        track.offsets, track.sync, track.sizes = np.empty(0, "i8"), np.empty(0, "i8"), np.empty(0, "i8")
        return
    if track.chunks is None or track.stsc is None or not len(track.stsc):
        raise Malformed("sample table is incomplete")
    first = np.append(track.stsc["f0"].astype("i8") - 1, len(track.chunks))
    runs, each = np.diff(first), track.stsc["f1"].astype("i8")
    if first[0] or (runs < 0).any() or int((runs * each).sum()) != n or (each < 1).any():
        raise Malformed("chunks and samples don't agree")
    per_chunk = np.repeat(each, runs)
    sizes = np.full(n, track.sizes, "i8") if isinstance(track.sizes, int) else track.sizes
    before = np.cumsum(sizes) - sizes
    starts = np.cumsum(per_chunk) - per_chunk
    track.offsets = np.repeat(track.chunks - before[starts], per_chunk) + before
    if (track.offsets < 0).any() or (track.offsets + sizes > length).any():
        raise Malformed("samples reach beyond the file")
    if track.sync is not None and len(track.sync) and (track.sync.min() < 0 or track.sync.max() >= n):
        raise Malformed("keyframes reach beyond the samples")


def parse(value: bytes | None) -> list[Track]:
    """The tracks of one container; raises Malformed."""
    if not value:
        raise Malformed("empty")
    data, tracks = memoryview(value), []
    if bytes(data[4:8]) not in (b"ftyp", b"moov", b"mdat", b"free", b"skip", b"wide", b"styp"):
        raise Malformed("not an ISO media container")
    try:
        _walk(data, 0, len(data), tracks)
        for t in tracks:
            _place(t, len(data))
            _joined(t, len(data))
    except (struct.error, IndexError) as e:
        raise Malformed("box is cut off") from e
    return tracks


def payload(value: bytes, track: Track) -> bytes:
    """A track's stored bytes in sample order; samples that touch are read together."""
    at, sizes = track.ranges()
    if not len(at):
        return b""
    ends = at + sizes
    cut = np.flatnonzero(np.append(True, at[1:] != ends[:-1]))
    stop = np.append(cut[1:], len(at)) - 1
    return b"".join(value[a:b] for a, b in zip(at[cut].tolist(), ends[stop].tolist(), strict=True))


def _box(kind: bytes, *parts: bytes) -> bytes:
    size = 8 + sum(map(len, parts))
    return b"".join((struct.pack(">I4s", size, kind), *parts)) if size < 1 << 32 else b"".join((struct.pack(">I4sQ", 1, kind, size + 8), *parts))


def _full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags), *parts)


def padded(data: bytes) -> bytes:
    """Zero bytes up to a positive multiple of the sample size."""
    return data + bytes(max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


_MATRIX = struct.pack(">9I", 1 << 16, 0, 0, 0, 1 << 16, 0, 0, 0, 1 << 30)
_FTYP = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")
_HDLR = _full(b"hdlr", bytes(4), b"soun", bytes(12), b"bytes\0")
_STSD = _full(b"stsd", struct.pack(">I", 1), _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16)))
_DINF = _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1)))
_SMHD = _full(b"smhd", bytes(4))


def mux(data: bytes) -> bytes:
    """One raw 8-bit audio track of the bytes, whose length is a positive multiple of the sample size."""
    n, rest = divmod(len(data), UNIT)
    if rest or not n:
        raise ValueError("payload isn't a positive multiple of the sample size")
    media = _box(b"mdat", data)
    base = len(_FTYP) + len(media) - len(data)
    n_chunks, tail = -(-n // CHUNK), n % CHUNK
    at = base + np.arange(n_chunks, dtype="i8") * (CHUNK * UNIT)
    wide = int(at[-1]) >= 1 << 32
    groups = [(1, CHUNK, 1)] * (n >= CHUNK) + [(n_chunks, tail, 1)] * bool(tail)
    sync = np.arange(1, n + 1, KEY_EVERY, dtype=">u4")
    ticks = n * UNIT
    clock = struct.pack(">QQIQ", 0, 0, RATE, ticks)
    table = _box(
        b"stbl",
        _STSD,
        _full(b"stts", struct.pack(">III", 1, n, UNIT)),
        _full(b"stss", struct.pack(">I", len(sync)), sync.tobytes()),
        _full(b"stsc", struct.pack(">I", len(groups)), *(struct.pack(">III", *g) for g in groups)),
        _full(b"stsz", struct.pack(">II", UNIT, n)),
        _full(b"co64" if wide else b"stco", struct.pack(">I", n_chunks), at.astype(">u8" if wide else ">u4").tobytes()),
    )
    head = _full(b"mvhd", clock, struct.pack(">IHH", 1 << 16, 1 << 8, 0), bytes(8), _MATRIX, bytes(24), struct.pack(">I", 2), flags=1 << 24)
    track = _full(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, ticks), bytes(8), struct.pack(">HHHH", 0, 0, 1 << 8, 0), _MATRIX, bytes(8), flags=1 << 24 | 7)
    mdhd = _full(b"mdhd", clock, struct.pack(">HH", 0x55C4, 0), flags=1 << 24)
    return b"".join((_FTYP, media, _box(b"moov", head, _box(b"trak", track, _box(b"mdia", mdhd, _HDLR, _box(b"minf", _SMHD, _DINF, table))))))


def probe(df: DataFrame, media_col: str, out_col: str = "media") -> DataFrame:
    """Add ``struct<error, tracks>`` of each binary value."""
    spec = f"struct<error:string,tracks:array<{TRACK}>>"
    key = pa.struct([("offset", pa.int64()), ("size", pa.int64())])
    kind = pa.struct([("track_id", pa.int64()), ("handler", pa.string()), ("codec", pa.string()), ("timescale", pa.int64()), ("duration", pa.int64()), ("seconds", pa.float64()), ("n_samples", pa.int64()), ("keyframes", pa.list_(key))])
    out = pa.struct([("error", pa.string()), ("tracks", pa.list_(kind))])

    def run(columns):
        rows = []
        for v in columns[0]:
            try:
                tracks = parse(v.as_py())
            except Malformed as e:
                rows.append({"error": str(e), "tracks": []})
                continue
            rows.append({"error": None, "tracks": [
                {"track_id": t.track_id, "handler": t.handler, "codec": t.codec, "timescale": t.timescale, "duration": t.duration, "seconds": t.duration / t.timescale if t.timescale else None, "n_samples": t.n_samples,
                 "keyframes": [{"offset": a, "size": b} for a, b in zip(*(x.tolist() for x in t.keyframes()), strict=True)]}
                for t in tracks
            ]})
        return [pa.array(rows, out)]

    return map_columns(df, [media_col], f"`{out_col}` {spec}", lambda: run)


def wrap(df: DataFrame, bytes_col: str, out_col: str = "media") -> DataFrame:
    """Store each binary value, zero-padded (null as empty), as a container."""
    return map_columns(df, [bytes_col], f"`{out_col}` binary", lambda: lambda c: [pa.array([mux(padded(v.as_py() or b"")) for v in c[0]], pa.binary())])


def feature(track: Track) -> str:
    """Codec, duration, sample and keyframe counts, first and last keyframe range, and a digest of all ranges."""
    at, sizes = track.keyframes()
    ranges = np.stack([at, at + sizes], 1).astype("<i8")
    digest = hashlib.sha256(ranges.tobytes()).hexdigest()[:16]
    return f"{track.codec.strip()} {track.duration}/{track.timescale} samples={track.n_samples} keyframes={len(at)} first={at[0]}-{at[0] + sizes[0]} last={at[-1]}-{at[-1] + sizes[-1]} ranges={digest}"


def store_texts(df: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Store each text's padded UTF-8 as a container, parse the container, read its payload back and digest both.

    The containers stay in the worker: only their digests leave it. A null text is the empty one.
    """

    def run(columns):
        rows = []
        for t in columns[0]:
            raw = (t.as_py() or "").encode()
            stored = mux(padded(raw))
            track = parse(stored)[0]
            back = payload(stored, track)
            rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(track)))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        return [pa.array(x, k) for x, k in zip(zip(*rows, strict=True) if rows else [[]] * 7, kinds, strict=True)]

    return map_columns(df, [text_col], "n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string", lambda: run, keep)
