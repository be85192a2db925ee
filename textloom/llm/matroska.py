"""Matroska media columns: packet tables from EBML bytes.

``packets`` walks the elements of a Matroska or WebM file (variable-length ids
and sizes, unknown sizes of live files, EBML-, Xiph- and fixed-size lacing,
SimpleBlock and BlockGroup, Tracks, Info and Cues) and gives one row a frame:
track, codec, timestamp, duration, key frame, lacing and its place in it, the
cluster, the byte range of the frame in the file, and how the track's frames are
encoded.  ``stripped`` holds the bytes that header stripping took off each frame;
they go before the range, and the CRC-32 covers both.  Frames under other
compression or encryption are given as stored, with ``encoding`` saying so.  The
obsolete EncryptedBlock is skipped like any unknown element.

Defined results: null media gives no rows; empty media, foreign bytes and damaged or
truncated files give the frames found before the damage and one row with ``error``
set and the other frame fields null.  Packets of tracks that Tracks doesn't
list have a null codec.  Ties in timestamps keep file order (``packet``).  Very
long files are walked in place, without a copy.  Rows are parsed one by one;
repeated rows and null ids change nothing.  An empty table has no packets.
Columns are taken by exact name and others, whatever they are called, ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
SCALE, TIMECODE, SIMPLE, GROUP, BLOCK, REFERENCE, BLOCK_DURATION = 0x2AD7B1, 0xE7, 0xA3, 0xA0, 0xA1, 0xFB, 0x9B
ENTRY, NUMBER, KIND, CODEC, DEFAULT_DURATION = 0xAE, 0xD7, 0x83, 0x86, 0x23E383
ENCODINGS, ENCODING, COMPRESSION, ALGORITHM, SETTINGS, ENCRYPTION = 0x6D80, 0x6240, 0x5034, 0x4254, 0x4255, 0x5035
ALGORITHMS = {0: "zlib", 1: "bzlib", 2: "lzo", 3: "header"}
CUE, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
#: Children of the segment: an element of unknown size ends where one of these (or end of file) comes.
TOP = {INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1941A469, 0x1043A770, 0x1254C367}
LACES = {0: "none", 1: "xiph", 2: "fixed", 3: "ebml"}


class Damaged(ValueError):
    pass


def read_id(data: bytes, at: int, end: int) -> tuple[int, int]:
    if at >= end:
        raise Damaged("id past the end")
    n = 9 - data[at].bit_length()
    if n > 4 or at + n > end:
        raise Damaged("bad id")
    return int.from_bytes(data[at : at + n], "big"), at + n


def read_size(data: bytes, at: int, end: int) -> tuple[int | None, int]:
    """Value (None: unknown, all bits set) and the position after it."""
    if at >= end:
        raise Damaged("size past the end")
    n = 9 - data[at].bit_length()
    if n > 8 or at + n > end:
        raise Damaged("bad size")
    v = int.from_bytes(data[at : at + n], "big") & ((1 << 7 * n) - 1)
    return (None if v == (1 << 7 * n) - 1 else v), at + n


def element(data: bytes, at: int, end: int) -> tuple[int, int, int | None]:
    """(id, start of the content, its end or None where the size is unknown)."""
    key, at = read_id(data, at, end)
    size, at = read_size(data, at, end)
    if size is not None and at + size > end:
        raise Damaged(f"element {key:#x} is cut off")
    return key, at, None if size is None else at + size


def children(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    while at < end:
        key, a, b = element(data, at, end)
        if b is None:
            raise Damaged(f"element {key:#x} of unknown size")
        yield key, a, b
        at = b


def uint(data: bytes, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


def lace(data: bytes, at: int, end: int, kind: int) -> list[tuple[int, int]]:
    """Byte ranges of the frames of a block's payload."""
    if kind == 0:
        return [(at, end)]
    if at >= end:
        raise Damaged("lacing without a count")
    n = data[at] + 1
    at += 1
    sizes: list[int] = []
    if kind == 2:
        if (end - at) % n:
            raise Damaged("fixed lacing doesn't divide")
        sizes = [(end - at) // n] * (n - 1)
    elif kind == 1:
        for _ in range(n - 1):
            size = 0
            while True:
                if at >= end:
                    raise Damaged("Xiph lacing past the end")
                size += data[at]
                at += 1
                if data[at - 1] != 255:
                    break
            sizes.append(size)
    else:
        for k in range(n - 1):
            first = at
            v, at = read_size(data, at, end)
            bits = 7 * (at - first)
            if v is None:
                v = (1 << bits) - 1
            sizes.append(v if k == 0 else sizes[-1] + v - ((1 << bits - 1) - 1))
    out = []
    for size in sizes:
        if size < 0 or at + size > end:
            raise Damaged("laced frame past the end")
        out.append((at, at + size))
        at += size
    return [*out, (at, end)]


class Parser:
    def __init__(self, data: bytes):
        self.data, self.scale = data, 1_000_000
        self.tracks: dict[int, dict] = {}
        self.cues: set[tuple[int, int, int | None]] = set()  # track, time, cluster position
        self.rows: list[tuple] = []
        self.ticks: list[int] = []
        self.error: str | None = None
        self.clusters = 0
        self.segment = 0
        try:
            self.walk()
        except Damaged as e:
            self.error = str(e)

    def walk(self) -> None:
        data, end = self.data, len(self.data)
        key, a, b = element(data, 0, end)
        if key != EBML or b is None:
            raise Damaged("no EBML header")
        at = b
        while at < end:
            start = at
            key, a, b = element_or_rest(data, at, end)
            if key == SEGMENT:
                self.segment = a
                self.top(a, end if b is None else b)
            at = end if b is None else b
            if b is not None and b > end:
                raise Damaged(f"element {key:#x} at {start} is cut off")

    def top(self, at: int, end: int) -> None:
        data, cut = self.data, end > len(self.data)
        end = min(end, len(data))
        while at < end:
            place = at
            key, a, b = element_or_rest(data, at, end)
            stop = min(b, end) if b is not None else end
            if key == INFO and b is not None:
                for k, x, y in children(data, a, stop):
                    if k == SCALE:
                        self.scale = uint(data, x, y)
            elif key == TRACKS and b is not None:
                for k, x, y in children(data, a, stop):
                    if k == ENTRY:
                        got = {c: (u, v) for c, u, v in children(data, x, y)}
                        field = lambda c, d=0: uint(data, *got[c]) if c in got else d  # noqa: B023, E731
                        codec = bytes(data[slice(*got[CODEC])]).rstrip(b"\0").decode("ascii", "replace") if CODEC in got else None
                        self.tracks[field(NUMBER)] = {"codec": codec, "kind": field(KIND), "duration": field(DEFAULT_DURATION) or None} | (encoding(data, *got[ENCODINGS]) if ENCODINGS in got else {})
            elif key == CLUSTER:
                stop = self.cluster(a, stop, place - self.segment, b is None)
            elif key == CUES and b is not None:
                self.cue_points(a, stop)
            elif b is None:
                raise Damaged(f"element {key:#x} of unknown size")
            if b is not None and b > end:
                raise Damaged(f"element {key:#x} is cut off")
            at = stop
        if cut:
            raise Damaged("the segment is cut off")

    def cue_points(self, a: int, b: int) -> None:
        data = self.data
        for k, x, y in children(data, a, b):
            if k != CUE:
                continue
            time, places = 0, []
            for c, u, v in children(data, x, y):
                if c == CUE_TIME:
                    time = uint(data, u, v)
                elif c == CUE_TRACK_POSITIONS:
                    got = {d: uint(data, p, q) for d, p, q in children(data, u, v) if d in (CUE_TRACK, CUE_CLUSTER)}
                    places.append((got.get(CUE_TRACK), got.get(CUE_CLUSTER)))
            self.cues |= {(t, time, p) for t, p in places}

    def cluster(self, at: int, end: int, place: int, open_end: bool) -> int:
        """Parses a cluster; where its size is unknown it ends at the next child of the segment."""
        data, time, number = self.data, 0, self.clusters
        self.clusters += 1
        while at < end:
            before = at
            key, at = read_id(data, at, end)
            if open_end and key in TOP:
                return before
            size, at = read_size(data, at, end)
            if size is None:
                raise Damaged(f"element {key:#x} of unknown size")
            stop = at + size
            if stop > end:
                raise Damaged(f"element {key:#x} is cut off")
            if key == SIMPLE:
                self.block(at, stop, time, number, place, None, None)
            elif key == TIMECODE:
                time = uint(data, at, stop)
            elif key == GROUP:
                got = {c: (u, v) for c, u, v in children(data, at, stop)}
                if BLOCK in got:
                    self.block(*got[BLOCK], time, number, place, REFERENCE not in got, uint(data, *got[BLOCK_DURATION]) if BLOCK_DURATION in got else None)
            at = stop
        return at

    def block(self, at: int, end: int, time: int, cluster: int, place: int, key: bool | None, duration: int | None) -> None:
        data = self.data
        track, at = read_size(data, at, end)
        if at + 3 > end:
            raise Damaged("block without a header")
        shift = int.from_bytes(data[at : at + 2], "big", signed=True)
        flags = data[at + 2]
        kind = flags >> 1 & 3
        frames = lace(data, at + 3, end, kind)
        info = self.tracks.get(track, {})
        ticks = time + shift
        each = duration * self.scale // len(frames) if duration is not None else info.get("duration")
        is_key, codec, stripped = bool(flags & 0x80) if key is None else key, info.get("codec"), info.get("stripped")
        for k, (a, b) in enumerate(frames):
            crc = zlib.crc32(data[a:b]) if stripped is None else zlib.crc32(data[a:b], zlib.crc32(stripped))
            self.rows.append((len(self.rows), track, codec, ticks * self.scale + (k * each if each else 0), each, is_key, LACES[kind], k, cluster, place, a, b, crc, info.get("encoding"), stripped))
            self.ticks.append(ticks)

    def columns(self) -> list[list]:
        """One list a field of FIELDS, with a last row for the error."""
        out = [list(c) for c in zip(*self.rows)] or [[] for _ in FIELDS[:-2]]
        track, lace_index, place = (out[NAMES.index(n)] for n in ("track", "lace_index", "cluster_offset"))
        out.append([i == 0 and ((t, k, p) in self.cues or (t, k, None) in self.cues) for t, k, p, i in zip(track, self.ticks, place, lace_index)])
        out.append([None] * len(self.rows))
        if self.error:
            for c in out[:-1]:
                c.append(None)
            out[-1].append(self.error)
        return out


def encoding(data: bytes, a: int, b: int) -> dict:
    """How a track's frames are stored; several encodings are named in file order."""
    names, stripped = [], None
    for k, x, y in children(data, a, b):
        if k == ENCODING:
            got = {c: (u, v) for c, u, v in children(data, x, y)}
            if ENCRYPTION in got:
                names.append("encrypted")
            if COMPRESSION in got or ENCRYPTION not in got:
                own = {c: (u, v) for c, u, v in children(data, *got[COMPRESSION])} if COMPRESSION in got else {}
                names.append(ALGORITHMS.get(uint(data, *own[ALGORITHM]) if ALGORITHM in own else 0, "unknown"))
                if names[-1] == "header":
                    stripped = bytes(data[slice(*own[SETTINGS])]) if SETTINGS in own else b""
    return {"encoding": "+".join(names) or None, "stripped": stripped if names == ["header"] else None}


def element_or_rest(data: bytes, at: int, end: int) -> tuple[int, int, int | None]:
    """Like ``element`` but the end may lie past the data (a truncated file keeps its whole frames)."""
    key, at = read_id(data, at, end)
    size, at = read_size(data, at, end)
    return key, at, None if size is None else at + size


FIELDS = [
    ("packet", pa.int32()), ("track", pa.int64()), ("codec", pa.string()), ("timestamp_ns", pa.int64()), ("duration_ns", pa.int64()), ("keyframe", pa.bool_()), ("lacing", pa.string()), ("lace_index", pa.int32()),
    ("cluster", pa.int32()), ("cluster_offset", pa.int64()), ("byte_start", pa.int64()), ("byte_end", pa.int64()), ("crc", pa.int64()), ("encoding", pa.string()), ("stripped", pa.binary()), ("cued", pa.bool_()), ("error", pa.string()),
]
NAMES = [n for n, _ in FIELDS]
DDL = "packet int, track long, codec string, timestamp_ns long, duration_ns long, keyframe boolean, lacing string, lace_index int, cluster int, cluster_offset long, byte_start long, byte_end long, crc long, encoding string, stripped binary, cued boolean, error string"


def parse(data: bytes) -> list[dict]:
    """Packet rows of one file, with CRC-32 of each frame and whether a cue points at it."""
    return [dict(zip(NAMES, r)) for r in zip(*Parser(data).columns())]


def packets(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row a frame: the id and the packet fields."""
    slim = C.narrow(df, doc_id=id_col, media=media_col).where("media is not null")
    kind = slim.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            ids, held = [], [[] for _ in FIELDS]
            for d, raw in zip(batch.column("doc_id").to_pylist(), batch.column("media")):
                file = raw.as_buffer()
                got = Parser(memoryview(file).cast("B") if file is not None else b"").columns()
                ids += [d] * len(got[0])
                for own, more in zip(held, got):
                    own += more
                if len(ids) > 50_000:
                    yield table(id_type, ids, held)
                    ids, held = [], [[] for _ in FIELDS]
            yield table(id_type, ids, held)

    def table(id_type: pa.DataType, ids: list, columns: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids, id_type), *(pa.array(c, t) for c, (_, t) in zip(columns, FIELDS))], ["doc_id", *NAMES])

    return slim.mapInArrow(C.tidy(run), f"doc_id {kind}, {DDL}")


def frame_bytes(df: DataFrame, frames: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """The frames' payload by their byte ranges, stripped headers put back: doc_id, packet, payload."""
    slim = C.narrow(df, doc_id=id_col, media=media_col)
    joined = slim.join(frames.where("error is null").select("doc_id", "packet", "byte_start", "byte_end", "stripped"), "doc_id")
    own = F.expr("substring(media, cast(byte_start + 1 as int), cast(byte_end - byte_start as int))")
    return joined.select("doc_id", "packet", F.concat(F.coalesce("stripped", F.lit(b"")), own).alias("payload"))


# -- muxer --


def vint(v: int, width: int = 0) -> bytes:
    n = max(width, 1)
    while v >= (1 << 7 * n) - 1:
        n += 1
    return (v | 1 << 7 * n).to_bytes(n, "big")


def box(key: int, body: bytes, unknown: bool = False) -> bytes:
    head = key.to_bytes((key.bit_length() + 7) // 8, "big")
    return head + (b"\x01\xff\xff\xff\xff\xff\xff\xff" if unknown else vint(len(body))) + body


def number(v: int) -> bytes:
    return v.to_bytes(max(1, (v.bit_length() + 7) // 8), "big")


def laced(frames: list[bytes], kind: int) -> bytes:
    if kind == 0:
        return frames[0]
    head = bytes([len(frames) - 1])
    if kind == 1:
        for f in frames[:-1]:
            head += b"\xff" * (len(f) // 255) + bytes([len(f) % 255])
    elif kind == 3:
        head += vint(len(frames[0]))
        for a, b in zip(frames, frames[1:-1]):
            d = len(b) - len(a)
            n = 1
            while not -((1 << 7 * n - 1) - 1) <= d <= (1 << 7 * n - 1) - 1:
                n += 1
            head += ((d + (1 << 7 * n - 1) - 1) | 1 << 7 * n).to_bytes(n, "big")
    return head + b"".join(frames)


def mux(payload: bytes, frame: int = 400, per_cluster: int = 8, tick_ms: int = 40, live: bool = False) -> bytes:
    """A small Matroska file with the payload as frames of two tracks; lacing turns over block by block."""
    cuts = [payload[i : i + frame] for i in range(0, len(payload), frame)]
    tracks = box(TRACKS, b"".join(box(ENTRY, box(NUMBER, number(t)) + box(KIND, number(kind)) + box(CODEC, codec) + box(DEFAULT_DURATION, number(tick_ms * 1_000_000))) for t, kind, codec in ((1, 17, b"S_TEXT/UTF8"), (2, 18, b"B_VOBBTN"))))
    body = box(INFO, box(SCALE, number(1_000_000))) + tracks
    cues, k, block, tick = b"", 0, 0, 0
    while k < len(cuts):
        start = tick
        inner = box(TIMECODE, number(start))
        place = len(body)
        for n in range(per_cluster):
            if k >= len(cuts):
                break
            kind, track = block % 4, 1 + block % 2
            take = 1 if kind == 0 else 3
            frames = cuts[k : k + take]
            if kind == 2 and len({len(f) for f in frames}) > 1 or len(frames) == 1:
                kind, frames = 0, frames[:1]
            k += len(frames)
            head = vint(track) + struct.pack(">h", tick - start)
            if block % 5 == 4:
                inner += box(GROUP, box(BLOCK, head + bytes([kind << 1]) + laced(frames, kind)) + box(BLOCK_DURATION, number(tick_ms * len(frames))) + (box(REFERENCE, b"\xd8") if n else b""))
            else:
                inner += box(SIMPLE, head + bytes([kind << 1 | (0x80 if n == 0 else 0)]) + laced(frames, kind))
            if n == 0:
                cues += box(CUE, box(CUE_TIME, number(tick)) + box(CUE_TRACK_POSITIONS, box(CUE_TRACK, number(track)) + box(CUE_CLUSTER, number(place))))
            tick += tick_ms * len(frames)
            block += 1
        body += box(CLUSTER, inner, live)
    return box(EBML, box(0x4282, b"matroska")) + box(SEGMENT, body + box(CUES, cues), live)


def media_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, media): each text muxed into a Matroska file; null text gives null media."""
    slim = C.narrow(df, doc_id=id_col, text=text_col)
    kind = slim.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in C.text_chunks(batch):
                made = [None if t is None else mux(t.encode("utf-8"), live=len(t) % 7 == 0) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(made, pa.binary())], ["doc_id", "media"])

    return slim.mapInArrow(C.tidy(run), f"doc_id {kind}, media binary")
