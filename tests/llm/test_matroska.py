from __future__ import annotations

import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.llm import matroska as M


def joined(data):
    rows = M.parse(data)
    assert all(r["error"] is None for r in rows)
    return b"".join(data[r["byte_start"] : r["byte_end"]] for r in rows)


@given(st.binary(max_size=9000), st.integers(1, 500), st.integers(1, 12), st.booleans())
@settings(max_examples=80, deadline=None)
def test_frames_come_back(payload, frame, per_cluster, live):
    data = M.mux(payload, frame, per_cluster, live=live)
    assert joined(data) == payload
    rows = M.parse(data)
    assert [r["packet"] for r in rows] == list(range(len(rows)))
    for r in rows:
        assert r["crc"] == zlib.crc32(data[r["byte_start"] : r["byte_end"]])
        assert r["codec"] == {1: "S_TEXT/UTF8", 2: "B_VOBBTN"}[r["track"]]
    # the muxer's clock: 40 ms a frame, in file order
    assert [r["timestamp_ns"] for r in rows] == [i * 40_000_000 for i in range(len(rows))]


@given(st.lists(st.binary(max_size=700), min_size=2, max_size=20), st.sampled_from([1, 3]))
@settings(max_examples=80, deadline=None)
def test_lacing(frames, kind):
    body = M.laced(frames, kind)
    assert [body[a:b] for a, b in M.lace(body, 0, len(body), kind)] == frames


def test_fixed_lacing_and_bad_lacing():
    body = M.laced([b"abc"] * 5, 2)
    assert [body[a:b] for a, b in M.lace(body, 0, len(body), 2)] == [b"abc"] * 5
    for raw, kind in ((b"", 1), (b"\x02abcd", 2), (b"\x02\xff", 1), (b"\x01\xff\xff", 1), (b"\x02\x90a", 3)):
        with pytest.raises(M.Damaged):
            M.lace(raw, 0, len(raw), kind)


@given(st.integers(0, 2**56 - 2), st.integers(0, 8))
def test_vint(v, width):
    raw = M.vint(v, width)
    assert M.read_size(raw, 0, len(raw)) == (v, len(raw))


def test_all_laces_cues_and_key_frames_occur():
    rows = M.parse(M.mux(bytes(range(256)) * 60, 100))
    assert {r["lacing"] for r in rows} == {"none", "xiph", "fixed", "ebml"}
    first = {}
    for r in rows:
        first.setdefault(r["cluster"], r)
    assert all(r["cued"] and r["keyframe"] for r in first.values())
    assert not all(r["cued"] for r in rows) and not all(r["keyframe"] for r in rows)


def test_every_truncation_keeps_whole_frames():
    payload = bytes(range(256)) * 12
    data = M.mux(payload, 90)
    every = M.parse(data)
    cues_from = max(r["byte_end"] for r in every)
    for n in range(0, len(data), 7):
        rows = M.parse(data[:n])
        good = [r for r in rows if r["error"] is None]
        assert [r["byte_end"] for r in good] == [r["byte_end"] for r in every][: len(good)]
        assert len(rows) - len(good) == 1 or n >= cues_from
        assert all(r["byte_end"] <= n for r in good)


@given(st.binary(max_size=200))
@settings(max_examples=150, deadline=None)
def test_foreign_bytes_never_crash(raw):
    for data in (raw, M.box(M.EBML, b"") + raw, M.box(M.EBML, b"") + M.box(M.SEGMENT, raw), M.box(M.EBML, b"") + M.box(M.SEGMENT, M.box(M.CLUSTER, raw))):
        M.parse(data)


def test_whole_table(spark, documents, texts):
    media = M.media_of(documents).cache()
    rows = M.packets(media).collect()
    bodies = {r.doc_id: r.media for r in media.collect()}
    got = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.packet)):
        assert r.error is None
        got.setdefault(r.doc_id, []).append(bodies[r.doc_id][r.byte_start : r.byte_end])
    assert {i: b"".join(x).decode() for i, x in got.items()} == {i: t for i, t in texts.items() if t}
    payload = {}
    for r in sorted(M.frame_bytes(media, M.packets(media)).collect(), key=lambda r: (r.doc_id, r.packet)):
        payload.setdefault(r.doc_id, []).append(bytes(r.payload))
    assert payload == {i: [bytes(x) for x in xs] for i, xs in got.items()}
    media.unpersist()


def test_messy_and_empty(spark, messy, empty):
    rows = M.packets(M.media_of(messy)).collect()
    assert all(r.error is None for r in rows)
    assert {r.doc_id for r in rows} == {None, 1, 4, 5, 6, 7, 8, 9}
    assert M.packets(M.media_of(empty)).count() == 0
    bad = spark.createDataFrame([(1, bytearray(b"")), (2, None), (3, bytearray(b"not media")), (None, bytearray(M.mux(b"x")))], "doc_id long, media binary")
    got = {r.doc_id: r for r in M.packets(bad).collect()}
    assert set(got) == {1, 3, None} and got[1].error and got[3].error and got[3].packet is None and got[None].error is None


def test_hand_written_file():
    """Bytes put down from the format's description, not by the muxer: sizes of several widths, header stripping,
    Xiph lacing, a void element, two clusters that share a time, a cue that names one of them."""
    ebml = bytes.fromhex("1A45DFA3 80")
    info = bytes.fromhex("1549A966 87 2AD7B1 83 0F4240")  # scale of a million
    encodings = bytes.fromhex("6D80 8E 6240 8B 5034 88 4254 81 03 4255 81 41")  # stripped header: A
    entry = bytes.fromhex("D7 81 05 83 81 11 86 85 535F534D31") + encodings  # track 5, subtitles, S_SM1
    entry = b"\xae" + bytes([0x80 | len(entry)]) + entry
    tracks = bytes.fromhex("1654AE6B 40") + bytes([len(entry)]) + entry  # a size of two bytes
    block = bytes.fromhex("A3 8B 85 0003 82 02 01 02 62 6363 64")  # time +3, Xiph, 3 frames of 1, 2 and 1 bytes
    first = bytes.fromhex("E7 81 0A") + block
    first = bytes.fromhex("1F43B675 10 0000") + bytes([len(first)]) + first  # a size of four bytes
    void = bytes.fromhex("EC 82 0000")
    second = bytes.fromhex("E7 81 0D A3 85 85 0000 80 7A")  # the same time, 13 ms, one frame: z
    second = bytes.fromhex("1F43B675") + bytes([0x80 | len(second)]) + second
    head = len(info) + len(tracks)
    at = [head, head + len(first) + len(void)]
    cues = bytes.fromhex("1C53BB6B 8E BB 8C B3 81 0D B7 87 F7 81 05 F1 82") + at[1].to_bytes(2, "big")
    body = info + tracks + first + void + second + cues
    data = ebml + bytes.fromhex("18538067 01") + len(body).to_bytes(7, "big") + body
    rows = M.parse(data)
    assert [r["error"] for r in rows] == [None] * 4
    assert [data[r["byte_start"] : r["byte_end"]] for r in rows] == [b"b", b"cc", b"d", b"z"]
    assert [(r["track"], r["codec"], r["encoding"], r["stripped"]) for r in rows] == [(5, "S_SM1", "header", b"A")] * 4
    assert [r["crc"] for r in rows] == [zlib.crc32(b"A" + x) for x in (b"b", b"cc", b"d", b"z")]
    assert [r["timestamp_ns"] for r in rows] == [13_000_000] * 4
    assert [(r["lacing"], r["lace_index"], r["keyframe"]) for r in rows] == [("xiph", 0, True), ("xiph", 1, True), ("xiph", 2, True), ("none", 0, True)]
    assert [(r["cluster"], r["cluster_offset"], r["cued"]) for r in rows] == [(0, at[0], False)] * 3 + [(1, at[1], True)]


def test_stripped_headers_are_put_back(spark):
    track = M.box(M.NUMBER, b"\x01") + M.box(M.ENCODINGS, M.box(M.ENCODING, M.box(M.COMPRESSION, M.box(M.ALGORITHM, b"\x03") + M.box(M.SETTINGS, b"head"))))
    data = M.box(M.EBML, b"") + M.box(M.SEGMENT, M.box(M.TRACKS, M.box(M.ENTRY, track)) + M.box(M.CLUSTER, M.box(M.TIMECODE, b"\x00") + M.box(M.SIMPLE, b"\x81\0\0\x80 tail")))
    df = spark.createDataFrame([(1, data)], "doc_id long, media binary")
    assert [bytes(r.payload) for r in M.frame_bytes(df, M.packets(df)).collect()] == [b"head tail"]
