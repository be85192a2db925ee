"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Pre-tokens are cut in numpy, a chunk at a time, by tables of character classes
that ``regex`` fills (``PATTERN`` only; other patterns are cut by ``regex``), and
told apart by hashes whose bytes are compared afterwards.  Those of at most
``SHORT`` bytes that are new are merged side by side: in each round every one
merges its leftmost pair of lowest rank, found as the least of a column.  Rounds
grow with the length, so longer ones go through the queue.

Queue: pre-tokens are doubly linked lists of parts, laid out one after the other.
Every adjacent pair with a merge rank is an entry, its left position, in the
bucket of that rank; a three-level bitmap over ranks finds the lowest non-empty
bucket by find-first-set, and entries whose pair has changed since are skipped
when popped.  A pre-token of n bytes costs O(n) entries, so megabyte-long ones
are no slower a byte than words.  Within a rank, positions are popped left to
right, as the merge rule demands.  Pairs never cross pre-tokens, so all long
pre-tokens of a chunk share one queue, filled from a table of byte pairs.

Distinct pre-tokens are encoded once and remembered, as packed ids, in a table a
worker, of at most ``CACHE_TOKENS`` entries of at most ``SHORT``
bytes beside those of the chunk in hand; when it is full, those that the
chunk doesn't use are forgotten, which only costs time.  The table of mergeable
pairs is complete from the start: every split of every piece into two pieces.

Defined results: null text gives null ids and n_tokens 0; empty text gives no
ids.  Very long texts are encoded whole.  Decoding ids returns the bytes; ids
outside the vocabulary raise.  Of equal ranks the leftmost pair merges first, so
there are no ties.  Rows are encoded one by one; repeated rows and null doc_ids
change nothing.  An empty table gives an empty result.  Columns are taken by exact
name and others, whatever they are called, ignored.  The vocabulary is a file that
every executor must see under the same path: on shared storage, in its image, or
sent along with ``spark.files``.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import common as C

CACHE_TOKENS, SHORT, BLOCK = 200_000, 64, 1 << 13
LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"


class RankQueue:
    """Buckets a rank; three levels of 64-bit words say which are not empty."""

    def __init__(self, size: int):
        self.low = [0] * ((size >> 6) + 1)
        self.mid = [0] * ((size >> 12) + 1)
        self.top = 0
        self.bucket: dict[int, list[int]] = {}

    def mark(self, rank: int) -> None:
        i = rank >> 6
        self.low[i] |= 1 << (rank & 63)
        j = i >> 6
        self.mid[j] |= 1 << (i & 63)
        self.top |= 1 << j

    def push(self, rank: int, position: int) -> None:
        got = self.bucket.get(rank)
        if got is None:
            self.bucket[rank] = [position]
            self.mark(rank)
        else:
            got.append(position)

    def put(self, rank: int, positions: list[int]) -> None:
        """Many entries at once."""
        got = self.bucket.get(rank)
        if got is None:
            self.bucket[rank] = positions
            self.mark(rank)
        else:
            got.extend(positions)

    def pop(self) -> tuple[int, list[int]] | None:
        """The lowest rank with its positions, in order; the bucket is emptied."""
        if not self.top:
            return None
        j = (self.top & -self.top).bit_length() - 1
        m = self.mid[j]
        i = (j << 6) + (m & -m).bit_length() - 1
        w = self.low[i]
        bit = w & -w
        rank = (i << 6) + bit.bit_length() - 1
        w ^= bit
        self.low[i] = w
        if not w:
            m &= m - 1
            self.mid[j] = m
            if not m:
                self.top &= self.top - 1
        positions = self.bucket.pop(rank)
        if len(positions) > 1:
            positions.sort()
        return rank, positions


@cache
def classes() -> np.ndarray:
    """Class of every code point as ``regex`` sees it."""
    points = np.delete(np.arange(0x110000, dtype="<u4"), np.s_[0xD800:0xE000])
    text = points.tobytes().decode("utf-32-le")
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, text):
            out[points[m.start() : m.end()]] = kind
    return out


def pre_tokens(offsets: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Where each match of ``PATTERN`` begins, in bytes; texts lie one after the other."""
    n, at = len(raw), None
    points = raw
    if n and raw.max() >= 0x80:
        points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), "<u4")
        n = len(points)
        at = np.flatnonzero((raw & 0xC0) != 0x80)
    kind = classes()[points]
    text = np.zeros(n + 1, bool)  # a text begins; all of them end at n
    text[offsets if at is None else np.searchsorted(at, offsets)] = True
    text[n] = True
    start = text.copy()
    start[1:n] |= kind[1:] != kind[:-1]
    run = start.copy()
    # white space before more of its text: its last character is apart, and if that is a blank, it begins what follows
    last = np.flatnonzero((kind == SPACE) & run[1:] & ~text[1:])
    start[last] = True
    start[last[points[last] == 32] + 1] = False
    # 's 't 'm 'd 're 've 'll where no match has taken the apostrophe
    i = np.flatnonzero((points == 39) & run[:n])
    i = i[text[i] | (points[i - 1] != 32)]
    i = i[~text[i + 1]]
    a, b = points[i + 1], points[np.minimum(i + 2, n - 1)]
    two = ((b == 101) & ((a == 114) | (a == 118)) | (a == 108) & (b == 108)) & ~text[i + 2]
    one = (a == 115) | (a == 116) | (a == 109) | (a == 100)
    i, two = i[one | two], two[one | two]
    start[i + 1] = False
    start[i + 2 + two] = True
    found = np.flatnonzero(start[:n])
    return found if at is None else at[found]


class PairTable:
    """Merge ranks of pairs of ids: an open-addressing table that is asked for many at once."""

    FREE = C.U64(0xFFFFFFFFFFFFFFFF)

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, size: int):
        bits = max(4, 2 + len(rank).bit_length())
        self.size, self.shift, self.mask = C.U64(size), C.U64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, self.FREE), np.full(1 << bits, -1, np.int32)
        key, slot = self.slots(left, right)
        while len(key):
            free = self.keys[slot] == self.FREE
            self.keys[slot[free]] = key[free]
            mine = self.keys[slot] == key
            self.values[slot[mine]] = rank[mine]
            key, rank, slot = key[~mine], rank[~mine], (slot[~mine] + 1) & self.mask

    def slots(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left.astype(C.U64) * self.size + right.astype(C.U64)
        return key, ((key * C.BASE) >> self.shift).view(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks, -1 for pairs that don't merge."""
        key, slot = self.slots(left, right)
        there = self.keys[slot]
        out = np.where(there == key, self.values[slot], np.int32(-1))
        todo = np.flatnonzero((there != key) & (there != self.FREE))
        slot = slot[todo]
        while len(todo):
            slot = (slot + 1) & self.mask
            there = self.keys[slot]
            hit = there == key[todo]
            out[todo[hit]] = self.values[slot[hit]]
            more = ~hit & (there != self.FREE)
            todo, slot = todo[more], slot[more]
        return out


class ByteBPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks = ranks
        self.find = None if pattern == PATTERN else regex.compile(pattern).findall
        self.pieces: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
        for piece, i in ranks.items():
            self.pieces[i] = piece
        self.byte = [ranks.get(bytes([i]), -1) for i in range(256)]
        if min(self.byte) < 0:
            raise ValueError("the vocabulary lacks single bytes")
        # left id, right id and merge rank of each pair, the id of the joined piece
        self.pairs = [(a, b, i) for piece, i in ranks.items() for k in range(1, len(piece)) if (a := ranks.get(piece[:k])) is not None and (b := ranks.get(piece[k:])) is not None]
        left, right, rank = np.array(self.pairs, np.int32).reshape(-1, 3).T
        self.pair_rank = PairTable(left, right, rank, len(self.pieces) + 1)
        self.queue = RankQueue(len(self.pieces))
        self.seen: dict[bytes, bytes] = {}
        self.first = np.full(1 << 16, -1, np.int32)  # rank of each pair of bytes
        for x in range(256):
            for y in range(256):
                self.first[x << 8 | y] = ranks.get(bytes((x, y)), -1)
        self.byte_ids = np.array(self.byte, np.int32)
        lengths = np.array([len(x or b"") for x in self.pieces], np.int64)
        self.ends = np.cumsum(lengths)
        self.lengths = lengths
        self.known = np.array([x is not None for x in self.pieces])
        self.blob = np.frombuffer(b"".join(x or b"" for x in self.pieces), np.uint8)

    @classmethod
    def load(cls, path: str = RANKS, pattern: str = PATTERN) -> ByteBPE:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)

    @cached_property
    def right(self) -> list[dict[int, int]]:
        """By left id: right id -> merge rank of the pair."""
        none: dict[int, int] = {}
        out = [none] * len(self.pieces)
        for a, b, i in self.pairs:
            if out[a] is none:
                out[a] = {}
            out[a][b] = i
        return out

    def merge_all(self, tokens: list[bytes]) -> list[bytes]:
        """Ids of each pre-token as bytes of int32."""
        whole = [self.ranks.get(t) for t in tokens]
        out = [b"" if i is None else i.to_bytes(4, "little") for i in whole]
        size = np.array([len(t) if i is None else 0 for t, i in zip(tokens, whole)], np.int64)
        order = np.argsort(size, kind="stable")
        some = np.searchsorted(size[order], [1, SHORT + 1])
        short, long = order[some[0] : some[1]], order[some[1] :].tolist()
        for start in range(0, len(short), BLOCK):
            block = short[start : start + BLOCK].tolist()
            for k, got in zip(block, self.merge_short([tokens[k] for k in block])):
                out[k] = got
        for k, got in zip(long, self.merge_long([tokens[k] for k in long])):
            out[k] = got
        return out

    def merge_short(self, tokens: list[bytes]) -> list[bytes]:
        """As merge_long, for pre-tokens of 1 to ``SHORT`` bytes: a column each, one merge of each a round."""
        size = np.array([len(t) for t in tokens], np.int64)
        rows, width, beyond = int(size.max()), len(tokens), len(self.pieces)
        place = np.arange(rows + 1)[:, None]
        inside = place < size
        text = np.zeros((width, rows + 1), np.uint8)
        text[inside.T] = np.frombuffer(b"".join(tokens), np.uint8)
        text = np.ascontiguousarray(text.T)
        # the last row is what lies beyond either end: its id merges with none
        ids = np.where(inside, self.byte_ids[text], np.int32(beyond))
        nxt = np.where(place + 1 < size, place + 1, rows).astype(np.int8)
        prv = np.where(np.broadcast_to(place > 0, ids.shape), place - 1, rows).astype(np.int8)
        wide = np.int32 if beyond < 1 << 25 else np.int64
        none = wide(np.iinfo(wide).max)
        key = np.full(ids.shape, none)  # rank of the pair that begins there, and its place in the low 6 bits
        rank = self.first[text[:-1].astype(np.int32) << 8 | text[1:]].astype(wide)
        key[:-1] = np.where(inside[1:] & (rank >= 0), rank << 6 | place[:-1].astype(wide), none)
        column, ended = np.arange(width), []
        while len(column):
            least = key.min(axis=0)
            live = np.flatnonzero(least < none)
            if len(live) < 0.7 * len(column):
                over = np.flatnonzero(least == none)
                ended.append((column[over], ids[:-1, over].T))
                column, least = column[live], least[live]
                ids, key, nxt, prv = (x.take(live, axis=1) for x in (ids, key, nxt, prv))  # row by row in memory, as the flat views need
                live = np.arange(len(column))
            w, least = len(column), least[live]
            rank, here = (least >> 6).astype(np.int32), least & 63
            flat_ids, flat_key, flat_nxt, flat_prv = (x.reshape(-1) for x in (ids, key, nxt, prv))
            i = here.astype(np.int64) * w + live
            j = flat_nxt[i].astype(np.int64) * w + live
            right, left = flat_nxt[j], flat_prv[i]
            k, h = right.astype(np.int64) * w + live, left.astype(np.int64) * w + live
            flat_ids[i], flat_ids[j], flat_key[j] = rank, -1, none
            flat_nxt[i], flat_prv[k] = right, here
            new = self.pair_rank.get(np.concatenate([rank, flat_ids[h]]), np.concatenate([flat_ids[k], rank])).astype(wide)
            new = np.where(new >= 0, new << 6, none)
            flat_key[i], flat_key[h] = new[: len(i)] | here, new[len(i) :] | left
        out = [b""] * width
        for columns, got in ended:
            keep = (got >= 0) & (got < beyond)
            flat, to = got[keep].tobytes(), [0, *(4 * np.cumsum(keep.sum(axis=1))).tolist()]
            for c, a, b in zip(columns.tolist(), to, to[1:]):
                out[c] = flat[a:b]
        return out

    def merge_long(self, tokens: list[bytes]) -> list[bytes]:
        """Ids of each pre-token, by one queue for all of them."""
        raw = np.frombuffer(b"".join(tokens), np.uint8)
        n = len(raw)
        if not n:
            return [b""] * len(tokens)
        size = np.array([len(t) for t in tokens], np.int64)
        end = np.cumsum(size)
        nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
        nxt[end[size > 0] - 1] = n
        prv[(end - size)[size > 0]] = -1
        at = np.flatnonzero(nxt < n)
        rank = self.first[raw[at].astype(np.int32) << 8 | raw[np.minimum(at + 1, n - 1)]]
        at, rank = at[rank >= 0], rank[rank >= 0]
        now = np.full(n, -1, np.int64)  # rank of the pair that begins at each place
        now[at] = rank
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        cut = np.flatnonzero(np.append(True, rank[1:] != rank[:-1])) if len(rank) else []
        stop = [*cut[1:], len(rank)]
        spots = at.tolist()
        queue = self.queue
        for r, a, b in zip(rank[cut].tolist() if len(rank) else [], cut, stop):
            queue.put(r, spots[a:b])
        ids, nxt, prv, now = self.byte_ids[raw].tolist(), nxt.tolist(), prv.tolist(), now.tolist()
        right, push, pop = self.right, queue.push, queue.pop
        while (got := pop()) is not None:
            rank, positions = got
            after = right[rank]
            for k, i in enumerate(positions):
                if now[i] != rank:
                    continue  # stale: merged into its left neighbour, or one of the two parts has changed
                j = nxt[i]
                ids[i], ids[j], now[j] = rank, -1, -1
                lower, r = False, -1
                j = nxt[j]
                nxt[i] = j
                if j < n:
                    prv[j] = i
                    r = after.get(ids[j], -1)
                    if r >= 0:
                        push(r, i)
                        lower = r < rank
                now[i] = r
                h = prv[i]
                if h >= 0:
                    r = right[ids[h]].get(rank, -1)
                    now[h] = r
                    if r >= 0:
                        push(r, h)
                        lower = lower or r < rank
                if lower and k + 1 < len(positions):  # a merge made a pair of lower rank: that one is next
                    queue.put(rank, positions[k + 1 :])
                    break
        ids = np.array(ids, np.int64)
        keep = ids >= 0
        to = 4 * np.append(0, np.cumsum(keep))[np.append(0, end)]
        flat, to = ids[keep].astype(np.int32).tobytes(), to.tolist()
        return [flat[a:b] for a, b in zip(to, to[1:])]

    def merge(self, token: bytes) -> list[int]:
        """Ids of one pre-token."""
        return np.frombuffer(self.merge_all([token])[0], "<i4").tolist()

    def cut(self, offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of all pre-tokens one after the other, where each begins and the last ends, and the first of each text and of none."""
        if self.find is None:
            start = pre_tokens(offsets, raw)
            return raw, np.append(start, len(raw)), np.searchsorted(start, offsets)
        found = [[t.encode("utf-8") for t in self.find(raw[a:b].tobytes().decode("utf-8"))] for a, b in zip(offsets.tolist(), offsets[1:].tolist())]
        size = np.array([len(t) for x in found for t in x], np.int64)
        return np.frombuffer(b"".join(t for x in found for t in x), np.uint8), np.append(0, np.cumsum(size)), np.append(0, np.cumsum([len(x) for x in found])).astype(np.int64)

    def remembered(self, tokens: list[bytes]) -> list[bytes]:
        """Ids of distinct pre-tokens as bytes of int32."""
        seen = self.seen
        new = [t for t in tokens if t not in seen]
        fresh = dict(zip(new, self.merge_all(new)))
        if len(seen) + len(new) > CACHE_TOKENS:
            seen = {t: seen[t] for t in tokens if t in seen}
        out = [fresh[t] if t in fresh else seen[t] for t in tokens]
        seen.update((t, x) for t, x in fresh.items() if len(t) <= SHORT)
        self.seen = seen
        return out

    def encode_all(self, offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each text has."""
        raw, edge, of_text = self.cut(offsets, raw)
        start, end = edge[:-1], edge[1:]
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(len(offsets) - 1, np.int64)
        _, first, which = np.unique(C.span_hash(raw, start, end, C.BASE), return_index=True, return_inverse=True)
        size, away = end - start, start[first][which] - start
        blob = raw.tobytes()
        if (size[first][which] != size).any() or (raw[np.arange(len(raw)) + np.repeat(away, size)] != raw).any():
            place: dict[bytes, int] = {}  # two pre-tokens share a hash
            which = np.array([place.setdefault(blob[a:b], len(place)) for a, b in zip(start.tolist(), end.tolist())], np.int64)
            tokens = list(place)
        else:
            tokens = [blob[a:b] for a, b in zip(start[first].tolist(), end[first].tolist())]
        got = self.remembered(tokens)
        ids, n = np.frombuffer(b"".join(got), np.int32), np.array([len(x) // 4 for x in got], np.int64)
        begin, count = (np.cumsum(n) - n)[which], n[which]
        total = np.append(0, np.cumsum(count))
        flat = ids[np.arange(total[-1]) + np.repeat(begin - total[:-1], count)]
        return flat, np.diff(total[of_text])

    def encode(self, text: str) -> list[int]:
        raw = np.frombuffer(text.encode("utf-8"), np.uint8)
        return self.encode_all(np.array([0, len(raw)], np.int64), raw)[0].tolist()

    def decode_bytes(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of ids, gathered in one pass."""
        ids = np.asarray(ids, np.int64)
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.pieces) or not self.known[ids].all()):
            raise ValueError("an id is outside the vocabulary")
        n = self.lengths[ids]
        first = self.ends[ids] - n
        total = np.cumsum(n)
        size = int(total[-1]) if len(n) else 0
        return self.blob[np.arange(size) - np.repeat(total - n - first, n)]

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(np.array(ids, np.int64)).tobytes().decode("utf-8", "replace")


_loaded: dict[tuple[str, str], ByteBPE] = {}


def tokenizer(path: str = RANKS, pattern: str = PATTERN) -> ByteBPE:
    """One tokenizer a worker process and vocabulary file."""
    key = path, pattern
    if key not in _loaded:
        _loaded[key] = ByteBPE.load(path, pattern)
    return _loaded[key]


def encode(df: DataFrame, path: str = RANKS, id_col: str = "doc_id", text_col: str = "text", pattern: str = PATTERN) -> DataFrame:
    """doc_id, ids, n_tokens, n_bytes, round_trip (decoding the ids gives the text's bytes again)."""
    slim = C.narrow(df, doc_id=id_col, text=text_col)
    kind = slim.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path, pattern)
        for batch in batches:
            for part in C.text_chunks(batch):
                texts = part.column("text")
                want_off, want = C.string_buffers(texts)
                flat, counts = bpe.encode_all(want_off, want)
                off = np.concatenate([[0], np.cumsum(counts)])
                back = bpe.decode_bytes(flat)
                ends = np.concatenate([[0], np.cumsum(bpe.lengths[flat])])[off]
                same = np.diff(ends) == np.diff(want_off)
                if len(back) == len(want) and same.all():
                    wrong = np.flatnonzero(back != want)
                    same[np.searchsorted(want_off, wrong, "right") - 1] = False
                else:
                    same = np.array([back[ends[k] : ends[k + 1]].tobytes() == want[want_off[k] : want_off[k + 1]].tobytes() for k in range(len(counts))])
                null = texts.is_null()
                holes = pa.array(np.append(null.to_numpy(zero_copy_only=False), False))
                lists = pa.ListArray.from_arrays(pa.array(off.astype(np.int32), mask=holes.to_numpy(zero_copy_only=False)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists, pa.array(counts), pa.array(np.diff(want_off)), pa.array(same)], ["doc_id", "ids", "n_tokens", "n_bytes", "round_trip"])

    return slim.mapInArrow(C.tidy(run), f"doc_id {kind}, ids array<int>, n_tokens long, n_bytes long, round_trip boolean")


def decode(df: DataFrame, path: str = RANKS, id_col: str = "doc_id", ids_col: str = "ids", pattern: str = PATTERN) -> DataFrame:
    """doc_id, text; null ids give null text."""
    slim = C.narrow(df, doc_id=id_col, ids=ids_col)
    kind = slim.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path, pattern)
        for batch in batches:
            texts = [None if x is None else bpe.decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return slim.mapInArrow(C.tidy(run), f"doc_id {kind}, text string")
