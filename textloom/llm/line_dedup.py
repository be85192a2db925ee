"""Line dedup by a sharded minimal perfect hash.

Distinct line hashes are counted over the whole corpus; those of lines in at
least two documents are spread over shards by their high bits.  Each shard gets
a minimal perfect hash (levels of bit arrays: a key settles on the first level
where no other key shares its bit, its index is the rank of that bit) that
addresses three arrays: a 32-bit fingerprint, the number of documents with the
line, and the id of the first of them.  Shard files lie in shared storage, their
paths follow from the folder and the shard's number; documents probe the arrays,
mapped where the storage is a mounted folder, so no line of a document is ever
shuffled for a join.

A line is text between line feeds, trimmed of blanks, tabs and carriage returns.
One that is in at least ``MIN_DOCS`` documents stays only in the document of
smallest id, and any line stays only at its first place in a document.  Lines of
fewer than ``MIN_CHARS`` characters after trimming always stay.  With
``long_words`` lines of at least that many words count as frequent from two
documents on, whatever ``min_docs`` (used by the pipeline, where near copies must
stay alike until they are found).  Characters of scripts without blanks count as
words.

Defined results: null texts stay null, empty ones empty; null ids never own or
count a line, and their rows lose those of ``min_docs`` other documents; rows that
share an id are one document, so repeated rows keep their lines.  Very long
texts count whole.  Ties don't exist: the smallest id owns a line.  An empty
table stays empty.  A text without removed lines is unchanged byte for byte.
Ids are whole numbers (a ``TypeError`` at call time else).  Columns are taken by
exact name and returned as they were, whatever they are called.  Two different
lines with the same 64-bit hash would count as one; the fingerprint comes from a
second hash and stops such a line, or one that no shard knows, from being
removed unless it agrees too.
"""

from __future__ import annotations

import mmap
import os
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

MIN_DOCS, MIN_CHARS, SHARD_KEYS, GAMMA = 2, 1, 1 << 20, 2.0
#: Seed of the second hash: Spark's xxhash64 of the literal 1, which it chains into that of the line.
SEED2 = -6698625589789238999 % (1 << 64)
NO_OWNER = np.iinfo(np.int64).min
#: Words from which the pipeline removes every repeat of a line between documents; shorter ones repeat by chance.
LONG_WORDS = 4
_WORD = re.compile("[\u2e80-\U0010ffff]|[^\\s\u2e80-\U0010ffff]+")


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys."""

    def __init__(self, levels: list[tuple[int, np.ndarray, np.ndarray]], n: int):
        self.levels, self.n = levels, n

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        h = C.mix(keys + np.uint64((level * 0x9E3779B97F4A7C15 + 0x5851F42D4C957F2D) & (2**64 - 1)))
        return ((h >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = GAMMA) -> PerfectHash:
        left, levels, base, level = keys, [], 0, 0
        while len(left):
            size = max(64, int(gamma * len(left)) + 63 & ~63)
            at = cls._place(left, level, size)
            alone = np.bincount(at, minlength=size) == 1
            words = np.packbits(alone, bitorder="little").view(np.uint64)
            ranks = np.cumsum(np.append(0, np.bitwise_count(words)[:-1])).astype(np.int64) + base
            levels.append((size, words, ranks))
            base += int(alone.sum())
            left = left[~alone[at]]
            level += 1
            if level > 200:
                raise ValueError("keys are not distinct")
        return cls(levels, base)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key; -1 for keys that no level holds."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, (size, words, ranks) in enumerate(self.levels):
            if not len(left):
                break
            at = self._place(keys[left], level, size)
            w, b = at >> 6, (at & 63).astype(np.uint64)
            word = words[w]
            hit = (word >> b) & np.uint64(1) == 1
            below = word[hit] & ((np.uint64(1) << b[hit]) - np.uint64(1))
            out[left[hit]] = ranks[w[hit]] + np.bitwise_count(below).astype(np.int64)
            left = left[~hit]
        return out


def pack_shard(keys: np.ndarray, prints: np.ndarray, counts: np.ndarray, owners: np.ndarray) -> bytes:
    ph = PerfectHash.build(keys)
    at = ph.index(keys)
    arrays = []
    for v, t in ((prints, np.uint32), (np.minimum(counts, 2**32 - 1), np.uint32), (owners, np.int64)):
        x = np.zeros(ph.n, t)
        x[at] = v
        arrays.append(x)
    out = [struct.pack("<qq", ph.n, len(ph.levels)), *(struct.pack("<q", s) for s, _, _ in ph.levels)]
    for _, words, ranks in ph.levels:
        out += [words.tobytes(), ranks.tobytes()]
    pad = b"\0" * (-ph.n * 4 % 8)
    return b"".join([*out, arrays[0].tobytes(), pad, arrays[1].tobytes(), pad, arrays[2].tobytes()])


class Shard:
    """Arrays of a shard file, views of its buffer."""

    def __init__(self, raw):
        n, depth = struct.unpack_from("<qq", raw, 0)
        sizes = struct.unpack_from(f"<{depth}q", raw, 16)
        at, levels = 16 + 8 * depth, []
        for size in sizes:
            k = size // 64
            levels.append((size, np.frombuffer(raw, np.uint64, k, at), np.frombuffer(raw, np.int64, k, at + 8 * k)))
            at += 16 * k
        self.hash = PerfectHash(levels, n)
        width = (4 * n + 7) & ~7
        self.prints, self.counts = np.frombuffer(raw, np.uint32, n, at), np.frombuffer(raw, np.uint32, n, at + width)
        self.owners = np.frombuffer(raw, np.int64, n, at + 2 * width)

    def probe(self, keys: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, owner) of each key; count 0 where it or its fingerprint is unknown."""
        at = self.hash.index(keys)
        safe = np.maximum(at, 0)
        if not self.hash.n:
            return np.zeros(len(keys), np.int64), np.full(len(keys), NO_OWNER)
        ok = (at >= 0) & (self.prints[safe] == prints)
        return np.where(ok, self.counts[safe], 0).astype(np.int64), self.owners[safe]


@dataclass(frozen=True)
class Shards:
    """Where the shard of a line hash is."""

    folder: str
    bits: int  # high bits of a hash that number its shard

    def number(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(keys), np.int64)

    def path(self, number: int) -> str:
        return f"{self.folder}/{number:08d}.lines"


_open: dict[str, Shard | None] = {}


def open_shard(path: str, most: int = 64) -> Shard | None:
    """A shard, kept open; None where no line belongs to it."""
    if path not in _open:
        if len(_open) >= most:
            _open.pop(next(iter(_open)))
        fs, name = pafs.FileSystem.from_uri(path)
        if fs.get_file_info(name).type == pafs.FileType.NotFound:
            got = None
        elif isinstance(fs, pafs.LocalFileSystem):
            with open(name, "rb") as f:
                got = Shard(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))
        else:
            with fs.open_input_file(name) as f:
                got = Shard(f.readall())
        _open[path] = got
    return _open[path]


def put(path: str, data: bytes) -> None:
    """Write under a temporary name and move: a second attempt of a task replaces whole files only."""
    fs, name = pafs.FileSystem.from_uri(path)
    fs.create_dir(os.path.dirname(name), recursive=True)
    temp = f"{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(temp) as f:
        f.write(data)
    fs.move(temp, name)


def line_rows(df: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, key, print) of every line that counts."""
    line = F.explode(F.split("text", "\n")).alias("line")
    lines = df.where("text is not null and doc_id is not null").select("doc_id", line).select("doc_id", F.regexp_replace("line", r"^[ \t\r]+|[ \t\r]+$", "").alias("line"))
    second = F.xxhash64(F.lit(1), "line").bitwiseAND(F.lit(0xFFFFFFFF))
    return lines.where(F.length("line") >= max(1, min_chars)).select("doc_id", F.xxhash64("line").alias("key"), second.alias("print"))


def build(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 2, min_chars: int = MIN_CHARS, shard_keys: int = SHARD_KEYS) -> Shards:
    """Writes shard files over the distinct lines of at least ``min_docs`` (2 or more) documents."""
    C.whole_id(df, id_col)
    folder = C.shared_path(df.sparkSession, "line-shards")
    slim = C.narrow(df, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    rows = line_rows(slim, min_chars)
    # documents a line: hashes of (doc, line) are distinct first, combined before the shuffle
    counted = rows.groupBy("key", "doc_id").agg(F.min("print").alias("print")).groupBy("key").agg(F.min("print").alias("print"), F.count("*").alias("n"), F.min("doc_id").alias("owner"))
    counted = C.settle(counted.where(F.col("n") >= max(2, min_docs)), "line-counts")
    total, bits = counted.count(), 0
    while shard_keys << bits < total:
        bits += 1
    shards = Shards(folder, bits)

    def make(key: tuple, table: pa.Table) -> pa.Table:
        col = lambda c: table.column(c).to_numpy()
        data = pack_shard(col("key").view(np.uint64), col("print").astype(np.uint32), col("n"), col("owner"))
        put(shards.path(int(key[0].as_py())), data)
        return pa.table({"n": pa.array([table.num_rows], pa.int64()), "bytes": pa.array([len(data)], pa.int64())})

    shard = F.shiftrightunsigned("key", 64 - bits).cast("int") if bits else F.lit(0)
    made = counted.withColumn("shard", shard).groupBy("shard").applyInArrow(make, "n long, bytes long")
    if made.agg(F.sum("n").alias("n")).first().n not in (total, None):
        raise RuntimeError("shards don't hold all lines")
    return shards


def trimmed(line: str) -> str:
    return line.strip(" \t\r")


def is_long(line: str, words: int) -> bool:
    return len(line) >= words and len(_WORD.findall(line)) >= words


def clean(df: DataFrame, shards: Shards, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, report: bool = False, long_words: int | None = None) -> DataFrame:
    """``df`` with repeated lines removed from its text, columns as they were.

    ``long_words``: words from which a line goes wherever it is in two documents.
    With ``report`` instead doc_id, text, n_lines, n_removed.
    """
    C.whole_id(df, id_col)
    if report:
        df = C.narrow(df, doc_id=id_col, text=text_col)
        id_col, text_col = "doc_id", "text"
        schema = f"doc_id {df.schema['doc_id'].dataType.simpleString()}, text string, n_lines long, n_removed long"
    else:
        names = df.columns
        id_col, text_col = (f"c{names.index(c)}" for c in (id_col, text_col))
        df, _ = C.numbered(df)
        schema = df.schema
    place = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in C.text_chunks(batch, text_col):
                ids = part.column(id_col).cast(pa.int64())
                texts = part.column(text_col).to_pylist()
                # first places of each document's lines
                lines, raws, doc, least, gone = [], [], [], [], {}
                for d, t in enumerate(texts):
                    seen: set[str] = set()
                    for k, x in enumerate(t.split("\n") if t else ()):
                        x = trimmed(x)
                        if len(x) < max(1, min_chars):
                            continue
                        if x in seen:
                            gone.setdefault(d, set()).add(k)
                            continue
                        seen.add(x)
                        lines.append(k)
                        raws.append(x.encode("utf-8"))
                        doc.append(d)
                        least.append(2 if long_words is not None and is_long(x, long_words) else min_docs)
                keys = np.array([xxhash.xxh64_intdigest(x, 42) for x in raws], np.uint64)
                own_id = pc.fill_null(ids, NO_OWNER).to_numpy(zero_copy_only=False)
                doc_of, least = np.array(doc, np.int64), np.array(least, np.int64)
                number = shards.number(keys)
                for s in np.unique(number).tolist():
                    shard = open_shard(shards.path(s))
                    if shard is None or not shard.hash.n:
                        continue
                    own = np.flatnonzero(number == s)
                    at = shard.hash.index(keys[own])
                    safe = np.maximum(at, 0)
                    again = (at >= 0) & (shard.counts[safe] >= least[own]) & (shard.owners[safe] != own_id[doc_of[own]])
                    own, safe = own[again], safe[again]
                    prints = np.array([xxhash.xxh64_intdigest(raws[i], SEED2) & 0xFFFFFFFF for i in own], np.uint32)
                    for i in own[shard.prints[safe] == prints].tolist():
                        gone.setdefault(doc[i], set()).add(lines[i])
                out = list(texts)
                for d, drop in gone.items():
                    out[d] = "\n".join(x for k, x in enumerate(texts[d].split("\n")) if k not in drop)
                new = pa.array(out, part.schema.field(text_col).type)
                if report:
                    counts = [0 if t is None else t.count("\n") + 1 for t in texts]
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), new, pa.array(counts, pa.int64()), pa.array([len(gone.get(d, ())) for d in range(len(texts))], pa.int64())], ["doc_id", "text", "n_lines", "n_removed"])
                else:
                    yield pa.RecordBatch.from_arrays([new if k == place else part.column(k) for k in range(part.num_columns)], schema=part.schema)

    out = df.mapInArrow(C.tidy(run), schema)
    return out if report else out.toDF(*names)


def sql(table: str = "documents", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> str:
    return f"""
with l as (select doc_id, unnest(string_split(text, chr(10))) as raw, unnest(range(1, len(string_split(text, chr(10))) + 1)) as i from {table} where text is not null),
t as (select doc_id, i, raw, regexp_replace(raw, '^[ \\t\\r]+|[ \\t\\r]+$', '', 'g') as line from l),
c as (select line, min(doc_id) as owner from t where length(line) >= {max(1, min_chars)} group by line having count(distinct doc_id) >= {min_docs}),
k as (select t.doc_id, t.i, t.raw, length(t.line) >= {max(1, min_chars)} and (coalesce(t.doc_id <> c.owner, false) or row_number() over (partition by t.doc_id, t.line order by t.i) > 1) as gone
      from t left join c on t.line = c.line),
r as (select doc_id, string_agg(raw, chr(10) order by i) filter (where not gone) as text, count(*) as n_lines, count(*) filter (where gone) as n_removed from k group by doc_id)
select d.doc_id, case when d.text is null then null else coalesce(r.text, '') end as text, coalesce(n_lines, 0)::bigint as n_lines, coalesce(n_removed, 0)::bigint as n_removed
from {table} d left join r using (doc_id)"""
