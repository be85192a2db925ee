"""Shared plumbing: Arrow text buffers, byte-level hashing, columns by position."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..plans.cut import discard, settle, shared_path, shared_root  # noqa: F401
from ..plans.small import checked, measured, spread  # noqa: F401

CHUNK_BYTES = 1 << 20
U64 = np.uint64
BASE, QBASE, PBASE = U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93), U64(0xC2B2AE3D27D4EB4F)


# -- tasks and ids --


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow; what a worker freed goes back to the machine when a task ends, as idle workers stay."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return task


def whole_id(df: DataFrame, id_col: str) -> None:
    """Raises where the id column isn't of a whole-number type."""
    kind = df.schema.fields[df.columns.index(id_col)].dataType
    if not isinstance(kind, IntegralType):
        raise TypeError(f"{id_col} is {kind.simpleString()}; a whole number is needed")


# -- Arrow text --


def string_buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (int64, starting at 0) and UTF-8 bytes; nulls are empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    arr = arr.cast(pa.large_string())
    if arr.null_count:
        arr = arr.fill_null("")
    if not len(arr):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, off, data = arr.buffers()
    offsets = np.frombuffer(off, np.int64)[arr.offset : arr.offset + len(arr) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], raw[offsets[0] : offsets[-1]]


def text_chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``limit`` bytes of text; one document is never split."""
    if not batch.num_rows:
        return
    offsets, _ = string_buffers(batch.column(column))
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
        yield batch.slice(start, end - start)
        start = end


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    have = _powers.get(int(base))
    if have is None or len(have[0]) < n:
        size = max(n, CHUNK_BYTES + 1024)
        inv = U64(pow(int(base), -1, 1 << 64))
        one = np.ones(size, U64)
        up, down = one.copy(), one
        up[1:], down[1:] = base, inv
        have = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if size <= CHUNK_BYTES + 1024:
            _powers[int(base)] = have
    return have[0][:n], have[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64) -> np.ndarray:
    """Polynomial hashes of ``values[start:end]`` from prefix sums, mixed; the length is part of the hash."""
    up, down = powers(len(values) + 1, base)
    total = np.zeros(len(values) + 1, U64)
    np.cumsum((values.astype(U64) + U64(1)) * up[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U64) * PBASE)


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def spans(offsets: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs outside ``gap`` that don't cross documents: starts, ends, document index."""
    n = len(gap)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    before = np.empty(n, bool)
    before[0], before[1:] = True, gap[:-1]
    after = np.empty(n, bool)
    after[-1], after[:-1] = True, gap[1:]
    edge = offsets[:-1]
    before[edge[edge < n]] = True
    edge = offsets[1:]
    after[edge[edge > 0] - 1] = True
    inside = ~gap
    starts = np.flatnonzero(inside & before)
    ends = np.flatnonzero(inside & after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def words_of(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words: runs of bytes other than ASCII white space."""
    return spans(offsets, _SPACE[data])


def char_index(data: np.ndarray) -> np.ndarray:
    """Code points before each byte position, one longer than ``data``."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out


def per_doc(doc: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    got = np.bincount(doc, weights, minlength=n)
    return np.rint(got).astype(np.int64)


def numbered(df: DataFrame) -> tuple[DataFrame, Callable[[str], str]]:
    """``df`` with its columns named by position, and the new name of a column (the first that
    is spelled so): names that clash with each other or with a join partner never matter."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]), lambda name: f"c{df.columns.index(name)}"


def narrow(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns under plain names."""
    plain, name = numbered(df)
    return plain.select(*[F.col(name(old)).alias(new) for new, old in columns.items()])


def n_words(text: Column) -> Column:
    """Runs of characters other than blank, tab, line feed and carriage return; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\r]+")), F.lit(0)).cast("long")
