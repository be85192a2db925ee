"""Python over Arrow columns of text in pieces: a worker's objects follow the piece, not the batch of 10,000 rows."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: About so many bytes of text become Python objects at once; one row is never split.
PIECE_BYTES = 1 << 20


def freed() -> None:
    """What was freed goes back to the machine, as idle workers stay."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def pieces(texts: pa.Array, limit: int | None = None) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes (``PIECE_BYTES``)."""
    limit = limit or PIECE_BYTES
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16)
    start = 0
    while start < len(texts):
        done = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, done + limit, "right")))
        yield start, end
        start = end


def in_pieces(f: Callable[[list[str | None]], pa.Array], kind: pa.DataType) -> Callable[[pa.Array], pa.Array]:
    """An Arrow function of a text column from one of a list of texts."""

    def run(texts: pa.Array) -> pa.Array:
        out = [f(texts.slice(a, b - a).to_pylist()) for a, b in pieces(texts)]
        got = pa.concat_arrays(out) if out else pa.array([], kind)
        del out
        freed()
        return got

    return run
