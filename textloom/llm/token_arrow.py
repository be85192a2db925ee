"""Token ids as Arrow IPC files of equal-length sequences.

Documents are tokenised, joined with an end-of-text id after each, and cut into
sequences of ``SEQ_LEN`` ids a partition; the last sequence of a partition is
padded and its mask is 0 there.  A shard is one Arrow IPC file (the stream
messages plus a footer) without compression: every record batch holds
``ROWS`` sequences (the last one fewer) as ``fixed_size_list<uint16>[SEQ_LEN]`` (uint32 for
larger vocabularies) and ``fixed_size_list<uint8>[SEQ_LEN]`` masks, so sequence
i is row i % ROWS of batch i // ROWS, a view into the mapped file.

Defined results: null and empty texts add no ids (not even an end id); null doc_ids
are tokenised and listed as null; repeated rows are tokenised each, and there are
no ties.  Very long texts run over as many sequences as they fill.  An empty
partition, or an empty table, writes no shard.  Columns are taken by exact name
and others, whatever they are called, ignored.  A repeated task attempt replaces
its shard by an equal file with one rename: where rows come from a shuffle they
are sorted within their partition first.
"""

from __future__ import annotations

import base64
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .byte_bpe import PATTERN, RANKS

SEQ_LEN, ROWS, SHARD_ROWS, END_ID = 1024, 64, 1 << 15, 50256

_encoders: dict[tuple[str, str], object] = {}


def encoder(path: str, pattern: str):
    import tiktoken

    key = path, pattern
    if key not in _encoders:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[key]


class ShardWriter:
    """One IPC file under a temporary name until it is whole."""

    def __init__(self, path: str, seq_len: int, dtype: np.dtype):
        self.fs, self.path = pafs.FileSystem.from_uri(path)
        self.fs.create_dir(os.path.dirname(self.path), recursive=True)
        self.temp = f"{self.path}.{uuid.uuid4().hex}"
        self.kind = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([pa.field("ids", pa.list_(pa.field("item", self.kind, False), seq_len), False), pa.field("mask", pa.list_(pa.field("item", pa.uint8(), False), seq_len), False)])
        self.out = self.fs.open_output_stream(self.temp)
        self.ipc = pa.ipc.new_file(self.out, self.schema)

    def write(self, ids: np.ndarray, mask: np.ndarray) -> None:
        arrays = [pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), type=f.type) for x, f in zip((ids, mask), self.schema)]
        self.ipc.write_batch(pa.RecordBatch.from_arrays(arrays, schema=self.schema))

    def drop(self) -> None:
        """Removes what a failed attempt wrote."""
        self.out.close()
        self.fs.delete_file(self.temp)

    def close(self) -> None:
        self.ipc.close()
        self.out.close()
        self.fs.move(self.temp, self.path)


class Sequences:
    """Random access to a shard; sequences and masks are views of the mapped file."""

    def __init__(self, path: str):
        fs, name = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
        self.source = pa.memory_map(name) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(name)
        self.reader = pa.ipc.open_file(self.source)
        self.rows = self.reader.get_batch(0).num_rows if self.reader.num_record_batches else 0
        last = self.reader.num_record_batches - 1
        self.n = last * self.rows + self.reader.get_batch(last).num_rows if last >= 0 else 0

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        if not 0 <= i < self.n:
            raise IndexError(i)
        batch, row = self.reader.get_batch(i // self.rows), i % self.rows
        width = batch.schema.field("ids").type.list_size
        return tuple(batch.column(c).values.to_numpy(zero_copy_only=True)[(batch.column(c).offset + row) * width :][:width] for c in ("ids", "mask"))


def write(df: DataFrame, folder: str | None = None, tokenizer_path: str = RANKS, pattern: str = PATTERN, seq_len: int = SEQ_LEN, rows: int = ROWS, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the shards as it is computed; one row a sequence: shard, seq, n_tokens, doc_ids, digest."""
    folder = folder or C.shared_path(df.sparkSession, "token-shards")
    slim = C.narrow(df, doc_id=id_col, text=text_col)
    kind = slim.schema["doc_id"].dataType.simpleString()
    if "Exchange" in slim._jdf.queryExecution().sparkPlan().toString() or "Repartition" in slim._jdf.queryExecution().optimizedPlan().toString():
        # rows from a shuffle come in any order: a repeated attempt must cut the same sequences
        slim = slim.sortWithinPartitions("doc_id", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path, pattern)
        dtype = np.dtype(np.uint16 if max(end_id, enc.max_token_value) < 1 << 16 else np.uint32)
        task = TaskContext.get().partitionId()
        held = np.zeros(0, dtype)  # ids not yet written, and the documents they come from
        docs: list[tuple[object, int]] = []
        shard, writer, seq, id_type = 0, None, 0, None

        def flush(ids: np.ndarray, mask: np.ndarray, final: bool) -> pa.RecordBatch:
            nonlocal writer, shard, seq, docs
            if writer is None:
                writer = ShardWriter(f"{folder}/part-{task:06d}-{shard:04d}.arrow", seq_len, dtype)
            writer.write(ids, mask)
            lists, k, used = [], 0, 0
            for row in mask.sum(axis=1, dtype=np.int64).tolist():
                have = []
                while row > 0:
                    have.append(docs[k][0])
                    step = min(row, docs[k][1] - used)
                    row, used = row - step, used + step
                    if used == docs[k][1]:
                        k, used = k + 1, 0
                lists.append(have)
            docs = docs[k:]
            if used:
                docs[0] = docs[0][0], docs[0][1] - used
            n = len(ids)
            out = pa.RecordBatch.from_arrays(
                [pa.array([writer.path] * n), pa.array(np.arange(seq, seq + n)), pa.array(mask.sum(axis=1, dtype=np.int64)), pa.array(lists, pa.list_(id_type)), pa.array([xxhash.xxh64_intdigest(x.tobytes()) - (1 << 63) for x in ids], pa.int64())],
                ["shard", "seq", "n_tokens", "doc_ids", "digest"],
            )
            seq += n
            if final or seq >= SHARD_ROWS:
                writer.close()
                writer, shard, seq = None, shard + 1, 0
            return out

        block = rows * seq_len

        def pack() -> Iterator[pa.RecordBatch]:
            nonlocal held, id_type
            for batch in batches:
                id_type = batch.schema.field("doc_id").type
                for part in C.text_chunks(batch):
                    pieces = [held]
                    for d, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                        if not text:
                            continue
                        ids = enc.encode_ordinary(text)
                        ids.append(end_id)
                        pieces.append(np.array(ids, dtype))
                        docs.append((d, len(ids)))
                    held = np.concatenate(pieces)
                    while len(held) >= block:
                        yield flush(held[:block].reshape(rows, seq_len), np.ones((rows, seq_len), np.uint8), False)
                        held = held[block:]
            if len(held):
                n = -(-len(held) // seq_len)
                ids = np.full(n * seq_len, end_id, dtype)
                ids[: len(held)] = held
                mask = (np.arange(n * seq_len) < len(held)).astype(np.uint8)
                yield flush(ids.reshape(n, seq_len), mask.reshape(n, seq_len), True)
            elif writer is not None:
                writer.close()

        try:
            yield from pack()
        except BaseException:  # also GeneratorExit: the task was ended
            if writer is not None:
                writer.drop()
            raise

    return slim.mapInArrow(C.tidy(run), f"shard string, seq long, n_tokens long, doc_ids array<{kind}>, digest long")
