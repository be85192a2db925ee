from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textloom.llm import token_arrow as T


def stored(rows):
    """All ids that the listed sequences hold, shard by shard."""
    shards = {}
    for r in rows:
        shards.setdefault(r.shard, []).append(r)
    ids = []
    for path in sorted(shards):
        seqs = T.Sequences(path)
        own = sorted(shards[path], key=lambda r: r.seq)
        assert [r.seq for r in own] == list(range(len(seqs)))
        for r in own:
            got, mask = seqs[r.seq]
            assert len(got) == len(mask) and mask.sum() == r.n_tokens
            assert (mask[: r.n_tokens] == 1).all() and (got[r.n_tokens :] == T.END_ID).all()
            ids += got[: r.n_tokens].tolist()
    return ids


def test_every_document_comes_back(spark, documents, texts, tmp_path):
    out = T.write(documents.coalesce(1).sortWithinPartitions("doc_id"), f"file://{tmp_path}/shards", seq_len=128, rows=8).collect()
    ids = stored(out)
    enc = T.encoder(T.RANKS, T.PATTERN)
    pieces, at = [], 0
    for k, x in enumerate(ids):
        if x == T.END_ID:
            pieces.append(enc.decode(ids[at:k]))
            at = k + 1
    assert pieces == [texts[i] for i in sorted(texts) if texts[i]]
    flat = [d for r in sorted(out, key=lambda r: (r.shard, r.seq)) for d in r.doc_ids]
    assert list(dict.fromkeys(flat)) == [i for i in sorted(texts) if texts[i]]


def test_access_is_zero_copy_and_random(spark, documents, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "SHARD_ROWS", 64)
    rows = T.write(documents.coalesce(1), f"file://{tmp_path}/s", seq_len=64, rows=16).collect()
    assert len({r.shard for r in rows}) > 0
    path = rows[0].shard
    seqs = T.Sequences(path)
    before = pa.total_allocated_bytes()
    views = [seqs[i] for i in np.random.default_rng(0).permutation(len(seqs))]
    assert pa.total_allocated_bytes() == before
    assert not any(x.flags.owndata or x.flags.writeable for pair in views for x in pair)
    assert seqs.reader.schema.field("ids").type == pa.list_(pa.field("item", pa.uint16(), False), 64)
    with pytest.raises(IndexError):
        seqs[len(seqs)]


def test_a_repeated_attempt_writes_the_same(documents, tmp_path):
    one = T.write(documents, f"file://{tmp_path}/a")
    a = sorted(tuple(map(str, r)) for r in one.collect())
    b = sorted(tuple(map(str, r)) for r in one.collect())
    assert a == b
    assert not [p for p in (tmp_path / "a").iterdir() if not p.name.endswith(".arrow")]


def test_messy_and_empty(messy, empty):
    rows = T.write(messy, seq_len=32, rows=4).collect()
    texts = [r.text for r in messy.select("text").collect() if r.text]
    assert stored(rows).count(T.END_ID) == len(texts)
    seen = {d for r in rows for d in r.doc_ids}
    assert seen == {None, 1, 4, 5, 6, 7, 8, 9}
    assert T.write(empty).count() == 0


def test_packing_of_many_partitions_and_shards(spark, documents, tmp_path, monkeypatch):
    """Against a packer in plain Python: each partition in its own order, cut into shards, the last sequence padded."""
    monkeypatch.setattr(T, "SHARD_ROWS", 32)
    width, block = 64, 8
    parts = documents.repartition(3).sortWithinPartitions("doc_id", F.xxhash64("text"))
    enc = T.encoder(T.RANKS, T.PATTERN)
    want = {}
    order = {}
    for r in parts.select(F.spark_partition_id().alias("p"), "doc_id", "text").collect():
        order.setdefault(r.p, []).append((r.doc_id, r.text))
    for p, docs in order.items():
        flat = [(x, d) for d, t in docs if t for x in [*enc.encode_ordinary(t), T.END_ID]]
        shard = seq = 0
        for a in range(0, len(flat), width):
            own = flat[a : a + width]
            ids = [x for x, _ in own]
            want[f"part-{p:06d}-{shard:04d}.arrow", seq] = (ids + [T.END_ID] * (width - len(ids)), len(ids), list(dict.fromkeys(d for _, d in own)))
            seq += 1
            if seq >= 32:  # shards end with whole blocks
                shard, seq = shard + 1, 0
    rows = T.write(documents.repartition(3), f"file://{tmp_path}/many", seq_len=width, rows=block).collect()
    assert len({r.shard for r in rows}) > 6
    got = {(r.shard.rsplit("/", 1)[1], r.seq): (T.Sequences(r.shard)[r.seq][0].tolist(), r.n_tokens, r.doc_ids) for r in rows}
    assert got == want


def test_a_failed_attempt_leaves_no_file(spark, documents, tmp_path):
    ids = documents.select("doc_id").collect()[-1].doc_id
    bad = documents.coalesce(1).withColumn("text", F.when(F.col("doc_id") == ids, F.raise_error(F.lit("ended"))).otherwise(F.repeat("text", 20)).cast("string"))
    with pytest.raises(Exception, match="ended"):
        T.write(bad, f"file://{tmp_path}/bad", seq_len=16, rows=2).collect()
    assert not (tmp_path / "bad").exists() or not list((tmp_path / "bad").iterdir())
