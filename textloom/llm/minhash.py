"""b-bit MinHash near-duplicate groups.

Word shingles are hashed once; ``PERMS`` multiply-shift permutations give 64-bit
minima.  Bands of full minima make the candidates.  ``BITS`` bits of every minimum
are packed into the signature (bits 32 and up: the lowest bits of a multiply-shift
hash are its weakest), and the similarity of a candidate
pair comes from the number of agreeing low-bit fields, corrected for chance
agreement: J = (p - 2^-b) / (1 - 2^-b).

Documents with equal signatures collapse to their smallest id before banding,
so thousands of exact copies cost one bucket entry.  Buckets of any size are
linked completely: leaders absorb their neighbours in one vectorised pass, and
followers are only compared with members that are not yet connected to them,
which leaves the connected components as all pairs would.  A bucket of more than
``BUCKET_BLOCK`` members (documents that share boilerplate) is never one row: it
is dealt into blocks and each pair of blocks is linked by a task of its own.
Components come from distributed star contraction.

Defined results: texts with no word, null texts and null ids take part in no
group; texts of fewer than ``SHINGLE`` words have one shingle, the whole text;
very long texts count whole.  Rows that share an id are one document (they stay
or go together); repeated rows are no copies of themselves.  Ties go to the
smallest id.  Ids are whole numbers (a ``TypeError`` at call time else).  An
empty table has no groups.  Columns are taken by exact name, others, whatever
they are called, are ignored (``groups``) or kept (``keep_one``).  Case and punctuation at word level are kept apart from white
space only: words are lower-cased runs without ASCII white space.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

PERMS, BITS, BANDS, SHINGLE, THRESHOLD, SEED = 128, 4, 32, 3, 0.5, 7
BLOCK = 1 << 16
#: Members of a bucket that are compared in one task; larger buckets are compared block by block.
BUCKET_BLOCK = 2048


def _permutations(perms: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    return r.integers(1, 1 << 63, perms, np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 1 << 63, perms, np.uint64)


def shingles(offsets: np.ndarray, data: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of word shingles and their document; document order."""
    start, end, doc = C.words_of(offsets, data)
    word = C.span_hash(data, start, end, C.BASE)
    if not len(word):
        return word, doc
    first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    count = np.diff(np.append(first, len(doc)))
    last_word = np.repeat(first + count, count)
    at = np.arange(len(word))
    whole = at + size <= last_word
    whole[first] = True
    s = at[whole]
    e = np.minimum(s + size, last_word[whole])
    return C.span_hash(word, s, e, C.QBASE), doc[s]


def minima(offsets: np.ndarray, data: np.ndarray, perms: int, size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents with a shingle, their minima[doc, perm])."""
    h, doc = shingles(offsets, data, size)
    if not len(h):
        return np.zeros(0, np.int64), np.zeros((0, perms), np.uint64)
    mult, add = _permutations(perms, seed)
    docs = doc[np.append(True, doc[1:] != doc[:-1])]
    out = np.full((perms, len(docs)), np.iinfo(np.uint64).max, np.uint64)
    rank = np.cumsum(np.append(0, doc[1:] != doc[:-1]))
    buf = np.empty(BLOCK, np.uint64)
    for a in range(0, len(h), BLOCK):
        part, r = h[a : a + BLOCK], rank[a : a + BLOCK]
        cut = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
        own, v = slice(r[0], r[-1] + 1), buf[: len(part)]
        for i in range(perms):
            np.multiply(part, mult[i], out=v)
            np.add(v, add[i], out=v)
            np.minimum(out[i, own], np.minimum.reduceat(v, cut), out=out[i, own])
    return docs, out.T


def pack(low: np.ndarray, bits: int) -> np.ndarray:
    """Low bits of the minima as packed bytes, field after field."""
    field = (low >> np.uint64(32)).astype(np.uint32)
    planes = ((field[:, :, None] >> np.arange(bits, dtype=np.uint32)) & 1).astype(np.uint8)
    return np.packbits(planes.reshape(len(low), -1), axis=1, bitorder="little")


def words_of(sig: np.ndarray) -> np.ndarray:
    """Packed signatures as rows of 64-bit words."""
    short = -sig.shape[-1] % 8
    if short:  # padding agrees with itself and is subtracted again
        sig = np.concatenate([sig, np.zeros((*sig.shape[:-1], short), np.uint8)], axis=-1)
    return np.ascontiguousarray(sig).view(np.uint64)


def agreeing(one: np.ndarray, many: np.ndarray, bits: int) -> np.ndarray:
    """Number of equal ``bits``-bit fields of packed signatures (bits of 1, 2, 4 or 8)."""
    return agreeing_words(words_of(one), words_of(many), bits, many.shape[-1] * (8 // bits))


def agreeing_words(one: np.ndarray, many: np.ndarray, bits: int, fields: int) -> np.ndarray:
    x = np.bitwise_xor(many, one)
    fold = x.copy()
    for k in range(1, bits):
        fold |= x >> np.uint64(k)
    fold &= np.uint64({1: 0xFFFFFFFFFFFFFFFF, 2: 0x5555555555555555, 4: 0x1111111111111111, 8: 0x0101010101010101}[bits])
    return fields - np.bitwise_count(fold).sum(axis=-1, dtype=np.int64)


def similarity(equal: np.ndarray, perms: int, bits: int) -> np.ndarray:
    c = 2.0**-bits
    return np.maximum(0.0, (equal / perms - c) / (1 - c))


def bucket_links(ids: np.ndarray, sig: np.ndarray, bits: int, least: int) -> list[tuple[int, int, int]]:
    """Edges (a, b, agreeing fields) whose components are those of all similar pairs of the bucket."""
    order = np.argsort(ids, kind="stable")
    ids, fields = ids[order], sig.shape[1] * (8 // bits)
    sig = words_of(sig[order])
    links: list[tuple[int, int, int]] = []
    cluster = np.zeros(len(ids), np.int64)  # the leader of each member, later its component
    followers: list[np.ndarray] = []
    left = np.arange(len(ids))
    while len(left):
        head = left[0]
        equal = agreeing_words(sig[head], sig[left], bits, fields)
        equal[0] = least
        near = equal >= least
        own = left[near]
        links += zip([int(ids[head])] * (len(own) - 1), ids[own[1:]].tolist(), equal[near][1:].tolist())
        cluster[own] = head
        followers.append(own[1:])
        left = left[~near]
    # leaders were compared with each other, so any further link has a follower at one end
    for x in np.concatenate(followers) if followers else ():
        other = np.flatnonzero(cluster != cluster[x])
        if not len(other):
            break
        equal = agreeing_words(sig[x], sig[other], bits, fields)
        hit = equal >= least
        if hit.any():
            found, at = np.unique(cluster[other[hit]], return_index=True)
            for y, q in zip(other[hit][at].tolist(), equal[hit][at].tolist()):
                u, v = sorted((int(ids[x]), int(ids[y])))
                links.append((u, v, q))
            cluster[np.isin(cluster, found)] = cluster[x]
    return links


def signatures(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", perms: int = PERMS, bits: int = BITS, bands: int = BANDS, size: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, sig binary, keys array<long>) for documents with a word."""
    rows = perms // bands
    slim = C.narrow(df, doc_id=id_col, text=text_col).where("doc_id is not null and text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in C.text_chunks(batch):
                docs, low = minima(*C.string_buffers(pc.utf8_lower(part.column("text"))), perms, size, seed)
                packed = pack(low, bits)
                keys = np.empty((len(docs), bands), np.uint64)
                for b in range(bands):
                    h = np.full(len(docs), b + 1, np.uint64)
                    for r in range(rows):
                        h = C.mix(h * C.PBASE + low[:, b * rows + r])
                    keys[:, b] = h
                flat = pa.array(keys.reshape(-1).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(docs)).cast(pa.int64()), pa.array([x.tobytes() for x in packed], pa.binary()), pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, bands, dtype=np.int32)), flat)],
                    ["doc_id", "sig", "keys"],
                )

    return slim.mapInArrow(C.tidy(run), "doc_id long, sig binary, keys array<long>")


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """(id, root) of the connected components of (a, b) by alternating large and small stars."""
    spark = edges.sparkSession
    path = C.shared_path(spark, name)
    at = f"{path}/0"
    now = C.settle(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), name, at)
    step, mark = 0, None
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(least.select("a", F.col("m").alias("b"))).distinct()
        step += 1
        new = C.settle(small, name, f"{path}/{step}")
        seen = new.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        C.discard(spark, f"{path}/{step - 1}")
        now = new
        if (seen.n, seen.h) == mark:
            break
        mark = (seen.n, seen.h)
    return now.select(F.col("a").alias("id"), F.col("b").alias("root"))


def groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, perms: int = PERMS, bits: int = BITS, bands: int = BANDS, size: int = SHINGLE, seed: int = SEED, block: int = BUCKET_BLOCK) -> DataFrame:
    """Members of near-duplicate groups of two or more: doc_id, group_id (smallest id), similarity to it, keep."""
    C.whole_id(df, id_col)
    least = int(np.ceil(perms * (threshold * (1 - 2.0**-bits) + 2.0**-bits)))
    sigs = C.settle(signatures(df, id_col, text_col, perms, bits, bands, size, seed), "minhash")
    # equal signatures collapse to the smallest id; xxhash64 first keeps the shuffle keys short
    heads = sigs.groupBy("sig").agg(F.min("doc_id").alias("head"), F.first("keys").alias("keys"))
    heads = C.settle(heads.select("head", "sig", "keys"), "minhash-heads")
    slots = heads.select("head", F.explode("keys").alias("key"))
    sizes = slots.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block)
    large, few = C.measured(sizes, "minhash-large")
    large = F.broadcast(large) if few else large.hint("merge")
    small = slots.join(large.select("key"), "key", "left_anti")
    buckets = small.groupBy("key").agg(F.collect_list("head").alias("ids")).where(F.size("ids") > 1)  # at most ``block`` each
    # most buckets of one cluster of copies hold the same ids: one of them is enough
    buckets = buckets.select(F.array_sort(F.array_distinct("ids")).alias("ids")).where(F.size("ids") > 1)
    buckets = buckets.groupBy(F.xxhash64("ids").alias("k1"), F.hash("ids").alias("k2")).agg(F.first("ids").alias("ids")).withColumn("bucket", F.xxhash64("k1", "k2"))
    member = buckets.select("bucket", F.explode("ids").alias("head"))
    # members of a large bucket are dealt into blocks, and every pair of blocks is a task's bucket of its own
    parts = F.ceil(F.col("n") / block).cast("int")
    dealt = slots.join(large, "key").select("key", "head", parts.alias("parts")).withColumn("i", F.pmod(F.xxhash64("head", "key"), F.col("parts")).cast("int"))
    dealt = dealt.select("key", "head", "i", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("j")).where((F.col("i") != F.col("j")))
    member = member.union(dealt.select(F.xxhash64("key", F.least("i", "j"), F.greatest("i", "j")).alias("bucket"), "head"))
    filled = member.join(heads.select("head", "sig"), "head").groupBy("bucket").agg(F.collect_list(F.struct("head", "sig")).alias("m"))

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = perms * bits // 8
        for batch in batches:
            col = batch.column("m")
            flat = col.flatten()
            if not len(flat):
                continue
            ids = flat.field("head").to_numpy(zero_copy_only=False)
            sig = np.frombuffer(b"".join(flat.field("sig").to_pylist()), np.uint8).reshape(-1, width)
            off = np.concatenate([[0], np.cumsum(pc.list_value_length(col).to_numpy(zero_copy_only=False))])
            got = [x for a, b in zip(off[:-1], off[1:]) for x in bucket_links(ids[a:b], sig[a:b], bits, least)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in got], pa.int64()) for k in range(2)], ["a", "b"])

    edges = filled.select("m").mapInArrow(C.tidy(link), "a long, b long").distinct()
    roots = components(edges)
    # members: heads that a link reaches, and every document that shares a signature with its head
    head_of = sigs.select("doc_id", "sig").distinct()
    top = heads.select("sig", "head").join(roots, F.col("head") == F.col("id"), "left").select("sig", F.coalesce("root", "head").alias("group_id"))
    member = head_of.join(top, "sig")
    size_of = member.groupBy("group_id").agg(F.countDistinct("doc_id").alias("n")).where("n > 1")
    member = member.join(size_of.select("group_id"), "group_id")
    lead = heads.select(F.col("head").alias("group_id"), F.col("sig").alias("lead_sig"))
    near = member.join(lead, "group_id")

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = perms * bits // 8
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, width) for c in ("sig", "lead_sig"))
            s = similarity(agreeing(a, b, bits), perms, bits)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("group_id"), pa.array(s, pa.float64())], ["doc_id", "group_id", "similarity"])

    rated = near.select("doc_id", "group_id", "sig", "lead_sig").mapInArrow(C.tidy(rate), "doc_id long, group_id long, similarity double")
    # an id with several texts can be in several groups: it belongs to the smallest
    rated = rated.groupBy("doc_id").agg(F.min(F.struct("group_id", (-F.col("similarity")).alias("s"))).alias("x"))
    return rated.select("doc_id", F.col("x.group_id").alias("group_id"), (-F.col("x.s")).alias("similarity"), (F.col("doc_id") == F.col("x.group_id")).alias("keep"))


def keep_one(df: DataFrame, **options) -> DataFrame:
    """The rows of ``df`` less all but the smallest id of each group; columns as they were."""
    options = {"id_col": "doc_id", **options}
    gone = groups(df, **options).where("not keep").select(F.col("doc_id").alias("gone"))
    plain, name = C.numbered(df)
    return plain.join(gone, F.col(name(options["id_col"])) == F.col("gone"), "left_anti").toDF(*df.columns)
