"""Named entities and their aliases.

A tagger fills the gap of a trained model: ``gazetteer`` tags known words, any
function that adds a ``flag`` can replace it.  Names are counted and their context
vectors summed over the whole corpus; clusters are made on the small table of
frequent names, by patterns, syllables or vectors.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Word2Vec
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.cut import settle
from ..plans.small import among, checked, local
from .graph import louvain

#: Most frequent names; their vectors (200 bytes each) are broadcast to be compared.
MAX_ENTITIES = 200_000
BLOCK = 1024
_SUFFIX = {
    "person": ({"人名"}, "哥 姐 先生 女士 小姐 同志 同学 老师 教授"),
    "district": ({"地名"}, "国 省 市 区 县 村 镇 古镇 新区 特区 自治区 特别行政区 帝国 王国 共和国"),
    "organization": ({"地名", "机构名"}, "厂 公司 有限公司 协会 基金会 俱乐部 队 国家队 集团 联盟"),
}
#: Shortest stem first, as a lazy match finds it.
PATTERNS = {k: (types, re.compile(r"^(\S+?)(?:" + "|".join(words.split()) + ")$")) for k, (types, words) in _SUFFIX.items()}
BRACKETS = re.compile(r"[\[{(<#【（《](\S+?)[\]})>#】）》]")


def type_of_tag(tag: Column) -> Column:
    """Entity type of a part-of-speech tag, null for other tags."""
    out = F.lit(None).cast("string")
    for prefix, name in (("nz", "其他专名"), ("nt", "机构名"), ("ns", "地名"), ("nr", "人名")):
        out = F.when(tag.startswith(prefix), name).otherwise(out)
    return out


def entities(tokens: DataFrame) -> DataFrame:
    """Distinct (doc_id, entity, etype) of tagged tokens (doc_id, word, flag)."""
    return tokens.select("doc_id", F.col("word").alias("entity"), type_of_tag(F.col("flag")).alias("etype")).where("etype is not null").distinct()


def gazetteer(tokens: DataFrame, known: DataFrame) -> DataFrame:
    """``tokens`` (with a column word) and their ``flag`` from a table (word, flag); null for unknown words."""
    first = known.groupBy(F.col("word").alias("__w")).agg(F.min("flag").alias("flag"))
    return tokens.drop("flag").join(checked(first, "gazetteer"), F.col("word") == F.col("__w"), "left").drop("__w")


def counts(tokens: DataFrame, min_count: int = 5) -> tuple[DataFrame, DataFrame]:
    """((name, etype, n) of frequent entities, (word, n) of frequent other words)."""
    t = tokens.withColumn("etype", type_of_tag(F.col("flag")))
    named = t.where("etype is not null").groupBy(F.lower("word").alias("name"), "etype").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)
    plain = t.where("etype is null").groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)
    return named, plain


def merge(named: list[tuple[str, str, int]], plain: dict[str, int], partition: list[int], syllables: Callable[[str], tuple[str, ...]] | None = None, adjacency: dict[str, list[str]] | None = None, tolerance: int | None = 0) -> tuple[dict[str, set[str]], dict[str, str], dict[str, int]]:
    """Applies patterns and syllables in vocabulary order; returns mentions and type of each cluster's most frequent name, and mention counts."""
    ids = {(n, t): i for i, (n, t, _) in enumerate(named)}
    mentions, count = {n for n, _, _ in named}, {n: c for n, _, c in named}
    by_sound: dict[tuple[str, ...], list[str]] = {}
    if syllables and tolerance is not None:
        for n, _, _ in named:
            by_sound.setdefault(tuple(syllables(n)), []).append(n)
    part, extra = list(partition), {}
    for i, (name, etype, _) in enumerate(named):
        trials = [("brackets", BRACKETS.sub(r"\1", name))] if BRACKETS.match(name) else []
        trials += [(k, m.group(1)) for k, (types, p) in PATTERNS.items() if etype in types and (m := p.match(name))]
        for kind, stem in trials:
            if (stem, etype) in ids:
                part[i] = part[ids[stem, etype]]
            if kind in ("district", "organization") and len(stem) > 1 and (stem in mentions or stem in plain):
                extra.setdefault(i, set()).add(stem)
                count.setdefault(stem, plain.get(stem, 0))
        if by_sound:
            sound = tuple(syllables(name))
            near = [sound] + ([(*sound[:k], q, *sound[k + 1 :]) for k, p in enumerate(sound) for q in (adjacency or {}).get(p, ())] if tolerance else [])
            for s in near:
                for other in sorted(by_sound.get(s, ())):
                    if (other, etype) in ids:
                        part[i] = part[ids[other, etype]]
    clusters: dict[int, list[int]] = {}
    for i, c in enumerate(part):
        clusters.setdefault(c, []).append(i)
    out, types = {}, {}
    for own in clusters.values():
        head = max(own, key=lambda i: (named[i][2], -i))
        key = f"{named[head][0]}_{named[head][1]}"
        out[key] = {named[i][0] for i in own} | extra.get(head, set())
        types[key] = named[head][1]
    return out, types, count


def embed(names: list[str], dim: int = 50, min_n: int = 1, max_n: int = 4) -> np.ndarray:
    """Sub-word vectors of unit length: character n-grams of the padded names by signed hashing."""
    out = np.zeros((len(names), dim))
    for i, name in enumerate(names):
        for f in {f"<{name}>"[a : a + n] for n in range(min_n, max_n + 1) for a in range(len(name) + 3 - n)}:
            h = zlib.crc32(f.encode())
            out[i, h % dim] += 1.0 if h >> 31 else -1.0
    return _unit(out)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def context_vectors(tokens: DataFrame, names: DataFrame, dim: int = 50) -> DataFrame:
    """(i, slot, v) of signed-hash context vectors, from tokens (doc_id, word) and (name, i).

    A document's vector sums its words; a name's sums the documents with it, less
    what their length alone lets expect.  Both sums are linear in the tokens, no
    context word is left out, and only (document, slot) and (name, slot) rows are shuffled.
    """
    t = tokens.where("doc_id is not null and word is not null").select("doc_id", F.lower("word").alias("w"))
    h = F.crc32(F.concat(F.lit("w:"), F.col("w")).cast("binary"))
    signed = t.select("doc_id", F.pmod(h, F.lit(dim)).cast("int").alias("slot"), F.when(h >= 1 << 31, 1).otherwise(-1).alias("s"))
    docs = settle(signed.groupBy("doc_id", "slot").agg(F.sum("s").alias("v"), F.count("*").alias("n")), "doc-vectors")
    whole = docs.groupBy("slot").agg(F.sum("v").alias("all"))  # at most ``dim`` rows
    size = docs.agg(F.sum("n").alias("size"))  # one row
    hits = t.join(checked(names, "names"), F.col("w") == F.col("name")).groupBy("doc_id", "i").agg(F.count("*").alias("tf"))
    own = hits.join(docs, "doc_id").groupBy("i", "slot").agg(F.sum(F.col("tf") * F.col("v")).alias("v"), F.sum(F.col("tf") * F.col("n")).alias("n"))
    length = own.groupBy("i").agg(F.sum("n").alias("length"))
    every = length.crossJoin(F.broadcast(whole)).crossJoin(F.broadcast(size))  # at most ``dim`` and one rows are broadcast
    return every.join(own.select("i", "slot", "v"), ["i", "slot"], "left").select("i", "slot", (F.coalesce("v", F.lit(0)) - F.col("length") / F.col("size") * F.col("all")).alias("v"))


def similar_names(spark: SparkSession, kinds: list[str], vectors: np.ndarray, threshold: float) -> DataFrame:
    """(etype, u, v) of names of one type whose vectors have a cosine over ``threshold``; every task compares blocks of rows with all others."""
    shared = spark.sparkContext.broadcast((np.array(kinds), _unit(vectors).astype(np.float32)))  # at most MAX_ENTITIES rows
    blocks = spark.range(0, len(kinds), BLOCK, max(1, -(-len(kinds) // BLOCK)))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, unit = shared.value
        for batch in batches:
            for a in batch.column(0).to_pylist():
                for b in range(a, len(unit), 8 * BLOCK):  # a table of fixed size, whatever the number of names
                    u, v = np.nonzero((unit[a : a + BLOCK] @ unit[b : b + 8 * BLOCK].T > threshold) & (kind[a : a + BLOCK, None] == kind[None, b : b + 8 * BLOCK]))
                    ahead = v + b > u + a
                    u, v = u[ahead] + a, v[ahead] + b
                    yield pa.RecordBatch.from_arrays([pa.array(kind[u].astype(object), pa.string()), pa.array(u.astype(np.int32)), pa.array(v.astype(np.int32))], ["etype", "u", "v"])

    return blocks.mapInArrow(compare, "etype string, u int, v int")


def cluster(spark: SparkSession, named: list[tuple[str, str, int]], vectors: np.ndarray, threshold: float = 0.98) -> list[int]:
    """Louvain communities of each type's cosine graph, a type in one task; names without a similar one stay alone."""
    pairs = similar_names(spark, [t for _, t, _ in named], vectors, threshold)

    def communities(key: tuple, table: pa.Table) -> pa.Table:
        u, v = table.column("u").to_numpy(), table.column("v").to_numpy()
        nodes = np.unique(np.concatenate([u, v]))
        a, b = np.searchsorted(nodes, u).tolist(), np.searchsorted(nodes, v).tolist()
        label = louvain(len(nodes), [(x, y, 1.0) for x, y in zip(a, b)])
        first: dict[int, int] = {}
        for i, c in zip(nodes.tolist(), label):
            first.setdefault(c, i)
        return pa.table({"i": pa.array(nodes.astype(np.int32)), "part": pa.array([first[c] for c in label], pa.int32())})

    part = list(range(len(named)))
    for r in pairs.groupBy("etype").applyInArrow(communities, "i int, part int").collect():  # a row a name
        part[r.i] = r.part
    return part


def entity_discover(tokens: DataFrame, method: str = "NFL", min_count: int = 5, syllables=None, adjacency=None, pinyin_tolerance: int | None = 0, threshold: float = 0.98, dim: int = 50, min_n: int = 1, max_n: int = 4, vectors: Callable[[list[str]], np.ndarray] | None = None) -> tuple[dict[str, set[str]], dict[str, str], dict[str, int]]:
    """(mentions, types, mention counts) from tagged tokens (doc_id, word, flag).

    ``NERP`` merges by patterns and syllables only, ``NFL`` first by vectors:
    sub-words and contexts, or trained ones (``trained_vectors``).
    """
    method = method.upper()
    if method not in ("NFL", "NERP"):
        raise ValueError(f"unknown method {method!r}")
    spark = tokens.sparkSession
    named_df, plain_df = counts(tokens, min_count)
    rows = named_df.orderBy(F.desc("n"), "name", "etype").limit(MAX_ENTITIES + 1).collect()
    if len(rows) > MAX_ENTITIES:
        raise ValueError(f"more than {MAX_ENTITIES} frequent entities: raise min_count")
    named = [(r.name, r.etype, r.n) for r in rows]
    # of the other words only possible stems of named entities matter
    stems = sorted({m.group(1) for n, _, _ in named for _, p in PATTERNS.values() if (m := p.match(n))})
    plain = {r.word: r.n for r in among(plain_df, F.col("word"), stems, True).collect()} if stems else {}
    partition = list(range(len(named)))
    if method == "NFL" and named:
        names = [n for n, _, _ in named]
        if vectors is None:
            every = np.zeros((len(named), dim))
            keys = local(spark, [(n, i) for i, n in enumerate(names)], "name string, i int")
            # ``dim`` rows a name, as numbers: 16 bytes each, where row objects take hundreds
            got = context_vectors(tokens, keys, dim).select("i", "slot", F.col("v").cast("double")).toArrow()
            every[got.column("i").to_numpy(), got.column("slot").to_numpy()] = got.column("v").to_numpy()
            del got
            every = _unit(every) + embed(names, dim, min_n, max_n)
        else:
            every = vectors(names)
        partition = cluster(spark, named, every, threshold)
    return merge(named, plain, partition, syllables, adjacency, pinyin_tolerance)


def entity_table(tokens: DataFrame, **options) -> DataFrame:
    """``entity_discover`` as rows: entity, etype, mention, n."""
    mentions, types, count = entity_discover(tokens, **options)
    return local(tokens.sparkSession, [(e, types[e], m, count.get(m, 0)) for e, own in mentions.items() for m in sorted(own)], "entity string, etype string, mention string, n long")


def trained_vectors(tokens: DataFrame, dim: int = 50, min_count: int = 5, iterations: int = 1, seed: int = 1) -> Callable[[list[str]], np.ndarray]:
    """Skip-gram vectors of Spark ML, trained on the documents' words; of a name without one the sub-word vector."""
    sents = tokens.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.lower("word").alias("w")))), lambda x: x["w"]).alias("words"))
    model = Word2Vec(vectorSize=dim, minCount=min_count, maxIter=iterations, seed=seed, inputCol="words", outputCol="v").fit(sents)

    def look_up(names: list[str]) -> np.ndarray:
        found = {r.word: r.vector.toArray() for r in among(model.getVectors(), F.col("word"), names, True).collect()}
        out = embed(names, dim)
        for i, n in enumerate(names):
            if n in found:
                out[i] = found[n]
        return out

    return look_up
