"""Co-occurrence graphs as edge tables (u, v, weight), u <= v, and graph measures."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..plans.batches import freed
from ..plans.cut import settle
from ..plans.small import checked


#: Pairs that a task holds before it combines them.
PAIRS = 1 << 21


def _combined(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    every, at = np.unique(np.concatenate(keys), return_inverse=True)
    return every, np.bincount(at, np.concatenate(counts), len(every)).astype(np.int64)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v, n) of the item sets of a batch, combined over its documents; a large set is paired a few rows at a time."""
    for batch in batches:
        sets = batch.column("s")
        coded = sets.flatten().dictionary_encode()
        code, names = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        ends = np.cumsum(pc.list_value_length(sets).to_numpy(zero_copy_only=False))
        keys, counts, held = [], [], 0
        for a, b in zip(np.append(0, ends[:-1]).tolist(), ends.tolist()):
            own = code[a:b]
            step = max(1, PAIRS // max(1, len(own)))
            for i in range(0, len(own) - 1, step):
                rows = range(i, min(i + step, len(own) - 1))
                left = np.repeat(own[i : rows[-1] + 1], [len(own) - 1 - r for r in rows])
                keys.append(left * len(names) + np.concatenate([own[r + 1 :] for r in rows]))
                counts.append(np.ones(len(left)))
                held += len(left)
                if held >= 4 * PAIRS:
                    every, n = _combined(keys, counts)
                    keys, counts, held = [every], [n], len(every)
                    if held >= 2 * PAIRS:
                        yield _edges(every, n, names)
                        keys, counts, held = [], [], 0
        if keys:
            yield _edges(*_combined(keys, counts), names)


def _edges(keys: np.ndarray, n: np.ndarray, names: pa.Array) -> pa.RecordBatch:
    ends = [names.take(pa.array(x)) for x in (keys // len(names), keys % len(names))]
    return pa.RecordBatch.from_arrays([*ends, pa.array(n)], ["u", "v", "n"])


def pair_counts(items: DataFrame, min_freq: int = 0) -> DataFrame:
    """Edges from (doc_id, item).  Each document's sorted item set is paired and
    counted in numpy, so what is shuffled is combined already, and no self-join
    shuffles the sets again."""
    kind = items.schema["item"].dataType.simpleString()
    sets = items.where("item is not null").groupBy("doc_id").agg(F.array_sort(F.collect_set("item")).alias("s")).where(F.size("s") > 1)
    pairs = sets.select("s").mapInArrow(_pairs, f"u {kind}, v {kind}, n long")
    return pairs.groupBy("u", "v").agg(F.sum("n").alias("weight")).where(F.col("weight") >= min_freq)


#: Items of a block: the pairs of two blocks are counted in one dense table.
BLOCK_ITEMS = 3072
#: Up to so many neighbours are paired document by document.
FEW_ITEMS = 256


def block_pair_counts(items: DataFrame, names: DataFrame, n: int, min_freq: int = 0) -> DataFrame:
    """``pair_counts`` of distinct (doc_id, item) rows with many items; ``names`` (item) has the ``n`` that count.

    Items are dealt to blocks by hash.  A task takes two blocks, with the documents'
    items in both, and counts their pairs in a table of fixed size: memory follows
    neither the pairs nor the documents' squares, and no pair is shuffled, only each
    document's items once for each block."""
    kind = items.schema["item"].dataType.simpleString()
    blocks = max(1, -(-n // BLOCK_ITEMS))
    b = F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int")
    numbered = names.select("item", b.alias("b")).withColumn("k", F.row_number().over(W.partitionBy("b").orderBy("item")) - 1)
    numbered = settle(numbered, "block-items")
    doc = F.col("doc_id").cast("long") if isinstance(items.schema["doc_id"].dataType, IntegralType) else F.xxhash64("doc_id")
    # of ids, names only in the rows of a block's vocabulary
    own = items.join(checked(numbered, "block-numbers"), "item").groupBy("doc_id", "b").agg(F.collect_list("k").alias("ks")).select("b", doc.alias("d"), "ks", F.lit(None).cast(f"array<{kind}>").alias("own"))
    words = numbered.groupBy("b").agg(F.array_sort(F.collect_list("item")).alias("own")).select("b", F.lit(None).cast("long").alias("d"), F.lit(None).cast("array<int>").alias("ks"), "own")
    meets = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda o: F.struct(F.least(o, "b").alias("i"), F.greatest(o, "b").alias("j"), (o < F.col("b")).alias("right")))
    rows = own.unionAll(words).withColumn("m", F.explode(meets)).select("m.i", "m.j", "m.right", "d", "ks", "own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _count_blocks(pa.Table.from_batches(list(batches)), max(1, min_freq))
        freed()

    return rows.groupBy("i", "j").applyInArrow(run, f"u {kind}, v {kind}, weight long")


def _side(table: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Names of a block, and of its documents ids in order, ends and items."""
    said = table.filter(pc.is_valid(table.column("own")))
    own = table.filter(pc.is_valid(table.column("d"))).sort_by("d")
    ks = own.column("ks").combine_chunks()
    names = said.column("own").combine_chunks().flatten()
    return names, own.column("d").to_numpy(), np.append(0, np.cumsum(pc.list_value_length(ks).to_numpy(zero_copy_only=False))).astype(np.int64), ks.flatten().to_numpy()


def _count_blocks(table: pa.Table, least: int) -> Iterator[pa.RecordBatch]:
    right = pc.cast(table.column("right"), pa.bool_())
    same = table.column("i")[0].as_py() == table.column("j")[0].as_py()
    x = _side(table.filter(pc.invert(right)))
    y = x if same else _side(table.filter(right))
    if not len(x[0]) or not len(y[0]):
        return
    width = len(y[0])
    counts = np.zeros(len(x[0]) * width, np.int32)
    both, a, b = np.intersect1d(x[1], y[1], assume_unique=True, return_indices=True)
    n, m = x[2][a + 1] - x[2][a], y[2][b + 1] - y[2][b]
    made = np.cumsum(n * m)
    start = 0
    while start < len(both):
        end = max(start + 1, int(np.searchsorted(made, (made[start - 1] if start else 0) + PAIRS, "right")))
        # each left item of a document, repeated for its right ones
        own = np.repeat(np.arange(start, end), n[start:end])
        left = x[3][np.arange(len(own)) - np.repeat(np.cumsum(n[start:end]) - n[start:end], n[start:end]) + x[2][a[own]]].astype(np.int64)
        times = m[own]
        at = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times) + np.repeat(y[2][b[own]], times)
        keys = np.repeat(left * width, times) + y[3][at]
        counts += np.bincount(keys, minlength=len(counts)).astype(np.int32)
        start = end
    order = np.empty(len(x[0]) + width, np.int64)
    order[pc.array_sort_indices(pa.concat_arrays([x[0], y[0]])).to_numpy()] = np.arange(len(order))
    every = np.flatnonzero(counts >= least)
    if same:
        every = every[every // width < every % width]
    for c in range(0, len(every), PAIRS // 8):
        some = every[c : c + PAIRS // 8]
        i, j = some // width, some % width
        if same:
            u, v = x[0].take(pa.array(i)), y[0].take(pa.array(j))
        else:
            swap = order[i] > order[len(x[0]) + j]
            names = pa.concat_arrays([x[0], y[0]])
            j = j + len(x[0])
            u, v = names.take(pa.array(np.where(swap, j, i))), names.take(pa.array(np.where(swap, i, j)))
        yield pa.RecordBatch.from_arrays([u, v, pa.array(counts[some].astype(np.int64))], ["u", "v", "weight"])


def entity_graph(found: DataFrame, min_freq: int = 0, used_types: list[str] = ()) -> DataFrame:
    """From (doc_id, entity, etype)."""
    own = found.where(F.col("etype").isin(list(used_types))) if used_types else found
    return pair_counts(own.select("doc_id", F.col("entity").alias("item")), min_freq)


def entity_graph_from_index(index: DataFrame, entities: DataFrame, min_freq: int = 0, used_types: list[str] = ()) -> DataFrame:
    """From an index (term, doc_id) and (entity, etype)."""
    found = index.join(checked(entities, "entities"), F.col("term") == F.col("entity")).select("doc_id", "entity", "etype")
    return entity_graph(found, min_freq, used_types)


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between the given nodes (column ``node``)."""
    for end in ("u", "v"):
        edges = edges.join(nodes.select(F.col("node").alias(end)), end, "left_semi")
    return edges.select("u", "v", "weight")


def ego_graph(items: DataFrame, center: str, min_freq: int = 0, other_min_freq: int = -1) -> DataFrame:
    """Graph around ``center`` from (doc_id, item): documents with it only, its
    edges of at least ``min_freq``, others of at least ``other_min_freq`` (-1:
    the same), between the center and its neighbours.

    Edges of the center are counted first, which is linear; only their other
    ends, the neighbours, are paired, as no other pair can stay."""
    other = min_freq if other_min_freq == -1 else other_min_freq
    there = checked(items.where(F.col("item") == center).select("doc_id").distinct(), "ego-docs")
    own = settle(items.where(F.col("item") != center).join(there, "doc_id", "left_semi").distinct(), "ego-items")
    spokes = own.groupBy("item").agg(F.count("*").alias("weight")).where(F.col("weight") >= min_freq)
    spokes = checked(spokes, "ego-spokes")
    near, n = own.join(spokes.select("item"), "item", "left_semi"), spokes.count()
    rim = pair_counts(near, other) if n <= FEW_ITEMS else block_pair_counts(near, spokes.select("item"), n, other)
    c = F.lit(center)
    return rim.union(spokes.select(F.least("item", c), F.greatest("item", c), "weight"))


def pagerank_matrix(weights: np.ndarray, alpha: float = 0.85, tol: float = 1e-6, max_iter: int = 100) -> np.ndarray:
    """Power iteration on a symmetric weight matrix; dangling mass is spread evenly."""
    n = len(weights)
    if not n:
        return np.zeros(0)
    out = weights.sum(axis=1)
    m = np.divide(weights, out[:, None], out=np.zeros_like(weights, dtype=float), where=out[:, None] > 0)
    x = np.full(n, 1.0 / n)
    for _ in range(max_iter):
        last = x
        x = alpha * (last @ m + last[out == 0].sum() / n) + (1 - alpha) / n
        if np.abs(x - last).sum() < n * tol:
            break
    return x


def power_iteration(n: int, flow: Callable[[np.ndarray], np.ndarray], alpha: float = 0.85, tol: float = 1e-6, max_iter: int = 100) -> np.ndarray:
    """``pagerank_matrix`` of a symmetric weight matrix that is only known by its product with a vector."""
    if not n:
        return np.zeros(0)
    out = flow(np.ones(n))
    lone = out < 1e-12
    share = np.where(lone, 0.0, 1 / np.where(lone, 1.0, out))
    x = np.full(n, 1.0 / n)
    for _ in range(max_iter):
        last = x
        x = alpha * (flow(last * share) + last[lone].sum() / n) + (1 - alpha) / n
        if np.abs(x - last).sum() < n * tol:
            break
    return x


def power_iterations(sizes: np.ndarray, flow: Callable[[np.ndarray], np.ndarray], alpha: float = 0.85, tol: float = 1e-6, max_iter: int = 100) -> np.ndarray:
    """``power_iteration`` of several graphs at once, of ``sizes`` nodes each (none empty); each stops where it would alone."""
    if not len(sizes):
        return np.zeros(0)
    n, graph, starts = np.repeat(sizes, sizes).astype(float), np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes) - sizes
    out = flow(np.ones(len(n)))
    lone = out < 1e-12
    share = np.where(lone, 0.0, 1 / np.where(lone, 1.0, out))
    x, active = 1 / n, np.ones(len(sizes), bool)
    for _ in range(max_iter):
        lost = np.bincount(graph[lone], x[lone], len(sizes))[graph] if lone.any() else 0.0
        new = alpha * (flow(x * share) + lost / n) + (1 - alpha) / n
        moved = np.add.reduceat(np.abs(new - x), starts)
        x = np.where(active[graph], new, x)
        active &= moved >= sizes * tol
        if not active.any():
            break
    return x


#: Most edges that one task ranks.
TASK_EDGES = 1_000_000


def pagerank(edges: DataFrame, alpha: float = 0.85, iterations: int = 20, cut_every: int = 5) -> DataFrame:
    """(node, rank) of an undirected graph after a fixed number of rounds.

    Up to ``TASK_EDGES`` edges are one task's sparse iteration; a larger graph
    takes a join a round, its lineage cut in shared storage.
    """
    edges = settle(edges.select("u", "v", "weight"), "pagerank-edges")
    if edges.limit(TASK_EDGES + 1).count() <= TASK_EDGES:
        kind = edges.schema["u"].dataType

        def run(table: pa.Table) -> pa.Table:
            names = sorted({x for c in ("u", "v") for x in table.column(c).to_pylist()})
            at = {x: i for i, x in enumerate(names)}
            u, v = (np.array([at[x] for x in table.column(c).to_pylist()], np.int64) for c in ("u", "v"))
            w, apart = table.column("weight").to_numpy().astype(float), u != v
            src, dst, w = np.append(u, v[apart]), np.append(v, u[apart]), np.append(w, w[apart])
            rank = power_iteration(len(names), lambda x: np.bincount(dst, w * x[src], len(names)), alpha, 0.0, iterations)
            return pa.table({"node": pa.array(names, table.schema.field("u").type), "rank": rank})

        return edges.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(run, f"node {kind.simpleString()}, rank double")
    arcs = edges.select(F.col("u").alias("a"), F.col("v").alias("b"), F.col("weight").cast("double").alias("w"))
    arcs = arcs.union(arcs.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    total = arcs.groupBy("a").agg(F.sum("w").alias("t"))
    arcs = settle(arcs.join(total, "a").select("a", "b", F.when(F.col("t") > 0, F.col("w") / F.col("t")).otherwise(0.0).alias("p"), (F.col("t") <= 0).alias("dangling")), "pagerank-arcs")
    nodes = settle(arcs.groupBy(F.col("a").alias("node")).agg(F.max("dangling").alias("dangling")), "pagerank-nodes")
    n = max(1, nodes.count())
    ranks = nodes.select("node", "dangling", F.lit(1.0 / n).alias("rank"))
    for k in range(iterations):
        lost = ranks.agg(F.coalesce(F.sum(F.when(F.col("dangling"), F.col("rank"))), F.lit(0.0)).alias("lost"))
        flow = arcs.join(ranks.select(F.col("node").alias("a"), "rank"), "a").groupBy(F.col("b").alias("node")).agg(F.sum(F.col("p") * F.col("rank")).alias("f"))
        ranks = nodes.join(flow, "node", "left").crossJoin(F.broadcast(lost)).select("node", "dangling", (alpha * (F.coalesce("f", F.lit(0.0)) + F.col("lost") / n) + (1 - alpha) / n).alias("rank"))  # one row is broadcast
        if k % cut_every == cut_every - 1:
            ranks = settle(ranks, "pagerank")
    return ranks.select("node", "rank")


#: Most edges of a graph whose communities are found in one task.
MAX_EDGES = 5_000_000


def communities(edges: DataFrame) -> DataFrame:
    """(node, community) by Louvain in one task, so of at most ``MAX_EDGES`` edges; a community is named after its smallest node."""
    n = edges.limit(MAX_EDGES + 1).count()
    if n > MAX_EDGES:
        raise ValueError(f"more than {MAX_EDGES} edges: prune the graph by weight first")

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("u", "v", "weight"))))
        names = sorted({x for u, v, _ in rows for x in (u, v)})
        at = {x: i for i, x in enumerate(names)}
        label = louvain(len(names), [(at[u], at[v], float(w)) for u, v, w in rows])
        first: dict[int, str] = {}
        for x, c in zip(names, label):
            first.setdefault(c, x)
        return pa.table({"node": pa.array(names, pa.string()), "community": pa.array([first[c] for c in label], pa.string())})

    return edges.select("u", "v", "weight", F.lit(0).alias("all")).groupBy("all").applyInArrow(run, "node string, community string")


def louvain(n: int, edges: list[tuple[int, int, float]]) -> list[int]:
    """Communities of a small graph by greedy modularity moves and aggregation; nodes in id order, so the result is fixed."""
    label = list(range(n))
    nodes = list(range(n))
    weight = {(u, v): w for u, v, w in edges}
    while True:
        near: dict[int, dict[int, float]] = {u: {} for u in nodes}
        loops = dict.fromkeys(nodes, 0.0)
        for (u, v), w in weight.items():
            if u == v:
                loops[u] += w
            else:
                near[u][v] = near[u].get(v, 0.0) + w
                near[v][u] = near[v].get(u, 0.0) + w
        degree = {u: sum(near[u].values()) + 2 * loops[u] for u in nodes}
        m2 = sum(degree.values())
        com = {u: u for u in nodes}
        if m2 == 0:
            break
        mass = dict(degree)
        moved, any_move = True, False
        while moved:
            moved = False
            for u in nodes:
                links: dict[int, float] = {}
                for v, w in near[u].items():
                    links[com[v]] = links.get(com[v], 0.0) + w
                mass[com[u]] -= degree[u]
                gain = lambda c: links.get(c, 0.0) - mass[c] * degree[u] / m2  # noqa: B023, E731
                best = max(sorted({com[u], *links}), key=lambda c: (gain(c), c == com[u], -c))
                if gain(best) <= gain(com[u]) + 1e-12:
                    best = com[u]
                mass[best] += degree[u]
                if best != com[u]:
                    com[u], moved, any_move = best, True, True
        label = [com[c] for c in label]
        if not any_move:
            break
        merged: dict[tuple[int, int], float] = {}
        for (u, v), w in weight.items():
            k = tuple(sorted((com[u], com[v])))
            merged[k] = merged.get(k, 0.0) + w
        weight, nodes = merged, sorted(set(com.values()))
    order: dict[int, int] = {}
    return [order.setdefault(c, len(order)) for c in label]
