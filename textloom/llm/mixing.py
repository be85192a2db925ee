"""Mix sources to target weights by weighted fair queueing.

Each source is shuffled by a seeded hash of the id; a document's virtual finish
time is the running token count of its source divided by the source's target
weight.  All documents are sorted by finish time and the mix ends where the
running total of tokens would pass the budget.

Running totals don't use one window a source (a hot source would be one task),
nor slices of equal width (documents crowd where weights differ): the order is
cut into ranges of about ``SLICE_ROWS`` documents by Spark's range partitioning,
which samples the whole sort key, totals of the ranges are accumulated in a
small table, and documents only accumulate within their range.  Only ids, hashes
and counts are shuffled; ``select`` returns text by the last mixed position of
each source, a join with one row a source.

Defined results: a null source is a source of its own (weight of ``default``);
weights that are missing take ``default``, weights of 0 or less exclude the
source; null ids and null or empty texts weigh 0 tokens and keep their place;
very long texts count all their words.  Ties in the hash go to the smaller id,
ties in finish time to source, hash and id.  Repeated rows are separate
documents; ``select`` keeps or drops rows that share an id together.  An empty
table gives an empty mix.  Columns are taken by exact name, others, whatever
they are called, are ignored (``queue``) or kept (``select``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as C

#: Documents a range of the order, about.
SLICE_ROWS = 50_000
#: Most sources whose cuts are broadcast (about 100 bytes each); beyond it the cuts are joined by a shuffle.
BROADCAST_SOURCES = 50_000
SEED = "mix-1"


def _weighted(df: DataFrame, weights: dict[str, float], default: float, seed: str, id_col: str, text_col: str, source_col: str) -> DataFrame:
    slim = C.narrow(df, doc_id=id_col, text=text_col, source=source_col)
    pairs = [x for k, v in sorted(weights.items()) for x in (F.lit(k), F.lit(float(v)))]
    weight = F.coalesce(F.create_map(*pairs)[F.col("source")], F.lit(float(default))) if pairs else F.lit(float(default))
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("h")
    out = slim.select("doc_id", "source", C.n_words(F.col("text")).alias("n_tokens"), weight.alias("weight"), key)
    return out.where("weight > 0")


def _running(df: DataFrame, order: list[str], rows: int, within: list[str], name: str, slice_rows: int) -> DataFrame:
    """``df`` with ``slice``, ``own`` (running tokens of its range) and ``before`` (tokens of earlier ranges), within groups of equal ``within``."""
    cut = C.settle(df.repartitionByRange(max(1, -(-rows // slice_rows)), *order).withColumn("slice", F.spark_partition_id()), name)
    totals = cut.groupBy(*within, "slice").agg(F.sum("n_tokens").alias("t"))
    earlier = F.sum("t").over(W.partitionBy(*within).orderBy("slice").rowsBetween(W.unboundedPreceding, -1))
    before = C.checked(totals.select(*[F.col(c).alias(f"_{c}") for c in within], F.col("slice").alias("_slice"), F.coalesce(earlier, F.lit(0)).alias("before")), f"{name}-totals")  # about a row a range
    own = F.sum("n_tokens").over(W.partitionBy(*within, "slice").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    same: Column = F.col("slice") == F.col("_slice")
    for c in within:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return cut.withColumn("own", own).join(before, same).drop("_slice", *[f"_{c}" for c in within])


def queue(df: DataFrame, weights: dict[str, float], budget_share: float = 0.5, default: float = 1.0, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", budget_tokens: int | None = None, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """The mix: doc_id, source, n_tokens, h, finish, mixed_tokens, in order of finish.

    The budget is ``budget_tokens`` or else a share of all tokens.
    """
    docs = C.settle(_weighted(df, weights, default, seed, id_col, text_col, source_col), "mix-docs")
    whole = docs.agg(F.count("*").alias("n"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens")).first()
    # running tokens of each source in hash order
    timed = _running(docs, ["source", "h", "doc_id"], whole.n, ["source"], "mix-hashed", slice_rows)
    timed = timed.select("doc_id", "source", "n_tokens", "h", ((F.col("before") + F.col("own")) / F.col("weight")).alias("finish"))
    # running tokens of the whole mix in finish order
    order = ["finish", "source", "h", "doc_id"]
    timed = C.settle(timed, "mix-timed")
    mixed = _running(timed, order, whole.n, [], "mix-finish", slice_rows).withColumn("mixed_tokens", F.col("before") + F.col("own"))
    budget = int(whole.tokens * budget_share) if budget_tokens is None else budget_tokens
    return mixed.where(F.col("mixed_tokens") <= budget).select("doc_id", "source", "n_tokens", "h", "finish", "mixed_tokens").orderBy(*order)


def select(df: DataFrame, weights: dict[str, float], budget_share: float = 0.5, default: float = 1.0, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", budget_tokens: int | None = None) -> DataFrame:
    """The rows of ``df`` in the mix, columns as they were.

    A source's part of the mix is a prefix of its hash order, so one cut a
    source (its last hash and id) decides, and no text is shuffled while there
    are at most ``BROADCAST_SOURCES`` sources.  Rows that share an id stay or go
    together.
    """
    mix = queue(df, weights, budget_share, default, seed, id_col, text_col, source_col, budget_tokens)
    last = mix.groupBy("source").agg(F.max(F.struct("h", "doc_id")).alias("last")).withColumnRenamed("source", "of")
    last = C.settle(last, "mix-cuts")
    if last.count() <= BROADCAST_SOURCES:
        last = F.broadcast(last)
    plain, name = C.numbered(df)
    doc_id = F.col(name(id_col))
    key = F.struct(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")))).alias("h"), doc_id.alias("doc_id"))
    return plain.join(last, F.col(name(source_col)).eqNullSafe(F.col("of")) & (key <= F.col("last")), "left_semi").toDF(*df.columns)


def sql(weights: dict[str, float], budget_share: float = 0.5, default: float = 1.0, seed: str = SEED, table: str = "documents") -> str:
    case = "case source " + " ".join(f"when '{k}' then {float(v)!r}::double" for k, v in sorted(weights.items())) + f" else {float(default)!r}::double end" if weights else f"{float(default)!r}::double"
    return f"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r]+')), 0)::bigint as n_tokens, {case} as weight,
             md5('{seed}:' || coalesce(doc_id::varchar, '')) as h from {table}),
t as (select doc_id, source, n_tokens, h, (sum(n_tokens) over (partition by source order by h, doc_id rows unbounded preceding))::bigint / weight as finish from d where weight > 0),
m as (select *, (sum(n_tokens) over (order by finish, source nulls first, h, doc_id nulls first rows unbounded preceding))::bigint as mixed_tokens from t)
select doc_id, source, n_tokens, h, finish, mixed_tokens from m
where mixed_tokens <= floor((select sum(n_tokens) from t) * {budget_share})"""
