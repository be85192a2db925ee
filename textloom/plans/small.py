"""Small tables beside large ones: broadcast only behind a check of their size.

A frame that PySpark makes from Python objects has no statistics, so the planner
takes it for endless and may broadcast the *other* side, the documents.  ``local``
makes a local relation of known size instead, ``checked`` measures any frame.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .cut import settle

#: Most bytes of rows that are broadcast.
BROADCAST_BYTES = 32 << 20
#: Most literals of a list that is written into a plan.
LITERALS = 1000


def local(spark: SparkSession, rows: Iterable[tuple], schema: str) -> DataFrame:
    """Rows of the driver as a local relation, with a broadcast hint up to ``BROADCAST_BYTES`` and a merge hint beyond."""
    kind = StructType.fromDDL(schema)
    names = kind.names
    table = pa.Table.from_pylist([dict(zip(names, r)) for r in rows], schema=to_arrow_schema(kind))
    df = spark.createDataFrame(table, schema=kind)
    return F.broadcast(df) if table.nbytes + 16 * table.num_rows <= BROADCAST_BYTES else df.hint("merge")


def measured(df: DataFrame, name: str = "small", limit: int = BROADCAST_BYTES) -> tuple[DataFrame, bool]:
    """``df``, written once to shared storage, and whether its rows take at most ``limit`` bytes."""
    kept = settle(df, name)
    width = sum((F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) for c in kept.columns), F.lit(16))
    size = kept.agg(F.sum(width).alias("n")).first().n or 0
    return kept, size <= limit


def checked(df: DataFrame, name: str = "small", limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df``, written once, with a broadcast hint where its rows take at most ``limit`` bytes and a merge hint beyond."""
    kept, fits = measured(df, name, limit)
    return F.broadcast(kept) if fits else kept.hint("merge")


def among(df: DataFrame, column: Column, words: DataFrame | Iterable[str], keep: bool) -> DataFrame:
    """Rows whose ``column`` is (``keep``) or is not in a list of words or in the first column of a frame.

    Up to ``LITERALS`` listed words are a filter; other lists are a semi or anti join behind a size check.
    """
    if not isinstance(words, DataFrame):
        words = sorted(set(words))
        if len(words) <= LITERALS:
            hit = column.isin(words) if words else F.lit(False)
            return df.where(hit if keep else ~F.coalesce(hit, F.lit(False)))
        words = local(df.sparkSession, [(w,) for w in words], "__w string")
    else:
        words = checked(words.select(F.col(words.columns[0]).alias("__w")).distinct(), "words")
    return df.join(words, column == F.col("__w"), "left_semi" if keep else "left_anti")


def repeated(df: DataFrame, key: str) -> bool:
    """Whether two rows have the same ``key``; only keys are read and shuffled."""
    return not df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").isEmpty()


#: Tables of at most so many bytes may be a single row group, which is a single task.
SPREAD_BYTES = 32 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small scan dealt over all cores; a table of more than ``SPREAD_BYTES`` has row groups enough and stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size <= SPREAD_BYTES and cores > 1 else df
