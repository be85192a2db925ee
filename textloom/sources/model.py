"""A saved model: lexicon, sentiment dictionary and linking memory in one folder of Parquet tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lexicon import Lexicon
from ..operators.linking import Memory
from ..plans.small import local


@dataclass(frozen=True)
class Model:
    lexicon: Lexicon
    sentiment: DataFrame | None = None  # word, score
    memory: Memory | None = None


def save(spark: SparkSession, model: Model, path: str) -> None:
    model.lexicon.save(spark, path)
    options = [(model.lexicon.language, model.lexicon.standard_name, model.memory.strategy if model.memory else None, model.sentiment is not None)]
    local(spark, options, "language string, standard_name boolean, strategy string, sentiment boolean").coalesce(1).write.mode("overwrite").parquet(f"{path}/options")
    if model.sentiment is not None:
        model.sentiment.select("word", "score").write.mode("overwrite").parquet(f"{path}/sentiment")
    if model.memory is not None:
        local(spark, sorted(model.memory.counts.items()), "entity string, n long").write.mode("overwrite").parquet(f"{path}/counts")
        local(spark, sorted(model.memory.latest.items()), "surface string, entity string").write.mode("overwrite").parquet(f"{path}/latest")


def load(spark: SparkSession, path: str) -> Model:
    o = spark.read.parquet(f"{path}/options").first()
    lexicon = Lexicon.load(spark, path, language=o.language, standard_name=o.standard_name)
    sentiment = spark.read.parquet(f"{path}/sentiment").withColumn("score", F.col("score").cast("double")) if o.sentiment else None
    memory = None
    if o.strategy is not None:  # at most an entry an entity and a mention of the lexicon, whose size is checked
        memory = Memory(o.strategy, {r.entity: r.n for r in spark.read.parquet(f"{path}/counts").collect()}, {r.surface: r.entity for r in spark.read.parquet(f"{path}/latest").collect()})
    return Model(lexicon, sentiment, memory)
