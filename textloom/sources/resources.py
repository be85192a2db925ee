"""Readers of lexicon resources, sample corpora and saved models, from paths that the user supplies."""

from __future__ import annotations

import hashlib
import os
import shutil
from pathlib import Path

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.small import local


def sentiment_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(word, polarity) from JSON {"pos": [...], "neg": [...]}."""
    raw = spark.read.schema("pos array<string>, neg array<string>").option("multiLine", True).json(path)
    return raw.select(F.explode(F.map_from_arrays(F.array(F.lit("pos"), F.lit("neg")), F.array("pos", "neg"))).alias("polarity", "w")).select(F.explode("w").alias("word"), "polarity")


def stopwords(spark: SparkSession, path: str) -> DataFrame:
    """(word) from a JSON list, a JSON object with one list, or a text file of one word a line."""
    raw = spark.read.option("wholetext", True).text(path)
    as_list = F.from_json("value", "array<string>")
    as_map = F.flatten(F.map_values(F.from_json("value", "map<string,array<string>>")))
    lines = F.split("value", r"\r?\n")
    word = F.explode(F.when(F.trim("value").startswith("["), as_list).when(F.trim("value").startswith("{"), as_map).otherwise(lines)).alias("word")
    return raw.select(word).where("word <> ''").distinct()


def english_stopwords(spark: SparkSession) -> DataFrame:
    return local(spark, [(w,) for w in StopWordsRemover.loadDefaultStopWords("english")], "word string")


def typed_words(spark: SparkSession, path: str, used_types: list[str] | None = None) -> DataFrame:
    """(etype, word) from JSON {type: [words]}."""
    raw = spark.read.option("wholetext", True).text(path)
    out = raw.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("etype", "w")).select("etype", F.explode("w").alias("word"))
    return out if used_types is None else out.where(F.col("etype").isin(used_types))


def neighbours(spark: SparkSession, path: str) -> DataFrame:
    """(p, neighbor) of syllables from JSON {syllable: [neighbours]}; as ``adjacency`` for fuzzy syllables."""
    raw = spark.read.option("wholetext", True).text(path)
    return raw.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("p", "n")).select("p", F.explode("n").alias("neighbor")).distinct()


def readings(spark: SparkSession, path: str) -> DataFrame:
    """(ch, syllable) from JSON {character: [syllables]}; a character's first syllable counts."""
    raw = spark.read.option("wholetext", True).text(path)
    return raw.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("ch", "s")).where(F.size("s") > 0).select("ch", F.get("s", F.lit(0)).alias("syllable"))


def word_frequencies(spark: SparkSession, path: str, min_freq: float = 0, max_freq: float = float("inf"), with_pos: bool = False) -> DataFrame:
    """(word, freq[, pos]) from lines ``word freq pos``; lines of another shape are skipped, bounds are strict."""
    parts = F.split("value", " ")
    rows = spark.read.text(path).where(F.size(parts) == 3).select(F.get(parts, F.lit(0)).alias("word"), F.get(parts, F.lit(1)).try_cast("long").alias("freq"), F.get(parts, F.lit(2)).alias("pos"))
    rows = rows.where((F.col("freq") > min_freq) & (F.col("freq") < max_freq))
    return rows if with_pos else rows.drop("pos")


def chapters(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text) from a JSON list of texts."""
    raw = spark.read.option("wholetext", True).text(path)
    return raw.select(F.posexplode(F.from_json("value", "array<string>")).alias("p", "text")).select(F.col("p").cast("long").alias("doc_id"), "text")


def entity_dict(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """((mention, entity), (entity, etype)) from JSON [{entity: [mentions]}, {entity: type}]."""
    raw = spark.read.option("wholetext", True).text(path)
    both = F.from_json("value", "array<string>")
    mentions = raw.select(F.explode(F.from_json(F.get(both, F.lit(0)), "map<string,array<string>>")).alias("entity", "m")).select(F.explode("m").alias("mention"), "entity")
    types = raw.select(F.explode(F.from_json(F.get(both, F.lit(1)), "map<string,string>")).alias("entity", "etype"))
    return mentions, types


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def text_lines(spark: SparkSession, path: str, clean=None) -> DataFrame:
    """(text) of non-empty lines after cleaning; ``clean``: Column -> Column."""
    raw = spark.read.text(path).select((clean(F.col("value")) if clean else F.col("value")).alias("text"))
    return raw.where(F.length("text") > 0)


def data_home(path: str | None = None) -> Path:
    """Folder of local resources, made where missing; TEXTLOOM_DATA or ~/textloom_data by default."""
    home = Path(path or os.environ.get("TEXTLOOM_DATA", "~/textloom_data")).expanduser()
    home.mkdir(parents=True, exist_ok=True)
    return home


def clear_data_home(path: str | None = None) -> None:
    shutil.rmtree(data_home(path))


def sha256(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def fetch(source: str, name: str, checksum: str, home: str | None = None) -> Path:
    """Copies a local resource into the data folder unless it is there; raises on a wrong SHA-256."""
    target = data_home(home) / name
    if not target.exists():
        shutil.copyfile(source, target)
    if sha256(str(target)) != checksum:
        raise OSError(f"{target} has another SHA-256 than {checksum}")
    return target


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(name, sha256, bytes) of files in any storage that Spark reads."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def fetch_shared(spark: SparkSession, source: str, target: str, checksum: str) -> str:
    """Copies a file between any two storages that Hadoop knows (http sources too) unless ``target`` is there; raises on a wrong SHA-256."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    a, b = (jvm.org.apache.hadoop.fs.Path(p) for p in (source, target))
    if not b.getFileSystem(conf).exists(b):
        jvm.org.apache.hadoop.fs.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, conf)
    if checksums(spark, target).first().sha256 != checksum:
        raise OSError(f"{target} has another SHA-256 than {checksum}")
    return target


def save_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)
