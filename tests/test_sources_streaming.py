from __future__ import annotations

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from textloom.operators.lexicon import Lexicon
from textloom.sources import resources as R
from textloom.streaming import text as T


def put(path, content):
    path.write_text(content if isinstance(content, str) else json.dumps(content, ensure_ascii=False), encoding="utf-8")
    return str(path)


def test_readers(spark, tmp_path):
    p = put(tmp_path / "senti.json", {"pos": ["好", "棒"], "neg": ["差"]})
    assert {tuple(r) for r in R.sentiment_lexicon(spark, p).collect()} == {("好", "pos"), ("棒", "pos"), ("差", "neg")}
    for name, content in (("a.json", ["的", "了"]), ("b.json", {"stopwords": ["的", "了"]}), ("c.txt", "的\r\n了\n")):
        assert {r.word for r in R.stopwords(spark, put(tmp_path / name, content)).collect()} == {"的", "了"}
    assert "the" in {r.word for r in R.english_stopwords(spark).collect()}
    p = put(tmp_path / "typed.json", {"食物": ["饭"], "动物": ["猫", "狗"]})
    assert {tuple(r) for r in R.typed_words(spark, p, ["动物"]).collect()} == {("动物", "猫"), ("动物", "狗")}
    assert R.typed_words(spark, p).count() == 3
    p = put(tmp_path / "freq.txt", "今天 5 t\n坏行\n没有 9 v\n太多 1 2 3\n零 0 m\n")
    assert {tuple(r) for r in R.word_frequencies(spark, p, 0, 9, with_pos=True).collect()} == {("今天", 5, "t")}
    p = put(tmp_path / "ch.json", ["第一", "第二"])
    assert [tuple(r) for r in R.chapters(spark, p).orderBy("doc_id").collect()] == [(0, "第一"), (1, "第二")]
    m, t = R.entity_dict(spark, put(tmp_path / "ent.json", [{"甲": ["甲", "阿甲"]}, {"甲": "人名"}]))
    lex = Lexicon.from_tables(t, m)
    assert lex.mention2entity("阿甲") == ("甲", "人名")
    p = put(tmp_path / "l.json", '{"a": 1}\n{"a": 2}\n')
    assert R.json_lines(spark, p, "a int").agg(F.sum("a")).first()[0] == 3
    p = put(tmp_path / "t.txt", "x\n\n  \ny\n")
    assert [r.text for r in R.text_lines(spark, p, F.trim).collect()] == ["x", "y"]


def test_data_folder_and_checksums(tmp_path, monkeypatch):
    monkeypatch.setenv("TEXTLOOM_DATA", str(tmp_path / "home"))
    source = put(tmp_path / "s.txt", "content")
    target = R.fetch(source, "s.txt", R.sha256(source))
    assert target.read_text() == "content" and target.parent == tmp_path / "home"
    with pytest.raises(OSError):
        R.fetch(source, "s.txt", "0" * 64)
    R.clear_data_home()
    assert not (tmp_path / "home").exists()


LEX = Lexicon().add_entities({"甲师傅": ["甲师傅", "师傅"], "乙师傅": ["乙师傅", "师傅"]})


def run(spark, df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name).collect()


def feed(spark, path, rows, schema):
    for k, batch in enumerate(rows):
        spark.createDataFrame(batch, schema).coalesce(1).write.parquet(f"{path}/in/{k}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{path}/in")


def test_memory_survives_batches(spark, tmp_path):
    schema = "scope string, doc_id long, text string"
    stream = feed(spark, tmp_path, [[("a", 1, "甲师傅")], [("a", 2, "师傅"), ("b", 3, "师傅")]], schema)
    got = {r.doc_id: [x.entity for x in r.links] for r in run(spark, T.link_with_memory(stream, LEX, "latest"), "memory_links")}
    assert got[1] == ["甲师傅"] and got[3] == ["乙师傅"] and got[2] in (["甲师傅"], ["乙师傅"])


def test_windowed_counts_drop_late_rows(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    at = lambda m: t0 + timedelta(minutes=m)
    batches = [[(at(1), "甲师傅"), (at(2), "甲师傅 乙师傅")], [(at(60), "乙师傅")], [(at(3), "甲师傅"), (at(120), "无")]]
    stream = feed(spark, tmp_path, batches, "ts timestamp, text string")
    got = {(r.start, r.entity): r.n for r in run(spark, T.entity_counts(stream, LEX), "windowed_counts")}
    assert got[t0, "甲师傅"] >= 2 and got[t0, "乙师傅"] == 1
