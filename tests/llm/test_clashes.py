"""Columns that differ from a used one by case only, which Spark by itself finds ambiguous."""

from __future__ import annotations

from textloom.llm import byte_bpe, cotraining, language_id, line_dedup, matroska, minhash, mixing, passage_dedup, quality_rules, token_arrow


def test_operators_take_the_exact_name(spark):
    text = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
    rows = [(i, text, "en", "s", 5, "other", "x", i) for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, TEXT string, Source string, DOC_ID long")
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 1)], "doc_id long, quality int, QUALITY int")
    assert {r.n_words for r in quality_rules.score(df).collect()} == {20}
    assert cotraining.score(df, cotraining.fit(df, labels)).count() == 3
    assert token_arrow.write(df, seq_len=16, rows=2).count() > 0
    assert minhash.groups(df).count() == 3 and minhash.keep_one(df).columns == df.columns and minhash.keep_one(df).count() == 1
    model = language_id.fit(df, min_count=1)
    assert language_id.detect(df, model).count() == 3 and language_id.keep_known(df, model).count() == 3
    assert matroska.packets(matroska.media_of(df)).where("error is null").count() > 0
    assert mixing.queue(df, {}, 1.0).count() == 3 and mixing.select(df, {}, 1.0).columns == df.columns
    assert {r.n_tokens for r in byte_bpe.encode(df).collect()} == {len(byte_bpe.tokenizer().encode(text))}
    out = line_dedup.clean(df, line_dedup.build(df), min_docs=2)
    assert out.columns == df.columns and sorted(r[1] for r in out.collect()) == ["", "", text]
    assert passage_dedup.dedup(df).count() == 2
