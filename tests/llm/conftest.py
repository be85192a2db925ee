from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns whose names operators use inside.
CLASH = ["key", "sig", "h", "gone", "last", "of", "slice", "group_id", "c0", "weight", "root", "y", "media"]


def messy_rows() -> list[tuple]:
    word = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    rows = [
        (1, word + "\nshared line of all\n" + word.upper(), "en", "src0"),
        (2, None, "en", "src0"),
        (3, "", "en", None),
        (4, " \n\t\r\n ", None, "src1"),
        (None, word, "en", "src1"),
        (None, word, "en", "src1"),
        (5, word, "en", "src2"),
        (5, word, "en", "src2"),
        (6, word, None, "src2"),
        (7, "é" * 70_000 + " " + "x" * 3_000_000, "fr", "src9"),
        (8, "…?!​\U0001f600 ퟿ 漢字", "zh", "src0"),
        (9, "shared line of all", "en", "src0"),
    ]
    return [(*r, None if r[1] is None else len(r[1])) for r in rows]


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing extra columns."""
    rows = [(*r, *["clash"] * len(CLASH)) for r in messy_rows()]
    return spark.createDataFrame(rows, DOCS + "".join(f", `{c}` string" for c in CLASH)).repartition(3)


@pytest.fixture(scope="session")
def empty(messy):
    return messy.where("false")


@pytest.fixture(scope="session")
def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}
