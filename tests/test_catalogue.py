"""Every registered query with SQL gives DuckDB's rows; the others run."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from textloom.plans import catalogue, catalogue_more  # noqa: F401


@pytest.fixture(scope="module")
def con(data):
    con = duckdb.connect()
    for name in os.listdir(data):
        con.execute(f"create view {name.split('.')[0]} as select * from read_parquet('{data}/{name}')")
    return con


def canon(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return [canon(x) for x in v]
    return str(v)


def rows(values, names):
    at = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(str([canon(r[i]) for i in at]) for r in values)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_like_sql(spark, data, con, name):
    df = catalogue.QUERIES[name](spark, data)
    got = rows(df.collect(), df.columns)
    r = con.execute(catalogue.SQL[name])
    names = [c[0] for c in r.description]
    assert sorted(names) == sorted(df.columns)
    assert got == rows(r.fetchall(), names)


def test_entry_works_without_the_training_data_parts():
    import subprocess
    import sys
    import tempfile
    from pathlib import Path
    from shutil import copy, copytree, ignore_patterns

    root = Path(__file__).resolve().parents[1]
    with tempfile.TemporaryDirectory() as d:
        copytree(root / "textloom", f"{d}/textloom", ignore=ignore_patterns("llm", "__pycache__"))
        copy(root / "__spark_entry__.py", d)
        code = "import __spark_entry__ as e; q = e.queries(); assert 'entity_counts' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
        subprocess.run([sys.executable, "-c", code], cwd=d, check=True, env={**os.environ, "PYTHONPATH": ""})
