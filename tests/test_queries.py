"""Every registered query against its DuckDB twin, and the library without the training-data operators."""

import ast
import math
import pathlib

import duckdb
import pandas as pd
import pytest

from lodestone import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()
ROOT = pathlib.Path(__file__).parent.parent


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in pathlib.Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def cell(v):
    if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and math.isnan(v):
        return ""
    if isinstance(v, bool) or type(v).__name__ in ("bool", "bool_"):
        return str(bool(v))
    if isinstance(v, (int, float)) or type(v).__module__ == "numpy":
        return f"{float(v):.9g}"
    return str(v)


def plain(df):
    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, sf_dir, name):
    got, want = QUERIES[name](spark, sf_dir).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want) and len(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_has_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["qid", "doc_id", "score", "rank"]
    assert set(SQL) <= set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_nothing_else_imports_llm():
    for p in (ROOT / "lodestone").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT / "lodestone").parts:
            nodes = list(ast.walk(ast.parse(p.read_text())))
            names = [f"{n.module or ''}.{a.name}" for n in nodes if isinstance(n, ast.ImportFrom) for a in n.names]
            names += [a.name for n in nodes if isinstance(n, ast.Import) for a in n.names]
            assert not any("llm" in n.split(".") or "corpus_pipeline" in n for n in names), p
