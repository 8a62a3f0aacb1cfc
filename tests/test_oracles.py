"""Every query that SQL can express gives the rows of its DuckDB statement; the others run and have rows."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from tests.conftest import DATA
from tessella.plans import registry

SLOW = {"cat_kmeans", "tree_eval"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def _plain(v):
    return round(v, 6) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    rows = sorted((tuple(_plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    found = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    expected = sorted((tuple(_plain(r[names.index(c)]) for c in cols) for r in found.fetchall()), key=repr)
    assert rows == expected


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES) - SLOW))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0
