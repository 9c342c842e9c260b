"""Every query with a DuckDB twin gives the twin's rows on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pytest

from treeflow import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, list | tuple):
        return tuple(map(_plain, v))
    return v


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_twin(name, spark, duck, sf):
    df = registry.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    found = sorted(repr(tuple(_plain(r[c]) for c in columns)) for r in df.collect())
    twin = duck.execute(registry.ORACLES[name])
    names = [x[0] for x in twin.description]
    assert sorted(names) == columns
    wanted = sorted(repr(tuple(_plain(r[names.index(c)]) for c in columns)) for r in twin.fetchall())
    assert found == wanted


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(name, spark, sf):
    assert registry.QUERIES[name](spark, sf).count() > 0


def test_progress_past_its_total(spark, tmp_path):
    """More done than the total, no or negative time, and numbers that doubles can't hold."""
    ids = "NULL, 0, -1, -7, 1, 2, 3, 99999, 100000, 100001, 150001, 299999, 300001, 6000000, 27021597764223, 1000000000000007, 3002399751580333, 3074457345618258600"
    c = duckdb.connect()
    c.sql(f"""COPY (SELECT e AS event_id, u AS user_id FROM (SELECT CAST(unnest([{ids}]) AS BIGINT)) a(e), (SELECT CAST(unnest([NULL, -3, -2, -1, 0, 1, 2, 3, 5, 7]) AS BIGINT)) b(u))
TO '{tmp_path}/events.parquet'""")
    c.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    columns = ["event_id", "per_second", "eta_s", "load"]
    found = sorted(repr(tuple(r)) for r in registry.QUERIES["fn_progress"](spark, str(tmp_path)).select(*columns).collect())
    assert found == sorted(map(repr, c.execute(f"SELECT {', '.join(columns)} FROM ({registry.ORACLES['fn_progress']})").fetchall()))
