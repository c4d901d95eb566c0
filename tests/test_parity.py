"""Every registered query against its reference SQL on the smallest tables."""

import datetime
import decimal

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from codicil.plans import PLANS as QUERIES
from codicil.plans import SQL as ORACLES
from tests.conftest import SMALL



def plain(v):
    if isinstance(v, float):
        return round(v, 5) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 5)
    if hasattr(v, "asDict"):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def test_registry():
    assert set(ORACLES) <= set(QUERIES) <= set(queries())
    assert set(ORACLES) <= set(oracle_sql()) <= set(queries())
    assert set(QUERIES) - set(ORACLES) == {"r04_dense_ann_recall"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in ORACLES:
        assert got
        return
    found = duck.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in order) for r in found.fetchall()), key=repr)


def test_entry(spark, monkeypatch):
    df = entry(spark)
    assert df.columns == ["query_id", "chunk_id", "fused_rank", "score", "excerpt_no"]
    assert df.count() > 0
