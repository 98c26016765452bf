"""Every registered query runs over whole tables; those with SQL give the same rows as the SQL."""

import math

import pytest

from fieldnote.plans import registry

from .conftest import SF

QUERIES = registry.load()


def shown(v):
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return str(int(v)) if v == int(v) and abs(v) < 1e15 else f"{v:.6g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(shown(x) for x in v) + "]"
    return str(v)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(shown(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    q = QUERIES[name]
    df = q.job(spark, SF)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    if q.sql is None:
        return
    cur = con.execute(q.sql)
    rows = cur.fetchall()
    assert got == table([c[0] for c in cur.description], rows)


def test_entry_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
