"""Registered queries of the folder equal their SQL on whole tables."""

import pytest

from fieldnote.llm.queries import JOBS, SQL
from tests.conftest import SF
from tests.test_queries import table


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    df = JOBS[name](spark, SF)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(SQL[name])
    want = cur.fetchall()
    assert want and got == table([c[0] for c in cur.description], want)
