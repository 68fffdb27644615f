"""Every query outside the llm package against its SQL on the smallest tables."""

import pytest
from support import SF, rows_of

from tidemark.plans import catalog

QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, name):
    df = QUERIES[name](spark, SF)
    got = rows_of(df.columns, df.collect())
    if name not in ORACLES:
        assert got
        return
    rel = tables.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    types = dict(zip(rel.columns, map(str, rel.types), strict=True))
    assert {c: KINDS[t] for c, t in df.dtypes if t in KINDS} == {c: types[c] for c, t in df.dtypes if t in KINDS}
    assert got == rows_of(rel.columns, rel.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
