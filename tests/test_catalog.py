"""Every query against its SQL in DuckDB, and the driver's contract."""

import pytest

import __spark_entry__ as entry
from threadloom import catalog

from .conftest import SF, cells


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    rows = [r.asDict() for r in df.collect()]
    if name not in catalog.ORACLE_SQL:
        assert rows and df.columns
        return
    want = duck.sql(catalog.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    wanted = [dict(zip(want.columns, r)) for r in want.fetchall()]
    assert cells(rows, columns) == cells(wanted, columns)


def test_entry(spark):
    assert entry.entry(spark).count() == 11
    assert set(entry.oracle_sql()) <= set(entry.queries())
