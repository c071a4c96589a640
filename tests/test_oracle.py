"""Every query with SQL gives the rows that DuckDB gives; the others run and have rows."""

import math

import pandas as pd
import pytest

from casegrid.plans import catalog


def rows(frame: pd.DataFrame) -> list[tuple]:
    def plain(x):
        if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and math.isnan(x)):
            return "null"
        if hasattr(x, "item"):
            x = x.item()
        if isinstance(x, float):
            return str(int(x)) if x.is_integer() else repr(round(x, 9))
        if hasattr(x, "isoformat"):
            return pd.Timestamp(x).isoformat()
        return str(x)

    return sorted(tuple(plain(x) for x in r) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(name, spark, duck, sf_dir):
    got = catalog.QUERIES[name](spark, sf_dir).toPandas()
    if name in catalog.ORACLE:
        want = duck.execute(catalog.ORACLE[name]).fetchdf()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got.columns) > 0


def test_names_are_unique_and_sql_has_queries():
    assert set(catalog.ORACLE) <= set(catalog.QUERIES)


def test_entry_imports_and_registers(spark):
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
