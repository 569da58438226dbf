"""Every registered query against its SQL on the same tables."""

import math

import pytest

from tests.conftest import ROOT
from tilescope.plans import all_queries

REGISTRY = all_queries()
WITH_SQL = sorted(n for n, q in REGISTRY.items() if q.sql is not None)
ROWS_ONLY = sorted(n for n, q in REGISTRY.items() if q.sql is None)


def plain(value):
    """Comparable form: numbers as floats, the rest as text."""
    if isinstance(value, bool) or value is None:
        return ("", str(value))
    if isinstance(value, (int, float)):
        return ("n", "nan" if math.isnan(value) else float(value) + 0.0)
    return ("s", str(value))


def rows(records, names, order):
    place = {n: i for i, n in enumerate(names)}
    return sorted(tuple(plain(r[place[n]]) for n in order) for r in records)


@pytest.mark.parametrize("name", WITH_SQL)
def test_equals_sql(spark, duck, name):
    query = REGISTRY[name]
    result = query.run(spark, ROOT)
    expected = duck.execute(query.sql)
    names = [c[0] for c in expected.description]
    order = sorted(names)
    assert sorted(result.columns) == order
    got, want = rows(result.collect(), result.columns, order), rows(expected.fetchall(), names, order)
    assert got, "a query that finds nothing proves nothing"
    assert got == want


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_runs(spark, name):
    assert REGISTRY[name].run(spark, ROOT).count() > 0


def test_entry(spark):
    from __spark_entry__ import entry, oracle_sql, queries

    assert entry(spark).columns
    assert set(oracle_sql()) <= set(queries())
