"""Every core query against its SQL on the smallest tables."""

import pytest

from compare import same, tables
from hitloom.plans import queries as core

SQL = core.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return tables(sf_dir)


@pytest.mark.parametrize("name", sorted(core.queries()))
def test_query(spark, sf_dir, con, name):
    df = core.queries()[name](spark, sf_dir)
    if name in SQL:
        same(df, con, SQL[name])
    else:
        assert df.columns and df.count() >= 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(core.queries())


def test_sorted_outputs_are_sorted(spark, sf_dir):
    q = core.queries()
    got = [(r.rname, r.pos if r.pos > 0 else 1 << 31, r.flag & 16, r.line_no) for r in q["sort_coord"](spark, sf_dir).collect()]
    assert got == sorted(got)
    names = [(r.qname, r.line_no) for r in q["sort_name"](spark, sf_dir).collect()]
    assert names == sorted(names)


def test_entry(spark, sf_dir):
    import __spark_entry__ as e

    assert e.queries().keys() >= e.oracle_sql().keys()
    assert e.entry(spark).count() > 0
