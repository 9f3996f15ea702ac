import pytest

from compare import same, tables
from hitloom.llm import queries as llm

SQL = llm.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return tables(sf_dir)


@pytest.mark.parametrize("name", sorted(llm.queries()))
def test_query(spark, sf_dir, con, name):
    df = llm.queries()[name](spark, sf_dir)
    if name in SQL:
        same(df, con, SQL[name])
    else:
        assert df.columns and df.count() > 0
