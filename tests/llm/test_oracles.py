import pytest

from lumora.llm import queries
from tests.test_oracles import duck, rows_of  # noqa: F401


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_numbered_query_equals_sql(spark, sf, duck, name):  # noqa: F811
    df = queries.QUERIES[name](spark, sf)
    con = duck.execute(queries.ORACLES[name])
    names = [c[0] for c in con.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(names, con.fetchall())
