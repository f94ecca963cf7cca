"""Every registered query of the training-data operators on the smallest folder, against its SQL where there is one."""

import pytest

from postloom.llm import queries
from tests.test_queries import SF, duck, rows  # noqa: F401


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):  # noqa: F811
    df = queries.QUERIES[name](spark, SF)
    got = rows(df.columns, df.collect())
    assert got
    if name in queries.SQL:
        rel = duck.execute(queries.SQL[name])
        columns = [d[0] for d in rel.description]
        assert sorted(columns) == sorted(df.columns)
        assert got == rows(columns, rel.fetchall())
