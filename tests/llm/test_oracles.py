"""Every registered query that has SQL gives the SQL's rows."""

import pytest

from weftgraph.llm import registry


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(repr([None if v is None or v != v else str(v) for v in r]) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, con, name):
    c, folder = con
    assert rows(registry.queries()[name](spark, folder).toPandas()) == rows(c.execute(registry.oracle_sql()[name]).df())
