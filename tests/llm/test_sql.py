"""The operators' queries that SQL can express give the rows of their SQL."""

import pytest
from conftest import values

from wardlight.llm import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_as_sql(name, spark, sf_dir, duck):
    got, want = registry.queries()[name](spark, sf_dir), duck.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert values([tuple(r) for r in got.collect()], got.columns) == values(want.fetchall(), columns)
