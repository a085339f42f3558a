"""Every training-data query with a SQL counterpart against it, on the smallest tables."""

import pytest

from ridgeweave.llm import registry
from tests.test_catalog import SF, duck, plain, pytestmark  # noqa: F401


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows_as_sql(spark, duck, name):  # noqa: F811
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    expected = duck.sql(registry.ORACLES[name])
    assert sorted(expected.columns) == cols
    assert plain(df.select(cols).collect()) == plain(expected.select(", ".join(f'"{c}"' for c in cols)).fetchall())
