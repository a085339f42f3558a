"""Every registered route query against its SQL, on the smallest tables."""

import os

import pytest

from ridgeweave.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(rows):
    return sorted(repr(tuple(round(v, 6) + 0.0 if isinstance(v, float) else v for v in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    expected = duck.sql(catalog.ORACLES[name])
    assert sorted(expected.columns) == cols
    assert plain(df.select(cols).collect()) == plain(expected.select(", ".join(f'"{c}"' for c in cols)).fetchall())


def test_entry_without_llm():
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_where_the_folder_is_gone(tmp_path):
    """A copy without the training-data operators still imports, and keeps the other queries."""
    import pathlib
    import shutil
    import subprocess
    import sys

    root = pathlib.Path(__file__).parent.parent
    shutil.copytree(root / "ridgeweave", tmp_path / "ridgeweave", ignore=lambda d, names: {"llm", "__pycache__"} & set(names))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(sum(k.startswith('q_') for k in e.queries()), sum(k.startswith(('op', 'pipe')) for k in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True, timeout=120)
    assert out.stdout.split() == [str(len(catalog.QUERIES)), "0"]
