"""Every registered query with a DuckDB form gives the same rows as that form."""

import os

import duckdb
import pytest

from marginalia.plans import registry

from .helpers import duck_rows, spark_rows

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")
ORACLE = registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in registry.TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, con, name):
    df = registry.queries()[name](spark, SF)
    assert spark_rows(df) == duck_rows(con, ORACLE[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_no_python_rows():
    """Outside the llm subpackage everything is DataFrame or SQL work."""
    from pathlib import Path

    import marginalia

    for path in Path(marginalia.__file__).parent.rglob("*.py"):
        if "llm" not in path.parts:
            text = path.read_text()
            assert not any(w in text for w in ("pandas_udf", "mapInPandas", "mapInArrow", "applyInPandas", ".rdd", "F.udf")), path
