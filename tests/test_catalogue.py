"""Every query of the core on the smallest tables, against its SQL where it has one."""

import glob
import os

import duckdb
import pytest
from comparing import sorted_rows

from finstrata.plans import catalogue


@pytest.fixture(scope="module")
def sql(tiny):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{tiny}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(spark, tiny, sql, name):
    df = catalogue.QUERIES[name](spark, tiny)
    rows = sorted_rows(df.columns, df.collect())
    if name not in catalogue.SQL:
        assert len(df.columns) > 0
        return
    result = sql.execute(catalogue.SQL[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows == sorted_rows(columns, result.fetchall())


def test_entry_registers_everything():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalogue.QUERIES) <= set(entry.queries())


def test_core_does_not_know_the_llm_package():
    from pathlib import Path

    root = Path(catalogue.__file__).resolve().parents[1]
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "finstrata.llm" not in p.read_text(), p
