"""Every query outside ``llm`` against its SQL in DuckDB."""

import duckdb
import pytest

from stemma.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    return round(float(value), 9) if isinstance(value, float) or type(value).__name__ == "Decimal" else value


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, duck, name):
    frame, expected = registry.QUERIES[name](spark, DATA), duck.sql(registry.ORACLE[name])
    columns = sorted(frame.columns)
    assert columns == sorted(expected.columns)
    at = [expected.columns.index(c) for c in columns]
    got = sorted(tuple(str(plain(row[c])) for c in columns) for row in frame.collect())
    assert got == sorted(tuple(str(plain(row[i])) for i in at) for row in expected.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_registers_are_built_without_a_session():
    """The driver may ask for the queries before it has a session, so no module may touch one as it is imported."""
    import subprocess
    import sys

    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and set(e.oracle_sql()) <= set(q)"
    where = __file__.rsplit("/", 2)[0]
    subprocess.run([sys.executable, "-c", code], cwd=where, check=True, timeout=120)
