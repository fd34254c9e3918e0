"""Every query of the catalogue against its SQL in DuckDB."""

import os

import duckdb
import pytest

from plusminus import queries as catalogue

Q, SQL = catalogue.queries(), catalogue.oracle_sql()


def settled(rows):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(data):
        con.execute(f"CREATE VIEW {f.partition('.')[0]} AS SELECT * FROM '{data}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(Q))
def test_query(spark, data, duck, name):
    df = Q[name](spark, data)
    columns = sorted(df.columns)
    rows = settled(tuple(r) for r in df.select(*columns).collect())
    if name not in SQL:
        assert rows
        return
    quoted = ", ".join(f'"{c}"' for c in columns)
    assert rows == settled(duck.sql(f"SELECT {quoted} FROM ({SQL[name]})").fetchall())


def test_entry(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"key", "value", "range"}
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
