"""Every registered query against its SQL twin on the smallest tables."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from sweeploom.plans import bindings  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def show(v):
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return repr(float(v) + 0.0)
        return repr(v)

    return sorted(tuple(show(row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("name", sorted(bindings.QUERIES))
def test_query(spark, duck, name):
    df = bindings.QUERIES[name](spark, FOLDER)
    got = canonical([tuple(r) for r in df.collect()], df.columns)
    if name not in bindings.SQL:
        assert got
        return
    cursor = duck.execute(bindings.SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert got == canonical(cursor.fetchall(), names)


def test_sweeps_are_drawn_once_and_matrices_carry_other_columns(spark):
    from pyspark.sql import functions as F
    from sweeploom.plans.bindings import base, models

    folder = "/root/testdata/sf0.001"
    assert "l_suppkey" not in models._sweeps(spark, folder)._jdf.queryExecution().toString()
    rows = base.two_port(spark, folder, F.col("l_discount").alias("d"))
    assert rows.where(F.col("d") != F.col("matrix")[0]).isEmpty()
