"""Every relational query against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from marlstone.plans.catalog import ORACLES, QUERIES

DATA = os.environ.get("MARLSTONE_TEST_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def canonical(rows):
    """Rows in an order that the last digits of floats do not touch."""
    plain = [tuple(v if isinstance(v, float) and not math.isnan(v) else str(v) for v in r) for r in rows]
    return sorted(plain, key=lambda r: ([x for x in r if isinstance(x, str)], [round(x, 2) for x in r if not isinstance(x, str)]))


def same(a, b):
    """Equal, but for the last of four digits or the ninth figure of a float: sums depend on their order."""
    if isinstance(a, str) or isinstance(b, str):
        return str(a) == str(b)
    return math.isclose(a, b, rel_tol=1e-9, abs_tol=1.01e-4)


#: Queries that SQL cannot tell; tests/test_operators.py compares their operators with brute force.
WITHOUT_SQL = {"dd2_j7_minhash", "q1_q2_rouge", "tf4_compression"}


def test_every_query_has_sql():
    assert set(QUERIES) - set(ORACLES) == WITHOUT_SQL


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    want = duck.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    got, want = canonical(got.select(columns).collect()), canonical(want.fetchall())
    assert len(got) == len(want)
    assert [(g, w) for g, w in zip(got, want) if not all(map(same, g, w))] == []
