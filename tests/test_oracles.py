"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from evstream.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path).split('.')[0]} AS SELECT * FROM '{path}'")
    return con


def test_every_query_has_its_sql():
    assert QUERIES.keys() == ORACLES.keys()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = duck.sql(ORACLES[name])
    assert sorted(want.columns) == columns
    rows = duck.sql(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()
    order = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted((tuple(r) for r in df.select(*columns).collect()), key=order) == sorted(rows, key=order)


def test_eviction_is_after_the_last_packet(spark):
    """On a table of more than 100 packets, which the smallest is not."""
    sf = SF.replace("0.001", "0.01")
    rows = QUERIES["packet_eviction_all"](spark, sf).collect()
    last = QUERIES["recording_packets"](spark, sf).count() - 1
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{sf}/events.parquet'")
    assert last > 100 and max(r.packet_id for r in rows) == last
    assert sorted((r.ord, r.packet_id) for r in rows) == sorted(con.sql(f"SELECT ord, packet_id FROM ({ORACLES['packet_eviction_all']})").fetchall())
