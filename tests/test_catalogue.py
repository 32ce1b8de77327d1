"""A sample of the catalogue against DuckDB on the smallest tables; tools/check.py runs all of it."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")

from tempofold.catalogue import ORACLES, QUERIES  # noqa: E402
from tools.check import TABLES, rows  # noqa: E402

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables not present")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", ["rollup_union", "validate_events", "visitor_hash", "sliding_limit", "asof_interp", "islands", "near_dup_pairs", "content_groups",
                                  "scrub", "daily_sweep", "auc", "document_violations", "limit_replay", "plane_fit", "constant_chain", "scrub_nested", "half_time", "touch_writes", "chunks"])
def test_rows_equal_sql(spark, con, name):
    df = QUERIES[name](spark, DATA)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(ORACLES[name])
    want = rows([c[0] for c in cur.description], cur.fetchall())
    assert got == want


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)
