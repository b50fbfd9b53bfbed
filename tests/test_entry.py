import duckdb
import os

import pytest

import __spark_entry__ as entry
from loomwork.plans import load

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no tables")


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["w2_carried_runs", "j4_one_to_one", "a5_costs", "w1_position_scores", "c7_tier_routing"])
def test_core_queries_equal_their_sql(spark, name):
    queries, sql = load()
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(D):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{D}/{f}'")
    got = queries[name](spark, D)
    found = con.execute(sql[name])
    names = [x[0] for x in found.description]
    assert sorted(got.columns) == sorted(names)
    key = lambda rows: sorted(tuple(f"{float(v):.5g}" if isinstance(v, (float, int)) or hasattr(v, "quantize") else str(v) for v in r) for r in rows)
    assert key(got.select(*names).collect()) == key(found.fetchall())
