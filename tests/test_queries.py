"""Every registered relational query against its SQL on DuckDB."""

import glob
import os

import duckdb
import pytest

from brindle.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def plain(rows):
    return sorted(repr([None if v is None or v != v else bytes(v) if isinstance(v, (bytes, bytearray)) else v for v in r]) for r in rows)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = plain(tuple(r) for r in df.select(*columns).collect())
    rel = con.execute(ORACLES[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert got == plain(tuple(r[i] for i in order) for r in rel.fetchall())


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["revenue"]
    assert set(e.oracle_sql()) <= set(e.queries()) and set(QUERIES) <= set(e.queries())


def test_whole_table_queries_leave_out_no_keys(spark):
    def rows(name):
        return spark.read.parquet(f"{SF}/{name}.parquet")

    customers, suppliers = rows("customer"), rows("supplier")
    assert QUERIES["union_all"](spark, SF).count() == customers.count() + suppliers.count()
    joined = QUERIES["join_nway"](spark, SF)
    near = customers.join(suppliers, customers.c_nationkey == suppliers.s_nationkey)
    assert joined.count() == near.count() and joined.select("c").distinct().count() == near.select("c_custkey").distinct().count()
    assert QUERIES["tpcc_payment_totals"](spark, SF).count() == rows("orders").select("o_custkey").distinct().count()
    assert 0 < QUERIES["except_distinct"](spark, SF).count() < QUERIES["union_distinct"](spark, SF).count()
    assert QUERIES["intersect_distinct"](spark, SF).count() > 0
