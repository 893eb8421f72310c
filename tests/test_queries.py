"""Every registered query with SQL gives the SQL's rows."""

import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tidewright.plans import ranges
from tidewright.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(found):
    return sorted((tuple(round(x, 6) if isinstance(x, float) and math.isfinite(x) else x for x in r) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_gives_the_oracles_rows(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    want = duck.execute(f"select {quoted} from ({ORACLES[name]})").fetchall()
    assert rows(map(tuple, df.select(*columns).collect())) == rows(want)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize(("name", "rest"), [("snapshot_replace_whole", "left_semi"), ("snapshot_keep_whole", "left_anti")])
def test_conflict_modes_run_over_whole_tables(spark, name, rest):
    customer, orders = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("customer", "orders"))
    source = orders.selectExpr("o_custkey * 2 as c_custkey").distinct()
    out = QUERIES[name](spark, SF)
    assert out.count() == customer.select("c_custkey").union(source).distinct().count() > customer.count()
    taken = source if rest == "left_semi" else source.join(customer, "c_custkey", "left_anti")
    assert out.where("c_name like '%-%'").count() == taken.count() > 0  # priorities have a hyphen, names of customers don't


@pytest.mark.parametrize("keys", ["o_orderkey + i * 2000000", "o_orderkey - i * 900000", "case when i < 9 then o_orderkey end"])
def test_object_ids_of_more_than_eight_digits(spark, tmp_path, keys):
    con, path = duckdb.connect(), tmp_path / "orders.parquet"
    con.execute(f"copy (select * replace ({keys} as o_orderkey) from '{SF}/orders.parquet', range(10) t(i)) to '{path}'")
    con.execute(f"create view orders as select * from '{path}'")
    found = QUERIES["partition_object_ids"](spark, str(tmp_path))
    assert rows(map(tuple, found.collect())) == rows(con.execute(ORACLES["partition_object_ids"]).fetchall())
    orders = spark.read.parquet(str(path)).selectExpr("lower(lpad(hex(800000000 + o_orderkey * 3600), 8, '0')) || '0000000000000000' as id", "800000000 + o_orderkey * 3600 as seconds")
    plan = ranges.by_extremes(orders, "id", 8, F.col("seconds"))
    assert sum(r["rows"] for r in ranges.coverage(orders, plan).collect()) == orders.count()
