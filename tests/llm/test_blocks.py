import bisect

import pytest
from pyspark.sql import functions as F

from tidewright.llm.bitfilter import marked, narrowed
from tidewright.llm.blocks import block_of, cut_points


@pytest.mark.parametrize("cuts", [[], [5], [1, 2, 3], list(range(0, 900, 7))])
def test_blocks_are_ranges(spark, cuts):
    df = spark.createDataFrame([(i,) for i in range(-5, 950, 3)] + [(None,)], "k long")
    for r in df.select("k", block_of("k", cuts).alias("b")).collect():
        assert r.b == (0 if r.k is None else bisect.bisect_right(cuts, r.k))


def test_cut_points_share_rows(spark):
    df = spark.range(1000).select(F.col("id").alias("doc_id"))
    cuts = cut_points(df, 100)
    counts = [r["count"] for r in df.groupBy(block_of("doc_id", cuts).alias("b")).count().collect()]
    assert len(counts) == 10 and max(counts) <= 150
    assert cut_points(df.limit(0), 100) == []


def test_bit_filter_loses_no_wanted_key(spark):
    rows, wanted = spark.range(5000), spark.range(0, 5000, 50)
    kept = {r.id for r in narrowed(rows, wanted, ["id"]).collect()}
    assert set(range(0, 5000, 50)) <= kept and len(kept) < 200
    assert marked(rows, wanted.limit(0), ["id"]).where("_tw_hit").count() == 0
