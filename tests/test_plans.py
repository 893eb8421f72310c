import pytest
from pyspark.sql import functions as F

from tidewright.functions import ids, policy
from tidewright.operators import snapshots
from tidewright.plans import ranges


def test_partition_counts():
    assert [ranges.partition_count(n, 10, 8) for n in (0, 9, 10, 25, 79, 80, 1000)] == [1, 1, 1, 2, 7, 8, 8]
    assert ranges.reads_in_parallel(50, True, 50) and not ranges.reads_in_parallel(50, False, 50) and not ranges.reads_in_parallel(49, True, 50)


@pytest.mark.parametrize("make", [ranges.sampled, ranges.by_extremes, ranges.balanced])
@pytest.mark.parametrize("keys", [list(range(-50, 400)), [1], [5] * 30, [None, 1, 2, None, 3], [2**53, 2**53 + 1, -(2**53)]])
def test_range_plans_cover_each_row_once(spark, make, keys):
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    plan = make(df, "k", 4)
    assert sum(r["rows"] for r in ranges.coverage(df, plan).collect()) == len(keys)
    direct = {r["part"]: r["n"] for r in df.groupBy(plan.partition().alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    assert {r["part"]: r["rows"] for r in ranges.coverage(df, plan).collect() if r["rows"]} == direct


def test_full_sample_is_skewed_as_planned(spark):
    df = spark.range(60_000).select(F.col("id").alias("k"))
    plan = ranges.sampled(df, "k", 6, sample=60_000)
    assert [r["rows"] for r in ranges.coverage(df, plan).orderBy("part").collect()] == [17142, 8571, 8571, 8571, 8571, 8574]


def test_predicates_reach_the_scan(spark, tmp_path):
    spark.range(1000).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = ranges.balanced(df, "id", 4)
    text = plan.read(df, 2)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(id" in text and "LessThan(id" in text


def test_hash_partitions_cover_text_keys_and_nulls(spark):
    df = spark.createDataFrame([(f"k{i}",) for i in range(100)] + [(None,)], "k string")
    assert df.groupBy(ids.placed(F.col("k"), 8)).count().agg(F.sum("count")).first()[0] == 101


def test_positions_are_a_permutation(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    found = ranges.positions(df, "k", rows=50).collect()
    assert sorted((r.position, r.k) for r in found) == [(i, i) for i in range(1000)]


def test_fnv_vectors(spark):
    df = spark.createDataFrame([("",), ("a",), ("foobar",), ("é",)], "t string")
    want = {"": 0x811C9DC5, "a": 0xE40C292C, "foobar": 0xBF9CF968}
    found = {r.t: r.h for r in df.select("t", ids.fnv1a(F.col("t")).alias("h")).collect()}
    assert {k: found[k] for k in want} == want
    h = 0x811C9DC5
    for b in "é".encode():
        h = (h ^ b) * 16777619 % 2**32
    assert found["é"] == h


def test_object_ids(spark):
    row = spark.createDataFrame([("64f0c0ffee0123456789abcd",)], "h string").select(ids.object_id_seconds(F.col("h")).alias("s")).first()
    assert row.s == 0x64F0C0FF


def test_conflict_modes(spark):
    source = spark.createDataFrame([(1, "b"), (1, "a"), (2, "x"), (None, "n")], "k int, v string")
    target = spark.createDataFrame([(2, "old"), (3, "keep")], "k int, v string")
    order = [F.col("v")]
    as_dict = lambda df: dict(map(tuple, df.collect()))
    assert as_dict(snapshots.written(source, target, ["k"], order, "replace")) == {1: "b", 2: "x", 3: "keep"}
    assert as_dict(snapshots.written(source, target, ["k"], order, "skip")) == {1: "a", 2: "old", 3: "keep"}
    with pytest.raises(snapshots.DuplicateKeys):
        snapshots.written(source, target, ["k"], order, "error")
    assert snapshots.without_key(source, ["k"]).count() == 1


def test_split_leaves():
    assert policy.leaves(128, 10) == [8] * 16
    assert policy.leaves(11, 10) == [5, 6] and policy.leaves(10, 10) == [10] and policy.leaves(1, 10) == [1]


def test_retry_splits_on_contention():
    sizes, waits = [], []

    def write(batch):
        sizes.append(len(batch))
        if len(batch) > 10:
            raise RuntimeError("WriteConflict")

    policy.Policy(sleep=waits.append).write(list(range(20)), write)
    assert sizes == [20, 10, 10] and waits == [5.0]


def test_retry_coerces_ids_once():
    seen = []

    def write(batch):
        seen.append(list(batch))
        if any(isinstance(x, int) for x in batch):
            raise RuntimeError("_id must be an objectId, string, long; found int")

    policy.Policy(sleep=lambda s: None).write([1, 2], write, lambda b: [str(x) for x in b])
    assert seen == [[1, 2], ["1", "2"]]


def test_retry_gives_up():
    calls = []

    def write():
        calls.append(1)
        raise RuntimeError("EOF")

    with pytest.raises(RuntimeError):
        policy.Policy(max_retries=3, sleep=lambda s: None).again(write)
    assert len(calls) == 3


def test_delays_are_bounded():
    p = policy.Policy(jitter=lambda: 0.999)
    assert p.delay(0, policy.OTHER) == pytest.approx(0.1499, abs=1e-3)
    assert p.delay(20, policy.OTHER) == 5.0 and p.delay(20, policy.CONNECTION) == 10.0 and p.delay(3, policy.CONTENTION) == 5.0
