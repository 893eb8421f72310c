import random

import pytest
from pyspark.sql import functions as F

from tidewright.operators import changes

SCHEMA = "seq long, ts timestamp, op string, db string, coll string, id long, doc struct<v: int>"


def log(spark, events):
    return spark.createDataFrame([(s, None, op, "d", "c", i, None if v is None else (v,)) for s, op, i, v in events], SCHEMA)


def replayed(events, start=()):
    state = dict(start)
    for _, op, i, v in sorted(events):
        if op == "delete":
            state.pop(i, None)
        elif v is not None:
            state[i] = v
    return state


def random_events(seed, n=200, keys=12):
    r = random.Random(seed)
    out = []
    for s in range(n):
        op = r.choice(["insert", "update", "replace", "delete"])
        out.append((s, op, r.randrange(keys), None if op == "delete" else r.randrange(1000)))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_final_state_is_a_replay(spark, seed):
    events = random_events(seed)
    shuffled = random.Random(seed).sample(events, len(events))
    found = changes.final_state(changes.applicable(log(spark, shuffled))).select("id", "doc.v").collect()
    assert dict(map(tuple, found)) == replayed(events)


def test_applying_twice_is_applying_once(spark):
    events = random_events(7)
    snapshot = spark.createDataFrame([(i, -i) for i in range(20)], "id long, v int")
    once = changes.applied(snapshot, log(spark, events), ("id",))
    twice = changes.applied(once, log(spark, events), ("id",))
    want = replayed(events, {i: -i for i in range(20)})
    assert dict(map(tuple, once.collect())) == want == dict(map(tuple, twice.collect()))


def test_an_update_without_document_leaves_what_was_there(spark):
    events = [(1, "insert", 1, 10), (2, "update", 1, None), (3, "insert", 2, 5), (4, "delete", 2, None)]
    found = changes.final_state(changes.applicable(log(spark, events))).select("id", "doc.v").collect()
    assert list(map(tuple, found)) == [(1, 10)]


def test_rejects_name_their_reason(spark):
    rows = [
        (1, None, "insert", "d", "c", None, (1,)),
        (2, None, "insert", "", "c", 1, (1,)),
        (3, None, "invalidate", "d", "c", 1, None),
        (4, None, "update", "d", "c", 1, None),
        (5, None, "insert", "d", "c.with.dots", 1, (1,)),
    ]
    table = spark.createDataFrame(rows, SCHEMA)
    assert {r.seq: r.reason for r in changes.rejected(table).collect()} == {1: "no_key", 2: "no_namespace", 3: "unknown_op", 4: "no_document"}
    assert [r.seq for r in changes.applicable(table).collect()] == [5]


def test_groups_break_at_kind_and_size(spark):
    events = [(i, "insert", i, 1) for i in range(5)] + [(5, "delete", 1, None), (6, "insert", 9, 1)]
    found = changes.groups(log(spark, events), workers=1, most=2).orderBy("first_seq").collect()
    assert [(r.op, r.n_events) for r in found] == [("insert", 2), ("insert", 2), ("insert", 1), ("delete", 1), ("insert", 1)]


def test_foreign_databases_are_left_alone(spark):
    rows = [(1, None, "insert", "mine", "c", 1, (1,)), (2, None, "insert", "other", "c", 2, (1,))]
    assert [r.id for r in changes.applicable(spark.createDataFrame(rows, SCHEMA), "mine").collect()] == [1]


def test_checkpoints_follow_count_and_time(spark):
    base = 1_600_000_000
    rows = [(i, base + t) for i, t in enumerate([0, 1, 2, 50, 51, 120, 121, 122, 123])]
    table = spark.createDataFrame(rows, "seq long, s long").withColumn("ts", F.timestamp_seconds("s"))
    assert [tuple(r) for r in changes.checkpoints(table, 3, 60).orderBy("seq").collect()] == [(2, 3), (5, 3), (8, 3)]
    assert [tuple(r) for r in changes.checkpoints(table, 100, 60).orderBy("seq").collect()] == [(5, 6)]


def test_empty_log(spark):
    empty = log(spark, [])
    assert changes.final_state(empty).count() == 0
    assert changes.groups(empty).count() == 0
    assert not changes.lost_history(empty, 3).first()["lost"]


def test_rows_that_cannot_be_applied_touch_nothing(spark):
    rows = [(1, None, "insert", "d", "c", 1, (10,)), (2, None, "invalidate", "d", "c", 1, (99,)), (3, None, "update", "d", "c", 1, None), (4, None, "delete", "", "c", 1, None), (5, None, "update", "d", "c", 2, None)]
    broken = spark.createDataFrame(rows, SCHEMA)
    assert [(r.id, r.doc.v) for r in changes.final_state(broken).collect()] == [(1, 10)]
    snapshot = spark.createDataFrame([(1, -1), (2, -2)], "id long, v int")
    assert sorted(map(tuple, changes.applied(snapshot, broken, ("id",)).collect())) == [(1, 10), (2, -2)]
