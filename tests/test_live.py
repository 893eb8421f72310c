import json

import pytest
from pyspark.sql import functions as F

from tidewright import catalog, config
from tidewright.operators import copying
from tidewright.sources import files
from tidewright.streaming.replication import LostHistory, Replicator, Source
from tidewright.streaming.store import KeyedStore
from tidewright.streaming.tokens import TokenFile, normalised, parse

LOG = "seq long, ts timestamp, op string, db string, coll string, id long, doc struct<v: int>"


def write_log(spark, folder, events, mode="append"):
    rows = [(s, None, op, db, "things", i, None if v is None else (v,)) for s, op, db, i, v in events]
    spark.createDataFrame(rows, LOG).coalesce(1).write.mode(mode).parquet(folder)


def replicator(spark, tmp_path, snapshot):
    store = KeyedStore(spark, f"{tmp_path}/target/things", ["id"], "id long, v int", buckets=4)
    source = Source(spark, "d", {"things": spark.createDataFrame(snapshot, "id long, v int")}, f"{tmp_path}/log", LOG)
    return Replicator(source, {"things": store}, {"things": "things"}, f"{tmp_path}/checkpoint"), store


def rows(store):
    return dict(map(tuple, store.read().collect()))


def test_snapshot_then_stream_then_restart(spark, tmp_path):
    write_log(spark, f"{tmp_path}/log", [(1, "insert", "d", 1, 1), (2, "insert", "other", 9, 9)])
    live, store = replicator(spark, tmp_path, [(1, 10), (2, 20)])
    live.start().awaitTermination()
    assert rows(store) == {1: 10, 2: 20}  # the log up to the snapshot's position is part of the snapshot
    write_log(spark, f"{tmp_path}/log", [(3, "update", "d", 1, 11), (4, "delete", "d", 2, None), (5, "insert", "d", 3, 3)])
    live.start().awaitTermination()
    assert rows(store) == {1: 11, 3: 3}
    write_log(spark, f"{tmp_path}/log", [(6, "replace", "d", 3, 33)])
    replicator(spark, tmp_path, [(1, -1)])[0].start().awaitTermination()  # a new process: no second snapshot
    assert rows(store) == {1: 11, 3: 33}


def test_late_and_repeated_events_do_nothing(spark, tmp_path):
    store = KeyedStore(spark, f"{tmp_path}/s", ["id"], "id long, v int", buckets=2)
    batch = lambda events: spark.createDataFrame([(i, s, op, None if v is None else (v,)) for s, op, i, v in events], "id long, seq long, op string, doc struct<v: int>")
    assert store.take(batch([(5, "insert", 1, 5), (6, "delete", 2, None)]), 0)
    assert not store.take(batch([(7, "insert", 1, 7)]), 0)
    assert store.take(batch([(4, "insert", 2, 4), (3, "update", 1, 3)]), 1)
    assert rows(store) == {1: 5}
    assert store.clean() >= 0 and rows(store) == {1: 5}


def test_an_interrupted_copy_starts_again(spark, tmp_path):
    write_log(spark, f"{tmp_path}/log", [(1, "insert", "d", 1, 1)])
    live, store = replicator(spark, tmp_path, [(1, 1), (2, 2)])
    store.publish(store.manifest() | {"phase": "loading", "position": 0})
    live.start().awaitTermination()
    assert rows(store) == {1: 1, 2: 2} and store.manifest()["phase"] == "loaded"


def test_lost_history_leads_to_a_new_snapshot(spark, tmp_path):
    write_log(spark, f"{tmp_path}/log", [(1, "insert", "d", 1, 1)])
    live, store = replicator(spark, tmp_path, [(1, 1)])
    live.snapshot()
    write_log(spark, f"{tmp_path}/log", [(50, "insert", "d", 5, 5)], mode="overwrite")
    again, store = replicator(spark, tmp_path, [(7, 7)])
    again.start().awaitTermination()
    assert rows(store) == {7: 7}


def test_failing_batches_are_replayed(spark, tmp_path):
    write_log(spark, f"{tmp_path}/log", [(1, "insert", "d", 1, 1)])
    live, store = replicator(spark, tmp_path, [])
    live.snapshot()
    write_log(spark, f"{tmp_path}/log", [(2, "insert", "d", 2, 2)])
    original = live.apply

    def fails(batch, number):
        original(batch, number)
        raise RuntimeError("after the write")

    live.apply = fails
    with pytest.raises(Exception, match="after the write"):
        live.start().awaitTermination()
    live.apply = original
    live.start().awaitTermination()
    assert rows(store) == {2: 2}


def test_tokens(spark, tmp_path):
    file = TokenFile(spark, f"{tmp_path}/token.json")
    assert file.load() is None and json.loads((tmp_path / "token.json").read_text()) == {"_data": ""}
    for i in range(13):
        file.save({"_data": f"t{i}"})
    assert file.load() == "t12" and (tmp_path / "token.json.10").exists() and not (tmp_path / "token.json.11").exists()
    (tmp_path / "token.json").write_text("broken")
    for crc in tmp_path.glob(".*.crc"):
        crc.unlink()
    assert file.load() == "t11" and file.load() == "t11"
    file.delete()
    assert not list(tmp_path.glob("token.json*"))


@pytest.mark.parametrize("token, text", [("a", "a"), ({"_data": "a"}, "a"), ({"_data": {"_data": "a"}}, "a"), ("map[_data:a]", "a"), (None, ""), (b"a", "a")])
def test_token_shapes(token, text):
    assert normalised(token) == text


def test_token_content():
    assert parse('{"_data": ""}') is None and parse('{"_data": "x"}') == "x"
    with pytest.raises(ValueError):
        parse("[1]")


def test_copy_pair_reports_each_collection(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (1, "a"), (None, "n")], "k int, v string").write.parquet(f"{tmp_path}/src/db/one.parquet")
    spark.createDataFrame([("x",)], "other string").write.parquet(f"{tmp_path}/src/db/two.parquet")
    raw = {"databasePairs": [{"source": {"connectionString": f"{tmp_path}/src", "database": "db"}, "target": {"connectionString": f"{tmp_path}/dst", "database": "db"}}], "retryConfig": {"maxRetries": 1}}
    c = config.parse(raw)
    found = {r.collection: r for r in copying.copy_pair(spark, c.pairs[0], c, lambda _: ["k"]).collect()}
    assert found["one"].rows_read == 3 and found["one"].rows_rejected == 1 and found["one"].rows_written == 1 and found["one"].error is None
    assert found["two"].error is not None
    assert catalog.collections(spark, f"{tmp_path}/dst/db") == ["one"]
    assert files.exists(spark, f"{tmp_path}/dst/db/one.parquet")


def test_copying_again_keeps_or_replaces(spark, tmp_path):
    spark.createDataFrame([(1, "new")], "k int, v string").write.parquet(f"{tmp_path}/src/db/one.parquet")
    spark.createDataFrame([(1, "old"), (2, "two")], "k int, v string").write.parquet(f"{tmp_path}/dst/db/one.parquet")
    raw = {"databasePairs": [{"source": {"connectionString": f"{tmp_path}/src", "database": "db"}, "target": {"connectionString": f"{tmp_path}/dst", "database": "db"}}]}
    for upsert, want in ((False, {1: "old", 2: "two"}), (True, {1: "new", 2: "two"})):
        raw["databasePairs"][0]["target"]["collections"] = [{"sourceCollection": "one", "targetCollection": "one", "upsertMode": upsert}]
        c = config.parse(raw)
        assert copying.copy_pair(spark, c.pairs[0], c, lambda _: ["k"]).first()["error"] is None
        assert dict(map(tuple, spark.read.parquet(f"{tmp_path}/dst/db/one.parquet").collect())) == want


def test_configured_indexes_are_recorded_in_the_target(spark, tmp_path):
    for folder in ("src", "dst"):
        spark.createDataFrame([(1, "a"), (2, "a")], "k int, v string").write.parquet(f"{tmp_path}/{folder}/db/{'one' if folder == 'src' else 'uno'}.parquet")
    own = lambda name, field, **more: {"coll": "one", "name": name, "keys": [{"field": field, "direction": "1"}], **more}
    catalog.record_indexes(spark, f"{tmp_path}/src/db", [own("k", "k", unique=True, expire_after_seconds=5), own("v", "v", unique=True), own("spare", "v"), own("there", "k"), own("_id_", "k"), {"coll": "one", "name": "bare"}])
    catalog.record_indexes(spark, f"{tmp_path}/dst/db", [{**own("there", "v"), "coll": "uno"}])
    target = {"connectionString": f"{tmp_path}/dst", "database": "db", "collections": [{"sourceCollection": "one", "targetCollection": "uno"}], "indexes": [{"sourceCollection": "one", "indexNames": ["k", "v", "there", "_id_", "bare", "none"]}]}
    pair = config.parse({"databasePairs": [{"source": {"connectionString": f"{tmp_path}/src", "database": "db"}, "target": target}]}).pairs[0]
    status = {r["name"]: r["status"] for r in copying.sync_indexes(spark, pair).collect()}
    assert status == {"k": "created", "v": "broken", "there": "differs", "bare": "no_keys", "none": "missing"}
    kept = {r["name"]: r for r in catalog.indexes(spark, f"{tmp_path}/dst/db").collect()}
    assert set(kept) == {"k", "there"} and kept["k"]["coll"] == "uno" and kept["k"]["unique"] and kept["k"]["expire_after_seconds"] == 5
    assert {r["name"]: r["status"] for r in copying.sync_indexes(spark, pair).collect()}["k"] == "exists"
    assert catalog.collections(spark, f"{tmp_path}/dst/db") == ["uno"]


def test_unreadable_index_definitions_are_result_rows(spark, tmp_path):
    files.write_text(spark, f"{tmp_path}/src/db/{catalog.INDEX_FILE}", "no json\n")
    target = {"connectionString": f"{tmp_path}/dst", "database": "db", "indexes": [{"sourceCollection": "one", "indexNames": ["k"]}]}
    pair = config.parse({"databasePairs": [{"source": {"connectionString": f"{tmp_path}/src", "database": "db"}, "target": target}]}).pairs[0]
    assert copying.sync_indexes(spark, pair).first()["status"].startswith("failed: ")


def test_history_lost_after_batches_is_seen(spark, tmp_path):
    write_log(spark, f"{tmp_path}/log", [(1, "insert", "d", 1, 1)])
    live, store = replicator(spark, tmp_path, [(1, 10)])
    live.start().awaitTermination()
    write_log(spark, f"{tmp_path}/log", [(2, "update", "d", 1, 11), (3, "insert", "other", 9, 9)])
    live.start().awaitTermination()
    assert store.manifest()["upto"] == 3
    live.check_history()  # the log still begins before 4
    write_log(spark, f"{tmp_path}/log", [(4, "update", "d", 1, 12)], mode="overwrite")
    live.check_history()
    write_log(spark, f"{tmp_path}/log", [(6, "update", "d", 1, 13)], mode="overwrite")
    with pytest.raises(LostHistory):
        live.check_history()


def test_a_failed_rename_keeps_the_old_folder(spark, tmp_path, monkeypatch):
    spark.range(3).write.parquet(f"{tmp_path}/t.parquet")
    spark.range(5).write.parquet(f"{tmp_path}/.t.part")
    real = files.rename

    def refuse(session, old, new):
        if old.endswith(".part"):
            raise OSError("refused")
        real(session, old, new)

    monkeypatch.setattr(files, "rename", refuse)
    with pytest.raises(OSError):
        files.replace(spark, f"{tmp_path}/.t.part", f"{tmp_path}/t.parquet")
    assert spark.read.parquet(f"{tmp_path}/t.parquet").count() == 3
    monkeypatch.setattr(files, "rename", real)
    files.replace(spark, f"{tmp_path}/.t.part", f"{tmp_path}/t.parquet")
    assert spark.read.parquet(f"{tmp_path}/t.parquet").count() == 5 and files.listing(spark, str(tmp_path)) == ["t.parquet"]
