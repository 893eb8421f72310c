"""Queries over the change log that `events` stands for, each with the SQL it is held against.

seq = event_id, id = user_id, op by event_type, doc = (value, props), collections c0 to c2 of database shop by props.k.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions import ids
from tidewright.operators import changes
from tidewright.registry import query
from tidewright.sources import files

OP_OF_TYPE = {"signup": "insert", "click": "update", "view": "update", "purchase": "replace", "error": "delete"}
WORKERS, GROUP, THRESHOLD, RESUME, EVERY_S = 8, 128, 100, 5000, 21600

_SQL_OP = "case event_type when 'signup' then 'insert' when 'click' then 'update' when 'view' then 'update' when 'purchase' then 'replace' when 'error' then 'delete' end"
_SQL_LOG = f"""log as (
    select event_id as seq, ts, {_SQL_OP} as op, 'shop' as db,
           'c' || (cast(json_extract_string(props, '$.k') as integer) % 3) as coll, user_id as id, value, props
    from events)"""
_SQL_LAST = "last as (select * from (select *, row_number() over (partition by {key} order by seq desc) as r from log {where}) where r = 1)"
_SQL_FNV = """list_reduce(
    list_prepend(cast(2166136261 as bigint), list_transform(string_split(cast({id} as varchar), ''), lambda c: cast(ord(c) as bigint))),
    lambda a, b: (xor(a, b) * 16777619) % 4294967296)"""


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    op = F.create_map(*[F.lit(x) for pair in OP_OF_TYPE.items() for x in pair])
    return events.select(
        F.col("event_id").alias("seq"),
        "ts",
        op[F.col("event_type")].alias("op"),
        F.lit("shop").alias("db"),
        F.concat(F.lit("c"), (F.get_json_object("props", "$.k").cast("int") % 3).cast("string")).alias("coll"),
        F.col("user_id").alias("id"),
        F.struct("value", "props").alias("doc"),
    )


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return table.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("value"), F.col("c_mktsegment").alias("props"))


_SQL_APPLIED = f"""
    with {_SQL_LOG}, {_SQL_LAST.format(key="id", where="")}
    select c_custkey as id, c_acctbal as value, c_mktsegment as props from customer where c_custkey not in (select id from last)
    union all select id, value, props from last where op <> 'delete'"""


@query("cdc_apply_to_snapshot", _SQL_APPLIED)
def cdc_apply_to_snapshot(spark, sf_dir):
    return changes.applied(customers(spark, sf_dir), events_log(spark, sf_dir), ("id",))


@query("cdc_stream_replay", _SQL_APPLIED)
def cdc_stream_replay(spark, sf_dir):
    """The same state, by a snapshot and a stream of log files in micro-batches into a keyed store."""
    from tidewright.streaming.replication import Replicator, Source
    from tidewright.streaming.store import KeyedStore

    folder = files.new_folder(spark, "replay")
    log = events_log(spark, sf_dir).withColumn("coll", F.lit("customers"))
    log.repartitionByRange(6, "seq").sortWithinPartitions("seq").write.parquet(f"{folder}/log")
    store = KeyedStore(spark, f"{folder}/customers", ["id"], "id long, value double, props string", buckets=8)
    store.load(customers(spark, sf_dir), -1)
    source = Source(spark, "shop", {}, f"{folder}/log", ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in log.schema.fields))
    live = Replicator(source, {"customers": store}, {"customers": "customers"}, f"{folder}/checkpoint")
    stream = source.stream(files_per_batch=2).writeStream.foreachBatch(live.apply).option("checkpointLocation", live.checkpoint).trigger(availableNow=True).start()
    stream.awaitTermination()
    return store.read()


@query(
    "cdc_final_state",
    f"""with {_SQL_LOG}, {_SQL_LAST.format(key="db, coll, id", where="")}
    select db, coll, id, seq, op, value, props from last where op <> 'delete'""",
)
def cdc_final_state(spark, sf_dir):
    return changes.final_state(events_log(spark, sf_dir)).select("db", "coll", "id", "seq", "op", "doc.value", "doc.props")


@query(
    "cdc_resume_after",
    f"""with {_SQL_LOG}, {_SQL_LAST.format(key="db, coll, id", where=f"where seq > {RESUME}")}
    select db, coll, id, seq, op, value from last where op <> 'delete'""",
)
def cdc_resume_after(spark, sf_dir):
    return changes.final_state(changes.resumed(events_log(spark, sf_dir), RESUME)).select("db", "coll", "id", "seq", "op", "doc.value")


@query(
    "cdc_operation_groups",
    f"""with {_SQL_LOG},
    dealt as (select *, cast({_SQL_FNV.format(id="id")} % {WORKERS} as integer) as worker from log),
    marked as (select *, case when lag(db || '.' || coll || '.' || op) over w = db || '.' || coll || '.' || op then 0 else 1 end as fresh
               from dealt window w as (partition by worker order by seq)),
    numbered as (select *, cast(sum(fresh) over (partition by worker order by seq) as bigint) as island from marked),
    placed as (select *, (row_number() over (partition by worker, island order by seq) - 1) // {GROUP} as grp from numbered)
    select worker, island, cast(grp as bigint) as "group", db, coll, op, count(*) as n_events, min(seq) as first_seq, max(seq) as last_seq
    from placed group by worker, island, grp, db, coll, op""",
)
def cdc_operation_groups(spark, sf_dir):
    return changes.groups(events_log(spark, sf_dir), WORKERS, GROUP)


@query(
    "cdc_worker_fnv",
    f"""select id, hash, cast(hash % {WORKERS} as integer) as worker
    from (select user_id as id, cast({_SQL_FNV.format(id="user_id")} as bigint) as hash from (select distinct user_id from events))""",
)
def cdc_worker_fnv(spark, sf_dir):
    text = ids.canonical(F.col("id"))
    return events_log(spark, sf_dir).select("id").distinct().select("id", ids.fnv1a(text).alias("hash"), ids.worker(text, WORKERS).alias("worker"))


@query("cdc_op_counts_by_namespace", f"with {_SQL_LOG} select db, coll, op, count(*) as n_events from log group by db, coll, op")
def cdc_op_counts_by_namespace(spark, sf_dir):
    return events_log(spark, sf_dir).groupBy("db", "coll", "op").agg(F.count(F.lit(1)).alias("n_events"))


@query(
    "cdc_namespace_routing",
    f"""with {_SQL_LOG}, names as (select * from (values ('shop', 'c0', 'first'), ('shop', 'c1', 'second'), ('other', 'c2', 'third')) t(db, source, target))
    select log.coll as coll, coalesce(names.target, log.coll) as target, count(*) as n_events
    from log left join names on log.db = names.db and log.coll = names.source group by 1, 2""",
)
def cdc_namespace_routing(spark, sf_dir):
    names = spark.createDataFrame([("shop", "c0", "first"), ("shop", "c1", "second"), ("other", "c2", "third")], "db string, source string, target string")
    return changes.routed(events_log(spark, sf_dir), names, passthrough=True).groupBy("coll", "target").agg(F.count(F.lit(1)).alias("n_events"))


@query(
    "cdc_mapped_only",
    f"""with {_SQL_LOG} select case coll when 'c0' then 'first' else 'second' end as target, count(*) as n_events
    from log where coll in ('c0', 'c1') group by 1""",
)
def cdc_mapped_only(spark, sf_dir):
    names = spark.createDataFrame([("shop", "c0", "first"), ("shop", "c1", "second"), ("other", "c2", "third")], "db string, source string, target string")
    return changes.routed(events_log(spark, sf_dir), names).groupBy("target").agg(F.count(F.lit(1)).alias("n_events"))


@query(
    "cdc_rejects",
    f"""with {_SQL_LOG}, broken as (
        select seq, case when seq % 11 = 0 then null else id end as id, case when seq % 13 = 0 then '' else coll end as coll,
               case when seq % 17 = 0 then 'invalidate' else op end as op, seq % 19 = 0 as bare from log),
    judged as (select case when id is null then 'no_key' when coll = '' then 'no_namespace'
                           when op not in ('insert', 'update', 'replace', 'delete') then 'unknown_op'
                           when op <> 'delete' and bare then 'no_document' end as reason from broken)
    select reason, count(*) as n_events from judged where reason is not null group by reason""",
)
def cdc_rejects(spark, sf_dir):
    log = events_log(spark, sf_dir)
    broken = (
        log.withColumn("id", F.when(F.col("seq") % 11 != 0, F.col("id")))
        .withColumn("coll", F.when(F.col("seq") % 13 == 0, F.lit("")).otherwise(F.col("coll")))
        .withColumn("op", F.when(F.col("seq") % 17 == 0, F.lit("invalidate")).otherwise(F.col("op")))
        .withColumn("doc", F.when(F.col("seq") % 19 != 0, F.col("doc")))
    )
    return changes.rejected(broken).groupBy("reason").agg(F.count(F.lit(1)).alias("n_events"))


@query(
    "cdc_count_checkpoints",
    f"""with n as (select event_id as seq, row_number() over (order by event_id) as saved from events)
    select seq, saved from n where saved % {THRESHOLD} = 0""",
)
def cdc_count_checkpoints(spark, sf_dir):
    return changes.checkpoints_by_count(events_log(spark, sf_dir), THRESHOLD)


@query(
    "cdc_dual_checkpoints",
    f"""with recursive e as (select event_id as seq, epoch_us(ts) as us, row_number() over (order by event_id) as n from events),
    saves as (
        select cast(0 as bigint) as n, (select us from e where n = 1) as us, cast(0 as bigint) as since
        union all
        select f.n, f.us, s.n from saves s join lateral (
            select e.n, e.us from e where e.n > s.n and (e.n - s.n >= {THRESHOLD} or e.us - s.us >= {EVERY_S}000000) order by e.n limit 1) f on true)
    select e.seq, saves.n - saves.since as n_events from saves join e on e.n = saves.n""",
)
def cdc_dual_checkpoints(spark, sf_dir):
    return changes.checkpoints(events_log(spark, sf_dir), THRESHOLD, EVERY_S)


@query(
    "cdc_event_rate",
    "select cast(epoch(time_bucket(interval '5 minutes', ts)) as bigint) as window_start, count(*) as n_events from events group by 1",
)
def cdc_event_rate(spark, sf_dir):
    return changes.event_rate(events_log(spark, sf_dir)).select(F.unix_seconds("window_start").alias("window_start"), "n_events")


@query("cdc_ordered_writes", f"with {_SQL_LOG} select op, op in ('update', 'replace') as ordered, count(*) as n_events from log group by 1, 2")
def cdc_ordered_writes(spark, sf_dir):
    return events_log(spark, sf_dir).groupBy("op", changes.ordered_writes(F.col("op")).alias("ordered")).agg(F.count(F.lit(1)).alias("n_events"))


@query("cdc_lost_history", "select min(event_id) > 41 as lost from events where event_id > 100")
def cdc_lost_history(spark, sf_dir):
    return changes.lost_history(events_log(spark, sf_dir).where("seq > 100"), 40)


def broken_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log with rows in it that must touch nothing: unknown operations that carry a document, changes that carry none, no namespace."""
    log = events_log(spark, sf_dir)
    return log.select(
        "seq",
        "ts",
        F.when(F.col("seq") % 97 == 3, "invalidate").otherwise(F.col("op")).alias("op"),
        F.when(F.col("seq") % 101 == 7, "").otherwise(F.col("db")).alias("db"),
        "coll",
        "id",
        F.when((F.col("seq") % 89 == 5) & (F.col("op") != "delete"), F.lit(None)).otherwise(F.col("doc")).alias("doc"),
    )


_WHOLE = "where seq % 97 <> 3 and seq % 101 <> 7 and (seq % 89 <> 5 or op = 'delete')"


@query(
    "cdc_apply_broken_log",
    f"""
    with {_SQL_LOG}, {_SQL_LAST.format(key="id", where=_WHOLE)}
    select c_custkey as id, c_acctbal as value, c_mktsegment as props from customer where c_custkey not in (select id from last)
    union all select id, value, props from last where op <> 'delete'""",
)
def cdc_apply_broken_log(spark, sf_dir):
    return changes.applied(customers(spark, sf_dir), broken_log(spark, sf_dir), ("id",))


@query(
    "cdc_final_state_broken_log",
    f"""
    with {_SQL_LOG}, {_SQL_LAST.format(key="db, coll, id", where=_WHOLE)}
    select db, coll, id, seq, value, props from last where op <> 'delete'""",
)
def cdc_final_state_broken_log(spark, sf_dir):
    return changes.final_state(broken_log(spark, sf_dir)).select("db", "coll", "id", "seq", F.col("doc.value").alias("value"), F.col("doc.props").alias("props"))
