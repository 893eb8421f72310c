"""Change logs: from raw events to the last state of each key, and that state applied to a snapshot.

A log row is (seq, ts, op, db, coll, id, doc): seq gives the order, op is one of OPS, id the key inside (db, coll), doc the
whole row after the change as a struct, null on deletes. Every function takes and returns DataFrames without any state, so
batch queries and streams share them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidewright.functions import ids

OPS = ("insert", "update", "replace", "delete")
KEY = ("db", "coll", "id")


def rejected(log: DataFrame) -> DataFrame:
    """log's rows that are never applied, with `reason`.

    no_key: the event names no row; no_namespace: no db or collection; unknown_op: not one of OPS; no_document: an event other
    than a delete carries no document, so the state before it stays.
    """
    reason = (
        F.when(F.col("id").isNull(), "no_key")
        .when(F.col("db").isNull() | F.col("coll").isNull() | (F.col("db") == "") | (F.col("coll") == ""), "no_namespace")
        .when(F.col("op").isNull() | ~F.col("op").isin(*OPS), "unknown_op")
        .when((F.col("op") != "delete") & F.col("doc").isNull(), "no_document")
    )
    return log.withColumn("reason", reason).where("reason is not null")


def applicable(log: DataFrame, db: str | None = None, key: tuple[str, ...] = ("id",)) -> DataFrame:
    """log's rows that count, of one database if given. Logs of a single collection may do without db and coll."""
    named = [F.col(c) != "" for c in ("db", "coll") if c in log.columns]
    whole = [F.col(c).isNotNull() for c in key]
    out = log.where(reduce(lambda a, b: a & b, [*whole, *named, F.col("op").isin(*OPS), (F.col("op") == "delete") | F.col("doc").isNotNull()]))
    return out if db is None else out.where(F.col("db") == db)


def resumed(log: DataFrame, after: int | None) -> DataFrame:
    """Events strictly after a position; all of them without one."""
    return log if after is None else log.where(F.col("seq") > after)


def routed(log: DataFrame, mapping: DataFrame, passthrough: bool = False) -> DataFrame:
    """log with `target`: the name that mapping (db, source, target) gives its collection.

    Events of unmapped collections go; with passthrough they keep their collection's name.
    """
    names = mapping.select(F.col("db").alias("_db"), F.col("source").alias("_coll"), "target")
    on = (F.col("db") == F.col("_db")) & (F.col("coll") == F.col("_coll"))
    joined = log.join(names, on, "left" if passthrough else "inner").drop("_db", "_coll")
    return joined.withColumn("target", F.coalesce("target", "coll")) if passthrough else joined


def last_events(log: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """The last event of each key. A running maximum per task goes into the shuffle, so a hot key costs a row a task."""
    rest = [c for c in log.columns if c not in (*key, "seq")]
    last = log.groupBy(*key).agg(F.max_by(F.struct("seq", *rest), "seq").alias("_last"))
    return last.select(*key, *[F.col("_last")[c].alias(c) for c in ("seq", *rest)])


def final_state(log: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """Keys that exist after the log's applicable rows, with their last document."""
    return last_events(applicable(log, key=key), key).where("op <> 'delete'")


def applied(snapshot: DataFrame, log: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """snapshot after log: rows of touched keys go, the last documents of keys that aren't deleted come in.

    snapshot has the key and the fields of doc. Rows of the log that aren't applicable touch nothing. The log is reduced to a
    row a key, which then takes the place of the snapshot's row in an anti-join.
    """
    fields = [c for c in snapshot.columns if c not in key]
    new = last_events(applicable(log, key=key).select(*key, F.col("seq").cast("long").alias("seq"), "op", F.struct(*[F.col("doc")[c].alias(c) for c in fields]).alias("doc")), key)
    kept = snapshot.join(new.select(*key), list(key), "left_anti").select(*key, *fields)
    return kept.unionByName(new.where("op <> 'delete'").select(*key, *[F.col("doc")[c].alias(c) for c in fields]))


def grouped(log: DataFrame, workers: int = 8, most: int = 128, worker: Column | None = None) -> DataFrame:
    """log with worker, island and group: runs of one kind and namespace in a worker's order, cut at `most` events.

    This is what bulk writes are made of; it changes no final state.
    """
    own = W.partitionBy("worker").orderBy("seq")
    inside = W.partitionBy("worker", "island").orderBy("seq")
    kind = F.struct("db", "coll", "op")
    return (
        log.withColumn("worker", ids.worker(ids.canonical(F.col("id")), workers) if worker is None else worker)
        .withColumn("_new", F.coalesce((F.lag(kind).over(own) != kind).cast("int"), F.lit(1)))
        .withColumn("island", F.sum("_new").over(own))
        .withColumn("group", F.floor((F.row_number().over(inside) - 1) / most))
        .drop("_new")
    )


def groups(log: DataFrame, workers: int = 8, most: int = 128) -> DataFrame:
    """worker, island, group, db, coll, op, n_events, first_seq, last_seq of every group."""
    return (
        grouped(log, workers, most)
        .groupBy("worker", "island", "group")
        .agg(F.first("db").alias("db"), F.first("coll").alias("coll"), F.first("op").alias("op"), F.count(F.lit(1)).alias("n_events"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))
    )


def ordered_writes(op: Column, forced: bool = False) -> Column:
    """Whether a group's writes keep their order: updates and replaces always, others when forced."""
    return F.lit(True) if forced else op.isin("update", "replace")


def checkpoints_by_count(log: DataFrame, threshold: int) -> DataFrame:
    """seq, saved (events so far): after every `threshold` events."""
    from tidewright.plans.ranges import positions

    return positions(log.select("seq"), "seq").where((F.col("position") + 1) % threshold == 0).select("seq", (F.col("position") + 1).alias("saved"))


def checkpoints(log: DataFrame, threshold: int, interval_s: int) -> DataFrame:
    """seq, n_events: saves after `threshold` events or once `interval_s` passed since the last, whichever comes first.

    Both counts start anew at each save and time is looked at when an event arrives, so each save depends on the one before:
    one ordered pass over two columns, with three numbers of state.
    """
    import pyarrow as pa

    def run(batches):
        count, since = 0, None
        for batch in batches:
            seqs, sizes = [], []
            for seq, ts in zip(batch.column("seq").to_pylist(), batch.column("us").to_pylist(), strict=True):
                since = ts if since is None else since
                count += 1
                if count >= threshold or ts - since >= interval_s * 1_000_000:
                    seqs.append(seq)
                    sizes.append(count)
                    count, since = 0, ts
            yield pa.RecordBatch.from_arrays([pa.array(seqs, pa.int64()), pa.array(sizes, pa.int64())], ["seq", "n_events"])

    slim = log.select(F.col("seq").cast("long").alias("seq"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return slim.repartition(1).sortWithinPartitions("seq").mapInArrow(run, "seq long, n_events long")


def event_rate(log: DataFrame, every: str = "5 minutes") -> DataFrame:
    """window_start, n_events of the windows that have events."""
    spans = log.groupBy(F.window(F.col("ts").cast("timestamp"), every).alias("w")).agg(F.count(F.lit(1)).alias("n_events"))
    return spans.select(F.col("w.start").alias("window_start"), "n_events")


def lost_history(log: DataFrame, after: int) -> DataFrame:
    """One row, lost: whether the log no longer reaches back to a position, so that a new snapshot is needed."""
    return log.agg(F.coalesce(F.min("seq") > F.lit(after) + 1, F.lit(False)).alias("lost"))
