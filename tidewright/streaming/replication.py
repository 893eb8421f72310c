"""Live replication: a snapshot, then the change log from where it stood, into keyed stores, one a collection.

The log's position is noted before the snapshot is copied, and the copy is marked done only when it is whole, so an
interrupted first run starts the copy again instead of skipping what was left. Events that happened during the copy are applied
over it; keys and positions make that harmless. Each micro-batch is committed after it was written: what a crash interrupts
comes again under the same number. One stream and one checkpoint a pair, so pairs don't wait for each other.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from tidewright.operators import changes
from tidewright.streaming.store import KeyedStore

LOG = logging.getLogger("tidewright.live")


class LostHistory(RuntimeError):
    """The log no longer reaches back to the position that the target stands at."""


@dataclass
class Source:
    """A database that can be read: collections as tables, and a folder of log files (seq, ts, op, db, coll, id, doc)."""

    spark: SparkSession
    db: str
    tables: dict[str, DataFrame]
    log_folder: str
    log_schema: str

    def log(self) -> DataFrame:
        return self.spark.read.schema(self.log_schema).parquet(self.log_folder)

    def stream(self, files_per_batch: int = 16) -> DataFrame:
        return self.spark.readStream.schema(self.log_schema).option("maxFilesPerTrigger", files_per_batch).parquet(self.log_folder)

    def position(self) -> int:
        """The last position that the log has; -1 if it is empty."""
        return self.log().agg(F.coalesce(F.max("seq"), F.lit(-1))).first()[0]


@dataclass
class Replicator:
    """names: collection to target name. With passthrough, collections without one keep theirs; else their events are left."""

    source: Source
    stores: dict[str, KeyedStore]
    names: dict[str, str]
    checkpoint: str
    passthrough: bool = False
    counts: dict[str, int] = field(default_factory=dict)

    def target(self, collection: str) -> str | None:
        return self.names.get(collection, collection if self.passthrough else None)

    def snapshot(self) -> int:
        """Copy every collection whose copy isn't whole yet; the position that the stream starts after."""
        position = self.source.position()
        for collection, table in self.source.tables.items():
            name = self.target(collection)
            if name is None or name not in self.stores:
                continue
            store = self.stores[name]
            manifest = store.manifest()
            if manifest["phase"] == "loaded":
                continue
            store.publish(manifest | {"phase": "loading", "position": position})
            store.load(table, position)
            LOG.info("copied %s to %s as of %s", collection, name, position)
        return min((s.manifest()["position"] for s in self.stores.values() if s.manifest()["phase"] == "loaded"), default=position)

    def check_history(self) -> None:
        """Raise LostHistory if events between what the targets were last brought up to and the log's first are gone."""
        for store in self.stores.values():
            manifest = store.manifest()
            upto = manifest.get("upto")
            if manifest["phase"] == "loaded" and upto is not None and changes.lost_history(self.source.log(), upto).first()["lost"]:
                raise LostHistory(f"{store.folder} stands at {upto}")

    def restart(self) -> None:
        """Forget copies and positions: the next run begins with a new snapshot."""
        from tidewright.sources import files

        for store in self.stores.values():
            store.publish(store.manifest() | {"phase": "empty", "position": None, "batch": None, "upto": None})
        files.delete(self.source.spark, self.checkpoint)

    def apply(self, batch: DataFrame, number: int) -> None:
        """One micro-batch into all stores. May run again for the same number."""
        mine = changes.applicable(batch, self.source.db)
        upto = batch.agg(F.max("seq")).first()[0]
        by_target: dict[str, list[str]] = {}
        for collection in (*self.names, *(c for c in self.stores if self.passthrough and c not in self.names)):
            by_target.setdefault(self.target(collection), []).append(collection)
        for name, collections in by_target.items():
            if (store := self.stores.get(name)) is None:
                continue
            own = mine.where(F.col("coll").isin(collections))
            store.take(changes.resumed(own, store.manifest()["position"]).withColumnRenamed("id", store.key[0]), number, upto)

    def start(self, available_now: bool = True, every: str = "500 milliseconds") -> StreamingQuery:
        """Snapshot where needed, then stream; available_now stops at the end of the log."""
        try:
            self.check_history()
        except LostHistory as lost:
            LOG.warning("history is lost (%s): starting from a new snapshot", lost)
            self.restart()
        self.snapshot()
        trigger = {"availableNow": True} if available_now else {"processingTime": every}
        return self.source.stream().writeStream.foreachBatch(self.apply).option("checkpointLocation", self.checkpoint).trigger(**trigger).start()


class RateReport(StreamingQueryListener):
    """Logs how many events came a second since the last report; says so too where none came."""

    def __init__(self, every_s: float = 300.0):
        import time

        self.every_s, self.clock, self.since, self.events = every_s, time.monotonic, time.monotonic(), 0

    def onQueryStarted(self, event):
        LOG.info("stream %s started", event.id)

    def onQueryProgress(self, event):
        self.events += event.progress.numInputRows
        passed = self.clock() - self.since
        if passed >= self.every_s:
            if self.events:
                LOG.info("%d events in %.0f s, %.1f a second", self.events, passed, self.events / passed)
            else:
                LOG.info("no events in %.0f s", passed)
            self.since, self.events = self.clock(), 0

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        LOG.info("stream %s ended", event.id)
