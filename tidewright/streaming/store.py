"""A keyed table in versions: what a change stream is written into, since plain files know no merge.

A folder holds `data/<version>/bucket=<b>/` and a small manifest that names, for each bucket of keys, the version it was last
written in, beside the last batch taken in. A batch rewrites only the buckets that its keys fall into, then the manifest is
replaced in one step: readers see the state before or after a batch, and a batch that comes again is skipped by its number.
Rows keep the position of their last event and deleted keys stay as tombstones, so events that come late or twice do nothing.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions import ids
from tidewright.operators import changes
from tidewright.sources import files

MANIFEST = "manifest.json"


class KeyedStore:
    """key and fields name the table's columns; `schema` their types, as DDL."""

    def __init__(self, spark: SparkSession, folder: str, key: list[str], schema: str, buckets: int = 64):
        self.spark, self.folder, self.key, self.schema, self.buckets = spark, folder.rstrip("/"), key, schema, buckets
        self.fields = [f.name for f in spark.createDataFrame([], schema).schema.fields if f.name not in key]

    def manifest(self) -> dict:
        path = f"{self.folder}/{MANIFEST}"
        if not files.exists(self.spark, path):
            return {"version": 0, "batch": None, "phase": "empty", "position": None, "buckets": {}}
        return json.loads(files.read_text(self.spark, path))

    def publish(self, manifest: dict) -> None:
        files.write_text(self.spark, f"{self.folder}/{MANIFEST}", json.dumps(manifest, sort_keys=True))

    def _state(self, buckets: dict) -> DataFrame:
        """The named buckets with seq and deleted."""
        schema = f"{self.schema}, seq long, deleted boolean"
        paths = [f"{self.folder}/data/{version}/bucket={bucket}" for bucket, version in buckets.items()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        """The rows that exist, as of the last published batch."""
        return self._state(self.manifest()["buckets"]).where("not deleted").select(*self.key, *self.fields)

    def _write(self, rows: DataFrame, manifest: dict, touched: list[int], **news) -> dict:
        version = manifest["version"] + 1
        path = f"{self.folder}/data/{version}"
        files.delete(self.spark, path)  # what an attempt that didn't get to publish has left
        rows.withColumn("bucket", self._bucket()).repartition(F.col("bucket")).write.partitionBy("bucket").parquet(path)
        there = [int(n.removeprefix("bucket=")) for n in files.listing(self.spark, path) if n.startswith("bucket=")]
        buckets = {b: v for b, v in manifest["buckets"].items() if int(b) not in touched} | {str(b): version for b in there}
        after = manifest | {"version": version, "buckets": buckets} | news
        self.publish(after)
        return after

    def _bucket(self) -> F.Column:
        return ids.placed(F.struct(*self.key) if len(self.key) > 1 else F.col(self.key[0]), self.buckets)

    def load(self, snapshot: DataFrame, position: int | None) -> None:
        """Write a whole snapshot, taken when the log was at a position: events after it are applied over it."""
        rows = snapshot.select(*self.key, *self.fields, F.lit(-1).cast("long").alias("seq"), F.lit(False).alias("deleted"))
        manifest = self.manifest()
        self._write(rows, manifest | {"buckets": {}}, list(range(self.buckets)), phase="loaded", position=position, batch=None, upto=position)

    def take(self, log: DataFrame, batch: int | None = None, upto: int | None = None) -> bool:
        """Apply a batch of events (key, seq, op, doc); False if the manifest says that it is in already.

        upto is the position that the log has been read to, other collections' events included. Versions go that neither the
        new manifest names nor the one before it, which readers may still hold.
        """
        manifest = self.manifest()
        if batch is not None and manifest["batch"] is not None and batch <= manifest["batch"]:
            return False
        last = changes.last_events(log.select(*self.key, F.col("seq").cast("long").alias("seq"), "op", "doc"), tuple(self.key))
        rows = last.select(*self.key, *[F.col("doc")[f].alias(f) for f in self.fields], "seq", (F.col("op") == "delete").alias("deleted"))
        rows = rows.persist()
        try:
            known = manifest.get("upto")
            upto = known if upto is None else upto if known is None else max(known, upto)
            touched = [r[0] for r in rows.select(self._bucket().alias("b")).distinct().collect()]  # at most `buckets` numbers
            if touched:
                old = self._state({b: v for b, v in manifest["buckets"].items() if int(b) in touched})
                both = old.unionByName(rows)
                rest = [*self.fields, "deleted"]
                best = both.groupBy(*self.key).agg(F.max_by(F.struct("seq", *rest), "seq").alias("_row"))
                self._write(best.select(*self.key, *[F.col("_row")[c].alias(c) for c in (*self.fields, "seq", "deleted")]), manifest, touched, batch=batch, upto=upto)
                self.clean(manifest["buckets"])
            elif batch is not None:
                self.publish(manifest | {"batch": batch, "upto": upto})
        finally:
            rows.unpersist()
        return True

    def clean(self, spared: dict | None = None) -> int:
        """Remove versions that neither the manifest nor the spared buckets name; how many."""
        used = {str(v) for v in (*self.manifest()["buckets"].values(), *(spared or {}).values())}
        old = [n for n in files.listing(self.spark, f"{self.folder}/data") if n not in used]
        for name in old:
            files.delete(self.spark, f"{self.folder}/data/{name}")
        return len(old)

