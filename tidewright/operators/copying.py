"""Copies of whole databases: collections side by side, each with its result, so that no failure passes silently."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright import catalog
from tidewright.config import Config, Pair
from tidewright.functions import policy
from tidewright.operators import snapshots
from tidewright.plans import ranges
from tidewright.sources import files

LOG = logging.getLogger("tidewright.copy")
RESULT = "db string, collection string, target string, rows_read long, rows_rejected long, rows_written long, partitions int, seconds double, error string"
INDEX_RESULT = "db string, collection string, target string, name string, status string"


def copy_collection(spark: SparkSession, source: str, target: str, mapping, key: list[str], config: Config) -> dict:
    """Copy one collection into a new folder beside the old one, then put it in its place; a failure leaves the old one."""
    df = catalog.table(spark, source, mapping.source)
    rows = df.count()
    parts = 1
    if ranges.reads_in_parallel(rows, config.switches["parallelReadsEnabled"], config.numbers["minDocsForParallelReads"]):
        parts = ranges.partition_count(rows, config.numbers["minDocsPerPartition"], config.numbers["maxReadPartitions"])
    rejected = snapshots.without_key(df, key).count()
    where, part = f"{target}/{mapping.target}.parquet", f"{target}/.{mapping.target}.part"
    files.recover(spark, where)
    there = spark.read.parquet(where) if files.exists(spark, where) else None
    order = [F.xxhash64(*df.columns)]  # of equal keys any one may stay, but the same in each run
    out = snapshots.written(df, there, key, order, "replace" if mapping.upsert else "skip")
    if parts > 1:
        out = out.repartitionByRange(parts, *key)
    files.delete(spark, part)
    out.write.parquet(part)
    written = spark.read.parquet(part).count()
    files.replace(spark, part, where)
    return {"rows_read": rows, "rows_rejected": rejected, "rows_written": written, "partitions": parts}


def copy_pair(spark: SparkSession, pair: Pair, config: Config, keys: Callable[[str], list[str]]) -> DataFrame:
    """Copy a pair's collections, some at a time; a row of RESULT each. Connection strings are folders here."""
    source, target = f"{pair.source_uri.rstrip('/')}/{pair.source_db}", f"{pair.target_uri.rstrip('/')}/{pair.target_db}"
    chosen = catalog.selected(pair, catalog.collections(spark, source))
    retry = policy.Policy(config.retry.maxRetries, config.retry.baseDelayMs, config.retry.maxDelayMs, config.retry.enableBatchSplitting, config.retry.minBatchSize)

    def one(mapping) -> tuple:
        began, found, error = time.time(), {}, None
        try:
            retry.again(lambda: found.update(copy_collection(spark, source, target, mapping, keys(mapping.source), config)))
        except Exception as failure:  # one collection's failure is its own result; the others go on
            error = f"{type(failure).__name__}: {failure}"[:500]
            LOG.error("%s: %s", mapping.source, error)
        names = ("rows_read", "rows_rejected", "rows_written", "partitions")
        return (pair.source_db, mapping.source, mapping.target, *(found.get(n) for n in names), time.time() - began, error)

    with ThreadPoolExecutor(config.numbers["concurrentCollections"]) as pool:
        return spark.createDataFrame(list(pool.map(one, chosen)), RESULT)


def index_status(definition: dict | None, there: dict | None, rows: Callable[[], DataFrame]) -> str:
    """What becomes of an index in the target.

    missing: the source has none of that name; exists, differs: the target has it, and keeps its own; no_keys: it names no
    fields; broken: it is unique, but rows repeat; created: it is recorded.
    """
    if definition is None:
        return "missing"
    if there is not None:
        return "exists" if there == definition else "differs"
    if not definition["keys"]:
        return "no_keys"
    if definition["unique"] and not snapshots.duplicate_keys(rows(), [k["field"] for k in definition["keys"]]).isEmpty():
        return "broken"
    return "created"


def sync_indexes(spark: SparkSession, pair: Pair) -> DataFrame:
    """Record a pair's configured indexes beside the target's collections; a row of INDEX_RESULT each, failures too.

    Definitions are metadata, a row each, so they are brought together here; uniqueness is looked at where the rows are.
    """
    source, target = f"{pair.source_uri.rstrip('/')}/{pair.source_db}", f"{pair.target_uri.rstrip('/')}/{pair.target_db}"
    out, unread = [], None
    found, kept = {}, {}
    try:
        wanted = catalog.requested(spark, pair.indexes)
        found = {(r["coll"], r["name"]): r.asDict(recursive=True) for r in catalog.index_options(catalog.index_selection(catalog.indexes(spark, source), wanted)).collect()}
        kept = {(r["coll"], r["name"]): r.asDict(recursive=True) for r in catalog.indexes(spark, target).collect()}
    except Exception as failure:  # indexes never stop a copy
        unread = f"failed: {type(failure).__name__}: {failure}"[:500]
    before = len(kept)
    for request in pair.indexes:
        to = catalog.target_name(pair, request.source)
        for name in request.names:
            if not name or name == catalog.KEY_INDEX:
                continue
            definition = found.get((request.source, name))
            definition = None if definition is None else {**definition, "coll": to}
            try:
                status = unread or index_status(definition, kept.get((to, name)), lambda to=to: catalog.table(spark, target, to))
            except Exception as failure:
                status = f"failed: {type(failure).__name__}: {failure}"[:500]
            if status == "created":
                kept[to, name] = definition
            if status not in ("created", "exists"):
                LOG.warning("index %s of %s: %s", name, to, status)
            out.append((pair.source_db, request.source, to, name, status))
    if len(kept) > before:
        catalog.record_indexes(spark, target, kept.values())
    return spark.createDataFrame(out, INDEX_RESULT)
