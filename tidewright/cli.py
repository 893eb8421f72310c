"""Command line: copy databases, or copy them and keep up with their change logs."""

from __future__ import annotations

import argparse
import logging
import sys
import time

from tidewright import config as settings

LEVELS = {"debug": logging.DEBUG, "info": logging.INFO, "warn": logging.WARNING, "error": logging.ERROR}


def set_level(name: str) -> int:
    """The level of that name for all of this package's messages; info for an unknown one."""
    level = LEVELS.get(name.lower(), logging.INFO)
    logging.getLogger("tidewright").setLevel(level)
    return level


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="tidewright", description=__doc__)
    parser.add_argument("-config", "--config", default="replication.json", help="configuration file")
    parser.add_argument("-mode", "--mode", default="migrate", choices=("migrate", "live"), help="copy once, or copy and follow the change logs")
    parser.add_argument("-log-level", "--log-level", default="info", help="debug, info, warn or error")
    parser.add_argument("--key", default="_id", help="columns of a row's key, comma-separated")
    parser.add_argument("--log-folder", default="_changes", help="folder of change files in a source database (live)")
    return parser.parse_args(argv)


def _live(spark, pair, options):
    """Start a pair's stream."""
    from tidewright import catalog
    from tidewright.streaming.replication import Replicator, Source
    from tidewright.streaming.store import KeyedStore

    source, target = f"{pair.source_uri.rstrip('/')}/{pair.source_db}", f"{pair.target_uri.rstrip('/')}/{pair.target_db}"
    found = [c for c in catalog.collections(spark, source) if c != options.log_folder]
    chosen = catalog.selected(pair, found)
    tables = {m.source: catalog.table(spark, source, m.source) for m in chosen}
    key = options.key.split(",")
    ddl = {name: ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) for name, df in tables.items()}
    stores = {m.target: KeyedStore(spark, f"{target}/{m.target}", key, ddl[m.source]) for m in chosen}
    log_schema = spark.read.parquet(f"{source}/{options.log_folder}").schema
    origin = Source(spark, pair.source_db, tables, f"{source}/{options.log_folder}", log_schema)
    return Replicator(origin, stores, {m.source: m.target for m in chosen}, f"{target}/_checkpoint").start(available_now=False)


def main(argv: list[str] | None = None) -> int:
    """0 if all went well, 1 if a collection failed, 2 if the configuration is wrong."""
    options = arguments(argv)
    logging.basicConfig(format="%(asctime)s %(levelname)s %(message)s")
    set_level(options.log_level)
    log = logging.getLogger("tidewright")
    try:
        config = settings.load(options.config)
    except (OSError, settings.ConfigError) as error:
        log.error("%s", error)
        return 2
    from pyspark.sql import SparkSession

    from tidewright.operators import copying
    from tidewright.streaming.replication import RateReport

    spark = SparkSession.builder.appName("tidewright").config("spark.scheduler.mode", "FAIR").getOrCreate()
    began, failed = time.time(), 0
    if options.mode == "live":
        spark.streams.addListener(RateReport(60.0 * config.numbers["statsIntervalMinutes"]))
        streams = [_live(spark, pair, options) for pair in config.pairs]  # all at once: none waits for another
        for stream in streams:
            stream.awaitTermination()
    else:
        for pair in config.pairs:
            for row in copying.copy_pair(spark, pair, config, lambda _: options.key.split(",")).collect():
                log.info("%s", row.asDict())
                failed += row["error"] is not None
            for row in copying.sync_indexes(spark, pair).collect():
                log.info("%s", row.asDict())
    log.info("%s ended after %.1f s", options.mode, time.time() - began)
    return int(failed > 0)


if __name__ == "__main__":
    sys.exit(main())
