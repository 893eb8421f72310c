"""Databases as folders of collections: listing, selection, names in the target, and index definitions."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.config import IndexRequest, Mapping, Pair
from tidewright.sources import files

#: The index that every collection has and that is never copied.
KEY_INDEX = "_id_"
#: A database's index definitions: a JSON object a line, with the columns of INDEX_SCHEMA.
INDEX_FILE = "_indexes.json"
INDEX_SCHEMA = "coll string, name string, keys array<struct<field: string, direction: string>>, unique boolean, sparse boolean, expire_after_seconds bigint, partial_filter string, default_language string, language_override string, weights map<string, int>, background boolean"


def collections(spark: SparkSession, folder: str) -> list[str]:
    """Names of the collections in a database folder, sorted."""
    return sorted(name.removesuffix(".parquet") for name in files.listing(spark, folder) if not name.startswith((".", "_")) and not name.endswith(".old"))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A collection; nothing is read before it is used."""
    path = f"{folder}/{name}"
    return spark.read.parquet(f"{path}.parquet" if files.exists(spark, f"{path}.parquet") else path)


def selected(pair: Pair, found: Iterable[str]) -> list[Mapping]:
    """What is copied: the configured collections, else every one that was found, under its own name."""
    return list(pair.collections) or [Mapping(name, name) for name in found]


def mapping_rows(spark: SparkSession, pair: Pair, chosen: Iterable[Mapping]) -> DataFrame:
    """db, source, target of a pair's collections."""
    return spark.createDataFrame([(pair.source_db, m.source, m.target) for m in chosen], "db string, source string, target string")


def target_name(pair: Pair, source: str) -> str:
    """A collection's name in the target; its own where none is configured."""
    return next((m.target for m in pair.collections if m.source == source), source)


def indexes(spark: SparkSession, folder: str) -> DataFrame:
    """The index definitions of a database folder; none where nothing defines any."""
    path = f"{folder}/{INDEX_FILE}"
    lines = files.read_text(spark, path).splitlines() if files.exists(spark, path) else []
    return spark.createDataFrame([json.loads(line) for line in lines if line.strip()], INDEX_SCHEMA)


def record_indexes(spark: SparkSession, folder: str, definitions: Iterable[dict]) -> None:
    """Make these the index definitions of a database folder; what says nothing is left out."""
    told = ({k: v for k, v in d.items() if v is not None} for d in definitions)
    files.write_text(spark, f"{folder}/{INDEX_FILE}", "".join(json.dumps(d, sort_keys=True) + "\n" for d in told))


def requested(spark: SparkSession, requests: Iterable[IndexRequest]) -> DataFrame:
    """coll, name of the indexes that a configuration asks for."""
    return spark.createDataFrame([(r.source, n) for r in requests for n in r.names], "coll string, name string")


def index_selection(indexes: DataFrame, wanted: DataFrame) -> DataFrame:
    """The definitions that are wanted by collection and name; nameless ones and the key's own are never."""
    named = indexes.where(F.col("name").isNotNull() & (F.col("name") != "") & (F.col("name") != KEY_INDEX))
    return named.join(wanted.select("coll", "name"), ["coll", "name"], "left_semi")


def index_options(indexes: DataFrame) -> DataFrame:
    """Definitions as a target keeps them: keys in their order, and options only where they say something.

    A time to live counts if it is a 32-bit number; larger ones are left out, as are false switches.
    """
    ttl = F.when(F.col("expire_after_seconds").between(0, 2**31 - 1), F.col("expire_after_seconds").cast("int"))
    on = lambda c: F.when(F.col(c), F.lit(True))
    return indexes.select("coll", "name", "keys", on("unique").alias("unique"), on("sparse").alias("sparse"), ttl.alias("expire_after_seconds"), "partial_filter", "default_language", "language_override", "weights", on("background").alias("background"))
