"""Identifiers: canonical text, coercion of unsupported kinds, and the hashes that deal them to workers and partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# 32-bit FNV-1a.
FNV_OFFSET, FNV_PRIME = 2166136261, 16777619
#: Kinds of identifier that a target takes as they are; all others become text.
KEPT_KINDS = ("objectId", "string", "long")
KIND_OF_TYPE = {"string": "string", "int": "int", "bigint": "long", "double": "double", "float": "double", "boolean": "bool", "date": "date", "timestamp": "date", "timestamp_ntz": "date", "binary": "binary"}


def kind_of(df: DataFrame, column: str) -> str:
    """The kind of identifiers that a typed column holds."""
    kind = dict(df.dtypes)[column]
    return KIND_OF_TYPE.get(kind, "decimal" if kind.startswith("decimal") else "document")


def canonical(column: Column) -> Column:
    """The text of an identifier that hashes and comparisons use; structs become JSON with their fields in schema order."""
    return column.cast("string")


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over the UTF-8 bytes of a text, as bigint."""
    raw = F.hex(F.encode(text, "UTF-8"))
    byte = lambda i: F.conv(F.substr(raw, 2 * i + 1, F.lit(2)), 16, 10).cast("bigint")
    places = F.when(F.length(raw) > 0, F.sequence(F.lit(0), (F.length(raw) / 2 - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, F.lit(FNV_OFFSET).cast("bigint"), lambda h, i: (h.bitwiseXOR(byte(i)) * FNV_PRIME) % F.lit(1 << 32))


def worker(text: Column, workers: int) -> Column:
    """The worker that an identifier's events go to, for parity with logs written by other tools; placement needs only a hash."""
    return F.pmod(fnv1a(text), F.lit(workers)).cast("int")


def placed(column: Column, parts: int) -> Column:
    """A partition for any kind of identifier, null included."""
    return F.pmod(F.xxhash64(column), F.lit(parts)).cast("int")


def coerced(df: DataFrame, kind: str = "id_type", text: str = "id") -> DataFrame:
    """df with target_type and target_id: kinds that aren't kept become strings of their text."""
    kept = F.col(kind).isin(*KEPT_KINDS)
    return df.withColumn("target_type", F.when(kept, F.col(kind)).otherwise("string")).withColumn("target_id", F.col(text))


def collisions(df: DataFrame, keys: tuple[str, ...] = ("target_type", "target_id")) -> DataFrame:
    """Identifiers that differed before coercion and no longer do, with how many."""
    return df.groupBy(*keys).agg(F.count_distinct("id_type", "id").alias("n_ids")).where("n_ids > 1")


def object_id_seconds(hex_id: Column) -> Column:
    """The seconds since 1970 in the first 8 hex digits of a 24-digit identifier."""
    return F.conv(F.substring(hex_id, 1, 8), 16, 10).cast("bigint")


def object_id_at(seconds: Column) -> Column:
    """The smallest 24-digit identifier of a second."""
    return F.concat(F.lpad(F.lower(F.hex(seconds.cast("bigint"))), 8, "0"), F.lit("0" * 16))


def object_id_from(seconds: int) -> str:
    """The same of a number: its first 8 hex digits, of two's complement below 0."""
    return f"{seconds % 2**64:08x}"[:8] + "0" * 16
