"""Configuration: a JSON file of database pairs and tuning numbers, with defaults and checks."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, fields

# The defaults of omitted numbers. A number that is 0 or less counts as omitted.
DEFAULTS = {
    "saveThreshold": 100,
    "checkpointInterval": 5,
    "flushIntervalMs": 500,
    "initialReadBatchSize": 8192,
    "initialWriteBatchSize": 128,
    "initialChannelBufferSize": 10,
    "initialMigrationWorkers": 5,
    "concurrentCollections": 4,
    "incrementalReadBatchSize": 8192,
    "incrementalWriteBatchSize": 128,
    "incrementalWorkerCount": None,  # the machine's cores
    "statsIntervalMinutes": 5,
    "maxReadPartitions": 8,
    "minDocsPerPartition": 10000,
    "minDocsForParallelReads": 50000,
    "sampleSize": 1000,
    "workersPerPartition": 3,
}
RETRY_DEFAULTS = {"maxRetries": 5, "baseDelayMs": 100, "maxDelayMs": 5000, "minBatchSize": 10}
#: Switches that are off when omitted.
SWITCHES = ("forceOrderedOperations", "parallelReadsEnabled")


class ConfigError(ValueError):
    """The configuration lacks something or has it in another form."""


@dataclass(frozen=True)
class Retry:
    maxRetries: int = 5
    baseDelayMs: int = 100
    maxDelayMs: int = 5000
    minBatchSize: int = 10
    enableBatchSplitting: bool = False
    convertInvalidIds: bool = True  # cannot be switched off: an explicit false is read as true


@dataclass(frozen=True)
class Mapping:
    """A collection and the name it is copied to; upsert replaces rows that are already there."""

    source: str
    target: str
    upsert: bool = False


@dataclass(frozen=True)
class IndexRequest:
    source: str
    names: tuple[str, ...]


@dataclass(frozen=True)
class Pair:
    source_uri: str
    source_db: str
    target_uri: str
    target_db: str
    collections: tuple[Mapping, ...] = ()
    indexes: tuple[IndexRequest, ...] = ()


@dataclass(frozen=True)
class Config:
    pairs: tuple[Pair, ...]
    numbers: dict[str, int] = field(default_factory=dict)
    switches: dict[str, bool] = field(default_factory=dict)
    retry: Retry = field(default_factory=Retry)

    def __getattr__(self, name: str):
        for values in ("numbers", "switches"):
            if name in self.__dict__.get(values, {}):
                return self.__dict__[values][name]
        raise AttributeError(name)


def _number(raw: dict, name: str, default: int | None) -> int:
    value = raw.get(name, 0)
    if isinstance(value, bool) or not isinstance(value, int):
        raise ConfigError(f"{name} must be a whole number")
    return value if value > 0 else default if default is not None else os.cpu_count() or 1


def _text(raw: dict, name: str, where: str) -> str:
    value = raw.get(name) or ""
    if not isinstance(value, str) or not value:
        raise ConfigError(f"{where}: {name} is missing")
    return value


def _pair(raw: dict, i: int) -> Pair:
    source, target, where = raw.get("source") or {}, raw.get("target") or {}, f"databasePairs[{i}]"
    mappings = tuple(
        Mapping(_text(m, "sourceCollection", f"{where}.collections[{k}]"), _text(m, "targetCollection", f"{where}.collections[{k}]"), bool(m.get("upsertMode", False))) for k, m in enumerate(target.get("collections") or ())
    )
    indexes = tuple(IndexRequest(x.get("sourceCollection", ""), tuple(x.get("indexNames") or ())) for x in target.get("indexes") or ())
    return Pair(
        _text(source, "connectionString", f"{where}.source"),
        _text(source, "database", f"{where}.source"),
        _text(target, "connectionString", f"{where}.target"),
        _text(target, "database", f"{where}.target"),
        mappings,
        indexes,
    )


def parse(raw: dict) -> Config:
    """A configuration from its JSON value, defaults filled in and checked."""
    pairs = raw.get("databasePairs") or []
    if not pairs:
        raise ConfigError("databasePairs is empty")
    retry = raw.get("retryConfig") or {}
    policy = Retry(**{k: _number(retry, k, d) for k, d in RETRY_DEFAULTS.items()}, enableBatchSplitting=bool(retry.get("enableBatchSplitting", False)))
    return Config(
        tuple(_pair(p, i) for i, p in enumerate(pairs)),
        {k: _number(raw, k, d) for k, d in DEFAULTS.items()},
        {k: bool(raw.get(k, False)) for k in SWITCHES},
        policy,
    )


def load(path: str) -> Config:
    """A configuration from its file."""
    try:
        with open(path, encoding="utf-8") as file:
            raw = json.load(file)
    except json.JSONDecodeError as error:
        raise ConfigError(f"{path} is not JSON: {error}") from error
    if not isinstance(raw, dict):
        raise ConfigError(f"{path} must hold a JSON object")
    return parse(raw)


def as_rows(config: Config) -> list[tuple[str, str]]:
    """Every setting in force, by name."""
    rows = [(k, str(v)) for k, v in {**config.numbers, **config.switches}.items()]
    return rows + [(f"retryConfig.{f.name}", str(getattr(config.retry, f.name))) for f in fields(config.retry)]
