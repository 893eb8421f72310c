"""Snapshot writes: which rows a target holds after a copy, by conflict mode; batches, counts and progress."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODES = ("replace", "skip", "error")


class DuplicateKeys(ValueError):
    """Rows that an insert must not find twice."""


def _whole_keys(df: DataFrame, key: list[str]) -> DataFrame:
    return df.where(reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in key)))


def without_key(df: DataFrame, key: list[str]) -> DataFrame:
    """Rows that no keyed write can take, because a part of their key is null."""
    return df.where(reduce(lambda a, b: a | b, (F.col(k).isNull() for k in key)))


def one_per_key(df: DataFrame, key: list[str], order: list[Column], last: bool = True) -> DataFrame:
    """The last, or first, row of each key in a total order; null keys are no rows."""
    rest = [c for c in df.columns if c not in key]
    rank = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    pick = F.max_by if last else F.min_by
    best = _whole_keys(df, key).groupBy(*key).agg(pick(F.struct(*rest), rank).alias("_row"))
    return best.select(*key, *[F.col("_row")[c].alias(c) for c in rest])


def written(source: DataFrame, target: DataFrame | None, key: list[str], order: list[Column], mode: str = "replace") -> DataFrame:
    """The target's rows after source was written to it.

    replace: of rows with equal keys the last counts, over the target's; skip: the first counts and the target's stay;
    error: any key that occurs twice raises DuplicateKeys. Rows without a whole key are left out (see without_key).
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    if mode == "error":
        keyed = _whole_keys(source, key).select(*key)
        both = keyed if target is None else keyed.unionAll(target.select(*key))
        twice = both.groupBy(*key).count().where("count > 1").limit(1).collect()
        if twice:
            raise DuplicateKeys(f"key {tuple(twice[0])[:-1]} occurs {twice[0][-1]} times")
        rows = _whole_keys(source, key)
    else:
        rows = one_per_key(source, key, order, last=mode == "replace")
    if target is None:
        return rows
    if mode == "skip":
        return target.unionByName(rows.join(target.select(*key), key, "left_anti"))
    return target.join(rows.select(*key), key, "left_anti").unionByName(rows)


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that break a unique index, with how many rows have them."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def batches(df: DataFrame, key: str, size: int = 128) -> DataFrame:
    """df with batch_id: `size` rows a batch by rising key, the last one as many as are left."""
    from tidewright.plans.ranges import positions

    return positions(df, key).withColumn("batch_id", F.floor(F.col("position") / size)).drop("position")


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """collection, n_rows of every table: of Parquet the footers are enough."""
    return reduce(DataFrame.unionAll, (t.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("collection"), "n_rows") for name, t in tables.items()))


def progress_step(done: Column, total: Column) -> Column:
    """Tenths of the work that are done."""
    return F.when(total > 0, F.floor(done * 10 / total)).otherwise(F.lit(10)).cast("long")


def progress(batched: DataFrame) -> DataFrame:
    """batch_id, done, step of the batches after which another tenth is done. batched has a row a batch: batch_id, n_rows."""
    from pyspark.sql.window import Window as W

    so_far = W.orderBy("batch_id")
    steps = batched.withColumn("done", F.sum("n_rows").over(so_far)).withColumn("_total", F.sum("n_rows").over(W.partitionBy()))
    steps = steps.withColumn("step", progress_step(F.col("done"), F.col("_total")))
    steps = steps.withColumn("_before", F.coalesce(F.lag("step").over(so_far), F.lit(0)))
    return steps.where("step > _before").select("batch_id", "done", "step")


def retained(df: DataFrame, column: str, seconds: int, now: Column) -> DataFrame:
    """Rows that a time-to-live index keeps: those without the column, and those whose time isn't `seconds` past."""
    return df.where(F.col(column).isNull() | (F.col(column) + F.expr(f"interval {int(seconds)} seconds") > now))
