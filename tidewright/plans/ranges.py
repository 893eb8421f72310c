"""Plans of parallel reads: how many partitions a table gets, where they begin, and the predicate that reads each."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions import ids


def partition_count(rows: int, min_rows: int, most: int) -> int:
    """One below min_rows, else a partition for each min_rows, at most `most`."""
    return 1 if rows < min_rows else max(1, min(most, rows // min_rows))


def partition_count_column(rows: Column, min_rows: int, most: int) -> Column:
    return F.when(rows < min_rows, F.lit(1)).otherwise(F.greatest(F.lit(1), F.least(F.lit(most), F.floor(rows / min_rows)))).cast("int")


def reads_in_parallel(rows: int, enabled: bool, least: int) -> bool:
    return enabled and rows >= least


@dataclass(frozen=True)
class RangePlan:
    """Partitions of a column by interior bounds: the first below the first bound, each next from a bound on.

    Together the predicates cover every row once: nulls, and values of other kinds read as null, belong to the first.
    """

    column: str
    bounds: tuple

    def __len__(self) -> int:
        return len(self.bounds) + 1

    def predicate(self, i: int) -> Column:
        """The rows of partition i; simple comparisons, so that a scan can skip files by them."""
        column = F.col(self.column)
        if not self.bounds:
            return F.lit(True)
        if i == 0:
            return column.isNull() | (column < F.lit(self.bounds[0]))
        if i == len(self.bounds):
            return column >= F.lit(self.bounds[-1])
        return (column >= F.lit(self.bounds[i - 1])) & (column < F.lit(self.bounds[i]))

    def partition(self) -> Column:
        """The partition of each row."""
        if not self.bounds:
            return F.lit(0)
        passed = F.filter(F.array(*[F.lit(b) for b in self.bounds]), lambda b: b <= F.col(self.column))
        return F.when(F.col(self.column).isNull(), 0).otherwise(F.size(passed))

    def read(self, df: DataFrame, i: int) -> DataFrame:
        return df.where(self.predicate(i))


def sample_rows(df: DataFrame, column: str, rows: int, seed: int | None = None) -> DataFrame:
    """At most `rows` of the column's values: those of the smallest digest, the same in each run; at random with a seed."""
    key = F.md5(F.col(column).cast("string")) if seed is None else F.rand(seed)
    return df.where(F.col(column).isNotNull()).select(column).orderBy(key, column).limit(rows)


def sampled(df: DataFrame, column: str, parts: int, sample: int = 1000, most: int = 8, seed: int | None = None) -> RangePlan:
    """Bounds from a sorted sample of max(sample, 10 * parts): of len // (parts + 1) values a step, the 2nd step to the last.

    The first partition has no lower bound and ends at the second step, so it holds about two of parts + 1 shares. A sample of
    under parts + 1 values gives the plan by smallest and largest value instead.
    """
    if parts < 2:
        return RangePlan(column, ())
    values = sorted(r[0] for r in sample_rows(df, column, max(sample, 10 * parts), seed).collect())  # bounded by the sample's size
    if len(values) < parts + 1:
        return by_extremes(df, column, most)
    step = len(values) // (parts + 1)
    return RangePlan(column, tuple(values[(i + 1) * step] for i in range(1, parts)))


def by_extremes(df: DataFrame, column: str, parts: int, seconds: Column | None = None) -> RangePlan:
    """Bounds that cut the range from smallest to largest value into equal widths; texts of 24 hex digits by their seconds.

    seconds: what the identifiers were made of, where that may have more than their 8 digits. Bounds are cut to 8 digits like
    the identifiers, then sorted.
    """
    if ids.kind_of(df, column) == "string":
        seconds = ids.object_id_seconds(F.col(column)) if seconds is None else seconds
        low, high = df.agg(F.min(seconds), F.max(seconds)).first()
        if low is None or parts < 2:
            return RangePlan(column, ())
        width = (high - low) / parts
        return RangePlan(column, tuple(sorted(ids.object_id_from(math.floor(low + width * i)) for i in range(1, parts))))
    low, high = df.agg(F.min(column).cast("double"), F.max(column).cast("double")).first()  # one pass
    if low is None or parts < 2:
        return RangePlan(column, ())
    width = (high - low) / parts
    return RangePlan(column, tuple(low + width * i for i in range(1, parts)))


def balanced(df: DataFrame, column: str, parts: int) -> RangePlan:
    """Bounds at even shares of the rows: what large reads use. One pass whose state doesn't grow with the table."""
    found = df.agg(F.percentile_approx(column, [i / parts for i in range(1, parts)], 100 * parts)).first()[0] if parts > 1 else None
    return RangePlan(column, tuple(sorted(set(found or ()))))


def coverage(df: DataFrame, plan: RangePlan) -> DataFrame:
    """part, rows: read through each partition's own predicate."""
    out = None
    for i in range(len(plan)):
        part = plan.read(df, i).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(i).alias("part"), "rows")
        out = part if out is None else out.unionAll(part)
    return out


def positions(df: DataFrame, key: str, rows: int = 100_000, most: int = 1000) -> DataFrame:
    """df with `position`, from 0 by rising key, without sorting the table in one task: ranges are counted, then numbered alone."""
    from pyspark.sql.window import Window as W

    plan = balanced(df, key, max(1, min(most, -(-df.count() // rows))))
    dealt = df.withColumn("_part", plan.partition())
    before = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # a row a range: at most `most`
    before = before.select(F.col("_part").alias("_p"), (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    numbered = dealt.withColumn("_own", F.row_number().over(W.partitionBy("_part").orderBy(key)))
    return numbered.join(F.broadcast(before), F.col("_part") == F.col("_p")).withColumn("position", F.col("_before") + F.col("_own") - 1).drop("_part", "_own", "_p", "_before")
