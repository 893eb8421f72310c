"""Rows in one global order over many tasks: ranges of doc_id, each of them one partition."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ranges at most; beyond that they get longer instead of more.
MOST_BLOCKS = 16384


def cut_points(docs: DataFrame, rows: int) -> list[int]:
    """doc_ids that cut the table into ranges of about `rows` rows."""
    blocks = min(MOST_BLOCKS, -(-docs.count() // rows))
    if blocks < 2:
        return []
    found = docs.agg(F.percentile_approx("doc_id", [i / blocks for i in range(1, blocks)], 20 * blocks)).first()[0]
    return sorted(set(found or []))


def block_of(column: str, cuts: list[int]) -> Column:
    """How many cuts are at or below the column: 0 for null. Looked up in two steps of about the root of their number."""
    if not cuts:
        return F.lit(0)
    at_most = lambda values: F.size(F.filter(values, lambda c: c <= F.col(column)))
    step = math.isqrt(len(cuts)) + 1
    runs = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    run = F.greatest(at_most(F.array(*[F.lit(r[0]) for r in runs])), F.lit(1))
    inside = at_most(F.element_at(F.array(*[F.array(*map(F.lit, r)) for r in runs]), run))
    return F.when(F.col(column).isNull(), 0).otherwise((run - 1) * step + inside)
