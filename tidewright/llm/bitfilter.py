"""A filter of fixed size that keeps rows out of a shuffle whose key can't be among some wanted keys.

Each wanted key sets one of FILTER_BITS bits, 2 MB whatever the input; the bits are built by an aggregation and broadcast as
at most FILTER_BITS / 64 rows. Rows with another key may pass, so a join by the key itself has to follow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILTER_BITS = 1 << 24


def marked(rows: DataFrame, wanted: DataFrame, keys: list[str], mark: str = "_tw_hit") -> DataFrame:
    """rows with `mark`: whether the key may be one of wanted's. Both sides name the key columns alike."""
    bit = F.pmod(F.xxhash64(*keys), F.lit(FILTER_BITS))
    flags = wanted.select(bit.alias("_tw_bit")).groupBy(F.shiftright("_tw_bit", 6).alias("_tw_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_tw_bit & 63 as int))")).alias("_tw_bits"))
    dealt = rows.withColumn("_tw_bit", bit)
    hit = F.expr("coalesce((shiftrightunsigned(_tw_bits, cast(_tw_bit & 63 as int)) & 1) = 1, false)")
    return dealt.join(F.broadcast(flags), F.shiftright("_tw_bit", 6) == F.col("_tw_word"), "left").withColumn(mark, hit).drop("_tw_bit", "_tw_word", "_tw_bits")


def narrowed(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose key may be one of wanted's."""
    return marked(rows, wanted, keys).where("_tw_hit").drop("_tw_hit")
