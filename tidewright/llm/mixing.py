"""Mix sources to target weights: certain whole copies, then a Pareto order sample of fixed size in words.

Each source gets a word target by weight, at most `max_copies` times its size. Inside a source a document of size z is taken
m = min(max_copies, level * z ** power) times on average, where the level makes the words of all m add up to the target: with
the default power, longer documents are likelier by the root of their size, so that few-word rows don't fill the mix. floor(m)
copies are certain. The rest of m is the inclusion probability l of a Pareto order sample: with a uniform u a document ranks
by (u / (1 - u)) / (l / (1 - l)), and documents are taken in that order until the words still wanted are reached. u is a hash
of doc_id, text and a seed, so reruns agree, however the rows are stored.

The cut is found without sorting a source: words are summed by (source, block of the rank), running sums over at most BLOCKS
rows a source name the block that holds the cut, and only that block's rows are put in order. What is still missing then, less
than one document, is closed in the same order: by the next document that covers between half of the gap and all of it, FILLS
times.

Null texts have size 0; documents of size 0 are never taken, as no copy of theirs adds a word. Null sources form one source, the
last. Repeated rows and doc_ids are separate documents, though rows equal in doc_id and text, which stand side by side in the
order, may be exchanged. An empty table gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidewright.llm.scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"
#: Blocks of the rank; a source's cut is looked for in one of them.
BLOCKS = 4096
#: Rounds that close what is missing at the cut with one document each.
FILLS = 3
#: Inclusion probabilities keep this far from 0 and 1.
EDGE = 1e-9


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, max_copies: float) -> DataFrame:
    """source, source_size, target of a table (source, source_size): shares by weight, stopped at max_copies times the size.

    Sources are ordered by code point, null last, and take the weights in turn. Water-filling in closed form: by rising
    cap / weight, the first source whose cap is not reached by the level that is left fixes the level for all that follow.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    rising = W.orderBy("_bound", F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.row_number().over(order) - 1) % len(weights) + 1)
    everything = W.partitionBy()
    return (
        sizes.withColumn("_w", weight)
        .withColumn("_cap", F.col("source_size") * F.lit(float(max_copies)))
        .withColumn("_bound", F.col("_cap") / F.col("_w"))
        .withColumn("_all", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("_below", F.coalesce(F.sum("_cap").over(rising.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("_left", F.sum("_w").over(rising.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("_level", (F.col("_all") - F.col("_below")) / F.col("_left"))
        .withColumn("_level", F.min(F.when(F.col("_level") <= F.col("_bound"), F.struct("_bound", "source", "_level"))).over(everything)["_level"])
        .select("source", "source_size", F.least(F.col("_cap"), F.coalesce(F.col("_level"), F.col("_bound")) * F.col("_w")).alias("target"))
    )


def levels(sizes: DataFrame, targets: DataFrame, max_copies: float, power: float) -> DataFrame:
    """_s, source_size, target, _level, _want of each source; sizes has source, size, n: a row a source and size.

    From the largest size down, the first at which the level stays within max_copies, all larger ones taken in full, is the
    level. _want is what the certain copies leave of the target.
    """
    falling = W.partitionBy("source").orderBy(F.col("size").desc())
    solved = (
        sizes.where("size > 0")
        .join(targets.select(F.col("source").alias("_s"), "source_size", "target"), F.col("source").eqNullSafe(F.col("_s")))
        .withColumn("_z", F.pow(F.col("size").cast("double"), F.lit(float(power))))
        .withColumn("_words", F.col("size") * F.col("n"))
        .withColumn("_full", F.coalesce(F.sum(F.col("_words") * F.lit(float(max_copies))).over(falling.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("_weighed", F.sum(F.col("_words") * F.col("_z")).over(falling.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("_try", (F.col("target") - F.col("_full")) / F.col("_weighed"))
        .withColumn("_level", F.first(F.when(F.col("_try") * F.col("_z") <= max_copies, F.col("_try")), ignorenulls=True).over(falling.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    )
    sure = F.floor(_copies(F.col("_level"), F.col("size"), max_copies, power))
    return solved.groupBy("source").agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.first("_level").alias("_level"), (F.first("target") - F.sum(sure * F.col("_words"))).alias("_want")).withColumnRenamed("source", "_s")


def _copies(level: Column, size: Column, max_copies: float, power: float) -> Column:
    """Mean copies of a document; without a level all are taken max_copies times. Just below a whole number counts as it."""
    mean = F.least(F.lit(float(max_copies)), F.coalesce(level * F.pow(size.cast("double"), F.lit(float(power))), F.lit(float(max_copies))) + EDGE)
    return F.when(size > 0, mean).otherwise(F.lit(0.0))


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5,
    max_copies: float = 2,
    seed: int = 20,
    power: float = 0.5,
) -> DataFrame:
    """doc_id, text_hash, source, size, source_size, target, copies, taken of every document."""
    scratch = Scratch(docs.sparkSession, "mix")
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id"), F.xxhash64("text")), 11).cast("double") + 0.5) * F.lit(2.0**-53)
    sized = docs.select("doc_id", "source", F.xxhash64("text").alias("text_hash"), F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long").alias("size"), u.alias("_u"))
    sized = scratch.keep(sized, "sizes").withColumn("_row", F.monotonically_increasing_id())
    by_size = scratch.keep(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "by-size")
    targets = scratch.keep(source_targets(by_size.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, max_copies), "targets")
    solved = levels(by_size, targets, max_copies, power).select("_s", "_level", "_want")
    plan = targets.withColumnRenamed("source", "_t").join(solved, F.col("_t").eqNullSafe(F.col("_s")), "left").select(F.col("_t").alias("_s"), "source_size", "target", "_level", F.coalesce("_want", F.lit(0.0)).alias("_want"))
    plan = scratch.keep(plan, "plan")

    odds = lambda p: p / (1 - p)
    ranked = (
        sized.join(plan, F.col("source").eqNullSafe(F.col("_s")))
        .withColumn("_m", _copies(F.col("_level"), F.col("size"), max_copies, power))
        .withColumn("_whole", F.floor("_m"))
        .withColumn("_q", odds(F.col("_u")) / odds(F.greatest(F.least(F.col("_m") - F.col("_whole"), F.lit(1 - EDGE)), F.lit(EDGE))))
        .withColumn("_block", F.least(F.floor(F.col("_q") / (1 + F.col("_q")) * BLOCKS), F.lit(BLOCKS - 1)))
        .drop("_u", "_s", "_level", "_m")
    )
    ranked = scratch.keep(ranked, "ranked")

    before = W.partitionBy("source").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    blocks = (
        ranked.groupBy("source", "_block")
        .agg(F.sum("size").alias("_words"), F.first("_want").alias("_want"))
        .withColumn("_before", F.coalesce(F.sum("_words").over(before), F.lit(0)))
    )
    cut = blocks.where((F.col("_before") <= F.col("_want")) & (F.col("_before") + F.col("_words") > F.col("_want"))).select(F.col("source").alias("_s"), F.col("_block").alias("_cut"), "_before")
    placed = ranked.join(cut, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    inside = (
        placed.where(F.col("_block") == F.col("_cut"))
        .withColumn("_running", F.col("_before") + F.sum("size").over(W.partitionBy("source").orderBy("_q", "doc_id", "text_hash", "_row").rowsBetween(W.unboundedPreceding, 0)))
        .select(F.col("_row").alias("_r"), (F.col("_running") <= F.col("_want")).alias("_in"))
    )
    # a source without a cut wants nothing more, or has no words
    chosen = placed.join(inside, F.col("_row") == F.col("_r"), "left").withColumn("_in", (F.col("size") > 0) & F.coalesce(F.col("_in"), F.col("_block") < F.col("_cut"), F.lit(False)))
    chosen = scratch.keep(chosen.drop("_r", "_cut", "_before", "_block"), "chosen")
    for _ in range(FILLS):
        gaps = chosen.groupBy("source").agg((F.first("_want") - F.sum(F.when(F.col("_in"), F.col("size")).otherwise(0))).alias("_gap")).where("_gap >= 1").withColumnRenamed("source", "_s")
        fits = (
            chosen.where(~F.col("_in") & (F.col("_whole") < max_copies))
            .join(gaps, F.col("source").eqNullSafe(F.col("_s")))
            .where("size <= _gap and 2 * size >= _gap")
            .groupBy("source")
            .agg(F.min(F.struct("_q", "doc_id", "text_hash", "_row")).getField("_row").alias("_fit"))
            .select("_fit")
        )
        chosen = chosen.join(fits, F.col("_row") == F.col("_fit"), "left").withColumn("_in", F.col("_in") | F.col("_fit").isNotNull()).drop("_fit")
        chosen = scratch.keep(chosen, "filled")
    copies = (F.col("_whole") + F.col("_in").cast("long")).cast("long")
    return chosen.select("doc_id", "text_hash", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def repeated(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of docs as often as mix takes it. Rows equal in doc_id and text are taken alike, rounded up."""
    taken = mix(docs, **options).groupBy(F.col("doc_id").alias("_tw_id"), F.col("text_hash").alias("_tw_hash")).agg(F.ceil(F.avg("copies")).cast("int").alias("_tw_copies"))
    same = F.col("doc_id").eqNullSafe(F.col("_tw_id")) & (F.col("_tw_own") == F.col("_tw_hash"))
    rows = docs.withColumn("_tw_own", F.xxhash64("text")).join(taken.where("_tw_copies > 0"), same)
    return rows.withColumn("_tw_copy", F.explode(F.sequence(F.lit(1), F.col("_tw_copies")))).select(*docs.columns)
