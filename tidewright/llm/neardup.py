"""Near-duplicate documents by MinHash signatures and a multi-index Hamming join, confirmed on whole shingle sets.

A document's set is its distinct runs of five words (A-Z lowered; with fewer words, the whole sequence as one; without
words or text, empty and linked with nothing). Two documents are linked if 100 * |intersection| >= 75 * |union|.

1. A signature has POSITIONS symbols of 16 bits, each of the minimum of the set under one hash. Documents of equal sets
   form one class with one representative.
2. The symbols are split into CHUNKS of CHUNK. If at most DISTANCE = 2 * CHUNKS - 1 symbols of two signatures differ, some
   chunk has at most one that does, by pigeonhole; so one key for each place that may differ, made of the chunk's other
   symbols, guarantees that such a pair shares a key. A pair of similarity 0.75 differs in more symbols with a probability
   of 2 in a million.
3. A signature also has BITS bits, each the last one of a further minimum. Pairs that share a key are dropped if over
   BIT_DISTANCE bits differ, six deviations more than at similarity 0.75, where a pair is so lost once in 10**8.
4. Inside a key, every representative is first paired with one only, that which meets the most others over all of its keys:
   among copies of one text, the text itself or the copy nearest to it, to which the others are linked though not always to
   each other. These pairs are confirmed on the whole sets and joined to components, which swallows groups of near copies of
   any size in a number of pairs that follows their rows.
5. What is left inside a key are pairs of different components. In keys of at most FEW documents all of them are compared by
   bits at once; what passes is confirmed. In larger keys, a document of which over a quarter of the shingles are in no other
   of these components can't be linked to any: it goes, and this is done again without it, as long as an eighth goes.
   The same count bounds each pair's intersection. What stays gets sketches of WIDE bits, which tell 0.75 from 0.65; all pairs
   within PART_DISTANCE by the first of them and those before, and WIDE_DISTANCE by all, six deviations each, are confirmed, so no link between different components is lost; then components
   are formed anew over all links.

Shingles are compared as 64-bit hashes. A null doc_id takes no part in links: its component_id is null and it is kept.
Rows that share a doc_id are one node. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.bitfilter import narrowed
from tidewright.llm.components import components
from tidewright.llm.scratch import Scratch
from tidewright.llm.textkit import U64, Words, as_bytes, constants, mix64, slices

SHINGLE = 5
CHUNKS, CHUNK = 10, 3
POSITIONS = CHUNKS * CHUNK
DISTANCE = 2 * CHUNKS - 1
#: A signature's symbols lie in longs of four.
LONGS = -(-POSITIONS // 4)
BITS, BIT_DISTANCE = 256, 64
#: Documents under one key up to which all that are of different components are compared by their bits alone.
FEW = 32
#: Bits of the sketch that documents get which are still open after the first round.
WIDE, WIDE_DISTANCE = 2048, 346
INDEX, SKETCH = [f"s{i}" for i in range(LONGS)], [f"b{i}" for i in range(BITS // 64)]
SHARP = [f"w{i}" for i in range(WIDE // 64)]
#: The part of that sketch that large keys carry, as Spark splits them by bytes; with the BITS, six deviations more than at 0.75.
PART, PART_DISTANCE = SHARP[:8], 151

_PLACE = constants(SHINGLE, 5)
_XOR, _TIMES = constants(POSITIONS + BITS + WIDE, 11), constants(POSITIONS + BITS + WIDE, 13)


def shingle_sets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of all texts in a row, and where each text's begin (and the last's end)."""
    words = Words([as_bytes(t) for t in texts])
    first = words.first
    with np.errstate(over="ignore"):
        padded = np.concatenate([words.hashes, np.zeros(SHINGLE, dtype=U64)])
        runs = np.zeros(len(words), dtype=U64)
        for j in range(SHINGLE):
            runs += padded[j : j + len(words)] * _PLACE[j]
        runs = mix64(runs)
    out = []
    for d in range(len(texts)):
        a, b = first[d], first[d + 1]
        if b - a >= SHINGLE:
            own = np.sort(runs[a : b - SHINGLE + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif b > a:
            with np.errstate(over="ignore"):
                out.append(mix64(np.array([(words.hashes[a:b] * _PLACE[: b - a]).sum(dtype=U64) + U64(b - a)])))
        else:
            out.append(np.zeros(0, dtype=U64))
    return np.concatenate(out) if out else np.zeros(0, dtype=U64), np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int64)


def minima(sets: np.ndarray, at: np.ndarray, hashes: range) -> np.ndarray:
    """The minimum of each set, beginning at `at`, under each of some hashes, spread over 64 bits: a row a hash."""
    out, work = np.empty((len(hashes), len(at)), dtype=U64), np.empty_like(sets)
    with np.errstate(over="ignore"):
        for row, k in enumerate(hashes):
            np.bitwise_xor(sets, _XOR[k], out=work)
            np.multiply(work, _TIMES[k], out=work)
            out[row] = np.minimum.reduceat(work, at)
        return mix64(out)


def _packed(symbols: np.ndarray, width: int, longs: int) -> np.ndarray:
    """Rows of symbols of `width` bits side by side in rows of 64 bits."""
    out = np.zeros((longs, symbols.shape[1]), dtype=U64)
    for k, row in enumerate(symbols):
        out[k * width // 64] |= (row & U64((1 << width) - 1)) << U64(k * width % 64)
    return out


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_a, set_b (two hashes of the whole set), s0.. (four index symbols a long), b0.. (64 bits a long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text"):
            sets, ends = shingle_sets(texts)
            counts = np.diff(ends)
            full = np.flatnonzero(counts)
            found = np.zeros((2 + len(INDEX) + len(SKETCH), len(texts)), dtype=U64)
            if len(full):
                at = ends[:-1][full]
                low = minima(sets, at, range(POSITIONS + BITS))
                with np.errstate(over="ignore"):
                    found[0, full] = np.add.reduceat(sets, at)
                    found[1, full] = np.add.reduceat(mix64(sets), at)
                found[2 : 2 + LONGS, full] = _packed(low[:POSITIONS], 16, LONGS)
                found[2 + LONGS :, full] = _packed(low[POSITIONS:], 1, len(SKETCH))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts), *[pa.array(row.view(np.int64)) for row in found]], ["doc_id", "n_shingles", "set_a", "set_b", *INDEX, *SKETCH])

    schema = "doc_id long, n_shingles long, set_a long, set_b long, " + ", ".join(f"{n} long" for n in (*INDEX, *SKETCH))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def sharp_sketches(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """rep, w0.. (64 bits a long) of the documents that reps names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text"):
            sets, ends = shingle_sets(texts)
            full = np.flatnonzero(np.diff(ends))
            found = np.zeros((len(SHARP), len(texts)), dtype=U64)
            if len(full):
                found[:, full] = _packed(minima(sets, ends[:-1][full], range(POSITIONS + BITS, POSITIONS + BITS + WIDE)), 1, len(SHARP))
            yield pa.RecordBatch.from_arrays([batch.column("rep"), *[pa.array(row.view(np.int64)) for row in found]], ["rep", *SHARP])

    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string").alias("text"))
    own = narrowed(texts, reps, ["rep"]).join(reps, "rep", "left_semi")
    return own.mapInArrow(run, "rep long, " + ", ".join(f"{n} long" for n in SHARP))


def linkable(docs: DataFrame, nodes: DataFrame, scratch: Scratch, percent: int = 75) -> DataFrame:
    """rep, n_shared of the nodes (rep, label) with enough shingles that other labels have too, so that they may be linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text"):
            sets, ends = shingle_sets(texts)
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(sets.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("label"), lists], ["rep", "label", "shingles"])

    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string").alias("text"))
    own = narrowed(texts, nodes, ["rep"]).join(nodes, "rep").select("rep", "label", "text")
    sets = scratch.keep(own.mapInArrow(run, "rep long, label long, shingles array<long>").dropDuplicates(["rep"]), "sets")
    alive, before = None, sets.count()
    while True:
        rows = sets if alive is None else sets.join(alive.select("rep"), "rep")
        rows = rows.select("rep", "label", F.size("shingles").alias("_n"), F.explode("shingles").alias("x"))
        shared = rows.groupBy("x").agg(F.min("label").alias("_l"), F.max("label").alias("_m")).where("_l < _m").select("x")
        left = rows.join(shared, "x").groupBy("rep", "_n").agg(F.count(F.lit(1)).alias("n_shared"))
        alive = scratch.keep(left.where(f"n_shared * 100 >= _n * {percent}").select("rep", "n_shared"), "linkable")
        after = alive.count()
        if after * 8 > before * 7 or not after:
            scratch.drop(sets)
            return alive
        before = after


def _symbol(k: int, prefix: str = "s") -> F.Column:
    return F.shiftrightunsigned(F.col(f"{prefix}{k // 4}"), 16 * (k % 4)).bitwiseAND(0xFFFF)


def index_keys(prefix: str = "s") -> F.Column:
    """The keys of a signature: for each chunk and each place that may differ in it, the other symbols."""
    keys = []
    for c in range(CHUNKS):
        for out in range(CHUNK):
            key = F.lit(c * CHUNK + out).cast("long")
            for k in range(c * CHUNK, (c + 1) * CHUNK):
                if k != c * CHUNK + out:
                    key = F.shiftleft(key, 16).bitwiseOR(_symbol(k, prefix))
            keys.append(key)
    return F.array(*keys)


def _side(name: str, prefix: str, sketch: list[str] = SKETCH) -> list[F.Column]:
    """A representative, its size and its sketch, named for one side of a pair."""
    return [F.col("rep").alias(name), F.col("n_shingles").alias(f"{prefix}n"), *[F.col(c).alias(f"{prefix}{c}") for c in sketch]]


def _differing(left: str, right: str, sketch: list[str]) -> F.Column:
    return sum((F.bit_count(F.col(f"{left}{c}").bitwiseXOR(F.col(f"{right}{c}"))) for c in sketch), F.lit(0))


def _close(left: str, right: str) -> F.Column:
    """Whether sizes allow the similarity, and sketches are within the distance."""
    small, large = F.least(F.col(f"{left}n"), F.col(f"{right}n")), F.greatest(F.col(f"{left}n"), F.col(f"{right}n"))
    return (small * 100 >= large * 75) & (_differing(left, right, SKETCH) <= BIT_DISTANCE)


def pairs_of_few(placed: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs (a, b) of rows (key, n, rep, label) of keys of at most FEW documents that are of different components and close."""
    bits = ["n_shingles", *SKETCH]
    rows = placed.where(f"n <= {FEW}").select("key", "rep", "label")
    mixed = Window.partitionBy("key")  # of at most FEW rows
    rows = rows.join(reps.select("rep", *bits), "rep").select("*", F.min("label").over(mixed).alias("_l"), F.max("label").over(mixed).alias("_h")).where("_l < _h")
    held = rows.groupBy("key").agg(F.collect_list(F.struct("rep", "label", *bits)).alias("held"))
    left = held.select("held", F.explode("held").alias("x")).select("x", F.explode(F.filter("held", lambda y: (y["rep"] > F.col("x.rep")) & (y["label"] != F.col("x.label")))).alias("y"))
    sides = [F.col(f"{c}.{f}").alias(f"{c}{'n' if f == 'n_shingles' else f}") for c in "xy" for f in bits]
    return left.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"), *sides).where(_close("x", "y")).select("a", "b").distinct()


def confirm(pairs: DataFrame, docs: DataFrame, percent: int = 75) -> DataFrame:
    """The pairs (a, b) of doc_ids whose whole sets have 100 * intersection >= percent * union."""
    needed = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id")))
    some = narrowed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), needed, ["doc_id"])
    sided = pairs.join(some.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    sided = sided.join(some.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_id, known = object(), np.zeros(0, dtype=U64)
        for batch, right in slices(batches, "text_b", 1 << 19):
            ids, left = batch.column("a").to_pylist(), batch.column("text_a")
            sets, ends = shingle_sets(right)
            linked = []
            for i, a in enumerate(ids):
                if a != known_id:  # rows of the same left document come together after the join
                    known_id, known = a, shingle_sets([left[i].as_py()])[0]
                other = sets[ends[i] : ends[i + 1]]
                both = len(np.intersect1d(known, other, assume_unique=True))
                linked.append(both * 100 >= percent * (len(known) + len(other) - both) and both > 0)
            yield batch.select(["a", "b"]).filter(pa.array(linked))

    return sided.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    scratch = Scratch(docs.sparkSession, "neardup")
    signed = scratch.keep(signatures(docs), "signatures")
    of_set = ["n_shingles", "set_a", "set_b"]
    own = [F.first(c).alias(c) for c in (*INDEX, *SKETCH)]  # the same in all of a class
    reps = signed.where("n_shingles > 0 and doc_id is not null").groupBy(*of_set).agg(F.min("doc_id").alias("rep"), *own)
    reps = scratch.keep(reps, "classes")

    keys = reps.select("rep", F.explode(index_keys()).alias("key"))
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    held = scratch.keep(keys.join(shared, "key"), "keys")  # only what shares a key with another
    central = held.groupBy(F.col("rep").alias("_rep")).agg(F.sum("n").alias("met"))
    rank = F.struct("met", (-F.col("rep")).alias("low"))
    leads = held.join(central, F.col("rep") == F.col("_rep")).groupBy("key").agg(F.max(rank).alias("top")).select("key", (-F.col("top.low")).alias("lead"))
    stars = held.join(leads, "key").where("lead <> rep").select(F.least("lead", "rep").alias("a"), F.greatest("lead", "rep").alias("b")).distinct()
    stars = stars.join(reps.select(*_side("a", "x")), "a").join(reps.select(*_side("b", "y")), "b").where(_close("x", "y")).select("a", "b")
    links = scratch.keep(confirm(scratch.keep(stars, "stars"), docs), "links")
    labels = scratch.keep(components(links, scratch), "stars-joined")

    placed = held.join(labels, F.col("rep") == F.col("node"), "left").select("key", "n", "rep", F.coalesce("label", "rep").alias("label"))
    near = scratch.keep(pairs_of_few(placed, reps), "near")
    placed = placed.where(f"n > {FEW}").drop("n")
    mixed = placed.groupBy("key").agg(F.min("label").alias("_l"), F.max("label").alias("_h")).where("_l < _h").select("key")
    open_ = scratch.keep(placed.join(mixed, "key"), "open")
    alive = linkable(docs, open_.select("rep", "label").distinct(), scratch)
    sharp = scratch.keep(sharp_sketches(docs, alive.select("rep")), "sharp")
    both, sharp = [*INDEX, *SKETCH, *PART, "n_shared"], sharp.dropDuplicates(["rep"])
    rows = open_.join(alive, "rep").join(reps.select("rep", "n_shingles", *INDEX, *SKETCH), "rep").join(sharp.select("rep", *PART), "rep")
    left = rows.select(F.col("key").alias("key_a"), F.col("label").alias("la"), *_side("a", "x", both))
    right = rows.select(F.col("key").alias("key_b"), F.col("label").alias("lb"), *_side("b", "y", both))
    enough = 175 * F.least("xn_shared", "yn_shared") >= 75 * (F.col("xn") + F.col("yn"))  # the least intersection of 75 percent
    alike = enough & _close("x", "y") & (_differing("x", "y", [*SKETCH, *PART]) <= PART_DISTANCE)
    # a pair comes from the first key it shares only; interpreted, so that the cheap tests before it stay in a small method
    once = F.col("key_a") == F.filter(F.zip_with(index_keys("xs"), index_keys("ys"), lambda p, q: F.when(p == q, p)), lambda k: k.isNotNull())[0]
    rest = left.join(right, (F.col("key_a") == F.col("key_b")) & (F.col("la") != F.col("lb")) & (F.col("a") < F.col("b")) & alike & once).select("a", "b")
    for side in "ab":
        rest = rest.join(sharp.select(F.col("rep").alias(side), *[F.col(c).alias(f"{side}{c}") for c in SHARP]), side)
    rest = rest.where(_differing("a", "b", SHARP) <= WIDE_DISTANCE).select("a", "b")
    rest = scratch.keep(rest.union(near).distinct(), "rest")
    more = scratch.keep(confirm(rest, docs), "links")
    if not more.isEmpty():
        labels = scratch.keep(components(links.union(more), scratch), "joined")

    named = reps.select(*[F.col(c).alias(f"_{c}") for c in of_set], "rep").join(labels, F.col("rep") == F.col("node"), "left").select(*[f"_{c}" for c in of_set], F.coalesce("label", "rep").alias("_class"))
    same_set = (F.col("n_shingles") == F.col("_n_shingles")) & (F.col("set_a") == F.col("_set_a")) & (F.col("set_b") == F.col("_set_b"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("_class", "doc_id"))
    return signed.join(named, same_set, "left").select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))

