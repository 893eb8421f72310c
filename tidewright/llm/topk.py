"""Exact top-k by integer inner product: norm-sorted candidates, SVD-rotated partial sums, Cauchy-Schwarz residual bounds.

Each component x becomes floor(scale * x). Candidates are dealt out by descending length, so that a task holds a range of
lengths and reads it from the longest down. For a query whose k-th best score so far is t:

- a task passes over slices whose longest candidate c has |q| |c| < t for all of its queries, so all that follow in its range;
- vectors are rotated by the singular vectors of the whole table, which puts most of a score into the first coordinates; with
  p of them summed, the rest is at most |q_rest| |c_rest|, and pairs whose bound is under t go;
- what is left is scored exactly: in doubles while |q| |c| is under 2**53, as then every partial sum is an integer that a
  double holds, in integers of any size beyond.

The rotation changes no inner product, and rounding is covered by a slack, so pruning never loses a result. Before the search
every query gets its t from the longest HEAD vectors. Queries are taken in waves of WAVE_BYTES, one after another: a wave's
queries are broadcast, its result is written, and the broadcast is destroyed before the next wave is read.

Vectors that are null or hold null or non-finite components take no part, nor do null vec_ids; a component that is not finite
once scaled counts as non-finite (beyond 1.7e305). Shorter vectors count as padded with zeros. Rows that share a vec_id are
separate candidates; a query never meets rows of its own vec_id, and of rows sharing a query's vec_id the smallest vector
asks. Ties go to the smaller vec_id. Scores beyond 64 bits are ranked by their exact values and shown as the nearest of
+-(2**63 - 1). Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidewright.llm.scratch import Scratch

#: Longest vectors that give each query its first threshold, and bytes of them at most.
HEAD, HEAD_BYTES = 2048, 1 << 23
#: Bytes of queries in a wave: 8192 queries of 64 dimensions.
WAVE_BYTES = 1 << 22
#: Candidates scored at once, and queries beside them.
ROWS, ASKING = 1024, 512
#: Rows in a task's range of lengths, and ranges at most.
RANGE_ROWS, MOST_RANGES = 4096, 4096
#: Shares of the dimensions after which bounds are tried.
STEPS = (0.125, 0.5)
#: Products of lengths under which doubles add up integers exactly.
EXACT = float(1 << 53)
#: Scores are held between -MOST and MOST, beside their exact values.
MOST = 2**63 - 1
#: Rows longer than this count as this long when the rotation is fitted.
LONG = 2.0**40


def integer_vectors(table: DataFrame, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, v (the integer components as doubles, which hold them exactly), length (Euclidean; infinite if its square is)."""
    scaled = table.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(F.col(vector_col).cast("array<double>"), lambda c: c * F.lit(float(scale))).alias("v"))
    sound = scaled.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda c: c.isNotNull() & (F.abs(c) < float("inf"))))
    # from 2**53 on doubles are integers, and floor would have to fit a long
    whole = F.transform("v", lambda c: F.when(F.abs(c) < EXACT, F.floor(c).cast("double")).otherwise(c))
    floored = sound.select("vec_id", whole.alias("v"))
    return floored.withColumn("length", F.sqrt(F.aggregate("v", F.lit(0.0), lambda total, c: total + c * c)))


def _matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    """Lists of doubles as rows of dim numbers, filled up with zeros."""
    values, sizes = np.asarray(vectors.flatten(), dtype=np.float64), np.asarray(vectors.value_lengths())
    if (sizes == dim).all():
        return values.reshape(len(sizes), dim)
    out = np.zeros((len(sizes), dim))
    out[np.arange(dim) < sizes[:, None]] = values
    return out


def _lengths(m: np.ndarray) -> np.ndarray:
    return np.sqrt((m * m).sum(axis=1))


def rotation(vectors: DataFrame, dim: int) -> np.ndarray:
    """The right singular vectors of all rows, by falling singular value: from the sum of outer products, dim * dim numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            m, length = _matrix(batch.column("v"), dim), np.asarray(batch.column("length"))
            m = m[np.isfinite(length)] / np.maximum(length[np.isfinite(length)] / LONG, 1)[:, None]
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim * dim)), pa.array(total.ravel())], ["i", "x"])

    gram = np.zeros(dim * dim)
    for row in vectors.select("v", "length").mapInArrow(run, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect():
        gram[row["i"]] = row["x"]
    _, vectors_ = np.linalg.eigh(gram.reshape(dim, dim))
    return np.ascontiguousarray(vectors_[:, ::-1])


def sortable(score: int) -> bytes:
    """Bytes that sort as the integers do: the number of bytes, then these, complemented below zero."""
    size = (abs(score).bit_length() + 7) // 8
    if score >= 0:
        return (0x8000 + size).to_bytes(2, "big") + score.to_bytes(size, "big")
    return (0x7FFF - size).to_bytes(2, "big") + (256**size - 1 + score).to_bytes(size, "big")


def exact_scores(q: np.ndarray, c: np.ndarray, small: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inner products of rows with rows, in doubles where `small`: held within MOST, and the exact value of those not under it (else None)."""
    with np.errstate(over="ignore", invalid="ignore"):
        product = np.einsum("ij,ij->i", q, c)
    score, wide = np.where(small, product, 0).astype(np.int64), np.full(len(q), None, dtype=object)
    for i in np.flatnonzero(~small):
        value = sum(int(x) * int(y) for x, y in zip(q[i].tolist(), c[i].tolist(), strict=True))
        score[i] = max(-MOST, min(MOST, value))
        if abs(value) >= MOST:
            wide[i] = value
    return score, wide


class Best:
    """The k best (score, smaller vec_id first) of each of some queries."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.rows = np.zeros((0, 3), dtype=np.int64)  # query, score, vec_id
        self.wide = np.zeros(0, dtype=object)
        self.threshold = np.full(queries, -MOST)

    def add(self, query: np.ndarray, score: np.ndarray, vec_id: np.ndarray, wide: np.ndarray) -> None:
        rows, wide = np.concatenate([self.rows, np.stack([query, score, vec_id], axis=1)]), np.concatenate([self.wide, wide])
        beyond = np.zeros(len(rows), dtype=np.int64)
        held = np.flatnonzero(np.abs(rows[:, 1]) == MOST)
        if len(held):
            rank = {value: i for i, value in enumerate(sorted(set(wide[held].tolist())))}
            beyond[held] = [rank[value] for value in wide[held].tolist()]
        order = np.lexsort((rows[:, 2], -beyond, -rows[:, 1], rows[:, 0]))
        rows, wide = rows[order], wide[order]
        first = np.searchsorted(rows[:, 0], rows[:, 0])
        place = np.arange(len(rows)) - first
        last = rows[place == self.k - 1]
        self.threshold[last[:, 0]] = np.maximum(self.threshold[last[:, 0]], last[:, 1])
        self.rows, self.wide = rows[place < self.k], wide[place < self.k]

    def need(self) -> np.ndarray:
        """What a bound has to reach: anything while the threshold is the lowest that can be held."""
        return np.where(self.threshold > -MOST, self.threshold.astype(np.float64), -np.inf)


@np.errstate(over="ignore", invalid="ignore")
def within_reach(length: np.ndarray, longest: float, need: np.ndarray) -> np.ndarray:
    """Whether candidates of at most this length may reach what queries need; bounds that doubles can't hold exclude nothing."""
    return ~(length * longest * (1 + 1e-9) + 1 < need * (1 - np.sign(need) * 1e-12))


@np.errstate(over="ignore", invalid="ignore")
def search(best: Best, q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, turn: np.ndarray) -> None:
    """Put into best what the candidates c, in any order, add for the queries q; matrices of integers held in doubles."""
    dim = q.shape[1]
    steps = sorted({max(1, int(dim * s)) for s in STEPS}) if dim else []
    c_turned, c_length = c @ turn, _lengths(c)
    c_rest = {p: _lengths(c_turned[:, p:]) for p in steps}
    for at in range(0, len(q), ASKING):
        own = slice(at, at + ASKING)
        need, length = best.need()[own], _lengths(q[own])
        live = np.flatnonzero(within_reach(length, c_length.max(initial=0), need))
        if not len(live):
            continue
        turned = q[own][live] @ turn
        slack = 1e-9 * np.outer(length[live], c_length) + 1
        least = (need[live] * (1 - np.sign(need[live]) * 1e-12))[:, None]
        keep, partial, done = np.ones((len(live), len(c)), dtype=bool), np.zeros((len(live), len(c))), 0
        for p in steps:
            partial += turned[:, done:p] @ c_turned[:, done:p].T
            rest = np.outer(_lengths(turned[:, p:]), c_rest[p])
            keep = ~(partial + rest + slack < least)
            done = p
            if keep.mean() < 0.02:
                break
        a, b = np.nonzero(keep)
        for i in range(0, len(a), 1 << 15):
            qa, cb = at + live[a[i : i + (1 << 15)]], b[i : i + (1 << 15)]
            other = q_ids[qa] != c_ids[cb]
            qa, cb = qa[other], cb[other]
            score, wide = exact_scores(q[qa], c[cb], length[qa - at] * c_length[cb] < EXACT)
            good = score >= best.threshold[qa]
            best.add(qa[good], score[good], c_ids[cb][good], wide[good])


def _placed(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("wide").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(table: DataFrame, k: int = 10, every: int = 100, scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each query, the rows whose vec_id is divisible by `every`."""
    spark = table.sparkSession
    scratch = Scratch(spark, "topk")
    vectors = scratch.keep(integer_vectors(table, scale), "vectors")
    n, dim = vectors.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    dim = dim or 0
    turn = rotation(vectors, dim)
    most = max(k + 1, min(HEAD, HEAD_BYTES // (8 * dim + 8)))
    head = vectors.orderBy(F.col("length").desc(), "vec_id").limit(most).select("vec_id", "v").toArrow()
    head_ids, head_v = np.asarray(head.column("vec_id")), _matrix(head.column("v").combine_chunks(), dim)

    def thresholds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, q = np.asarray(batch.column("vec_id")), _matrix(batch.column("v"), dim)
            best = Best(len(q), k)
            for i in range(0, len(head_ids), ROWS):
                search(best, ids, q, head_ids[i : i + ROWS], head_v[i : i + ROWS], turn)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(best.threshold)], ["vec_id", "v", "t"])

    asking = vectors.where(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    asking = scratch.keep(asking.mapInArrow(thresholds, "vec_id long, v array<double>, t long"), "queries")
    ranges = max(1, min(MOST_RANGES, -(-n // RANGE_ROWS)))
    falling = vectors.repartitionByRange(ranges, F.col("length").desc(), F.col("vec_id")).sortWithinPartitions(F.col("length").desc(), "vec_id")

    def run_wave(wave_rows: DataFrame) -> tuple[DataFrame, Broadcast]:
        rows = wave_rows.select("vec_id", "v", "t").toArrow()
        asked = spark.sparkContext.broadcast((np.asarray(rows.column("vec_id")), _matrix(rows.column("v").combine_chunks(), dim), np.asarray(rows.column("t"))))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q_ids, q, t = asked.value
            best = Best(len(q), k)
            best.threshold[:] = t
            length = _lengths(q)
            for batch in batches:
                for i in range(0, batch.num_rows, ROWS):
                    part = batch.slice(i, ROWS)
                    if within_reach(length, np.asarray(part.column("length")).max(), best.need()).any():
                        search(best, q_ids, q, np.asarray(part.column("vec_id")), _matrix(part.column("v"), dim), turn)
            found = best.rows
            wide = pa.array([None if x is None else sortable(x) for x in best.wide.tolist()], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(q_ids[found[:, 0]]), pa.array(found[:, 2]), pa.array(found[:, 1]), wide], ["query_id", "vec_id", "score", "wide"])

        return _placed(falling.mapInArrow(run, "query_id long, vec_id long, score long, wide binary"), k), asked

    waves = max(1, -(-asking.count() * (8 * dim + 8) // WAVE_BYTES))
    if waves > 1:
        falling = scratch.keep(falling, "falling")  # sorted once for all waves
    out = []
    for wave in range(waves):
        found, asked = run_wave(asking.where(F.pmod(F.xxhash64("vec_id"), F.lit(waves)) == wave))
        out.append(scratch.path("found"))
        found.write.parquet(out[-1])
        asked.destroy()
    scratch.drop(vectors, asking, *([falling] if waves > 1 else []))
    return spark.read.schema(found.schema).parquet(*out)
