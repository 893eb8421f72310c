"""Fingerprints of improbable features, and how alike two fingerprints are.

Every window of WINDOW bytes has a score, its byte entropy from 0 to 1000. Windows rank by how rare their score is among all
windows of the corpus, the rarest first; scores under LOW (runs of few byte values, alike in any text) come last. Of each
NEIGHBOURS successive windows the first of the best rank gets a point, and windows with POPULAR points are a text's features;
where none has as many, the one with the most; equal windows of a text count together. Of a short text all windows of SHORT_WINDOW bytes are features, of one
shorter than these the whole.

Features go into Bloom filters of FILTER_BITS bits by HASHES hashes each; a filter that holds CAPACITY features is closed and
the next one chained on. Two filters compare by the bits they share, less what chance gives, over the most that they could.
Two chains compare by the mean, over the shorter chain's filters, of each one's best match in the other; if both have as many,
over those of both. The likeness is 0 to 1, and 1 for equal texts; an empty text is like an empty one only.

A fingerprint is a string: the number of features, a colon and the filters in base64; of an empty text "0:". Nulls are empty
texts. Empty tables give empty results; of rows with equal doc_id the one with the larger text hash comes first.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.blocks import block_of, cut_points
from tidewright.llm.textkit import _BYTE, U64, _power_tables, as_bytes, mix64, slices

WINDOW = 64
NEIGHBOURS = 64
POPULAR = 16
LOW = 100
#: Texts of fewer bytes are too short for windows to compete: all their windows of SHORT_WINDOW bytes are features. From LONG
#: bytes on the improbable windows are; in between both, so that texts on either side of a border still compare.
SHORT, SHORT_WINDOW, LONG = 640, 8, 400
SCORES = 1001
FILTER_BITS = 2048
HASHES = 5
CAPACITY = 160
#: Share of the way from chance to the most possible below which an overlap counts as none.
FLOOR = 0.3
#: Documents in a range of doc_ids that one task fingerprints.
BLOCK_ROWS = 4096

_counts = np.arange(WINDOW + 1)
_CLOGC = np.concatenate([[0], np.round(_counts[1:] * np.log2(_counts[1:]) * (1 << 16))]).astype(np.int64)
#: What a byte adds when it becomes the c-th of its value in a window.
_GAIN = np.concatenate([[0], np.diff(_CLOGC)])
_FULL = WINDOW * np.log2(WINDOW) * (1 << 16)


def window_scores(raw: np.ndarray) -> np.ndarray:
    """The entropy score of every window of the bytes, by where it starts.

    Sliding by one byte takes one byte value's count down and one up; those counts are found for all places at once, from how
    many places of the same value lie within a window's reach.
    """
    n = len(raw)
    if n < WINDOW:
        return np.zeros(0, dtype=np.int64)
    order = np.argsort(raw, kind="stable")
    key = (raw[order].astype(np.int64) << 40) | order
    rank = np.arange(n)
    gain, loss = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    gain[order] = _GAIN[rank - np.searchsorted(key, key - (WINDOW - 1)) + 1]
    loss[order] = _GAIN[np.searchsorted(key, key + WINDOW) - rank]
    total = np.cumsum(gain)[WINDOW - 1 :]
    total[1:] -= np.cumsum(loss)[: n - WINDOW]
    return np.round((_FULL - total) * (1000 / _FULL)).astype(np.int64)


def _spans(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' bytes in a row, and where each begins and the last ends."""
    return np.frombuffer(b"".join(texts), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def _inside(ends: np.ndarray, reach: int, n: int) -> np.ndarray:
    """Whether `reach` items from each of the first n places on lie in one text."""
    ok = np.ones(n, dtype=bool)
    for e in ends[1:-1]:
        ok[max(0, e - reach + 1) : e] = False
    return ok


def score_histogram(docs: DataFrame) -> np.ndarray:
    """How many windows of all texts have each score: SCORES numbers, whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SCORES, dtype=np.int64)
        for _, texts in slices(batches, "text"):
            raw, ends = _spans([as_bytes(t) for t in texts])
            scores = window_scores(raw)
            total += np.bincount(scores[_inside(ends, WINDOW, len(scores))], minlength=SCORES)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SCORES)), pa.array(total)], ["score", "n"])

    counted = docs.select("text").mapInArrow(run, "score long, n long").groupBy("score").agg(F.sum("n").alias("n"))
    out = np.zeros(SCORES, dtype=np.int64)
    for row in counted.collect():
        out[row["score"]] = row["n"]
    return out


def rarity_ranks(histogram: np.ndarray) -> np.ndarray:
    """Each score's rank: rarest 0 first, then by score; low scores after all others."""
    order = np.lexsort((np.arange(SCORES), histogram, np.arange(SCORES) < LOW))
    ranks = np.empty(SCORES, dtype=np.int64)
    ranks[order] = np.arange(SCORES)
    return ranks


def features(texts: list[bytes], ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts' features as 64-bit hashes in order, and which text each is of."""
    raw, ends = _spans(texts)
    forward, back = _power_tables(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, dtype=U64)
    with np.errstate(over="ignore"):
        np.cumsum(_BYTE[raw] * forward[: len(raw)], out=sums[1:])
    scores = window_scores(raw)
    best = (ranks[scores] << 40) | np.arange(len(scores))
    groups, step = best, 1
    while step < NEIGHBOURS and len(groups) > step:
        groups = np.minimum(groups[:-step], groups[step:])
        step *= 2
    if step < NEIGHBOURS:
        groups = groups[:0]
    groups = groups[_inside(ends, WINDOW + NEIGHBOURS - 1, len(groups))] if len(groups) else groups
    points = np.bincount(groups & ((1 << 40) - 1), minlength=len(scores)) if len(scores) else np.zeros(0, dtype=np.int64)
    sizes = np.diff(ends)
    hash_of = lambda a, b: mix64((sums[b] - sums[a]) * back[a])
    with np.errstate(over="ignore"):
        starts = np.flatnonzero(points)
        owner = np.searchsorted(ends, starts, side="right") - 1
        hashes = hash_of(starts, starts + WINDOW)
        # points of equal windows of a text count together, so that text that repeats itself has features too
        _, first, same = np.unique(mix64(hashes ^ (owner.astype(U64) * U64(0x9E3779B97F4A7C15))), return_index=True, return_inverse=True)
        total = np.bincount(same, weights=points[starts], minlength=len(first)).astype(np.int64)
        most = np.zeros(len(texts), dtype=np.int64)
        np.maximum.at(most, owner[first], total)
        best_of = np.full(len(texts), len(raw), dtype=np.int64)
        top = first[total == most[owner[first]]]
        np.minimum.at(best_of, owner[top], top)
        popular = np.where(most[owner[first]] >= POPULAR, total >= POPULAR, first == best_of[owner[first]])
        chosen = np.sort(first[popular & (sizes[owner[first]] >= LONG)])
        parts = []
        for d in np.flatnonzero(sizes < SHORT):
            a, b = int(ends[d]), int(ends[d + 1])
            at = np.arange(a, max(a, b - SHORT_WINDOW) + 1) if b > a else np.zeros(0, dtype=np.int64)
            parts.append((hash_of(at, np.minimum(at + SHORT_WINDOW, b)), np.full(len(at), d)))
        parts.append((hashes[chosen], owner[chosen]))
        hashes, owner = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.argsort(owner, kind="stable")
    return hashes[order], owner[order]


def fingerprints(texts: list[bytes], ranks: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """For each text its number of features, and its filters: rows of FILTER_BITS / 8 bytes."""
    hashes, owner = features(texts, ranks)
    counts = np.bincount(owner, minlength=len(texts))
    first = np.cumsum(counts) - counts
    chain = -(-counts // CAPACITY)
    begin = np.cumsum(chain) - chain
    row = begin[owner] + (np.arange(len(hashes)) - first[owner]) // CAPACITY
    bits = np.zeros((int(chain.sum()), FILTER_BITS), dtype=bool)
    for k in range(HASHES):
        bits[row, (hashes >> U64(11 * k)).astype(np.int64) & (FILTER_BITS - 1)] = True
    packed = np.packbits(bits, axis=1)
    return [(int(c), packed[b : b + n]) for c, b, n in zip(counts, begin, chain, strict=True)]


def as_string(print_: tuple[int, np.ndarray]) -> str:
    return f"{print_[0]}:{base64.b64encode(print_[1].tobytes()).decode()}"


def from_string(text: str) -> tuple[int, np.ndarray]:
    count, _, data = text.partition(":")
    return int(count), np.frombuffer(base64.b64decode(data), dtype=np.uint8).reshape(-1, FILTER_BITS // 8)


def likeness(x: tuple[int, np.ndarray], y: tuple[int, np.ndarray]) -> float:
    """0 to 1: how alike two fingerprints are."""
    a, b = x[1], y[1]
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if a.shape == b.shape and np.array_equal(a, b):
        return 1.0
    if len(a) > len(b):
        a, b = b, a
    size_b = np.bitwise_count(b).sum(axis=1, dtype=np.int64)
    scores = np.empty((len(a), len(b)))
    for i, f in enumerate(a):  # one filter against a whole chain: memory follows the chain's length
        size = int(np.bitwise_count(f).sum(dtype=np.int64))
        shared = np.bitwise_count(b & f).sum(axis=1, dtype=np.int64)
        most, chance = np.minimum(size, size_b), size * size_b / FILTER_BITS
        floor = chance + FLOOR * (most - chance)
        scores[i] = np.clip((shared - floor) / np.maximum(most - floor, 1e-9), 0, 1)
    best = scores.max(axis=1).mean()
    return float((best + scores.max(axis=0).mean()) / 2 if len(a) == len(b) else best)


def digest(docs: DataFrame, ranks: np.ndarray | None = None) -> DataFrame:
    """doc_id, fingerprint of every text; ranks are fitted on docs if not given."""
    ranks = rarity_ranks(score_histogram(docs)) if ranks is None else ranks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([as_string(x) for x in fingerprints([as_bytes(t) for t in texts], ranks)])], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fingerprint string")


def in_turn(docs: DataFrame) -> DataFrame:
    """block, own, doc_id, text_hash, text: by descending doc_id in ranges, each followed by the first document of the next range.

    The last range is followed by the first one's first document. Rows with own = 0 are those followers.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    cuts = cut_points(keyed, BLOCK_ROWS)
    keyed = keyed.withColumn("text_hash", F.xxhash64("text")).withColumn("block", block_of("doc_id", cuts))
    heads = sorted((r["block"], r["head"]) for r in keyed.groupBy("block").agg(F.max(F.struct(F.coalesce("doc_id", F.lit(-(2**63))).alias("k"), "text_hash")).alias("head")).collect())  # a row a range
    after = {head: heads[(i + 1) % len(heads)][0] for i, (_, head) in enumerate(heads)}
    rows = keyed.sparkSession.createDataFrame([(int(h["k"]), int(h["text_hash"]), int(b)) for h, b in after.items()], "_k long, _h long, _to int")
    sent = keyed.join(F.broadcast(rows), (F.coalesce("doc_id", F.lit(-(2**63))) == F.col("_k")) & (F.col("text_hash") == F.col("_h")), "left")
    both = F.filter(F.array(F.struct(F.col("block").alias("block"), F.lit(1).alias("own")), F.struct(F.col("_to").alias("block"), F.lit(0).alias("own"))), lambda x: x["block"].isNotNull())
    spread = sent.select(F.explode(both).alias("_p"), "doc_id", "text_hash", "text").select("_p.block", "_p.own", "doc_id", "text_hash", "text")
    return spread.repartitionById(len(cuts) + 1, F.col("block")).sortWithinPartitions(F.col("block"), F.col("own").desc(), F.col("doc_id").desc_nulls_last(), F.col("text_hash").desc())


def edited(text: str, following: str) -> str:
    """text with its last third of code points replaced by as many of the following text's first."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def against_edited(docs: DataFrame, ranks: np.ndarray | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document."""
    ranks = rarity_ranks(score_histogram(docs)) if ranks is None else ranks
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, of_block = [], None  # the document before, its text and print, until the one that follows comes
        for batch, texts in slices(batches, "text", 1 << 19):
            prints = fingerprints([as_bytes(t) for t in texts], ranks)
            out, changed = [], []
            for block, own, doc_id, text, print_ in zip(batch.column("block").to_pylist(), batch.column("own").to_pylist(), batch.column("doc_id").to_pylist(), texts, prints, strict=True):
                text = text or ""
                if block == of_block and held:
                    changed.append(as_bytes(edited(held[1], text)))
                    out.append((held[0], len(held[1]), held[2], print_))
                    held = []
                of_block = block
                if own:
                    held = [doc_id, text, print_]
            new = fingerprints(changed, ranks)
            columns = [
                pa.array([o[0] for o in out], pa.int64()),
                pa.array([o[1] for o in out], pa.int64()),
                pa.array([hashlib.sha256(c).hexdigest() for c in changed], pa.string()),
                pa.array([as_string(o[2]) for o in out], pa.string()),
                pa.array([as_string(e) for e in new], pa.string()),
                pa.array([likeness(o[2], e) for o, e in zip(out, new, strict=True)], pa.float64()),
                pa.array([likeness(o[2], o[3]) for o in out], pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)

    return in_turn(docs).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
