"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Tokens are runs of letters, digits and non-ASCII bytes, A-Z lowered; a sequence is up to SEQUENCE tokens of a line. A token's
features are itself and its first 3 to 6 bytes. The field has two states, clean and toxic, a weight for each feature and a
transition between each two states.

Labels say which documents are toxic, not which tokens. Tokens get labels from what sets the labelled documents apart: a
feature marks toxic tokens if it occurs in toxic documents far more often than their share explains, by a binomial tail under
a false discovery rate of FDR; near copies of one text count as one document. The field is then fitted to the token labels by
gradient ascent of its likelihood, and a logistic curve over a document's marginals to the document labels.

The fit sees at most SAMPLE documents of each label, those with the smallest hash of doc_id, of at most SAMPLE_CHARS
characters; scoring reads every text whole. Labels, lang, source and doc_id are no inputs of a score. With no labelled
document of either kind every score is 0. Null or empty texts score what a text without toxic tokens scores. Repeated rows
score alike; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.neardup import shingle_sets
from tidewright.llm.textkit import U64, Words, as_bytes, constants, mix64, slices

SAMPLE, SAMPLE_CHARS = 2000, 20_000
SEQUENCE = 128
PREFIXES = (3, 4, 5, 6)
FDR = 0.01
#: Sequences that the field is fitted to, half of them with toxic tokens; rounds, rate and penalty of the fit.
FIT_SEQUENCES, ROUNDS, RATE, PENALTY = 4000, 60, 0.3, 1e-3
SCORE_CUT = 0.7

_BETWEEN = np.ones(256, dtype=bool)
_BETWEEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_KIND = constants(1 + max(PREFIXES), 41)


class Tokens:
    """Tokens of some texts, their feature hashes and the sequences they form."""

    def __init__(self, texts: list[bytes]):
        self.words = Words(texts, _BETWEEN)
        n = len(self.words)
        with np.errstate(over="ignore"):
            self.features = np.stack([mix64(self.words.hashes ^ _KIND[0]), *[mix64(self.words.prefixes(p) ^ _KIND[p]) for p in PREFIXES]], axis=1) if n else np.zeros((0, 1 + len(PREFIXES)), dtype=U64)
        self.text = np.searchsorted(self.words.first, np.arange(n), side="right") - 1
        feeds = np.flatnonzero(np.frombuffer(self.words.data, dtype=np.uint8) == 10)
        line = np.searchsorted(feeds, self.words.starts)
        new = np.ones(n, dtype=bool)
        new[1:] = (line[1:] != line[:-1]) | (self.text[1:] != self.text[:-1])
        begin = np.maximum.accumulate(np.where(new, np.arange(n), 0)) if n else np.zeros(0, dtype=np.int64)
        new |= (np.arange(n) - begin) % SEQUENCE == 0
        self.sequence = np.cumsum(new) - 1
        self.begins = np.append(np.flatnonzero(new), n)
        self.first = self.words.first

    @classmethod
    def joined(cls, texts: list[str]) -> Tokens:
        """Tokens of many texts, made slice by slice; without the words' places."""
        out, parts = cls([]), [cls([as_bytes(t) for t in part]) for part in _slices(texts)]
        if parts:
            out.features = np.concatenate([p.features for p in parts])
            for name, size in (("text", lambda p: len(p.first) - 1), ("sequence", lambda p: len(p.begins) - 1)):
                before = np.cumsum([0, *map(size, parts)])
                setattr(out, name, np.concatenate([getattr(p, name) + b for p, b in zip(parts, before, strict=False)]))
            before = np.cumsum([0, *(len(p.text) for p in parts)])
            for name in ("begins", "first"):
                setattr(out, name, np.append(np.concatenate([getattr(p, name)[:-1] + b for p, b in zip(parts, before, strict=False)]), before[-1]))
        return out


def _slices(texts: list[str], limit: int = 1 << 20) -> Iterator[list[str]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size > limit:
            yield part
            part, size = [], 0
    if part:
        yield part


@dataclass
class Model:
    """keys: sorted feature hashes; weights: of each in the toxic state; bias; start and step: scores of first states and of
    transitions; curve: the logistic curve over a document's evidence."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float
    start: np.ndarray
    step: np.ndarray
    curve: np.ndarray

    def emissions(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of the toxic state for each token, and whether it has any feature that the model knows."""
        if not len(self.keys):
            return np.full(len(features), self.bias), np.zeros(len(features), dtype=bool)
        maybe = np.zeros(1 << 16, dtype=bool)
        maybe[(self.keys >> U64(48)).astype(np.int64)] = True
        score, known = np.full(len(features), self.bias), np.zeros(len(features), dtype=bool)
        for k in range(features.shape[1]):
            some = np.flatnonzero(maybe[(features[:, k] >> U64(48)).astype(np.int64)])
            at = np.searchsorted(self.keys, features[some, k])
            hit = self.keys[np.minimum(at, len(self.keys) - 1)] == features[some, k]
            score[some[hit]] += self.weights[at[hit]]
            known[some[hit]] = True
        return score, known

    def marginals(self, tokens: Tokens) -> np.ndarray:
        """Each token's probability of the toxic state. Sequences without a known feature depend on their length alone."""
        score, known = self.emissions(tokens.features)
        sizes = np.diff(tokens.begins)
        out = np.zeros(len(score))
        active = np.zeros(len(sizes), dtype=bool)
        active[tokens.sequence[known]] = True
        plain = np.flatnonzero(~active)
        if len(plain):
            lengths = np.unique(sizes[plain])
            table = np.zeros((SEQUENCE + 1, SEQUENCE))
            grid = np.full((len(lengths), SEQUENCE), self.bias)
            table[lengths] = forward_backward(grid, lengths, self.start, self.step)[0]
            of = np.flatnonzero(~active[tokens.sequence])
            seq = tokens.sequence[of]
            out[of] = table[sizes[seq], of - tokens.begins[seq]]
        rows = np.flatnonzero(active)
        for i in range(0, len(rows), 2048):
            part = rows[i : i + 2048]
            width = int(sizes[part].max())
            place = tokens.begins[part][:, None] + np.arange(width)
            inside = np.arange(width) < sizes[part][:, None]
            grid = np.where(inside, score[np.minimum(place, len(score) - 1)], 0.0)
            found = forward_backward(grid, sizes[part], self.start, self.step)[0]
            out[place[inside]] = found[inside]
        return out

    def evidence(self, marginals: np.ndarray, first: np.ndarray) -> np.ndarray:
        """For each text: 1, the largest marginal's logit, and the logarithm of the expected number of clearly toxic tokens."""
        n = len(first) - 1
        best, total = np.zeros(n), np.zeros(n)
        full = np.flatnonzero(np.diff(first))
        if len(full):
            at = first[:-1][full]
            best[full] = np.maximum.reduceat(marginals, at)
            total[full] = np.add.reduceat(np.where(marginals > 0.3, marginals, 0.0), at)
        best = np.clip(best, 1e-4, 1 - 1e-4)
        return np.stack([np.ones(n), np.log(best / (1 - best)), np.log(total + 0.1)], axis=1)

    def scores(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(evidence @ self.curve, -30, 30)))


def forward_backward(grid: np.ndarray, sizes: np.ndarray, start: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For sequences as rows of toxic-state scores: marginals, expected transitions (2, 2), expected starts (2,), log-likelihood norms."""
    n, width = grid.shape
    move = np.exp(step)
    up = np.exp(np.clip(grid, -30, 30))
    alpha, scale = np.zeros((n, width, 2)), np.ones((n, width))
    a = np.stack([np.full(n, math.exp(start[0])), math.exp(start[1]) * up[:, 0]], axis=1)
    for t in range(width):
        if t:
            a = alpha[:, t - 1] @ move
            a[:, 1] *= up[:, t]
        scale[:, t] = a.sum(axis=1)
        alpha[:, t] = a / scale[:, t, None]
        if t:
            over = t >= sizes  # past its end a sequence's last state is carried on
            alpha[over, t] = alpha[over, t - 1]
            scale[over, t] = 1
    beta = np.ones((n, 2))
    out, moves = np.zeros((n, width)), np.zeros((2, 2))
    for t in range(width - 1, -1, -1):
        both = alpha[:, t] * beta
        out[:, t] = both[:, 1] / both.sum(axis=1)
        if t:
            inside = t < sizes
            ahead = beta * np.stack([np.ones(n), up[:, t]], axis=1) / scale[:, t, None]
            pair = alpha[inside, t - 1][:, :, None] * move[None] * ahead[inside][:, None, :]
            moves += pair.sum(axis=0)
            before = ahead @ move.T
            beta = np.where(inside[:, None], before, beta)
    return out, moves, np.array([(1 - out[:, 0]).sum(), out[:, 0].sum()]), np.log(scale).sum(axis=1)


def _clusters(texts: list[str]) -> np.ndarray:
    """A number for each text, the same for near copies: texts are joined that share the minimum of their shingles under one of 4 hashes."""
    keys, found, label = constants(4, 43), [], np.arange(len(texts))
    for part in _slices(texts):
        sets, ends = shingle_sets(part)
        lows = np.zeros((len(keys), len(part)), dtype=U64)
        full = np.flatnonzero(np.diff(ends))
        with np.errstate(over="ignore"):
            for row, k in zip(lows, keys, strict=True):
                if len(full):
                    row[full] = np.minimum.reduceat((sets ^ k) * k, ends[:-1][full])
        found.append((lows, np.diff(ends) > 0))
    full = np.flatnonzero(np.concatenate([f for _, f in found])) if found else np.zeros(0, dtype=np.int64)
    if not len(full):
        return label
    lows = np.concatenate([low for low, _ in found], axis=1)[:, full]
    for _ in range(4):
        for low in lows:
            _, group = np.unique(low, return_inverse=True)
            best = np.full(group.max() + 1, len(texts))
            np.minimum.at(best, group, label[full])
            label[full] = best[group]
        label = label[label]
    return label


def _spread(tokens: Tokens, cluster: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of the clusters in `some` texts, sorted, with the number of clusters each occurs in."""
    rows = np.flatnonzero(some[tokens.text])
    found, counts = [], []
    with np.errstate(over="ignore"):
        owner = cluster[tokens.text[rows]].astype(U64) * U64(0x9E3779B97F4A7C15)
        for k in range(tokens.features.shape[1]):  # kinds of features never meet
            feature = tokens.features[rows, k]
            one = feature[np.unique(mix64(feature ^ owner), return_index=True)[1]]
            f, n = np.unique(one, return_counts=True)
            found.append(f)
            counts.append(n)
    order = np.argsort(np.concatenate(found), kind="stable")
    return np.concatenate(found)[order], np.concatenate(counts)[order]


def _tail(k: np.ndarray, n: np.ndarray, p: float) -> np.ndarray:
    """An upper bound of the logarithm of the binomial tail P(X >= k), by Chernoff."""
    share = np.clip(k / n, p, 1 - 1e-12)
    gap = share * np.log(share / p) + (1 - share) * np.log((1 - share) / (1 - p))
    return np.where(k >= n, n * math.log(p), -n * gap)


def toxic_features(tokens: Tokens, cluster: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Sorted features that set toxic texts apart."""
    of_toxic, n_toxic = _spread(tokens, cluster, toxic)
    of_clean, n_clean = _spread(tokens, cluster, ~toxic)
    at = np.minimum(np.searchsorted(of_clean, of_toxic), max(0, len(of_clean) - 1))
    clean = np.where(of_clean[at] == of_toxic, n_clean[at], 0) if len(of_clean) else np.zeros(len(of_toxic), dtype=np.int64)
    rate = len(np.unique(cluster[toxic])) / max(1, len(np.unique(cluster)))
    tail = _tail(n_toxic, n_toxic + clean, min(max(rate, 1e-3), 0.95))
    order = np.argsort(tail)
    allowed = np.log(FDR * np.arange(1, len(tail) + 1) / max(1, len(tail)))
    passed = np.flatnonzero(tail[order] <= allowed)
    chosen = order[: passed[-1] + 1] if len(passed) else order[:0]
    return np.sort(of_toxic[chosen][n_toxic[chosen] > 9 * clean[chosen]])


def fit(texts: list[str], toxic: np.ndarray, weight: np.ndarray) -> Model:
    """The model of labelled texts; weight: how many labelled documents each stands for."""
    none = Model(np.zeros(0, dtype=U64), np.zeros(0), -8.0, np.array([0.0, -4.0]), np.zeros((2, 2)), np.array([-30.0, 0.0, 0.0]))
    if not toxic.any() or toxic.all():
        return none
    tokens = Tokens.joined(texts)
    marks = toxic_features(tokens, _clusters(texts), toxic)
    if not len(marks):
        return none
    marked = np.zeros(len(tokens.text), dtype=bool)
    for column in tokens.features.T:
        marked |= marks[np.minimum(np.searchsorted(marks, column), len(marks) - 1)] == column
    marked &= toxic[tokens.text]
    keys = np.unique(tokens.features[marked])
    # of sequences with toxic tokens and without, so many each, from all over the sample
    has = np.zeros(len(tokens.begins) - 1, dtype=bool)
    has[tokens.sequence[marked]] = True
    rank = mix64(np.arange(len(has), dtype=U64))
    rows = np.concatenate([g[np.argsort(rank[g])][: FIT_SEQUENCES // 2] for g in (np.flatnonzero(has), np.flatnonzero(~has))])
    sizes = np.diff(tokens.begins)[rows]
    width = int(sizes.max())
    place = np.minimum(tokens.begins[rows][:, None] + np.arange(width), len(marked) - 1)
    inside = np.arange(width) < sizes[:, None]
    truth = marked[place] & inside
    features = tokens.features[place]
    own = np.searchsorted(keys, features)
    own = np.where(keys[np.minimum(own, len(keys) - 1)] == features, own, len(keys))  # the last is no feature
    moves = np.zeros((2, 2))
    for t in range(1, width):
        on = inside[:, t]
        np.add.at(moves, (truth[on, t - 1].astype(int), truth[on, t].astype(int)), 1)
    starts = np.array([(~truth[:, 0]).sum(), truth[:, 0].sum()], dtype=float)
    shape = [len(keys) + 1, 1, 2, 4]
    flat = np.zeros(sum(shape))
    flat[len(keys) + 1] = -2.0
    size2 = np.zeros(len(flat))
    for _ in range(ROUNDS):
        w, bias, start, step = np.split(flat, np.cumsum(shape)[:-1])
        w[-1] = 0
        grid = np.where(inside, w[own].sum(axis=2) + bias[0], 0.0)
        p, expected, first, _ = forward_backward(grid, sizes, start, step.reshape(2, 2))
        gap = np.where(inside, truth - p, 0.0)
        grad_w = np.bincount(own.ravel(), weights=np.repeat(gap.ravel(), own.shape[2]), minlength=len(keys) + 1)
        grad = np.concatenate([grad_w, [gap.sum()], starts - first, (moves - expected).ravel()]) / len(rows) - PENALTY * flat / 10
        size2 += grad * grad  # steps by each weight's own past gradients
        flat = flat + RATE * grad / (np.sqrt(size2) + 1e-8)
    w, bias, start, step = np.split(flat, np.cumsum(shape)[:-1])
    model = Model(keys, w[:-1], float(bias[0]), start, step.reshape(2, 2), np.zeros(3))
    x, y = model.evidence(model.marginals(tokens), tokens.first), toxic.astype(float)
    curve = np.zeros(3)
    for _ in range(30):  # Newton's steps of a penalised logistic regression
        p = 1 / (1 + np.exp(-np.clip(x @ curve, -30, 30)))
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(3)
        curve = curve + np.linalg.solve(hessian, x.T @ (weight * (y - p)) - 0.1 * curve)
    model.curve = curve
    return model


def trained(docs: DataFrame, labels: DataFrame, may_learn: Column | None = None) -> Model:
    """The model of the labelled documents; `may_learn` over doc_id says which labels the fit may see."""
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    if may_learn is not None:
        known = known.where(may_learn)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    totals = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = [r for y in (0, 1) for r in known.where(F.col("toxic") == y).orderBy(*order).limit(SAMPLE).collect()]
    if not chosen:
        return fit([], np.zeros(0, dtype=bool), np.zeros(0))
    small = F.broadcast(spark.createDataFrame([(r["doc_id"], r["toxic"]) for r in chosen], "_id long, _toxic int"))  # 2 * SAMPLE rows at most
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.join(small, F.col("doc_id") == F.col("_id")).where(F.length("text") <= SAMPLE_CHARS)
    rows = rows.groupBy("_id", "_toxic").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = [(t, y) for batch in batches for t, y in zip(batch.column("text").to_pylist(), batch.column("_toxic").to_pylist(), strict=True)]
        toxic = np.array([y == 1 for _, y in table], dtype=bool)
        counts = [max(1, int((~toxic).sum())), max(1, int(toxic.sum()))]
        weight = np.where(toxic, totals.get(1, 0) / counts[1], totals.get(0, 0) / counts[0])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit([t for t, _ in table], toxic, weight))], pa.binary())], ["model"])

    # the sample is bounded, so one task can fit it, and the driver gets the model alone
    found = rows.repartition(1).sortWithinPartitions("_id").mapInArrow(run, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else fit([], np.zeros(0, dtype=bool), np.zeros(0))


def tag(docs: DataFrame, model: Model, spans: bool = True) -> DataFrame:
    """doc_id, score, n_toxic (tokens more likely toxic than not) and, if wanted, spans: (start, end, score) of runs of such tokens.

    Offsets count characters (code points) of the text; a span's score is its tokens' mean marginal.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch, texts in slices(batches, "text", 1 << 19):
            data = [as_bytes(t) for t in texts]
            tokens = Tokens(data)
            p = model.marginals(tokens)
            first = tokens.words.first
            on = p > 0.5
            columns = [batch.column("doc_id"), pa.array(model.scores(model.evidence(p, first))), pa.array(np.bincount(tokens.text[on], minlength=len(data)).astype(np.int64))]
            if spans:
                found: list[list[dict]] = [[] for _ in data]
                toxic = np.flatnonzero(on)
                new = np.ones(len(toxic), dtype=bool)
                new[1:] = (np.diff(toxic) > 1) | (np.diff(tokens.sequence[toxic]) > 0)
                edges = np.append(np.flatnonzero(new), len(toxic))
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    i, j = toxic[a], toxic[b - 1]
                    d = int(tokens.text[i])
                    base = int(tokens.words.offsets[d])
                    start, end = int(tokens.words.starts[i]) - base, int(tokens.words.ends[j]) - base
                    chars = len(data[d][:start].decode("utf-8", "ignore"))
                    found[d].append({"start": chars, "end": chars + len(data[d][start:end].decode("utf-8", "ignore")), "score": float(p[i : j + 1].mean())})
                columns.append(pa.array(found, pa.list_(span)))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "n_toxic", "spans"][: len(columns)])

    schema = "doc_id long, score double, n_toxic long" + ", spans array<struct<start: long, end: long, score: double>>" * spans
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def kept(docs: DataFrame, model: Model, cut: float = SCORE_CUT) -> DataFrame:
    """The rows of docs that score below the cut, as they are. Rows stay where they are: no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch, texts in slices(batches, "text", 1 << 19):
            tokens = Tokens([as_bytes(t) for t in texts])
            scores = model.scores(model.evidence(model.marginals(tokens), tokens.words.first))
            yield batch.filter(pa.array(scores < cut))

    return docs.mapInArrow(run, docs.schema)


def held_out(column: str = "doc_id") -> Column:
    """Whether a document's label is kept from the fit: crc32 of its doc_id as text leaves 1 over 3."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 3 == 1, F.lit(False))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, n_toxic of every document, learning only from labels that aren't held out."""
    tagged = tag(docs, trained(docs, labels, ~held_out()), spans=False)
    return tagged.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= SCORE_CUT).cast("int").alias("predicted"), "n_toxic")
