"""Interpolated bigram model in an Elias-Fano n-gram trie, trained on a table and queried by scoring tasks.

Texts become words (A-Z lowered, split at space and 09-0D), each text followed by one end token, which is also the context of
a text's first token. With c for counts in the training texts, N tokens and V distinct ones,

    P(w) = (c(w) + 0.5) / (N + 0.5 (V + 1))          V + 1: all unknown words are one more
    P(w | h) = l c(h w) / c(h) + (1 - l) P(w)        l by the magnitude of c(h); 0 for unseen contexts

which sums to 1. l is fitted on leave-one-out counts of all training bigrams: a histogram of how much likelier the bigram
estimate is than P(w) for each magnitude, of fixed size, on which expectation maximisation runs.

The levels, each a monotone sequence in Elias-Fano form over memory-mapped files:

    words       hashes of the distinct tokens, sorted, cut by their top bits into files; counts beside them
    contexts    per file of bigrams, the word numbers that open one
    pointers    where each context's successors begin
    successors  word numbers, each raised by its context's place times V: monotone over the whole level
    codes       log10 P(w | h) of each bigram, quantised to 16 bits

A query finds the context, its range by two pointers, and the successor inside that range by the context's offset; what isn't
there backs off to (1 - l) P(w). A bigram's file is chosen by its context and the low bits of its word, so the successors of
a very common word are spread over many files. Nothing is pruned: what is counted and kept grows with the corpus.

Counts travel as compressed sorted blocks by file, at most one a task, file and FLUSH tokens. Files lie in the shared folder.
Null texts are empty; empty texts have the end token alone; a null doc_id counts as not held out. Without training texts every
token is unknown. Repeated rows count each time; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import json
import math
import os
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.eliasfano import EliasFano
from tidewright.llm.scratch import Scratch
from tidewright.llm.textkit import U64, Words, as_bytes, mix64, slices

#: Tokens that a task counts before it sends its blocks.
FLUSH = 3_000_000
#: Bytes of training text for one file of words, and of bigrams.
WORD_BYTES, PAIR_BYTES = 64 << 20, 16 << 20
#: Low bits of a bigram's word that choose its file beside its context.
SPREAD_BITS = 4
#: Quantisation: codes are steps of 10 ** -(LOWEST / 65535) down from 1.
LOWEST = 24.0
MAGNITUDES, RATIOS, OCTAVE = 64, 256, 4
END = mix64(np.array([0x0E0D], dtype=U64))[0]


def _packed(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted distinct keys and their counts, as differences by byte planes, compressed."""
    import zstandard

    steps = np.diff(keys, prepend=U64(0)).astype("<u8")
    planes = [steps.view(np.uint8).reshape(-1, 8).T, counts.astype("<u4").view(np.uint8).reshape(-1, 4).T]
    return len(keys).to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(p).tobytes() for p in planes))


def _unpacked(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    import zstandard

    n = int.from_bytes(block[:8], "little")
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(block[8:], max_output_size=12 * n + 1), dtype=np.uint8)
    steps = np.ascontiguousarray(raw[: 8 * n].reshape(8, n).T).view("<u8").ravel()
    return np.cumsum(steps, dtype=U64), np.ascontiguousarray(raw[8 * n :].reshape(4, n).T).view("<u4").ravel().astype(np.int64)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at], np.add.reduceat(counts, at)


def _counted(batches: Iterator[pa.RecordBatch], keys_of, file_of, files: int) -> Iterator[pa.RecordBatch]:
    """Count the keys of all texts; blocks of (file, keys and counts) whenever enough have been seen."""
    held: list[np.ndarray] = []
    size = 0

    def blocks() -> pa.RecordBatch:
        keys, counts = np.unique(np.concatenate(held), return_counts=True)
        file = file_of(keys)
        order = np.argsort(file, kind="stable")
        cut = np.searchsorted(file[order], np.arange(files + 1))
        some = np.flatnonzero(np.diff(cut))
        data = [_packed(keys[order[cut[f] : cut[f + 1]]], counts[order[cut[f] : cut[f + 1]]]) for f in some]
        return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(data, pa.binary())], ["file", "block"])

    for _, texts in slices(batches, "text"):
        keys = keys_of([as_bytes(t) for t in texts])
        held.append(keys)
        size += len(keys)
        if size >= FLUSH:
            yield blocks()
            held, size = [], 0
    if size:
        yield blocks()


def token_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' tokens, each text's end included; where each text's begin and the last's end."""
    words = Words(texts)
    first = words.first + np.arange(len(texts) + 1)
    out = np.empty(int(first[-1]), dtype=U64)
    ends = first[1:] - 1
    mask = np.ones(len(out), dtype=bool)
    mask[ends] = False
    out[mask] = words.hashes
    out[ends] = END
    return out, first


def contexts_of(tokens: np.ndarray, first: np.ndarray, opening) -> np.ndarray:
    """The token before each one; before a text's first, `opening`."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[first[:-1]] = opening
    return before


def _write(folder: str, name: str, arrays: dict[str, np.ndarray], meta: dict) -> None:
    """One file: a line of JSON, then each array at a multiple of 64 bytes. Written apart, then moved to its name."""
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(folder)
    system.create_dir(root, recursive=True)
    at, places = 0, {}
    for key, array in arrays.items():
        places[key] = [array.dtype.str, len(array), at]
        at += -(-array.nbytes // 64) * 64
    head = json.dumps({"meta": meta, "arrays": places}).encode() + b"\n"
    head = head.rjust(-(-len(head) // 64) * 64)
    part = f"{root}/.{name}-{uuid.uuid4().hex}"
    with system.open_output_stream(part) as out:
        out.write(head)
        for array in arrays.values():
            out.write(np.ascontiguousarray(array).tobytes())
            out.write(bytes(-array.nbytes % 64))
    system.move(part, f"{root}/{name}")


def _mapped(folder: str, name: str) -> tuple[dict[str, np.ndarray], dict]:
    """A file's arrays, memory-mapped where the folder is mounted; else from a copy that goes when they do."""
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(folder)
    if isinstance(system, fs.LocalFileSystem):
        data = np.memmap(f"{root}/{name}", dtype=np.uint8, mode="r")
    else:
        with tempfile.NamedTemporaryFile(delete=False) as copy, system.open_input_stream(f"{root}/{name}") as source:
            while chunk := source.read(1 << 20):
                copy.write(chunk)
        data = np.memmap(copy.name, dtype=np.uint8, mode="r")
        os.unlink(copy.name)  # the mapping holds it
    end = bytes(data[: 1 << 16]).index(b"\n") + 1
    head = json.loads(bytes(data[:end]))
    out = {}
    for key, (kind, n, at) in head["arrays"].items():
        size = np.dtype(kind).itemsize * n
        out[key] = data[end + at : end + at + size].view(kind)
    return out, head["meta"]


def _merge(batches: Iterator[pa.RecordBatch], build) -> Iterator[tuple]:
    """Blocks that come sorted by file: build(file, keys, counts) of each file's sums. Blocks are summed as they come."""
    file, keys, counts, size = None, [], [], 0
    for batch in batches:
        for i in range(batch.num_rows):
            f = batch.column("file")[i].as_py()
            if f != file and file is not None:
                yield build(file, *_summed(np.concatenate(keys), np.concatenate(counts)))
                keys, counts, size = [], [], 0
            file = f
            k, c = _unpacked(batch.column("block")[i].as_py())
            keys.append(k)
            counts.append(c)
            size += len(k)
            if size > 2 * FLUSH:
                k, c = _summed(np.concatenate(keys), np.concatenate(counts))
                keys, counts, size = [k], [c], 0
    if file is not None:
        yield build(file, *_summed(np.concatenate(keys), np.concatenate(counts)))


class Vocabulary:
    """The level of words: numbers and counts of token hashes."""

    def __init__(self, folder: str, sizes: list[int]):
        self.base = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.bits = (len(sizes) - 1).bit_length()
        self.parts, self.counts = [], []
        for i, n in enumerate(sizes):
            arrays, meta = _mapped(folder, f"words-{i:06d}") if n else ({"counts": np.zeros(0, dtype="<u4")}, None)
            self.parts.append(EliasFano(n, meta["width"], arrays["low"], arrays["high"], arrays["ones"]) if n else None)
            self.counts.append(arrays["counts"])

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each of some sorted hashes, -1 if it isn't there."""
        out = np.full(len(hashes), -1, dtype=np.int64)
        file = (hashes >> U64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(hashes), dtype=np.int64)
        cut = np.searchsorted(file, np.arange(len(self.parts) + 1))
        rest = U64((1 << (64 - self.bits)) - 1)
        for i in np.flatnonzero(np.diff(cut)):
            if self.parts[i] is not None:
                at, found = self.parts[i].successor(hashes[cut[i] : cut[i + 1]] & rest)
                out[cut[i] : cut[i + 1]] = np.where(found, at + self.base[i], -1)
        return out

    def count(self, numbers: np.ndarray) -> np.ndarray:
        """Counts of some numbers; 0 of -1."""
        out = np.zeros(len(numbers), dtype=np.int64)
        file = np.searchsorted(self.base, numbers, side="right") - 1
        order = np.argsort(file, kind="stable")
        cut = np.searchsorted(file[order], np.arange(len(self.parts) + 1))
        for i in np.flatnonzero(np.diff(cut)):
            rows = order[cut[i] : cut[i + 1]]
            out[rows] = self.counts[i][numbers[rows] - self.base[i]]
        return out


def pair_file(context: np.ndarray, word: np.ndarray, files: int) -> np.ndarray:
    key = (context.astype(U64) << U64(SPREAD_BITS)) | (word.astype(U64) & U64((1 << SPREAD_BITS) - 1))
    return (mix64(key) % U64(files)).astype(np.int64)


@dataclass
class Model:
    """Where a trained model's files are, and its few numbers."""

    folder: str
    word_sizes: list[int]
    pair_files: int
    tokens: int
    shares: list[float]  # l by the magnitude of a context's count

    @property
    def words(self) -> int:
        return sum(self.word_sizes)

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.5) / (self.tokens + 0.5 * (self.words + 1)))

    def open(self) -> Query:
        return Query(self)


def magnitude(counts: np.ndarray) -> np.ndarray:
    """Binary order of a count; 0 stays 0, 1 is 1."""
    return np.where(counts > 0, np.floor(np.log2(np.maximum(counts, 1))).astype(np.int64) + 1, 0)


class Query:
    """An open model."""

    def __init__(self, model: Model):
        self.model = model
        self.vocabulary = Vocabulary(model.folder, model.word_sizes)
        self.shares = np.array(model.shares)
        self.files: dict[int, tuple | None] = {}

    def _file(self, i: int) -> tuple | None:
        if i not in self.files:
            try:
                arrays, meta = _mapped(self.model.folder, f"pairs-{i:06d}")
                codes, _ = _mapped(self.model.folder, f"codes-{i:06d}")
                self.files[i] = (*levels(arrays, meta), codes["codes"])
            except FileNotFoundError:
                self.files[i] = None
        return self.files[i]

    def bigrams(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """log10 P(word | context) of numbered pairs that were seen; nan of others."""
        out = np.full(len(context), np.nan)
        file = pair_file(context, word, self.model.pair_files)
        order = np.argsort(file, kind="stable")
        cut = np.searchsorted(file[order], np.arange(self.model.pair_files + 1))
        for i in np.flatnonzero(np.diff(cut)):
            if (opened := self._file(int(i))) is None:
                continue
            contexts, pointers, successors, codes = opened
            rows = order[cut[i] : cut[i + 1]]
            h, place = np.unique(context[rows], return_inverse=True)
            at, known = contexts.successor(h)
            rows, at = rows[known[place]], at[place[known[place]]]
            if not len(rows):
                continue
            found_at, found = successors.successor(at.astype(U64) * U64(self.model.words) + word[rows].astype(U64))
            hit = np.flatnonzero(found)
            inside = (pointers.access(at[hit]) <= found_at[hit].astype(U64)) & (found_at[hit].astype(U64) < pointers.access(at[hit] + 1))
            hit = hit[inside]
            out[rows[hit]] = -LOWEST * codes[found_at[hit]].astype(np.float64) / 65535
        return out

    def tokens(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each token its count, its base log10 probability and the model's."""
        distinct, place = np.unique(hashes, return_inverse=True)
        numbers = self.vocabulary.numbers(distinct)
        counts = self.vocabulary.count(numbers)
        base = self.model.unigram(counts)
        end = np.searchsorted(distinct, END)
        before = contexts_of(place, first, end)
        pair = before * len(distinct) + place
        pairs, at = np.unique(pair, return_inverse=True)
        h, w = pairs // len(distinct), pairs % len(distinct)
        share = self.shares[np.minimum(magnitude(counts[h]), len(self.shares) - 1)]
        score = np.log10(1 - share) + base[w]
        both = np.flatnonzero((numbers[h] >= 0) & (numbers[w] >= 0))
        seen = self.bigrams(numbers[h[both]], numbers[w[both]])
        score[both] = np.where(np.isnan(seen), score[both], seen)
        return counts[place], base[place], score[at]


def levels(arrays: dict[str, np.ndarray], meta: dict) -> tuple[EliasFano, EliasFano, EliasFano]:
    return tuple(EliasFano(meta[k][0], meta[k][1], *(arrays[f"{k}_{part}"] for part in ("low", "high", "ones"))) for k in ("contexts", "pointers", "successors"))


def train(docs: DataFrame, folder: str) -> Model:
    """Train on the texts of docs; files go to folder."""
    scratch = Scratch(docs.sparkSession, "lm")
    texts = docs.select(F.col("text").cast("string").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    word_files = 1 << max(0, math.ceil(math.log2(max(1, size / WORD_BYTES))))
    bits = word_files.bit_length() - 1
    pair_files = max(1, math.ceil(size / PAIR_BYTES))

    def words_counted(batches):
        yield from _counted(batches, lambda t: token_hashes(t)[0], lambda k: (k >> U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(k), dtype=np.int64), word_files)

    def words_written(batches):
        def build(file, keys, counts):
            rest = keys & U64((1 << (64 - bits)) - 1)
            level = EliasFano.of(rest, 1 << (64 - bits))
            _write(folder, f"words-{file:06d}", level.arrays() | {"counts": counts.astype("<u4") if counts.max() < 1 << 32 else counts.astype("<u8")}, {"width": level.width})
            return file, len(keys), int(counts.sum())

        yield _rows(list(_merge(batches, build)), ["file", "n", "tokens"])

    def _rows(found, names):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)] if found else [pa.array([], pa.int64())] * len(names), names)

    blocks = texts.mapInArrow(words_counted, "file int, block binary").repartitionById(word_files, F.col("file")).sortWithinPartitions("file")
    listed = scratch.keep(blocks.mapInArrow(words_written, "file long, n long, tokens long"), "words").collect()  # a row a file
    sizes = [0] * word_files
    for row in listed:
        sizes[row["file"]] = row["n"]
    model = Model(folder, sizes, pair_files, sum(r["tokens"] for r in listed), [0.0] * MAGNITUDES)
    n_words = model.words

    def pairs_counted(batches):
        vocabulary = Vocabulary(folder, sizes)

        def keys_of(data):
            hashes, first = token_hashes(data)
            distinct, place = np.unique(hashes, return_inverse=True)
            numbers = vocabulary.numbers(distinct)
            before = contexts_of(numbers[place], first, numbers[np.searchsorted(distinct, END)])
            return before.astype(U64) * U64(n_words) + numbers[place].astype(U64)

        yield from _counted(batches, keys_of, lambda k: pair_file(k // U64(n_words), k % U64(n_words), pair_files), pair_files)

    def pairs_written(batches):
        vocabulary = Vocabulary(folder, sizes)
        total = np.zeros(MAGNITUDES * RATIOS)

        def build(file, keys, counts):
            context, word = (keys // U64(n_words)).astype(np.int64), (keys % U64(n_words)).astype(np.int64)
            new = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
            place = np.cumsum(np.isin(np.arange(len(keys)), new, assume_unique=True)) - 1
            three = {
                "contexts": EliasFano.of(context[new], n_words),
                "pointers": EliasFano.of(np.append(new, len(keys)), len(keys) + 1),
                "successors": EliasFano.of(place.astype(U64) * U64(n_words) + word.astype(U64), len(new) * n_words),
            }
            arrays = {f"{k}_{part}": a for k, level in three.items() for part, a in level.arrays().items()}
            _write(folder, f"pairs-{file:06d}", arrays, {k: [level.n, level.width] for k, level in three.items()})
            of_context = vocabulary.count(context[new])[place]
            of_word = vocabulary.count(word)
            _write(folder, f"counts-{file:06d}", {"pair": counts, "context": of_context, "word": of_word}, {})
            left = np.flatnonzero(of_context > 1)  # what one occurrence finds when it is taken out of the counts
            bigram = (counts[left] - 1) / (of_context[left] - 1)
            unigram = (of_word[left] - 0.5) / (model.tokens - 1 + 0.5 * (n_words + 1))
            ratio = np.where(bigram > 0, np.round(OCTAVE * np.log2(np.maximum(bigram, 1e-300) / unigram)) + RATIOS // 4, 0)
            ratio = np.clip(ratio, np.where(bigram > 0, 1, 0), RATIOS - 1).astype(np.int64)
            total[:] += np.bincount(magnitude(of_context[left] - 1) * RATIOS + ratio, weights=counts[left], minlength=len(total))
            return (file,)

        for _ in _merge(batches, build):
            pass
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bin", "n"])

    blocks = texts.mapInArrow(pairs_counted, "file int, block binary").repartitionById(pair_files, F.col("file")).sortWithinPartitions("file")
    histogram = scratch.keep(blocks.mapInArrow(pairs_written, "bin long, n double"), "pairs").groupBy("bin").agg(F.sum("n").alias("n"))
    total = np.zeros(MAGNITUDES * RATIOS)
    for row in histogram.collect():  # MAGNITUDES * RATIOS rows at most
        total[row["bin"]] = row["n"]
    model.shares = fitted_shares(total.reshape(MAGNITUDES, RATIOS))
    shares = np.array(model.shares)

    def codes_written(batches):
        for batch in batches:
            for file in batch.column("file").to_pylist():
                try:
                    counts, _ = _mapped(folder, f"counts-{file:06d}")
                except FileNotFoundError:
                    continue
                share = shares[np.minimum(magnitude(counts["context"]), MAGNITUDES - 1)]
                p = share * counts["pair"] / counts["context"] + (1 - share) * 10 ** model.unigram(counts["word"])
                codes = np.clip(np.round(-np.log10(p) * 65535 / LOWEST), 0, 65535).astype("<u2")
                _write(folder, f"codes-{file:06d}", {"codes": codes}, {})
                _remove(folder, f"counts-{file:06d}")
            yield pa.RecordBatch.from_arrays([batch.column("file")], ["file"])

    numbers = docs.sparkSession.range(pair_files).select(F.col("id").alias("file"))
    scratch.keep(numbers.repartition(min(pair_files, 4096)).mapInArrow(codes_written, "file long"), "codes")
    return model


def _remove(folder: str, name: str) -> None:
    """Remove a file that nothing reads any more; a task that is run again may find it gone."""
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(folder)
    try:
        system.delete_file(f"{root}/{name}")
    except FileNotFoundError:
        pass


def fitted_shares(histogram: np.ndarray, rounds: int = 200) -> list[float]:
    """l of each magnitude: the share of the bigram estimate that makes its histogram of likelihood ratios likeliest."""
    ratio = np.where(np.arange(RATIOS) > 0, 2.0 ** ((np.arange(RATIOS) - RATIOS // 4) / OCTAVE), 0.0)
    share = np.full(MAGNITUDES, 0.5)
    weight = histogram.sum(axis=1)
    for _ in range(rounds):
        gain = share[:, None] * ratio
        share = (histogram * gain / (gain + 1 - share[:, None])).sum(axis=1) / np.maximum(weight, 1e-9)
    share = np.clip(share, 1e-6, 1 - 1e-6)
    share[weight == 0] = 1e-6
    share[0] = 0.0
    return share.tolist()


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query = model.open()
        for batch, texts in slices(batches, "text"):
            hashes, first = token_hashes([as_bytes(t) for t in texts])
            counts, base, own = query.tokens(hashes, first)
            at = first[:-1]
            columns = [np.diff(first), np.add.reduceat((counts > 0).astype(np.int64), at), np.add.reduceat(base, at), np.add.reduceat(own, at)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, columns)], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def held_out(column: str = "doc_id") -> Column:
    """Whether a document is kept from training: crc32 of its doc_id as text leaves 1 over 5."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 5 == 1, F.lit(False))


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document, trained on those not held out."""
    folder = Scratch(docs.sparkSession, "lm-model").root
    model = train(docs.where(~held_out()), folder)
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
