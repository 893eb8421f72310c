r"""Token ids of documents in binary files: each document its own zstandard frame, under one shared dictionary.

A folder of files holds the documents in ascending doc_id order (null first; of equal doc_ids the smaller frame first):

    dictionary-<hash>.zdict    the dictionary, named by the first 16 hex digits of its sha256
    ids-<number>.tid           documents of a doc_id range, numbered in order

A .tid file, all numbers little-endian:

    magic "TWIDS01\n" | sha256 of the dictionary, 32 bytes | width of an id in bytes, u32
    the frames, one a document, in order
    doc_id of each, i64 | 1 for each null doc_id, u8 | where each frame begins and the last ends, u64 (documents + 1) | ids of each, u32
    where this index begins, u64 | documents, u32 | crc32 of the index, u32

So one document is read by its place in the index and one short frame, without what stands around it. Ids are written in
2 bytes if the vocabulary has at most 65,536 entries, else 4. A null text is empty and has the end id alone.

The dictionary is fitted on at most `sample_docs` documents, those with the smallest hash of doc_id, and at most
SAMPLE_BYTES of each; every document is written whole. Files are written through pyarrow's filesystems, under a name of the
attempt, then moved to their own: a task that is run again replaces its file.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidewright.llm.library import LibraryEncoder
from tidewright.llm.scratch import Scratch
from tidewright.llm.textkit import slices
from tidewright.llm.vocab import default_path

MAGIC = b"TWIDS01\n"
END_ID = 2
#: Documents a file, about.
FILE_DOCS = 8192
DICTIONARY_BYTES = 64 << 10
SAMPLE_BYTES = 8 << 10
LEVEL = 3
FOOTER = struct.Struct("<QII")


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _dictionary_name(digest: str) -> str:
    return f"dictionary-{digest[:16]}.zdict"


def _narrow(ids: bytes, width: int) -> bytes:
    return np.frombuffer(ids, dtype="<u4").astype(f"<u{width}").tobytes()


def train_dictionary(samples: list[bytes]) -> bytes:
    """A zstandard dictionary of serialized id arrays; the samples themselves where there are too few to train on."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[:DICTIONARY_BYTES]


def _shared(dictionary: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(dictionary) if dictionary else None


class _Writer:
    """One file under a name of its own until it is whole."""

    def __init__(self, system, root: str, number: int, head: bytes):
        self.system, self.root, self.number = system, root, number
        self.part = f"{root}/.ids-{number:08d}-{uuid.uuid4().hex}"
        self.out = system.open_output_stream(self.part)
        self.out.write(head)
        self.ids: list[int | None] = []
        self.counts: list[int] = []
        self.ends = [len(head)]

    def add(self, doc_id: int | None, count: int, frame: bytes) -> None:
        self.out.write(frame)
        self.ids.append(doc_id)
        self.counts.append(count)
        self.ends.append(self.ends[-1] + len(frame))

    def close(self) -> tuple:
        """The manifest's row."""
        real = [i for i in self.ids if i is not None]
        index = b"".join(
            (
                np.array([i or 0 for i in self.ids], dtype="<i8").tobytes(),
                bytes(i is None for i in self.ids),
                np.array(self.ends, dtype="<u8").tobytes(),
                np.array(self.counts, dtype="<u4").tobytes(),
            )
        )
        self.out.write(index + FOOTER.pack(self.ends[-1], len(self.ids), zlib.crc32(index)))
        size = self.out.tell()
        self.out.close()
        file = f"ids-{self.number:08d}.tid"
        self.system.move(self.part, f"{self.root}/{file}")
        return file, len(self.ids), sum(self.counts), size, min(real, default=None), max(real, default=None)


MANIFEST = {"file": pa.string(), "n_docs": pa.int64(), "n_ids": pa.int64(), "n_bytes": pa.int64(), "first_id": pa.int64(), "last_id": pa.int64()}


def write(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID, sample_docs: int = 1000, file_docs: int = FILE_DOCS) -> DataFrame:
    """Encode docs (doc_id, text) and write them to folder. The manifest: file, n_docs, n_ids, n_bytes, first_id, last_id, start."""
    path = path or default_path("byte_bpe_50k.json")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    files = max(1, -(-docs.count() // file_docs))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / files for i in range(1, files)], 100 * files)).first()[0] if files > 1 else []
    cuts = np.unique(np.array(cuts or [], dtype=np.int64))
    chosen = [r[0] for r in docs.where("doc_id is not null").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs).collect()]

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = LibraryEncoder(path)
        for _, texts in slices(batches, "text"):
            found = encode([(t or "")[: 4 * SAMPLE_BYTES] for t in texts])
            yield pa.RecordBatch.from_arrays([pa.array([x[: 2 * SAMPLE_BYTES] for x in found], pa.binary())], ["ids"])

    width = 2 if LibraryEncoder(path).vocab_size <= 1 << 16 else 4
    samples = docs.where(F.col("doc_id").isin(chosen)).select("text").mapInArrow(sampled, "ids binary").limit(2 * sample_docs).collect()
    dictionary = train_dictionary([_narrow(bytes(r[0]), width) for r in samples])
    digest = hashlib.sha256(dictionary)
    head = MAGIC + digest.digest() + struct.pack("<I", width)
    system, root = _filesystem(folder)
    system.create_dir(root, recursive=True)
    with system.open_output_stream(f"{root}/{_dictionary_name(digest.hexdigest())}") as out:
        out.write(dictionary)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        encode, end = LibraryEncoder(path), struct.pack("<I", end_id)
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=_shared(dictionary))
        for batch, texts in slices(batches, "text"):
            ids = [x + end for x in encode([t or "" for t in texts])]
            doc = batch.column("doc_id")
            places = np.searchsorted(cuts, np.asarray(doc.fill_null(-(2**63))), side="right").astype(np.int32)
            frames = [packer.compress(_narrow(x, width)) for x in ids]
            yield pa.RecordBatch.from_arrays([pa.array(places), doc, pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(frames, pa.binary())], ["place", "doc_id", "n", "frame"])

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _filesystem(folder)
        writer, found = None, []
        for batch in batches:
            for place, *document in zip(*(batch.column(c).to_pylist() for c in ("place", "doc_id", "n", "frame")), strict=True):
                if writer is None or place != writer.number:
                    if writer:
                        found.append(writer.close())
                    writer = _Writer(system, root, place, head)
                writer.add(*document)
        if writer:
            found.append(writer.close())
        columns = list(zip(*found, strict=True)) or [()] * len(MANIFEST)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, MANIFEST.values(), strict=True)], list(MANIFEST))

    placed = docs.mapInArrow(encoded, "place int, doc_id long, n long, frame binary").repartitionById(len(cuts) + 1, F.col("place"))
    ordered = placed.sortWithinPartitions("place", F.col("doc_id").asc_nulls_first(), "n", "frame")
    manifest = ordered.mapInArrow(written, "file string, n_docs long, n_ids long, n_bytes long, first_id long, last_id long")
    manifest = Scratch(docs.sparkSession, "ids").keep(manifest, "manifest")
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))


class Reader:
    """One file: its index, and any document's ids on demand."""

    def __init__(self, folder: str, file: str):
        import zstandard

        system, root = _filesystem(folder)
        self.source = system.open_input_file(f"{root}/{file}")
        size = self.source.size()
        head = self.source.read_at(len(MAGIC) + 36, 0)
        if head[: len(MAGIC)] != MAGIC:
            raise ValueError(f"{file} is not a file of ids")
        self.width = struct.unpack("<I", head[-4:])[0]
        begin, n, crc = FOOTER.unpack(self.source.read_at(FOOTER.size, size - FOOTER.size))
        index = self.source.read_at(size - FOOTER.size - begin, begin)
        if zlib.crc32(index) != crc:
            raise ValueError(f"the index of {file} is damaged")
        self.doc_ids = np.frombuffer(index, "<i8", n)
        self.nulls = np.frombuffer(index, np.uint8, n, 8 * n).astype(bool)
        self.ends = np.frombuffer(index, "<u8", n + 1, 9 * n)
        self.counts = np.frombuffer(index, "<u4", n, 9 * n + 8 * (n + 1))
        digest = head[len(MAGIC) : -4]
        with system.open_input_stream(f"{root}/{_dictionary_name(digest.hex())}") as source:
            dictionary = source.read()
        if hashlib.sha256(dictionary).digest() != digest:
            raise ValueError(f"the dictionary of {file} is another")
        self.unpacker = zstandard.ZstdDecompressor(dict_data=_shared(dictionary))

    def frame_ids(self, frame: bytes, i: int) -> np.ndarray:
        ids = np.frombuffer(self.unpacker.decompress(frame), dtype=f"<u{self.width}").astype("<u4")
        if len(ids) != self.counts[i]:
            raise ValueError(f"document {i} has {len(ids)} ids; its index says {self.counts[i]}")
        return ids

    def ids(self, i: int) -> np.ndarray:
        """Ids of the i-th document, by one read of its frame."""
        at = int(self.ends[i])
        return self.frame_ids(self.source.read_at(int(self.ends[i + 1]) - at, at), i)

    def runs(self, limit: int = 1 << 20) -> Iterator[tuple[int, list[np.ndarray]]]:
        """All documents in order, read by about `limit` bytes at once: the first one's place, and their ids."""
        i = 0
        while i < len(self.counts):
            at = int(self.ends[i])
            j = max(i + 1, int(np.searchsorted(self.ends, at + limit, side="right")) - 1)
            block = self.source.read_at(int(self.ends[j]) - at, at)
            yield i, [self.frame_ids(block[int(self.ends[k]) - at : int(self.ends[k + 1]) - at], k) for k in range(i, j)]
            i = j


def document(manifest: DataFrame, folder: str, doc_id: int) -> list[np.ndarray]:
    """Ids of every document of that doc_id: from the manifest's files whose range holds it, one frame each."""
    out = []
    for row in manifest.where((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id)).select("file").collect():
        reader = Reader(folder, row["file"])
        out += [reader.ids(int(i)) for i in np.flatnonzero((reader.doc_ids == doc_id) & ~reader.nulls)]
    return out


def read(manifest: DataFrame, folder: str, per_document=lambda ids: ids.astype(np.int64).tolist(), kind: str = "array<long>", column: str = "ids") -> DataFrame:
    """doc_id, start, n_tokens and per_document(ids) as `column`, of every document of the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                reader = Reader(folder, file)
                starts = start + np.concatenate([[0], np.cumsum(reader.counts, dtype=np.int64)])
                for i, ids in reader.runs():
                    j = i + len(ids)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(reader.doc_ids[i:j], mask=reader.nulls[i:j]), pa.array(starts[i:j]), pa.array(reader.counts[i:j].astype(np.int64)), pa.array([per_document(x) for x in ids])],
                        ["doc_id", "start", "n_tokens", column],
                    )

    files = manifest.count()
    spread = manifest.repartition(max(1, files), "file").select("file", "start")
    return spread.mapInArrow(run, f"doc_id long, start long, n_tokens long, {column} {kind}")
