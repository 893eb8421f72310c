"""Byte-level BPE by a monoid tree, and back.

The ids of a byte string are those of its halves, joined. By the pair rule of BPE, a row of tokens is what the merges make
of its bytes exactly when every two neighbours are what the merges make of theirs: merges inside a token run as they do
alone until one crosses a border, and the first that would cross it shows in the two tokens beside it. So a join encodes a
window of tokens around the seam anew, doubles it until both of its outer pairs hold, and keeps all tokens outside.
Decoding concatenates bytes up the same tree.

A null text is empty: no ids. Empty tables, repeated rows and other columns pass through unchanged.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidewright.llm.textkit import slices
from tidewright.llm.vocab import UnitMemo, default_path, read_ranks

#: Byte strings up to this long are leaves: merged directly.
LEAF = 4
#: Pairs of tokens, leaves and matches remembered in a process.
REMEMBERED = 200_000
#: Ids that one leaf of the decoding tree holds.
DECODE_LEAF = 4096


class Codec:
    """Encoder and decoder by the ranks of a vocabulary; `pattern` cuts texts into matches, each encoded separately."""

    def __init__(self, ranks: dict[bytes, int], pattern: str | None = None):
        import regex

        if pattern is None:
            import public_tokenizers

            pattern = public_tokenizers.PATTERN
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.pattern = regex.compile(pattern)
        self._pairs: dict[int, list[int] | None] = {}
        self._leaves: dict[bytes, list[int]] = {}
        self._matches: dict[str, list[int]] = {}

    def merged(self, data: bytes) -> list[int]:
        """Ids of a byte string by the merges themselves: always the lowest rank first, of equals the leftmost."""
        ranks = self.ranks
        if len(data) <= 64:
            parts = [data[i : i + 1] for i in range(len(data))]
            while len(parts) > 1:
                best, at = None, 0
                for i in range(len(parts) - 1):
                    rank = ranks.get(parts[i] + parts[i + 1])
                    if rank is not None and (best is None or rank < best):
                        best, at = rank, i
                if best is None:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            return [ranks[p] for p in parts]
        n = len(data)
        end = list(range(1, n + 1))  # of the part that starts here; 0 once it is merged away
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i]
            if not j or j >= n or end[j] != stop:
                continue
            end[i], end[j] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := ranks.get(data[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (p := before[i]) >= 0 and (r := ranks.get(data[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : end[i]]])
            i = end[i]
        return out

    def pair(self, a: int, b: int) -> list[int] | None:
        """What two tokens side by side become; None if they stay as they are."""
        key = a << 32 | b
        found = self._pairs.get(key, self)
        if found is self:
            found = self.merged(self.tokens[a] + self.tokens[b])
            if found == [a, b]:
                found = None
            if len(self._pairs) >= REMEMBERED:
                self._pairs.clear()
            self._pairs[key] = found
        return found

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Ids of the concatenation of what left and right encode."""
        if not left or not right:
            return left + right
        window, k = self.pair(left[-1], right[0]), 1
        if window is None:
            return left + right
        while True:
            i, j = max(len(left) - k, 0), min(k, len(right))
            if (i == 0 or self.pair(left[i - 1], window[0]) is None) and (j == len(right) or self.pair(window[-1], right[j]) is None):
                return left[:i] + window + right[j:]
            k *= 2
            window = self.merged(self.decode(left[-k:] + right[:k]))

    def tree(self, data: bytes) -> list[int]:
        """Ids of a byte string: those of its halves, joined."""
        if len(data) <= LEAF:
            found = self._leaves.get(data)
            if found is None:
                if len(self._leaves) >= REMEMBERED:
                    self._leaves.clear()
                found = self._leaves[data] = self.merged(data)
            return found
        half = len(data) >> 1
        return self.join(self.tree(data[:half]), self.tree(data[half:]))

    def match(self, text: str) -> list[int]:
        """Ids of one match of the pattern; a match that is a token is that token."""
        found = self._matches.get(text)
        if found is None:
            data = text.encode("utf-8", "surrogatepass")
            whole = self.ranks.get(data)
            found = self.tree(data) if whole is None else [whole]
            if len(text) <= 32:
                if len(self._matches) >= REMEMBERED:
                    self._matches.clear()
                self._matches[text] = found
        return found

    def encode(self, text: str) -> list[int]:
        """Ids of a text: of its matches in order."""
        found = self.pattern.findall(text)
        return self.match(found[0]) if len(found) == 1 else [i for m in found for i in self.match(m)]

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of ids, concatenated up the tree."""
        if len(ids) <= DECODE_LEAF:
            return b"".join(map(self.tokens.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])

    def encode_units(self, units: list[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        return [struct.pack(f"<{len(ids)}I", *ids) for ids in map(self.encode, units)]


def _codec(path: str) -> tuple[Codec, UnitMemo]:
    codec = Codec(read_ranks(path))
    return codec, UnitMemo(codec.encode_units, b"".join)


def encode(docs: DataFrame, path: str | None = None, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """docs with `ids_col`: array of the ids of `text_col`; a column of that name is replaced. No shuffle."""
    docs = docs.drop(ids_col)
    path = path or default_path("byte_bpe_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, memo = _codec(path)
        for batch, texts in slices(batches, text_col):
            found = [np.frombuffer(x, dtype="<u4").astype(np.int32) for x in memo([t or "" for t in texts])]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found) if found else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], [*batch.schema.names, ids_col])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType()))]))


def decode(table: DataFrame, path: str | None = None, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """table with `bytes_col`: the bytes that the ids of `ids_col` stand for; null ids decode to none."""
    table = table.drop(bytes_col)
    path = path or default_path("byte_bpe_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(read_ranks(path))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                ids = rows.column(rows.schema.get_field_index(ids_col)).to_pylist()
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([codec.decode(x or []) for x in ids], pa.binary())], [*rows.schema.names, bytes_col])

    return table.mapInArrow(run, T.StructType([*table.schema.fields, T.StructField(bytes_col, T.BinaryType())]))


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: both directions in one pass, so that neither ids nor bytes travel."""
    path = path or default_path("byte_bpe_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, memo = _codec(path)
        for batch, texts in slices(batches, "text"):
            found = memo([t or "" for t in texts])
            counts = [len(x) // 4 for x in found]
            backs = [codec.decode(np.frombuffer(x, dtype="<u4").tolist()) for x in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in found]), pa.array([hashlib.sha256(x).hexdigest() for x in backs])],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
