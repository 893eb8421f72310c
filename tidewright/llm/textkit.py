"""What the operators share: word splitting and 64-bit hashing of whole batches, slicing of Arrow batches by bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text handled at once by vectorised code; a longer single text is handled alone, whole.
SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 over an array of uint64: a bijection that spreads every bit."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit constants, the same in every process."""
    with np.errstate(over="ignore"):
        return mix64((np.arange(1, n + 1, dtype=U64) + U64(seed << 20)) * U64(_BASE)) | U64(1)


_BYTE = constants(256, 77)
_powers = [np.ones(1, dtype=U64), np.ones(1, dtype=U64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, _INVERSE)):
            table = np.full(size, base, dtype=U64)
            table[0] = 1
            _powers[k] = np.multiply.accumulate(table)
    return _powers[0], _powers[1]


class Words:
    """The words of some texts: runs of other bytes than those `between` marks (space and 09-0D), with A-Z lowered.

    `hashes` has one 64-bit hash a word, `first[d]:first[d + 1]` are those of text d; `starts` and `ends` are
    their places in `data`, the lowered bytes of all texts, each followed by one space.
    """

    def __init__(self, texts: list[bytes], between: np.ndarray = _SPACE):
        self.data = b" ".join([*texts, b""]).lower()
        raw = np.frombuffer(self.data, dtype=np.uint8)
        lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
        self.offsets = np.concatenate([[0], np.cumsum(lengths)])
        edge = np.diff(np.concatenate([[1], between[raw].astype(np.int8), [1]]))
        self.starts, self.ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        self.first = np.searchsorted(self.starts, self.offsets)
        forward, back = _power_tables(len(raw) + 1)
        total = np.zeros(len(raw) + 1, dtype=U64)
        with np.errstate(over="ignore"):
            np.cumsum(_BYTE[raw] * forward[: len(raw)], out=total[1:])
            self.hashes = mix64((total[self.ends] - total[self.starts]) * back[self.starts])
        self._total, self._back = total, back

    def __len__(self) -> int:
        return len(self.starts)

    def prefixes(self, n: int) -> np.ndarray:
        """The hash of each word's first n bytes; of a word that is no longer, its own."""
        stops = np.minimum(self.starts + n, self.ends)
        with np.errstate(over="ignore"):
            return mix64((self._total[stops] - self._total[self.starts]) * self._back[self.starts])


def as_bytes(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Cut Arrow batches into runs of rows whose `column` has about `limit` bytes; each with that column as a list."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(batch.schema.get_field_index(column))
        if pa.types.is_null(texts.type):
            sizes = np.zeros(batch.num_rows, dtype=np.int64)
        else:
            import pyarrow.compute as pc

            sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)
        at, total = 0, 0
        for i, size in enumerate(sizes):
            if total and total + size > limit:
                yield batch.slice(at, i - at), texts.slice(at, i - at).to_pylist()
                at, total = i, 0
            total += size + 1
        yield batch.slice(at), texts.slice(at).to_pylist()


def parted(ends: np.ndarray) -> np.ndarray:
    """The part that each item is in, from the items' running end offsets (first offset 0)."""
    return np.repeat(np.arange(len(ends) - 1), np.diff(ends))
