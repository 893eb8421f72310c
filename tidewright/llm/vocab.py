"""Public vocabularies on the executors, and the split of texts into units that are encoded alone.

A text is cut before each single space that a non-space follows. With the usual pattern of byte-level BPE (an optional
space belongs to the word after it, other white space never starts a word) a match never crosses such a place, so the ids
of a text are its units' ids in a row. Units repeat, so each is encoded once per process and remembered.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable

#: Units remembered in a process: in two generations, of which the older one goes when the younger one is full.
REMEMBERED = 800_000
#: Longer units are not remembered.
LONGEST = 64

_CUT = re.compile(r"(?= \S)")


def default_path(name: str) -> str:
    """Where the installed public vocabulary `name` is."""
    import public_tokenizers

    return public_tokenizers.path(name)


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file with a base64 token and its rank on each line."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


class UnitMemo:
    """Values of units (their ids as bytes, or how many there are) for whole texts.

    `encode` gives the values of a list of units; `combine` joins a text's values. Words of a text that single spaces part
    are looked up by the word; a text with other spacing after a space is cut with a pattern instead.
    """

    def __init__(self, encode: Callable[[list[str]], list], combine: Callable):
        self.encode, self.combine = encode, combine
        self.words: dict[str, object] = {}
        self.older: dict[str, object] = {}
        self.units: dict[str, object] = {}

    def __call__(self, texts: list[str]) -> list:
        if len(self.words) + len(self.units) > REMEMBERED // 2:
            self.older, self.words, self.units = self.words, {}, {}
        words, out = self.words, []
        parts = [t.split(" ") for t in texts]
        missing = {w for row in parts for w in row if w not in words}
        known = missing & self.older.keys()
        words.update((w, self.older[w]) for w in known)
        missing = [w for w in missing if w and w not in known and not w[0].isspace() and len(w) <= LONGEST]
        if missing:
            words.update(zip(missing, self.encode([" " + w for w in missing]), strict=True))
        get = words.get
        for text, row in zip(texts, parts, strict=True):
            try:  # a word that isn't there (spaces in a row, or too long to remember) is None, which combine can't take
                out.append(self.combine([self._unit(row[0]), *map(get, row[1:])]))
            except TypeError:
                out.append(self.combine([self._unit(u) for u in _CUT.split(text)]))
        return out

    def _unit(self, unit: str):
        value = self.units.get(unit)
        if value is None:
            value = self.encode([unit])[0]
            if len(unit) <= LONGEST:
                self.units[unit] = value
        return value
