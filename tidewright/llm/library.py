"""Ids of units by the tokenizers library, and texts' ids from them."""

from __future__ import annotations

import json
import os
import struct

from tidewright.llm.vocab import UnitMemo


#: Matches without a space before them that are remembered.
MATCHES = 50_000


def _byte_alphabet() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte: the byte's own where it is printable, else the next from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class LibraryEncoder:
    """Encodes texts with the tokenizers library and a vocabulary file, without special tokens.

    For a byte-level BPE without normaliser, the library's merges run on each distinct unit of the texts once; for any other
    vocabulary, and for texts that hold the string of an added token, the library encodes the whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.added = [t["content"] for t in spec.get("added_tokens") or ()]
        before = spec.get("pre_tokenizer") or {}
        self.vocab_size = self.tokenizer.get_vocab_size()
        self.by_unit = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not spec.get("normalizer") and spec["model"]["type"] == "BPE"
        if self.by_unit:
            import public_tokenizers
            import regex

            self.pattern = regex.compile(public_tokenizers.PATTERN)
            self.alphabet, self.model = _byte_alphabet(), self.tokenizer.model
            self.memo = UnitMemo(self._units, b"".join)
            self.matches: dict[str, bytes] = {}

    def _match(self, match: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(match.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.alphabet))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _units(self, units: list[str]) -> list[bytes]:
        words, matches, out = self.memo.words, self.matches, []
        tokenize, space, pack = self.model.tokenize, self.alphabet[32], struct.pack
        for unit in units:
            if unit[:1] == " " and unit.isascii() and unit[1:].isalpha():
                ids = [t.id for t in tokenize(space + unit[1:])]
                out.append(pack(f"<{len(ids)}I", *ids))
                continue
            parts = []
            for m in self.pattern.findall(unit):
                found = words.get(m[1:]) if m[0] == " " else matches.get(m)  # a word is known by itself, without its space
                if found is None:
                    found = self._match(m)
                    if m[0] != " " and len(m) < 16:
                        if len(matches) > MATCHES:
                            matches.clear()
                        matches[m] = found
                parts.append(found)
            out.append(b"".join(parts))
        return out

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in found]

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        if not self.by_unit:
            return self._whole(texts)
        plain = [not any(a in t for a in self.added) for t in texts]
        out = iter(self.memo([t for t, p in zip(texts, plain, strict=True) if p]))
        return [next(out) if p else self._whole([t])[0] for t, p in zip(texts, plain, strict=True)]
