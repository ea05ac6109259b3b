"""Tokenizing whole texts inside tasks with a public tokenizer file.

The tokenizer's pre-tokens never contain white space and its normaliser works character by character but for
canonical composition, which never crosses a space. So the ids of a text are the ids of its space-separated
parts, one after the other. Parts that come often are looked up. A part of Latin letters that is seen for the first time is
divided into pre-tokens here, which are looked up in turn, and a new pre-token goes to the tokenizer's model; any other
part goes to the tokenizer as a whole. The tests hold all this against the library on whole texts.
"""

from __future__ import annotations

import os
import re
import unicodedata

import numpy as np

_ENCODERS: dict[tuple[str, int], "PartEncoder"] = {}

#: Parts that are divided here: composed Latin text up to U+017F, without a special token's beginning. Lower case is the
#: same there character by character as for a whole string. White space is listed, for Python's own class has more.
_LATIN = {chr(c): unicodedata.category(chr(c))[0] for c in range(0x180)}
_LETTERS, _NUMBERS = ("".join(c for c in _LATIN if _LATIN[c] == kind) for kind in "LN")
_SPACE = "\t\n\v\f\r \x85\xa0"
_ODD = re.compile(r"[^\x00-\u017f]|<\|")
_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_SPACE}{_LETTERS}{_NUMBERS}]+")


def _byte_characters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself where printable, else the next from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(others)}


class PartEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit integers, with ``end_id`` appended.

    ``max_known`` bounds the entries of each of its three lookup tables in a Python worker, and ``longest`` their
    keys. Parts are learned until their table is full; pre-tokens that were not used lately are forgotten.
    """

    def __init__(self, path: str, end_id: int, max_known: int = 350_000, longest: int = 40):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.end = np.uint32(end_id).tobytes()
        self.max_known, self.longest = max_known, longest
        self.parts: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.byte_level = _byte_characters()
        self.divides = self._is_known_kind()

    def _is_known_kind(self) -> bool:
        """Whether the file has the pre-tokens and the normaliser that ``_encode_part`` knows."""
        import json

        spec = json.loads(self.tokenizer.to_str())
        steps = (spec.get("normalizer") or {}).get("normalizers", [])
        split = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0].get("pattern", {}).get("Regex", "")
        return [x["type"] for x in steps] == ["NFC", "Replace", "Lowercase"] and split == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def encode(self, text: str) -> bytes:
        known, new = self.parts.get, self._encode_part
        found = [new(x) if (ids := known(x)) is None else ids for x in text.replace("\n", " ").split(" ")]
        found.append(self.end)
        return b"".join(found)

    def _encode_part(self, part: str) -> bytes:
        if self.divides and part.isascii() and part.isalpha():
            ids = self._encode_word(part.lower())
        elif self.divides and not _ODD.search(part) and unicodedata.is_normalized("NFC", part):
            ids = b"".join([self._encode_word(w) for w in _WORDS.findall(part.lower())])
        else:
            ids = np.asarray(self.tokenizer.encode(part, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if len(self.parts) < self.max_known and len(part) <= self.longest:
            self.parts[part] = ids
        return ids

    def _encode_word(self, word: str) -> bytes:
        ids = self.words.get(word)
        if ids is None:
            ids = self.older.get(word)
            if ids is None:
                stood = word.encode("utf-8").decode("latin-1").translate(self.byte_level)
                ids = np.asarray([t.id for t in self.tokenizer.model.tokenize(stood)], dtype="<u4").tobytes()
            if len(word) <= self.longest:
                if len(self.words) >= self.max_known:
                    self.older, self.words = self.words, {}
                self.words[word] = ids
        return ids


def encoder(path: str, end_id: int) -> PartEncoder:
    """The worker's encoder for a tokenizer file, loaded once per Python process."""
    key = (path, end_id)
    if key not in _ENCODERS:
        _ENCODERS[key] = PartEncoder(path, end_id)
    return _ENCODERS[key]


def default_path() -> str:
    """The tokenizer file that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
