"""Exact, fast encoding with the tokenizers library: each distinct chunk of text is encoded once in a worker.

A chunk is a stretch of text whose ends are boundaries of the tokenizer's own pre-tokens, so
that the ids of a text are the ids of its chunks in a row. Two kinds are known:

* byte-level BPE with its usual pattern: a chunk is a space and what follows up to the next
  space or line feed; runs of two and more white-space characters are taken apart as the pattern does;
* BPE that drops white space: chunks lie between ASCII white space.

Texts that hold a special token, and tokenizers of other kinds, are encoded whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np
import pyarrow.compute as pc

#: White space as the tokenizers' patterns have it (Unicode White_Space).
_WS = "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_RUN = re.compile(_WS + "{2}")
_RUNS = re.compile(f"({_WS}{{2,}})")
#: Chunks that an encoder holds, unless stated: some 200 bytes each, about 250 MB.
CACHE = 1_200_000
#: Letters below this one have the same properties in every Unicode version.
_OLD = "\u0250"


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE writes each byte as a letter: printable bytes as themselves, the rest from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = (b for b in range(256) if b not in plain)
    return {b: chr(0x100 + i) for i, b in enumerate(others)}


_LETTERS = _byte_letters()


class _Chunks(dict):
    """Packed ids by chunk key; what is missing is encoded on first use."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, key):
        self[key] = ids = self.encode(key)
        return ids


class ChunkEncoder:
    """Encodes lists of texts to packed ids (little-endian, 16 bits if the vocabulary allows, else 32).

    About cache_entries chunks are held; a full cache starts anew, which costs time and changes no result.
    """

    def __init__(self, path: str, cache_entries: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.dtype = np.dtype("<u2" if self.code == "H" else "<u4")
        self.special = [t["content"] for t in spec.get("added_tokens") or []]
        self.limit = cache_entries
        self.kind = self._kind(spec)
        self.chunks = _Chunks(self._spaced if self.kind == "spaced" else self._word)

    @staticmethod
    def _kind(spec: dict) -> str:
        before, normal = spec.get("pre_tokenizer") or {}, spec.get("normalizer") or {}
        if before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not normal:
            return "spaced"
        steps = before.get("pretokenizers") or [{}]
        forms = [n.get("type") for n in normal.get("normalizers") or []]
        if steps[0].get("type") == "Split" and steps[0].get("behavior") == "Removed" and steps[0].get("invert") and forms == ["NFC", "Replace", "Lowercase"]:
            return "words"
        return "whole"

    def _whole(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _letters(self, word: str, lead: str = "") -> bytes:
        """Ids of letters that are one pre-token, straight from the BPE model."""
        text = (lead + word).encode().decode("latin-1").translate(_LETTERS)
        return array(self.code, [t.id for t in self.model.tokenize(text)]).tobytes()

    def _spaced(self, key: str) -> bytes:
        """key: a chunk without the space before it; with a line feed in front, that and the chunk; with a NUL, the bare chunk."""
        first = key[:1]
        if first == "\n":
            return self._whole("\n") + (self._bare(key[1:]) if len(key) > 1 else b"")
        if first == "\0":
            return self._bare(key[1:])
        if key.isalpha() and max(key) < _OLD:
            return self._letters(key, " ")
        if len(key) > 1 and key[-1] in ".,;:?!" and key[:-1].isalpha():
            return self.chunks[key[:-1]] + self.chunks["\0" + key[-1]]
        return self._whole(" " + key)

    def _bare(self, chunk: str) -> bytes:
        return self._letters(chunk) if chunk.isalpha() and max(chunk) < _OLD else self._whole(chunk)

    def _word(self, key: bytes) -> bytes:
        word = key.decode()
        low = word.lower()
        if low.isalpha() and max(low) < _OLD:
            return self._letters(low)
        if len(low) > 1 and low[-1] in ".,;:?!" and low[:-1].isalpha() and max(low) < _OLD:
            return self.chunks[key[:-1]] + self.chunks[key[-1:]]
        return self._whole(word)

    def _keys(self, text: str) -> list | None:
        if self.kind == "whole" or any(s in text for s in self.special):
            return None
        if self.kind == "words":
            return text.encode().split()
        if "\0" in text:
            return None
        if not _RUN.search(text):
            return ("\0" + text.replace("\n", " \n")).split(" ")
        keys, lead, parts = [], "\0", _RUNS.split(text)
        for i, part in enumerate(parts):
            if i % 2 == 0:
                keys += (lead + part.replace("\n", " \n")).split(" ") if part else []
            elif i == len(parts) - 2 and not parts[-1]:
                keys.append("\0" + part)
            else:  # the pattern takes all but the last character, which leads what follows if it is a space
                keys.append("\0" + part[:-1])
                lead = "" if part[-1] == " " else "\0"
                keys += ["\0" + part[-1]] if lead else []
        return keys

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.chunks) > self.limit:
            self.chunks.clear()
        get = self.chunks.__getitem__
        return [self._whole(t) if (keys := self._keys(t)) is None else b"".join(map(get, keys)) for t in texts]


_encoders: dict[tuple, ChunkEncoder] = {}


def encoder(path: str, cache_entries: int = CACHE) -> ChunkEncoder:
    """The worker's encoder for a tokenizer file; it lives as long as the worker."""
    key = path, cache_entries
    if key not in _encoders:
        _encoders[key] = ChunkEncoder(path, cache_entries)
    return _encoders[key]


def slices(texts: list, chars: int = 1_000_000):
    """(from, to) ranges over a list of texts (or nulls) with about so many characters each, at least one text."""
    begin = size = 0
    for at, t in enumerate(texts):
        if size and size + len(t or "") > chars:
            yield begin, at
            begin, size = at, 0
        size += len(t or "") + 1
    if texts:
        yield begin, len(texts)


def sliced(column, chars: int = 1_000_000):
    """(from, to, texts) of the same ranges over an Arrow column of texts; only one range at a time becomes Python strings."""
    sizes = [range(n or 0) for n in pc.utf8_length(column).to_pylist()]
    for i, j in slices(sizes, chars):
        yield i, j, column.slice(i, j - i).to_pylist()
