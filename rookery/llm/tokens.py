"""Fast, exact tokenization by a public tokenizer file, one word at a time.

Both vocabularies used here cut a text at white space before they merge, so the
ids of a text are the ids of its white-space chunks in a row. Chunks repeat, so
a bounded cache answers most of them and the tokenizer sees only the others.
A text that holds a special token's string goes to the tokenizer whole.
"""

from __future__ import annotations

import os
import re
import struct

import numpy as np

#: Code points with the Unicode property White_Space (fixed values).
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

#: Latin words before a blank, common punctuation or the end: both vocabularies
#: cut behind such a word, whatever follows, so its punctuation is a chunk apart.
LETTERS = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+"
LATIN = f"{LETTERS}(?=[{SPACE}.,!?;:|)]|\\Z)"
LATIN_ONLY = f" ?{LETTERS}"

#: Chunks for a byte-level vocabulary: a blank belongs to the word behind it.
BYTE_LEVEL = f" ?{LATIN}| ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"

#: Chunks for a vocabulary that drops white space and case.
WORD_LEVEL = f"{LATIN}|[^{SPACE}]+"

CACHE_ENTRIES = 400_000


def _byte_letters() -> dict[int, int]:
    """The letters that byte-level vocabularies write for bytes, by code point:
    printable Latin-1 stands for itself, the other bytes follow from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (b for b in range(256) if b not in plain)
    return {b: b for b in plain} | {b: 256 + n for n, b in enumerate(rest)}


_LETTERS = _byte_letters()
_LATIN_WORD = re.compile(LATIN_ONLY).fullmatch


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_FORMATS = [struct.Struct(f"<{n}I") for n in range(64)]


class _Cache(dict):
    """Packed ids of chunks. Latin words, which nothing cuts or changes before the
    merges, go to the tokenizer's model at once; other chunks take the whole way."""

    def __init__(self, tok, lower: bool):
        self._tok, self._merge, self._lower = tok, tok.model.tokenize, lower

    def __missing__(self, chunk: str) -> bytes:
        if _LATIN_WORD(chunk) and not (self._lower and chunk != chunk.lower()):
            ids = [t.id for t in self._merge(chunk.encode().decode("latin-1").translate(_LETTERS))]
        else:
            ids = self._tok.encode(chunk, add_special_tokens=False).ids
        packed = self[chunk] = pack_ids(ids)
        return packed


def pack_ids(ids: list[int]) -> bytes:
    return _FORMATS[len(ids)].pack(*ids) if len(ids) < len(_FORMATS) else np.array(ids, "<u4").tobytes()


class ChunkEncoder:
    """Ids of texts as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, pattern: str, lower: bool, entries: int = CACHE_ENTRIES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tok = Tokenizer.from_file(path)
        self._special = tuple(t.content for t in self._tok.get_added_tokens_decoder().values())
        self._chunks = re.compile(pattern).findall
        self._entries = entries
        self._lower = lower
        self._cache = _Cache(self._tok, lower)

    def encode(self, text: str) -> bytes:
        for s in self._special:
            if s in text:
                return pack_ids(self._tok.encode(text, add_special_tokens=False).ids)
        if len(self._cache) > self._entries:
            self._cache.clear()
        # the tokenizer lowers letter by letter, Python writes a sigma by its place
        if self._lower and "\u03a3" not in text:
            text = text.lower()
        chunks = self._chunks(text)
        return b"".join(map(self._cache.__getitem__, chunks))

    def encode_many(self, texts: list[str]) -> list[bytes]:
        return [self.encode(t) for t in texts]


_ENCODERS: dict[tuple[str, str], ChunkEncoder] = {}


def encoder(path: str, pattern: str) -> ChunkEncoder:
    """One encoder per worker process and vocabulary."""
    key = (path, pattern)
    if key not in _ENCODERS:
        _ENCODERS[key] = ChunkEncoder(path, pattern, lower=pattern == WORD_LEVEL)
    return _ENCODERS[key]
