"""Ids of whole batches of texts for a byte-level vocabulary that cuts words from marks,
digits and white space before it merges.

A batch's bytes are cut, all at once, where such a vocabulary cuts for certain: between
ASCII letters, digits, marks and breaks, and before a blank beside a visible ASCII byte.
Other characters and apostrophes, which may join a word, are never parted from what
stands beside them. The pieces become an Arrow dictionary, and only different ones are
looked up: in a bounded cache, or by the tokenizer. Texts that hold a special token's
string go to the tokenizer whole, and so do all texts of a vocabulary that turns out to
cut otherwise.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from rookery.llm.tokens import _LATIN_WORD, _LETTERS, CACHE_ENTRIES, pack_ids
from rookery.llm.words import BYTES, LETTER

#: Letters, digits, marks, breaks; 0: what may belong to its neighbours.
CLASSES = np.zeros(256, np.uint8)
CLASSES[LETTER] = 1
CLASSES[0x30:0x3A] = 2
CLASSES[[b for b in range(0x21, 0x7F) if not (LETTER[b] or 0x30 <= b < 0x3A or b == 0x27)]] = 3
CLASSES[9:14] = 4
VISIBLE = (BYTES > 0x20) & (BYTES < 0x7F)
#: Bytes of texts that are cut together.
BATCH = 4 << 20


def cuts(buf: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where pieces begin, in texts that begin at ``starts``."""
    begins = np.zeros(len(buf), bool)
    if len(buf):
        kind = CLASSES[buf]
        begins[1:] = (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)
        shown, blank = VISIBLE[buf], buf == 0x20
        beside = np.zeros(len(buf), bool)
        beside[1:] = shown[:-1]
        beside[:-1] |= shown[1:]
        begins |= blank & beside
        # of several breaks before something visible the last one stands alone
        broken = np.flatnonzero((kind[:-1] == 4) & shown[1:])
        first = np.zeros(len(buf) + 1, bool)
        first[starts] = True
        inner = broken[~(first[broken] | first[broken + 1])]
        begins[inner[(blank | (kind == 4))[inner - 1]]] = True
        begins[inner[buf[inner - 1] >= 0x80] + 1] = False
        begins[inner[(buf[inner - 1] < 9) | ((buf[inner - 1] > 13) & (buf[inner - 1] < 32)) | (buf[inner - 1] == 127)] + 1] = False
        begins[starts[starts < len(buf)]] = True
    return np.flatnonzero(begins)


class ByteLevel:
    def __init__(self, path: str, entries: int = CACHE_ENTRIES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tok = Tokenizer.from_file(path)
        self._special = [t.content.encode() for t in self._tok.get_added_tokens_decoder().values()]
        self._entries, self._cache = entries, {}
        self._cuts = self._cuts_so()
        # whether the model itself takes Latin words as they are, letters standing for bytes
        self._direct = all(self._merged(w) == self._whole(w) for w in (b"Ab", b" Cde", " f\u00e9g\u00c0".encode()))

    def _whole(self, text: bytes) -> bytes:
        return pack_ids(self._tok.encode(text.decode(), add_special_tokens=False).ids)

    def _cuts_so(self) -> bool:
        """Whether the vocabulary cuts where pieces begin, tried on a text of all kinds."""
        probe = "Ab cd, ef's  gh!!\n \n\tIJ 12ék |  l\n\nM3  n x'y  z 7.5%\r\nq   ".encode()
        at = [*cuts(np.frombuffer(probe, np.uint8), np.zeros(1, np.int64)).tolist(), len(probe)]
        return self._whole(probe) == b"".join(self._whole(probe[i:j]) for i, j in zip(at, at[1:]))

    def _piece(self, piece: bytes) -> bytes:
        """Ids of a piece that the cache lacks. Latin words need no more cutting: the model
        gets them at once."""
        return self._merged(piece) if self._direct and _LATIN_WORD(piece.decode()) else self._whole(piece)

    def _merged(self, word: bytes) -> bytes:
        return pack_ids([t.id for t in self._tok.model.tokenize(word.decode("latin-1").translate(_LETTERS))])

    def _batch(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = cuts(buf, offsets[:-1])
        bounds = np.append(at, len(buf)).astype(np.int64)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(bounds), pa.py_buffer(buf)]).dictionary_encode()
        codes = pieces.indices.to_numpy(zero_copy_only=False)
        if len(self._cache) > self._entries:
            self._cache.clear()
        different = pieces.dictionary.to_numpy(zero_copy_only=False)
        packed = list(map(self._cache.get, different))
        for i, ids in enumerate(packed):
            if ids is None:
                packed[i] = self._cache[different[i]] = self._piece(different[i])
        size = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        pool = np.frombuffer(b"".join(packed), "<i4")
        first = np.cumsum(size) - size
        n = size[codes]
        ends = np.cumsum(n)
        ids = pool[np.repeat(first[codes] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        # ids of the pieces before each text
        before = np.append(0, ends)[np.searchsorted(at, offsets)]
        return ids, np.diff(before)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each text has."""
        texts = texts.cast(pa.binary()).cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        buf = np.frombuffer(data, np.uint8) if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
        all_ids, counts, i = [], [], 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + BATCH)))
            j = min(j, len(texts))
            part = np.ascontiguousarray(buf[offsets[i] : offsets[j]])
            raw = part.tobytes()
            if not self._cuts or any(s in raw for s in self._special):
                for k in range(i, j):
                    text = raw[offsets[k] - offsets[i] : offsets[k + 1] - offsets[i]]
                    if self._cuts and not any(s in text for s in self._special):
                        ids, n = self._batch(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
                    else:
                        ids = np.frombuffer(self._whole(text), "<i4")
                        n = [len(ids)]
                    all_ids.append(ids)
                    counts.extend(n)
            else:
                ids, n = self._batch(part, offsets[i : j + 1] - offsets[i])
                all_ids.append(ids)
                counts.extend(n.tolist())
            i = j
        return np.concatenate(all_ids) if all_ids else np.zeros(0, "<i4"), np.array(counts, np.int64)


_ENCODERS: dict[str, ByteLevel] = {}


def byte_level(path: str) -> ByteLevel:
    """One encoder per worker process and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ByteLevel(path)
    return _ENCODERS[path]
