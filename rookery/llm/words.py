"""Runs of bytes of one class, as Arrow dictionaries: tokens of whole batches of texts
without a Python object each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are tokenized together.
CHUNK = 8 << 20

BYTES = np.arange(256)
UPPER = (BYTES >= 0x41) & (BYTES <= 0x5A)
LETTER = UPPER | ((BYTES >= 0x61) & (BYTES <= 0x7A))
BEYOND = BYTES >= 0x80
LOWER = np.where(UPPER, BYTES + 32, BYTES).astype(np.uint8)
SAME = BYTES.astype(np.uint8)


def runs(texts: pa.Array, classes: np.ndarray, to: np.ndarray = SAME) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The longest runs of bytes of one class above 0 within each text, mapped by ``to``, in
    order, and how many each text has."""
    texts = texts.cast(pa.binary()).cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buf = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    of = classes.astype(np.uint8)[buf]
    inside = of > 0
    begins, ends = inside.copy(), inside.copy()
    change = of[1:] != of[:-1]
    begins[1:] &= change
    ends[:-1] &= change
    filled = offsets[:-1] < offsets[1:]
    first, last = offsets[:-1][filled], offsets[1:][filled] - 1
    begins[first], ends[last] = inside[first], inside[last]  # runs do not cross texts
    starts = np.flatnonzero(begins)
    run_offsets = np.append(0, np.cumsum(np.flatnonzero(ends) + 1 - starts))
    out = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(run_offsets), pa.py_buffer(to[buf[inside]])])
    return out.dictionary_encode(), np.diff(np.searchsorted(starts, offsets))


def chunks(batches: Iterator[pa.RecordBatch], size: int = CHUNK) -> Iterator[pa.Table]:
    """Rows of ``size`` bytes or little more."""
    held, held_bytes = [], 0
    for b in batches:
        held.append(b)
        held_bytes += b.nbytes
        if held_bytes >= size:
            yield pa.Table.from_batches(held)
            held, held_bytes = [], 0
    if held:
        yield pa.Table.from_batches(held)
