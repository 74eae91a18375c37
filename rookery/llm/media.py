"""Media columns: byte payloads as progressive JPEG files, and their RGB tensors.

A payload byte becomes one coefficient of an 8 x 8 block of a 4:2:0 colour image (the
format's unit; samples would not survive rounding), six blocks an MCU, quantized by
1. The common bytes of texts take the coefficients 2, -2, 3, -3 and so on, the others
follow in their order, up to 129, so frequent bytes get short codes, no coefficient of
a payload is 0 or 1 in size, and blocks behind the payload are all zero. A comment
marker holds the number of payload blocks. Reading accumulates the scans into
coefficient arrays, which give the payload back exactly, and inverse-transforms them
into full-resolution RGB tensors, of which the features are taken.

Null texts are empty; an empty text is one block of zero bytes. Rows that repeat a
doc_id each get a row. Very long texts make wider images: the format's greatest, of
4,095 x 4,095 MCUs, holds 6.4 GB, more than a value of Spark's can. Only doc_id and
text are read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rookery.llm import jpeg
from rookery.llm.common import settle, stash, table, text_of, tune

UNIT = 64
#: MCUs in a row of an image, unless it would be higher than the format allows, and
#: the format's most (of 16 samples, in 65,535).
ROW, MOST = 64, 4095
_PARTS = (jpeg.Part(2, 2, 0), jpeg.Part(1, 1, 0), jpeg.Part(1, 1, 0))

#: Bytes in the order of their coefficients' size; the others follow in byte order.
COMMON = b" enthairosd\xc3ulc.gb,fwy\xa9%&m*!\xb3E$zT\nvqp"


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    """Coefficient of each byte, and byte of each coefficient plus 256."""
    rank = [*COMMON, *(b for b in range(256) if b not in COMMON)]
    to, back = np.zeros(256, np.int32), np.zeros(512, np.uint8)
    for i, b in enumerate(rank):
        to[b] = (2 + i // 2) * (1 - 2 * (i % 2))
        back[to[b] + 256] = b
    return to, back


TO, BACK = _coefficients()

FILES = "doc_id long, n_bytes long, media binary"
FEATURES = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
    "media_bytes long, media_sha256 string, feature string"
)


def padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % UNIT or (UNIT if not data else 0))


_FRAMES: dict[int, jpeg.Frame] = {}


def frame_of(blocks: int) -> jpeg.Frame:
    """The image that holds so many blocks."""
    if blocks not in _FRAMES:
        mcus = -(-blocks // 6)
        cols = min(mcus, max(ROW, -(-mcus // MOST)))
        rows = -(-mcus // cols)
        if len(_FRAMES) > 4096:
            _FRAMES.clear()
        _FRAMES[blocks] = jpeg.frame(cols * 16, rows * 16, _PARTS)
    return _FRAMES[blocks]


def _mcu_order(f: jpeg.Frame) -> np.ndarray:
    return f.order((0, 1, 2))[0]


def encode(payloads: list[bytes]) -> list[bytes]:
    """Padded payloads as JPEG files."""
    frames = [frame_of(len(p) // UNIT) for p in payloads]
    bases = np.cumsum([0, *(f.blocks for f in frames)]).tolist()
    c = np.zeros((bases[-1], 64), np.int32)
    for p, f, base in zip(payloads, frames, bases):
        v = np.frombuffer(p, np.uint8).reshape(-1, 64)
        c[base + _mcu_order(f)[: len(v)]] = TO[v]
    return jpeg.encode(frames, c, [b"payload" + struct.pack(">Q", len(p) // UNIT) for p in payloads])


def decode(files: list[bytes]) -> tuple[list[bytes], list[np.ndarray]]:
    """Payloads and RGB tensors."""
    images, c, bases = jpeg.decode(files)
    blocks = jpeg.samples(images, c, bases)
    payloads, tensors = [], []
    for x, base in zip(images, bases):
        n = struct.unpack(">Q", x.comment[-8:])[0]
        v = c[base + _mcu_order(x.frame)[:n]]
        payloads.append(BACK[v + 256].tobytes())
        tensors.append(jpeg.rgb(x, blocks[base : base + x.frame.blocks]))
    return payloads, tensors


def feature(tensor: np.ndarray) -> str:
    """Size, channel means and a checksum of the tensor."""
    h, w, _ = tensor.shape
    r, g, b = (tensor.reshape(-1, 3).sum(0, dtype=np.int64) / (h * w)).tolist()
    return f"{w}x{h};{r:.4f};{g:.4f};{b:.4f};{zlib.crc32(np.ascontiguousarray(tensor)):08x}"


def _portions(column: list[bytes], limit: int = 1 << 21):
    i = size = 0
    for j, x in enumerate(column):
        size += len(x)
        if size >= limit:
            yield i, j + 1
            i, size = j + 1, 0
    if i < len(column):
        yield i, len(column)


def _store(batches):
    settle()
    for b in batches:
        ids, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
        for i, j in _portions(texts):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids[i:j], pa.int64()),
                    pa.array([len(t) for t in texts[i:j]], pa.int64()),
                    pa.array(encode([padded(t) for t in texts[i:j]]), pa.binary()),
                ],
                names=["doc_id", "n_bytes", "media"],
            )


def _read(batches):
    settle()
    for b in batches:
        ids, sizes, media = (b.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media"))
        for i, j in _portions(media):
            payloads, tensors = decode(media[i:j])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids[i:j], pa.int64()),
                    pa.array(sizes[i:j], pa.int64()),
                    pa.array([len(p) for p in payloads], pa.int64()),
                    pa.array([hashlib.sha256(p).hexdigest() for p in payloads]),
                    pa.array([zlib.crc32(p[-UNIT:]) for p in payloads], pa.int64()),
                    pa.array([len(m) for m in media[i:j]], pa.int64()),
                    pa.array([hashlib.sha256(m).hexdigest() for m in media[i:j]]),
                    pa.array([feature(t) for t in tensors]),
                ],
                names=[c.split()[0] for c in FEATURES.split(", ")],
            )


def _tensors(batches):
    settle()
    for b in batches:
        ids, media = b.column("doc_id").to_pylist(), b.column("media").to_pylist()
        for i, j in _portions(media, 1 << 18):
            _, tensors = decode(media[i:j])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids[i:j], pa.int64()),
                    pa.array([t.shape[0] for t in tensors], pa.int32()),
                    pa.array([t.shape[1] for t in tensors], pa.int32()),
                    pa.array([t.tobytes() for t in tensors], pa.binary()),
                ],
                names=["doc_id", "height", "width", "rgb"],
            )


def store(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, media``: every text as a JPEG file."""
    tune(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().cast("binary").alias("text"))
    return rows.mapInArrow(_store, FILES)


def tensors(media: DataFrame) -> DataFrame:
    """``doc_id, height, width, rgb`` of stored files, row-major 8-bit RGB."""
    return media.select("doc_id", "media").mapInArrow(_tensors, "doc_id long, height int, width int, rgb binary")


def features(media: DataFrame) -> DataFrame:
    """Digests of the payloads read back, of the files, and the tensors' features."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_read, FEATURES)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(stash(store(table(spark, sf_dir, "documents")), "media", compression="uncompressed"))
