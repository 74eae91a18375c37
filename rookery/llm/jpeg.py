"""Progressive JPEG in numpy, many images at once.

Images of a batch are coded and decoded together. An entropy-coded segment ends at
each restart marker, and segments do not depend on each other, so decoding steps
through all of them in parallel, one Huffman symbol of each at a step; the state of a
segment is its bit position, block and coefficient. Spectral selection, successive
approximation (first and refinement scans, runs of ended bands), interleaved DC scans,
subsampled chroma and restart intervals are supported; arithmetic coding is not.
"""

from __future__ import annotations

import functools
import struct
from dataclasses import dataclass, field

import numpy as np

_U = np.uint64


def _zigzag() -> np.ndarray:
    """Natural order index of each zigzag position."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([r * 8 + c for r, c in cells])


ZIGZAG = _zigzag()
IDCT_BITS = 14


def _idct_matrix() -> np.ndarray:
    """64 x 64, zigzag coefficients to samples, in integers of IDCT_BITS fraction bits,
    so that sums in double precision are exact and do not depend on their order."""
    n = np.arange(8)
    c = np.cos((2 * n[None, :] + 1) * n[:, None] * np.pi / 16) * np.where(n[:, None] == 0, np.sqrt(1 / 8), 0.5)
    full = np.einsum("ux,vy->uvxy", c, c).reshape(64, 64)
    return np.round(full[ZIGZAG] * (1 << IDCT_BITS))


IDCT = _idct_matrix()


@dataclass(frozen=True)
class Huffman:
    """A table as the format stores it: symbols by code length."""

    counts: tuple[int, ...]
    symbols: tuple[int, ...]

    def codes(self) -> tuple[np.ndarray, np.ndarray]:
        """Code and its length by symbol (length 0: none)."""
        code, size, at, now = np.zeros(256, _U), np.zeros(256, np.int64), 0, 0
        for length, n in enumerate(self.counts, 1):
            for s in self.symbols[at : at + n]:
                code[s], size[s] = now, length
                now += 1
            at += n
            now <<= 1
        return code, size

    def lookup(self) -> tuple[np.ndarray, np.ndarray]:
        """Symbol and length by the next 16 bits."""
        symbol, size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        code, length = self.codes()
        for s in self.symbols:
            i = int(code[s]) << (16 - int(length[s]))
            j = i + (1 << (16 - int(length[s])))
            symbol[i:j], size[i:j] = s, length[s]
        return symbol, size

    @staticmethod
    def of(lengths: dict[int, int]) -> Huffman:
        order = sorted(lengths, key=lambda s: (lengths[s], s))
        counts = [0] * 16
        for s in order:
            counts[lengths[s] - 1] += 1
        return Huffman(tuple(counts), tuple(order))


_LOOKUPS: dict[Huffman, tuple[np.ndarray, np.ndarray]] = {}


def _lookup(h: Huffman):
    if h not in _LOOKUPS:
        if len(_LOOKUPS) > 64:
            _LOOKUPS.clear()
        _LOOKUPS[h] = h.lookup()
    return _LOOKUPS[h]


#: Tables of the encoder; short codes for small coefficients without zeros between.
DC_TABLE = Huffman.of({s: n for s, n in zip(range(12), (3, 2, 2, 2, 4, 5, 6, 7, 8, 9, 10, 11))})
AC_TABLE = Huffman.of(
    {s: n for s, n in zip(range(1, 11), (1, 2, 3, 4, 6, 7, 8, 14, 14, 14))}
    | {r << 4 | s: 13 if s <= 7 else 14 for r in range(1, 16) for s in range(1, 11)}
    | {0: 7, 0xF0: 10}
    | {r << 4: 12 for r in range(1, 15)}
)

#: The same for images whose bands have no zeros but at their ends: fewer symbols.
SHORT_TABLE = Huffman.of({s: n for s, n in zip(range(1, 9), (1, 2, 3, 5, 6, 7, 8, 9))} | {0: 5})


@dataclass(frozen=True)
class Part:
    """A component: sampling factors and its place among the frame's blocks."""

    h: int
    v: int
    quant: int


@dataclass
class Frame:
    """Geometry of an image: blocks of all components stand one behind the other."""

    width: int
    height: int
    parts: tuple[Part, ...]

    def __post_init__(self):
        self.hmax, self.vmax = max(p.h for p in self.parts), max(p.v for p in self.parts)
        self.mcus = (-(-self.height // (8 * self.vmax)), -(-self.width // (8 * self.hmax)))
        self.grid = [(self.mcus[0] * p.v, self.mcus[1] * p.h) for p in self.parts]
        sizes = [r * c for r, c in self.grid]
        self.base = [sum(sizes[:i]) for i in range(len(sizes))]
        self.blocks = sum(sizes)
        self._orders: dict[tuple[int, ...], tuple[np.ndarray, int, np.ndarray]] = {}

    def order(self, which: tuple[int, ...]) -> tuple[np.ndarray, int, np.ndarray]:
        """Blocks in a scan's order, how many make an MCU, and each one's component."""
        if which not in self._orders:
            order, each = self._order(which)
            self._orders[which] = order, each, np.searchsorted(self.base, order, side="right") - 1
        return self._orders[which]

    def _order(self, which: tuple[int, ...]) -> tuple[np.ndarray, int]:
        if len(which) == 1:
            p, (_, cols) = self.parts[which[0]], self.grid[which[0]]
            r = -(-(-(-self.height * p.v // self.vmax)) // 8)
            c = -(-(-(-self.width * p.h // self.hmax)) // 8)
            return (self.base[which[0]] + np.arange(r)[:, None] * cols + np.arange(c)).reshape(-1), 1
        each = []
        for i in which:
            p, (rows, cols) = self.parts[i], self.grid[i]
            ids = self.base[i] + np.arange(rows * cols).reshape(self.mcus[0], p.v, self.mcus[1], p.h)
            each.append(ids.transpose(0, 2, 1, 3).reshape(-1, p.v * p.h))
        out = np.concatenate(each, 1)
        return out.reshape(-1), out.shape[1]


@functools.lru_cache(512)
def frame(width: int, height: int, parts: tuple[Part, ...]) -> Frame:
    return Frame(width, height, parts)


@dataclass(frozen=True)
class Scan:
    parts: tuple[int, ...]
    first: int
    last: int
    high: int
    low: int


#: The encoder's script for three components.
SCRIPT = (
    Scan((0, 1, 2), 0, 0, 0, 1),
    Scan((0,), 1, 5, 0, 1),
    Scan((1,), 1, 63, 0, 1),
    Scan((2,), 1, 63, 0, 1),
    Scan((0,), 6, 63, 0, 1),
    Scan((0,), 1, 63, 1, 0),
    Scan((0, 1, 2), 0, 0, 1, 0),
    Scan((1,), 1, 63, 1, 0),
    Scan((2,), 1, 63, 1, 0),
)
RESTART = 8


_SIZES = np.array([n.bit_length() for n in range(1 << 12)])


def _size(a: np.ndarray) -> np.ndarray:
    """Bits of a magnitude."""
    return _SIZES[a]


def _packed(code: np.ndarray, size: np.ndarray, segment: np.ndarray, segments: int) -> list[bytes]:
    """Items of up to 56 bits as each segment's bytes, filled up with ones and stuffed."""
    bits = np.bincount(segment, size, segments).astype(np.int64)
    room = -(-bits // 8)
    pad = room * 8 - bits
    starts = np.concatenate(([0], np.cumsum(room)))
    within = np.cumsum(size) - size
    before = np.concatenate(([0], np.cumsum(bits)))[:-1]
    at = within - before[segment] + starts[:-1][segment] * 8
    fill = np.flatnonzero(pad)
    at = np.concatenate((at, starts[1:][fill] * 8 - pad[fill]))
    size = np.concatenate((size, pad[fill]))
    code = np.concatenate((code, (_U(1) << pad[fill].astype(_U)) - _U(1)))
    order = np.argsort(at, kind="stable")  # all but the fillings stand in order
    at, size, code = at[order], size[order], code[order]
    words = np.zeros(int(starts[-1]) // 8 + 2, _U)
    some = size > 0
    at, size, code = at[some], size[some], code[some]
    if len(at):
        word, shift = at >> 6, 64 - (at & 63) - size
        here = np.where(shift >= 0, code << np.maximum(shift, 0).astype(_U), code >> np.maximum(-shift, 0).astype(_U))
        new = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        words[word[new]] = np.bitwise_or.reduceat(here, new)
        over = np.flatnonzero(shift < 0)
        words[word[over] + 1] |= code[over] << (64 + shift[over]).astype(_U)
    data = words.astype(">u8").tobytes()
    return [data[i:j].replace(b"\xff", b"\xff\x00") for i, j in zip(starts[:-1].tolist(), starts[1:].tolist())]


def _packed_bits(bits: np.ndarray, each: np.ndarray) -> list[bytes]:
    """The same of single bits; ``each``: how many a segment has."""
    room = -(-each // 8)
    starts = np.concatenate(([0], np.cumsum(room)))
    out = np.ones(int(starts[-1]) * 8, np.uint8)
    shift = starts[:-1] * 8 - (np.cumsum(each) - each)
    if shift.any():
        out[np.repeat(shift, each) + np.arange(len(bits))] = bits
    else:
        out[: len(bits)] = bits
    data = np.packbits(out).tobytes()
    return [data[i:j].replace(b"\xff", b"\xff\x00") for i, j in zip(starts[:-1].tolist(), starts[1:].tolist())]


@functools.lru_cache(8)
def _literals(table: Huffman) -> tuple[np.ndarray, np.ndarray]:
    """Codes with their bits, and lengths, of the values from -511 to 511 without zeros before."""
    v = np.arange(-511, 512)
    code, length = table.codes()
    size = _size(np.abs(v))
    return code[size] << size.astype(_U) | _signed_bits(v, size), length[size] + size


def _joined(code: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Four items in a row (of at most 14 bits each) as one, row by row."""
    n, w = code.shape
    wide = -(-w // 4) * 4
    if wide > w:
        code = np.concatenate((code, np.zeros((n, wide - w), code.dtype)), 1)
        bits = np.concatenate((bits, np.zeros((n, wide - w), bits.dtype)), 1)
    out, total = code[:, 0::4].copy(), bits[:, 0::4].copy()
    for k in (1, 2, 3):
        out <<= bits[:, k::4].astype(_U)
        out |= code[:, k::4]
        total += bits[:, k::4]
    return out, total


def _signed_bits(v: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The format's bits of a value: itself, or its complement if negative."""
    return np.where(v >= 0, v, v + (1 << size) - 1).astype(_U)


def _encode_scan(c: np.ndarray, scan: Scan, segment: np.ndarray, part: np.ndarray, segments: int, table) -> list[bytes]:
    """``c``: the blocks in scan order; segment and component of each."""
    if scan.first == 0:
        if scan.high:
            return _packed_bits((c[:, 0] >> scan.low & 1).astype(np.uint8), np.bincount(segment, minlength=segments))
        v = c[:, 0] >> scan.low
        key = segment * 8 + part
        order = np.argsort(key, kind="stable")
        before = np.concatenate(([0], v[order][:-1]))
        before[np.concatenate(([True], np.diff(key[order]) != 0))] = 0
        diff = np.empty_like(v)
        diff[order] = v[order] - before
        size = _size(np.abs(diff))
        code, length = DC_TABLE.codes()
        return _packed(code[size] << size.astype(_U) | _signed_bits(diff, size), length[size] + size, segment, segments)
    code, length = table.codes()
    band = c[:, scan.first : scan.last + 1]
    n, w = band.shape
    whole = np.arange(w)
    if not scan.high:
        v = np.abs(band) >> scan.low
        np.negative(v, where=band < 0, out=v)
        used = v != 0
        filled = used[:, 0]
        some = np.flatnonzero(filled)
        if np.count_nonzero(used) == len(some) * w and used[some].all() and table is SHORT_TABLE:  # full blocks and empty ones
            literal, size = _literals(table)
            full = v[some] + 511
            out, bits = _joined(literal[full], size[full])
            if len(some) < n:
                grid, room = np.zeros((n, out.shape[1]), _U), np.zeros((n, out.shape[1]), np.int64)
                grid[some], room[some] = out, bits
                grid[~filled, 0], room[~filled, 0] = code[0], length[0]
                out, bits = grid, room
            return _packed(out.reshape(-1), bits.reshape(-1), np.repeat(segment, out.shape[1]), segments)
        last = np.maximum.accumulate(np.where(used, whole, -1), 1)
        before = np.concatenate((np.full((n, 1), -1), last[:, :-1]), 1)
        row, k = np.nonzero(used)
        v, run = v[row, k], k - before[row, k] - 1
        ends = np.flatnonzero(last[:, -1] < w - 1)
        size = _size(np.abs(v))
        symbol = (run & 15) << 4 | size
        out, bits = code[symbol] << size.astype(_U) | _signed_bits(v, size), length[symbol] + size
        for skip in (1, 2, 3):  # runs of 16 go before the symbol
            far = np.flatnonzero(run >= 16 * skip)
            out[far] |= code[0xF0] << bits[far].astype(_U)
            bits[far] += length[0xF0]
        key = np.concatenate((row * 64 + k, ends * 64 + 63))
        out = np.concatenate((out, np.full(len(ends), code[0])))
        bits = np.concatenate((bits, np.full(len(ends), length[0])))
        if len(ends):
            order = np.argsort(key, kind="stable")
            key, out, bits = key[order], out[order], bits[order]
        return _packed(out, bits, segment[key >> 6], segments)
    size = np.abs(band) >> scan.low
    filled = size[:, 0] > 1
    some = np.flatnonzero(filled)
    if np.count_nonzero(size) == len(some) * w and (size[some] > 1).all():  # each block ends its band, before bits or none
        end = [int(code[0]) >> i & 1 for i in range(int(length[0]) - 1, -1, -1)]
        bits = np.empty((n, w + len(end)), np.uint8)
        bits[:, : len(end)], bits[:, len(end) :] = end, size & 1
        each = np.bincount(segment, np.where(filled, w, 0) + len(end), segments).astype(np.int64)
        if len(some) < n:
            bits = bits[(np.arange(w + len(end)) < len(end)) | filled[:, None]]
        return _packed_bits(bits.reshape(-1), each)
    old, fresh = size > 1, size == 1
    seen = np.cumsum(fresh, 1) - fresh  # fresh ones before each
    row, k = np.nonzero(old)
    key = [(row * 65 + seen[row, k]) * 65 + 1 + k]
    out, bits = [(size[row, k] & 1).astype(_U)], [np.ones(len(row), np.int64)]
    fr, fk = np.nonzero(fresh)
    zeros = np.cumsum(size == 0, 1)
    if len(fr):
        at = zeros[fr, fk]
        start = np.where(np.concatenate(([True], fr[1:] != fr[:-1])), 0, np.concatenate(([0], at[:-1])))
        run = at - start
        if (run > 15).any():
            raise ValueError("the encoder writes no runs of 16 zeros in refinement scans")
        symbol = run << 4 | 1
        key.append((fr * 65 + seen[fr, fk]) * 65)
        out.append(code[symbol] << _U(1) | (band[fr, fk] > 0).astype(_U))
        bits.append(length[symbol] + 1)
    final = np.where(fresh.any(1), w - 1 - np.argmax(fresh[:, ::-1], 1), -1)
    ends = np.flatnonzero(final < w - 1)
    key.append((ends * 65 + fresh[ends].sum(1)) * 65)
    out.append(np.full(len(ends), code[0]))
    bits.append(np.full(len(ends), length[0]))
    key, out, bits = np.concatenate(key), np.concatenate(out), np.concatenate(bits)
    order = np.argsort(key, kind="stable")
    return _packed(out[order], bits[order], segment[key[order] // (65 * 65)], segments)


def _marker(code: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, code, len(body) + 2) + body


def encode(frames: list[Frame], coefficients: np.ndarray, comments: list[bytes]) -> list[bytes]:
    """Files of images with quantization by 1; ``coefficients``: all blocks, zigzag."""
    bases = np.concatenate(([0], np.cumsum([f.blocks for f in frames]))).tolist()
    quant = _marker(0xDB, b"\0" + b"\1" * 64)
    size = np.abs(coefficients[:, 1:])
    filled = size[:, 0] > 1
    short = size.max(initial=0) < 512 and (size[filled] > 1).all() and not size[~filled].any()
    ac = SHORT_TABLE if short else AC_TABLE
    tables = b"".join(
        _marker(0xC4, bytes([kind]) + bytes(t.counts) + bytes(t.symbols)) for kind, t in ((0, DC_TABLE), (0x10, ac))
    )
    restart = _marker(0xDD, struct.pack(">H", RESTART))
    parts = []
    for f, note in zip(frames, comments):
        head = struct.pack(">BHHB", 8, f.height, f.width, len(f.parts))
        head += b"".join(bytes([i + 1, p.h << 4 | p.v, p.quant]) for i, p in enumerate(f.parts))
        parts.append([b"\xff\xd8", _marker(0xFE, note), quant, _marker(0xC2, head), tables, restart])
    for scan in SCRIPT:
        orders, segment, kinds, counts, total = [], [], [], [], 0
        for f, base in zip(frames, bases):
            order, each, kind = f.order(scan.parts)
            orders.append(order + base)
            segment.append(np.arange(len(order)) // (RESTART * each) + total)
            counts.append(-(-len(order) // (RESTART * each)))
            total += counts[-1]
            kinds.append(kind)
        order = np.concatenate(orders)
        coded = _encode_scan(coefficients[order], scan, np.concatenate(segment), np.concatenate(kinds), sum(counts), ac)
        head = bytes([len(scan.parts)]) + b"".join(bytes([i + 1, 0]) for i in scan.parts)
        head = _marker(0xDA, head + bytes([scan.first, scan.last, scan.high << 4 | scan.low]))
        at = 0
        for out, n in zip(parts, counts):
            out.append(head)
            for i, data in enumerate(coded[at : at + n]):
                if i:
                    out.append(bytes([0xFF, 0xD0 + (i - 1) % 8]))
                out.append(data)
            at += n
    return [b"".join(p) + b"\xff\xd9" for p in parts]


@dataclass
class Parsed:
    frame: Frame | None = None
    comment: bytes = b""
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    scans: list[tuple[Scan, tuple, int, list[bytes]]] = field(default_factory=list)


def parse(data: bytes) -> Parsed:
    """Markers, tables and the unstuffed segments of each scan."""
    out, tables, restart, at = Parsed(), {}, 0, 2
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    ids: list[int] = []
    while at < len(data):
        code = data[at + 1]
        if code == 0xD9:
            break
        size = struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if code == 0xFE:
            out.comment = body
        elif code == 0xDB:
            i = 0
            while i < len(body):
                wide = body[i] >> 4
                raw = np.frombuffer(body, ">u2" if wide else "u1", 64, i + 1)
                out.quant[body[i] & 15] = raw.astype(np.int64)
                i += 1 + 64 * (1 + wide)
        elif code == 0xC4:
            i = 0
            while i < len(body):
                counts = tuple(body[i + 1 : i + 17])
                tables[body[i]] = Huffman(counts, tuple(body[i + 17 : i + 17 + sum(counts)]))
                i += 17 + sum(counts)
        elif code == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif code in (0xC0, 0xC1, 0xC2):
            _, height, width, n = struct.unpack_from(">BHHB", body)
            ids = [body[6 + 3 * i] for i in range(n)]
            out.frame = frame(width, height, tuple(Part(body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)))
        elif 0xC3 <= code <= 0xCF and code != 0xC8 and code != 0xCC:
            raise ValueError(f"JPEG process {code:#x} is not supported")
        elif code == 0xDA:
            n = body[0]
            which = tuple(ids.index(body[1 + 2 * i]) for i in range(n))
            first, last, approx = body[1 + 2 * n : 4 + 2 * n]
            scan = Scan(which, first, last, approx >> 4, approx & 15)
            used = tuple(
                tables.get(body[2 + 2 * i] >> 4) if not first else tables.get(0x10 | body[2 + 2 * i] & 15) for i in range(n)
            )
            segments, start = [], at
            while True:
                at = data.find(b"\xff", at)
                if at < 0:
                    raise ValueError("the file ends within a scan")
                nxt = data[at + 1]
                if nxt == 0:
                    at += 2
                    continue
                segments.append(data[start:at].replace(b"\xff\x00", b"\xff"))
                if 0xD0 <= nxt <= 0xD7:
                    start = at = at + 2
                    continue
                break
            out.scans.append((scan, used, restart, segments))
    return out


class _Bits:
    """Windows of the next bits at any place of concatenated segments."""

    def __init__(self, segments: list[bytes]):
        self.start = np.cumsum([0, *(len(s) for s in segments)])[:-1] * 8
        raw = np.frombuffer(b"".join(segments) + bytes(8), np.uint8)
        self.raw = raw
        wide = raw.astype(_U)
        n = len(raw) - 7
        self.words = np.zeros(n, _U)
        for i in range(6):
            self.words |= wide[i : n + i] << _U(40 - 8 * i)

    def at(self, p: np.ndarray) -> np.ndarray:
        """The 41 bits or more from bit p on, at the top of 48."""
        return self.words[p >> 3] << (p & 7).astype(_U) & _U((1 << 48) - 1)

    def single(self, p: np.ndarray) -> np.ndarray:
        return self.raw[p >> 3] >> (7 - (p & 7)).astype(np.uint8) & 1


def _take(window: np.ndarray, skip: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``size`` bits behind the first ``skip`` of a window."""
    out = window >> (48 - skip - size).astype(_U)
    return (out & ((_U(1) << size.astype(_U)) - _U(1))).astype(np.int64)


def _extended(v: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where((size > 0) & (v < 1 << np.maximum(size - 1, 0)), v - (1 << size) + 1, v)


def _decode_scan(c: np.ndarray, scan: Scan, tables, segments: list[bytes], order, part, first, count) -> None:
    """Accumulate a scan into ``c``. ``order``: blocks in scan order; ``part``: which
    of the scan's components each is; segments hold blocks first..first+count."""
    bits = _Bits(segments)
    low = scan.low
    if scan.first == 0 and scan.high:
        lane = np.repeat(np.arange(len(count)), count)
        p = bits.start[lane] + np.arange(len(order)) - first[lane]
        c[order, 0] |= bits.single(p).astype(np.int32) << low
        return
    p, now, end = bits.start.copy(), first.copy(), first + count
    looks = [_lookup(t) for t in tables]
    lanes = np.flatnonzero(now < end)
    if scan.first == 0:
        diff = np.zeros(len(order), np.int64)
        symbol = np.stack([x[0] for x in looks])
        length = np.stack([x[1] for x in looks])
        while len(lanes):
            i = now[lanes]
            window = bits.at(p[lanes])
            peek = (window >> _U(32)).astype(np.int64)
            t = part[i]
            size, skip = symbol[t, peek], length[t, peek]
            diff[i] = _extended(_take(window, skip, size), size)
            p[lanes] += skip + size
            now[lanes] += 1
            lanes = lanes[now[lanes] < end[lanes]]
        # predictions start anew in each segment
        lane = np.repeat(np.arange(len(count)), count)
        key = lane * len(tables) + part
        by = np.argsort(key, kind="stable")
        total = np.cumsum(diff[by])
        new = np.flatnonzero(np.concatenate(([True], np.diff(key[by]) != 0)))
        before = np.concatenate(([0], total))[new]
        total -= np.repeat(before, np.diff(np.append(new, len(by))))
        c[order[by], 0] = total << low
        return
    symbol, length = looks[0]
    ss, w = scan.first, scan.last - scan.first + 1
    cur, stop = now * w, end * w  # flat places: block in scan order, then coefficient
    p, cur, stop = p[lanes], cur[lanes], stop[lanes]
    if not scan.high:
        places, values = [], []
        while len(p):
            window = bits.at(p)
            peek = (window >> _U(32)).astype(np.int64)
            s, skip = symbol[peek], length[peek]
            run, size = s >> 4, s & 15
            ended = (size == 0) & (run < 15)
            more = np.where(ended, run, size)
            v = _take(window, skip, more)
            real = size > 0
            spot = cur + run
            places.append(spot[real])
            values.append(_extended(v, size)[real])
            p = p + skip + more
            cur = np.where(ended, (cur // w + (1 << np.where(ended, run, 0)) + v) * w, spot + 1)
            alive = cur < stop
            if not alive.all():
                p, cur, stop = p[alive], cur[alive], stop[alive]
        if places:
            at, v = np.concatenate(places), np.concatenate(values)
            c[order[at // w], ss + at % w] = v * (1 << low)
        return
    band = c[order, ss : scan.last + 1].reshape(-1)
    old = band != 0
    rank = np.concatenate(([0], np.cumsum(old)))
    zero = np.append(np.flatnonzero(~old), len(old))
    tasks, fresh = [], []
    while len(p):
        window = bits.at(p)
        peek = (window >> _U(32)).astype(np.int64)
        s, skip = symbol[peek], length[peek]
        run, size = s >> 4, s & 15
        ended = (size == 0) & (run < 15)
        more = np.where(ended, run, size)
        v = _take(window, skip, more)
        p = p + skip + more
        target = zero[np.minimum(cur - rank[cur] + run, len(zero) - 1)]
        until = np.where(ended, np.minimum((cur // w + (1 << np.where(ended, run, 0)) + v) * w, stop), target)
        tasks.append((cur, until, p))
        real = size > 0
        if real.any():
            fresh.append((target[real], np.where(v[real] > 0, 1, -1)))
        p = p + rank[until] - rank[cur]
        cur = np.where(ended, until, until + 1)
        alive = cur < stop
        p, cur, stop = p[alive], cur[alive], stop[alive]
    if tasks:
        begin, until, p = (np.concatenate(x) for x in zip(*tasks))
        n = rank[until] - rank[begin]
        held = np.flatnonzero(old)
        each = np.repeat(rank[begin] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        bit = bits.single(np.repeat(p - (np.cumsum(n) - n), n) + np.arange(int(n.sum())))
        at = held[each]
        band[at] += np.where(band[at] > 0, 1, -1) * (bit.astype(band.dtype) << low)
    for at, sign in fresh:
        band[at] = sign << low if low == 0 else sign * (1 << low)
    c[order, ss : scan.last + 1] = band.reshape(-1, w)


def decode(files: list[bytes]) -> tuple[list[Parsed], np.ndarray, list[int]]:
    """Headers, all images' coefficients (blocks, zigzag) and each image's first block."""
    images = [parse(f) for f in files]
    bases = np.concatenate(([0], np.cumsum([x.frame.blocks for x in images]))).tolist()
    c = np.zeros((bases[-1], 64), np.int32)
    for step in range(max((len(x.scans) for x in images), default=0)):
        groups: dict[tuple, list[int]] = {}
        for i, x in enumerate(images):
            if step < len(x.scans):
                scan, tables, _, _ = x.scans[step]
                groups.setdefault((scan, tables), []).append(i)
        for (scan, tables), members in groups.items():
            orders, parts, counts, segments = [], [], [], []
            for i in members:
                x = images[i]
                order, each, which = x.frame.order(scan.parts)
                _, _, restart, found = x.scans[step]
                n = restart * each or len(order)
                counts += [min(n, len(order) - k) for k in range(0, len(order), n)]
                segments += found
                lookup = np.zeros(len(x.frame.parts), np.int64)
                lookup[list(scan.parts)] = np.arange(len(scan.parts))
                parts.append(lookup[which])
                orders.append(order + bases[i])
            if len(counts) != len(segments):
                raise ValueError("restart markers are missing")
            count = np.array(counts)
            _decode_scan(c, scan, tables, segments, np.concatenate(orders), np.concatenate(parts), np.cumsum(count) - count, count)
    return images, c, bases


def samples(images: list[Parsed], c: np.ndarray, bases: list[int]) -> np.ndarray:
    """All blocks as 8-bit samples."""
    flat = c.astype(np.float64)
    for x, base in zip(images, bases):
        f = x.frame
        for p, at, (r, k) in zip(f.parts, f.base, f.grid):
            q = x.quant[p.quant]
            if (q != 1).any():
                flat[base + at : base + at + r * k] *= q
    out = flat @ IDCT
    out += 128.5 * (1 << IDCT_BITS)
    return np.clip(np.floor(out / (1 << IDCT_BITS)), 0, 255).astype(np.uint8)


def rgb(image: Parsed, blocks: np.ndarray) -> np.ndarray:
    """Full-resolution height x width x 3 tensor of one image's sample blocks."""
    f, planes = image.frame, []
    for p, at, (r, k) in zip(f.parts, f.base, f.grid):
        plane = blocks[at : at + r * k].reshape(r, k, 8, 8).transpose(0, 2, 1, 3).reshape(r * 8, k * 8)
        plane = plane.repeat(f.vmax // p.v, 0).repeat(f.hmax // p.h, 1)
        planes.append(plane[: f.height, : f.width].astype(np.int32))
    if len(planes) == 1:
        return np.repeat(planes[0][..., None], 3, 2).astype(np.uint8)
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    # 1.402, 0.344136, 0.714136 and 1.772 of the format's definition, in 16 fraction bits
    out = np.stack(
        (
            y + (91881 * cr + 32768 >> 16),
            y - (22554 * cb + 46802 * cr + 32768 >> 16),
            y + (116130 * cb + 32768 >> 16),
        ),
        2,
    )
    return np.clip(out, 0, 255).astype(np.uint8)
