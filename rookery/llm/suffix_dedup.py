"""Removal of repeated byte strings by a distributed, sparse suffix array.

A byte goes if it lies in a string of ``length`` bytes that also starts earlier, in
a document before or in the same one. The steps:

1. *Anchors.* Within every window of ``length`` bytes one position is chosen, the
   leftmost of least hash among its 32-byte strings. The choice depends on the
   window's bytes alone, so equal windows choose equal positions, and windows that
   choose the same one are neighbours: an anchor stands for the windows lo..hi.
   Only the suffixes at anchors, about 3 in 100, are sorted.
2. *Runs.* A task sorts the suffixes of some megabytes of text by their first 32
   bytes and then a fingerprint of all that the anchor's windows cover. Suffixes
   equal in both are a class; all but a run's first are repeats and stay behind.
   The others leave as a front-coded run, cut at splitters drawn from the anchors of
   sampled slices of text (the sample decides the balance of the tasks, nothing else).
3. *Merge.* Each range merges its runs with a loser tree that keeps, with every
   loser, how many bytes it shares with the winner that beat it. Different counts
   decide a match without a look at the strings; equal ones compare from there on.
   The common prefixes that come out are the suffix array's: 40 bytes in common, and
   all but the earliest document's entry are repeats; 32 or more, and the windows of
   the first entries of each class are compared one by one.
4. *Edges.* Those few windows meet by 80 bits of two independent hashes, each with its
   earliest place in each task.

A class sends at most one entry per run and the merge streams, so a passage that a
third of all documents hold neither fills a task nor makes pairs.

Null texts are empty. Documents are ordered by doc_id (null first), then by a hash
of the text; rows equal in both are one document, and each gets its result. Texts
shorter than ``length`` lose nothing. Only doc_id and text are read; other columns may
have any names. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructType

from rookery.llm.common import settle, stash, table, text_of, tune

LENGTH = 100
PREFIX = 32
WIDTH = PREFIX + 8
#: Text that one sorted run covers.
RUN_BYTES = 12 << 20
#: Text per range of the merge.
RANGE_BYTES = 12 << 20
#: Ranges at most, whose splitters all tasks hold; beyond that ranges grow.
MOST_RANGES = 1 << 18
#: Suffixes drawn for a range (and for all of them at least), about; of a slice of so
#: many bytes one in so many is drawn.
DRAWN, LEAST_DRAWN = 20, 4000
SLICE, ONE_IN = 4096, 8
#: Bytes hashed at once, to stay in the processor's cache.
BLOCK = 1 << 18

_ODD = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(32))
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(29)
    x *= _U(0xA0761D6478BD642F)
    x ^= x >> _U(32)
    return x


class _Hasher:
    """Polynomial hashes of all strings of 32 and of ``length`` bytes, by doubling."""

    def __init__(self, odd: int, length: int):
        self.length = length
        rng = np.random.default_rng(odd & 0xFFFFFFFF)
        self.bytes = rng.integers(1, 1 << 63, 256, dtype=np.int64).astype(_U)
        self.power = lambda n: _U(pow(odd, n, 1 << 64))

    def __call__(self, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        by, n = {1: self.bytes[buf]}, 1
        while n * 2 <= self.length:
            h = by[n]
            by[n * 2] = h[:-n] * self.power(n) + h[n:]
            n *= 2
        out, have = by[n], n
        while have < self.length:
            step = n
            while step > self.length - have:
                step //= 2
            h = by[step]
            k = len(out) - step
            out = out[:k] * self.power(step) + h[have : have + k]
            have += step
        return by[PREFIX], out


def window_hashes(buf: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of every window of ``length`` bytes."""
    return tuple(_mix(_Hasher(odd, length)(buf)[1]) for odd in _ODD)


def anchors(buf: np.ndarray, ends: np.ndarray, length: int = LENGTH):
    """Anchors of documents that stand one behind the other in ``buf``.

    ``ends`` are the documents' ends. Returns arrays ``a, lo, hi, print``: the
    anchor, its first and last window's start, and the fingerprint of its windows.
    """
    w = length - PREFIX + 1
    hasher = _Hasher(_ODD[0], length)
    found = []
    for at in range(0, max(0, len(buf) - length + 1), BLOCK):
        part = buf[at : at + BLOCK + length - 1]
        short, full = hasher(part)
        best = _mix(short)
        i, step = np.arange(len(best), dtype=np.int32), 1
        while step * 2 <= w:
            i = np.where(best[step:] < best[:-step], i[step:], i[:-step])
            best = np.minimum(best[:-step], best[step:])
            step *= 2
        if step < w:
            d = w - step
            i = np.where(best[d:] < best[:-d], i[d:], i[:-d])
        n = len(part) - length + 1
        i, ok = i[:n], np.ones(n, bool)
        # windows that cross a document's end are none
        for e in ends[np.searchsorted(ends, at, "right") : np.searchsorted(ends, at + len(part), "left")].tolist():
            ok[max(0, e - at - length + 1) : max(0, e - at)] = False
        p = np.flatnonzero(ok)
        if not len(p):
            continue
        c = i[p]
        first = np.flatnonzero(np.concatenate(([True], (c[1:] != c[:-1]) | (p[1:] != p[:-1] + 1))))
        last = p[np.append(first[1:], len(p)) - 1]
        first = p[first]
        found.append((i[first].astype(np.int64) + at, first + at, last + at, full[first], full[last]))
    if not found:
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(_U)
    a, lo, hi, left, right = (np.concatenate(x) for x in zip(*found))
    # an anchor whose windows two blocks share comes twice
    new = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (lo[1:] != hi[:-1] + 1))))
    final = np.append(new[1:], len(a)) - 1
    a, lo, hi, left, right = a[new], lo[new], hi[final], left[new], right[final]
    shape = ((a - lo) * length + (hi - lo)).astype(_U)
    return a, lo, hi, _mix(_mix(left + shape) * _U(3) + right)


def _rows(batches) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Keys, bytes and ends of the documents of one run after another, in order."""
    keys, texts, size = [], [], 0
    for b in batches:
        for k, h, t in zip(*(b.column(c).to_pylist() for c in ("k", "h", "text"))):
            keys.append((k, h))
            texts.append(t)
            size += len(t)
            if size >= RUN_BYTES:
                yield _joined(keys, texts)
                keys, texts, size = [], [], 0
    if keys:
        yield _joined(keys, texts)


def _joined(keys, texts):
    order = sorted(range(len(keys)), key=keys.__getitem__)
    order = [i for n, i in enumerate(order) if not n or keys[order[n - 1]] != keys[i]]
    ends = np.cumsum([len(texts[i]) for i in order])
    return [keys[i] for i in order], np.frombuffer(b"".join(texts[i] for i in order), np.uint8), ends


def _strings(buf: np.ndarray, a: np.ndarray, prints: np.ndarray) -> np.ndarray:
    out = np.empty((len(a), WIDTH), np.uint8)
    windows = np.lib.stride_tricks.sliding_window_view(buf, PREFIX)
    out[:, :PREFIX] = windows[a]
    out[:, PREFIX:] = prints.astype(">u8").view(np.uint8).reshape(-1, 8)
    return out


def sorted_run(keys, buf, ends, length: int = LENGTH):
    """A run and the repeats that it could settle by itself.

    The run: strings in order with the bytes each shares with the one before, the
    document's number, and the anchor's first and last window in the document.
    Repeats: document numbers and the byte spans of their windows.
    """
    a, lo, hi, prints = anchors(buf, ends, length)
    if not len(a):
        return None, None
    doc = np.searchsorted(ends, lo, side="right")
    start = np.concatenate(([0], ends))[doc]
    strings = _strings(buf, a, prints)
    words = strings.view(">u8").astype(_U)
    order = np.lexsort((lo, *(words[:, c] for c in range(WIDTH // 8 - 1, -1, -1))))
    words = words[order]
    same = np.concatenate(([False], (words[1:] == words[:-1]).all(1)))
    rest, order = order[same], order[~same]
    strings = strings[order]
    differ = strings[1:] != strings[:-1]
    shared = np.concatenate(([0], differ.argmax(1))).astype(np.uint8)
    run = (strings, shared, doc[order], (lo - start)[order], (hi - start)[order])
    rest.sort()
    return run, (doc[rest], (lo - start)[rest], (hi - start)[rest] + length)


def merged_spans(doc: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Overlapping or touching spans of a document as one; input ordered by both."""
    if not len(doc):
        return doc, start, end
    reach = np.maximum.accumulate(end + doc * (1 << 40)) - doc * (1 << 40)
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (start[1:] > reach[:-1])))
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(doc)])) - 1
    return doc[first], start[first], reach[last]


_BLOB = ("shared", "tails", "doc", "lo", "span", "keys")


def _pack(arrays: list[np.ndarray]) -> bytes:
    import zstandard

    parts = [x.tobytes() for x in arrays]
    head = np.array([len(parts), *map(len, parts)], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(parts))


def _unpack(blob: bytes) -> list[bytes]:
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(data, "<i8", 1)[0])
    sizes = np.frombuffer(data, "<i8", n, 8).tolist()
    out, at = [], 8 * (n + 1)
    for s in sizes:
        out.append(data[at : at + s])
        at += s
    return out


def front_coded(run, i: int, j: int, keys: np.ndarray) -> bytes:
    """Entries i to j of a run: shared lengths and the bytes behind them."""
    strings, shared, doc, lo, hi = (x[i:j] for x in run)
    shared = shared.copy()
    shared[0] = 0
    tails = strings[np.arange(WIDTH) >= shared[:, None]]
    docs, number = np.unique(doc, return_inverse=True)
    return _pack(
        [
            shared,
            tails,
            number.astype("<u4"),
            lo.astype("<u4"),
            (hi - lo).astype(np.uint8),
            keys[docs].astype("<i8"),
        ]
    )


def decoded(blob: bytes):
    """``strings, shared, keys of the documents, lo, hi`` of a front-coded run."""
    shared, tails, number, lo, span, keys = _unpack(blob)
    shared = np.frombuffer(shared, np.uint8)
    n = len(shared)
    out, own = np.zeros((n, WIDTH), np.uint8), np.arange(WIDTH) >= shared[:, None]
    out[own] = np.frombuffer(tails, np.uint8)
    rows = np.arange(n, dtype=np.int32)
    for c in range(WIDTH):
        out[:, c] = out[np.maximum.accumulate(np.where(own[:, c], rows, 0)), c]
    lo = np.frombuffer(lo, "<u4").astype(np.int64)
    keys = np.frombuffer(keys, "<i8").reshape(-1, 2)[np.frombuffer(number, "<u4")]
    return out.tobytes(), shared.tolist(), keys, lo, lo + np.frombuffer(span, np.uint8)


def merge(runs: list[tuple[bytes, list[int]]]) -> Iterator[tuple[int, int, int]]:
    """``(bytes shared with the one before, run, index)`` in order.

    A loser tree. ``shared[r]`` is what the head of run r has in common with the last
    winner that it met; a head that shares more is the smaller one, and only heads
    that share equally much are compared, from there on.
    """
    count = len(runs)
    size = 1
    while size < count:
        size *= 2
    at, shared = [0] * size, [-1] * size
    head: list[bytes] = [b""] * size
    lens = [len(s) for _, s in runs] + [0] * (size - count)
    for r, (data, _) in enumerate(runs):
        if lens[r]:
            head[r], shared[r] = data[:WIDTH], 0
    tree = [0] * size

    def play(x: int, y: int) -> tuple[int, int]:
        """Winner and loser."""
        hx, hy = shared[x], shared[y]
        if hx != hy:
            return (x, y) if hx > hy else (y, x)
        if hx < 0:
            return (x, y) if x < y else (y, x)
        a, b, i = head[x], head[y], hx
        if a[i:] == b[i:]:
            if x < y:
                shared[y] = WIDTH
                return x, y
            shared[x] = WIDTH
            return y, x
        while a[i] == b[i]:
            i += 1
        if a[i] < b[i]:
            shared[y] = i
            return x, y
        shared[x] = i
        return y, x

    winners = list(range(size))
    nodes = size
    while nodes > 1:
        up = []
        for k in range(nodes // 2):
            w, tree[nodes // 2 + k] = play(winners[2 * k], winners[2 * k + 1])
            up.append(w)
        winners, nodes = up, nodes // 2
    w = winners[0]
    while shared[w] >= 0:
        i = at[w]
        yield shared[w], w, i
        i += 1
        at[w] = i
        if i < lens[w]:
            data, lcps = runs[w]
            head[w], shared[w] = data[i * WIDTH : (i + 1) * WIDTH], lcps[i]
        else:
            shared[w] = -1
        node = (w + size) >> 1
        hw = shared[w]
        while node:
            o = tree[node]
            ho = shared[o]
            if ho > hw:
                tree[node], w, hw = w, o, ho
            elif ho == hw:
                w, tree[node] = play(w, o)
                hw = shared[w]
            node >>= 1


def _of(key: np.ndarray, ranges: int) -> int:
    """A range for what is settled already: any will do, so a document's hash picks one."""
    return int(key[1]) % ranges


def _map(splitters: list[bytes], length: int):
    def run(batches):
        settle()
        from bisect import bisect_left

        for keys, buf, ends in _rows(batches):
            found, rest = sorted_run(keys, buf, ends, length)
            if found is None:
                continue
            table_ = np.array(keys, np.int64).reshape(-1, 2)
            data = found[0].tobytes()
            heads = [data[i * WIDTH : (i + 1) * WIDTH] for i in range(len(found[0]))]
            cuts = [0, *(bisect_left(heads, s) for s in splitters), len(heads)]
            del heads, data
            ids, blobs = [], []
            for r, (i, j) in enumerate(zip(cuts, cuts[1:])):
                if i < j:
                    ids.append(r)
                    blobs.append(front_coded(found, i, j, table_))
            doc, start, end = merged_spans(*rest)
            if len(doc):
                ids.append(_of(table_[doc[0]], len(splitters) + 1))
                blobs.append(b"=" + _pack([table_[doc].astype("<i8"), start.astype("<i8"), end.astype("<i8")]))
            for i in range(0, len(ids), 16):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[i : i + 16], pa.int32()), pa.array(blobs[i : i + 16], pa.binary())],
                    names=["range", "blob"],
                )

    return run


FOUND = "k long, h long, start long, end long, settled boolean"


def _batch(keys, start, end, settled) -> pa.RecordBatch:
    keys = np.asarray(keys, np.int64).reshape(-1, 2)
    n = len(keys)
    cols = [keys[:, 0], keys[:, 1], np.asarray(start, np.int64), np.asarray(end, np.int64)]
    return pa.RecordBatch.from_arrays(
        [*(pa.array(np.ascontiguousarray(c)) for c in cols), pa.array(np.full(n, settled))],
        names=["k", "h", "start", "end", "settled"],
    )


def _reduce(splitters: list[bytes], length: int):
    def run(batches):
        settle()
        ranges: dict[int, list[bytes]] = {}
        for b in batches:
            for r, blob in zip(b.column("range").to_pylist(), b.column("blob").to_pylist()):
                if blob[:1] == b"=":
                    keys, start, end = (np.frombuffer(x, "<i8") for x in _unpack(blob[1:]))
                    yield _batch(keys, start, end, True)
                else:
                    ranges.setdefault(r, []).append(blob)
        for r, blobs in ranges.items():
            runs = [decoded(b) for b in blobs]
            blobs.clear()
            low = splitters[r - 1][:PREFIX] if r else None
            high = splitters[r][:PREFIX] if r < len(splitters) else None
            yield from _settle(runs, low, high, length)

    return run


def _settle(runs, low: bytes | None, high: bytes | None, length: int):
    """Repeats (spans) and windows to compare (first and last start) of a range.

    ``low`` and ``high`` are the first 32 bytes of the splitters around it: a group
    that shares them may go on in the next range and counts as having more classes.
    """
    keys = [x[2] for x in runs]
    los, his = [x[3] for x in runs], [x[4] for x in runs]
    # all positions of a range as numbers in order, so that the merge compares numbers
    flat = np.concatenate(keys) if keys else np.zeros((0, 2), np.int64)
    lo, hi = np.concatenate(los), np.concatenate(his)
    order = np.lexsort((lo, flat[:, 1], flat[:, 0]))
    places = np.column_stack((flat, lo))[order]
    rank = np.empty(len(lo), np.int64)
    rank[order] = np.concatenate(([0], np.cumsum((places[1:] != places[:-1]).any(1)))) if len(lo) else 0
    base = np.concatenate(([0], np.cumsum([len(x) for x in los]))).tolist()
    ranks = rank.tolist()
    strings = [x[0] for x in runs]
    repeats: list[int] = []
    edges: list[int] = []
    best, held, many = -1, -1, False  # the class's earliest; the group's only class so far
    for shared, w, i in merge([(x[0], x[1]) for x in runs]):
        e = base[w] + i
        if shared >= WIDTH:
            if ranks[e] < ranks[best]:
                repeats.append(best)
                best = e
            elif ranks[e] > ranks[best]:  # else a row that repeats the same document
                repeats.append(e)
            continue
        if best >= 0:
            if shared >= PREFIX or many:
                edges.append(best)
                many = True
        if shared < PREFIX:
            head = strings[w][i * WIDTH : i * WIDTH + PREFIX]
            many = head == low or head == high
        best = e
    if best >= 0 and many:
        edges.append(best)
    for picked, settled, add in ((repeats, True, length), (edges, False, 0)):
        picked = np.array(picked, np.int64)
        if settled and len(picked):
            picked = picked[np.argsort(rank[picked])]
        for i in range(0, len(picked), 50_000):
            p = picked[i : i + 50_000]
            yield _batch(flat[p], lo[p], hi[p] + add, settled)


def _sample(length: int):
    def run(batches):
        settle()
        for b in batches:
            out = []
            for t in b.column("text").to_pylist():
                buf = np.frombuffer(t, np.uint8)
                a, _, _, prints = anchors(buf, np.array([len(buf)]), length)
                some = prints % _U(ONE_IN) == 0
                if some.any():
                    data = _strings(buf, a[some], prints[some]).tobytes()
                    out += [data[i : i + WIDTH] for i in range(0, len(data), WIDTH)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["s"])

    return run


def splitters_of(rows: DataFrame, total: int, ranges: int, length: int) -> list[bytes]:
    """Strings that cut the suffixes into ``ranges`` of like size, or as many as differ."""
    wanted = max(DRAWN * ranges, LEAST_DRAWN)
    share = max(1, int(total * 2 / (length - PREFIX + 2)) // (wanted * ONE_IN))
    picked = F.filter(
        F.sequence(F.lit(0), F.floor(F.octet_length("text") / SLICE).cast("int")),
        lambda i: F.pmod(F.xxhash64("h", i, F.lit("slice")), F.lit(share)) == 0,
    )
    slices = rows.select("text", F.explode(picked).alias("i"))
    slices = slices.select(F.substring("text", F.col("i") * SLICE + 1, F.lit(SLICE)).alias("text"))
    drawn = sorted({bytes(r[0]) for r in slices.mapInArrow(_sample(length), "s binary").collect()})
    if len(drawn) < ranges:
        return drawn
    return sorted({drawn[len(drawn) * i // ranges] for i in range(1, ranges)})


def _bucket(w: np.ndarray, buckets: int) -> np.ndarray:
    return ((w >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)


def _repeated(order: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Of entries in order of their hashes and places: those that are not the first."""
    same = (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1])
    return np.concatenate(([False], same))


def _windows(length: int, buckets: int):
    """Hashes of the windows that are to be compared, by bucket. A task keeps each
    one's first place only; the others are repeats already."""

    def out(keys, parts):
        doc, p, one, two = (np.concatenate(x) for x in zip(*parts))
        table_ = np.array(keys, np.int64).reshape(-1, 2)
        rank = np.empty(len(keys), np.int64)
        rank[np.lexsort((table_[:, 1], table_[:, 0]))] = np.arange(len(keys))
        order = np.lexsort((p, rank[doc], two, one))
        again = _repeated(order, one, two)
        late = order[again]
        late = late[np.lexsort((p[late], doc[late]))]
        spans = merged_spans(doc[late], p[late].astype(np.int64), p[late].astype(np.int64) + length)
        order = order[~again]
        doc, p, one, two = doc[order], p[order], one[order], two[order]
        bucket = _bucket(one, buckets)
        first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        ids, blobs = [], []
        for i, j in zip(first.tolist(), [*first[1:].tolist(), len(bucket)]):
            docs, number = np.unique(doc[i:j], return_inverse=True)
            ids.append(int(bucket[i]))
            blobs.append(
                _pack([table_[docs].astype("<i8"), number.astype("<u4"), p[i:j].astype("<u4"), one[i:j], two[i:j]])
            )
        if len(spans[0]):
            ids.append(_of(table_[spans[0][0]], buckets))
            blobs.append(b"=" + _pack([table_[spans[0]].astype("<i8"), spans[1].astype("<i8"), spans[2].astype("<i8")]))
        for i in range(0, len(ids), 16):
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[i : i + 16], pa.int32()), pa.array(blobs[i : i + 16], pa.binary())], names=["range", "blob"]
            )

    def run(batches):
        settle()
        keys, parts, size, last = [], [], 0, None
        for b in batches:
            texts, spans = b.column("z").to_pylist(), b.column("edges").to_pylist()
            for k, h, t, edges in zip(b.column("k").to_pylist(), b.column("h").to_pylist(), texts, spans):
                if (k, h) == last:  # a row that repeats the document
                    continue
                last, t = (k, h), _unzipped(t)
                edges = sorted((e["start"], e["end"]) for e in edges)
                p = np.unique(np.concatenate([np.arange(i, j + 1) for i, j in edges]))
                new = np.flatnonzero(np.concatenate(([True], p[1:] - p[:-1] > length)))
                buf = np.frombuffer(t, np.uint8)
                for i, j in zip(new.tolist(), [*new[1:].tolist(), len(p)]):
                    at = p[i]
                    x, y = window_hashes(buf[at : p[j - 1] + length], length)
                    here = p[i:j] - at
                    parts.append((np.full(j - i, len(keys)), p[i:j].astype(np.int32), x[here], (y[here] >> _U(48)).astype(np.uint16)))
                    size += j - i
                keys.append((k, h))
            if size >= 1 << 20:
                yield from out(keys, parts)
                keys, parts, size = [], [], 0
        if size:
            yield from out(keys, parts)

    return run


def _meet(length: int):
    """Windows of a bucket that also start earlier, as spans."""

    def spans(blobs):
        parts = []
        for blob in blobs:
            keys, number, p, one, two = _unpack(blob)
            keys = np.frombuffer(keys, "<i8").reshape(-1, 2)[np.frombuffer(number, "<u4")]
            parts.append((keys, np.frombuffer(p, "<u4"), np.frombuffer(one, "<u8"), np.frombuffer(two, "<u2")))
        keys, p, one, two = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((p, keys[:, 1], keys[:, 0], two, one))
        late = order[_repeated(order, one, two)]
        if not len(late):
            return
        late = late[np.lexsort((p[late], keys[late, 1], keys[late, 0]))]
        own = keys[late]
        doc = np.concatenate(([0], np.cumsum((own[1:] != own[:-1]).any(1))))
        first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
        d, i, j = merged_spans(doc, p[late].astype(np.int64), p[late].astype(np.int64) + length)
        for at in range(0, len(d), 50_000):
            yield _batch(own[first][d[at : at + 50_000]], i[at : at + 50_000], j[at : at + 50_000], True)

    def run(batches):
        settle()
        held: dict[int, list[bytes]] = {}
        for b in batches:
            for r, blob in zip(b.column("range").to_pylist(), b.column("blob").to_pylist()):
                if blob[:1] == b"=":
                    keys, start, end = (np.frombuffer(x, "<i8") for x in _unpack(blob[1:]))
                    yield _batch(keys, start, end, True)
                else:
                    held.setdefault(r, []).append(blob)
        for blobs in held.values():
            yield from spans(blobs)

    return run


def _zipped(batches):
    settle()
    import zstandard

    z = zstandard.ZstdCompressor(level=3)
    for b in batches:
        cols = {c: b.column(c) for c in b.schema.names if c != "text"}
        cols["z"] = pa.array([z.compress(t) for t in b.column("text").to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))


def _unzipped(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


def _left(text: bytes, found) -> tuple[bytes, int]:
    """A text without these spans, and how many runs they make."""
    out, at, n = [], 0, 0
    for i, j in sorted((x["start"], x["end"]) for x in found or ()):
        if i > at or not n:
            out.append(text[at:i])
            n += 1
        at = max(at, j)
    return b"".join([*out, text[at:]]), n


def _cut(batches):
    settle()
    for b in batches:
        texts = [_unzipped(z) for z in b.column("z").to_pylist()]
        kept = [_left(t, found) for t, found in zip(texts, b.column("spans").to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [
                b.column("doc_id"),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([len(t) - len(x) for t, (x, _) in zip(texts, kept)], pa.int64()),
                pa.array([n for _, n in kept], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x, _ in kept], pa.string()),
                pa.array([x for x, _ in kept], pa.binary()),
            ],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
        )


NONE = -(1 << 63)


def keyed(docs: DataFrame, *more) -> DataFrame:
    """``k, h, text``: the document's place in the order, and its bytes; and other columns."""
    text = text_of()
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NONE)).alias("k"),
        F.xxhash64(text).alias("h"),
        text.cast("binary").alias("text"),
        *more,
    )


def dealt(rows: DataFrame) -> DataFrame:
    """Documents by their place in the order, texts compressed, in one exchange that
    the comparison of edges and the removal share."""
    schema = StructType([f for f in rows.schema if f.name != "text"]).add("z", BinaryType())
    rows = rows.mapInArrow(_zipped, schema)
    # said here so that no join adds it to one side alone, which would part the exchanges
    return rows.filter("k IS NOT NULL AND h IS NOT NULL").repartition("k", "h")


def repeats(docs: DataFrame, texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """``k, h, spans`` of the documents that hold repeated bytes; ``texts``: the
    dealt documents."""
    rows = keyed(docs)
    total = docs.agg(F.sum(F.octet_length(text_of()))).first()[0] or 0
    ranges = min(MOST_RANGES, max(1, -(-total // RANGE_BYTES)))
    splitters = splitters_of(rows, total, ranges, length)
    blobs = "range int, blob binary"
    found = rows.mapInArrow(_map(splitters, length), blobs).repartitionById(len(splitters) + 1, "range")
    found = stash(found.mapInArrow(_reduce(splitters, length), FOUND), "suffix-found")
    edges = found.filter(~F.col("settled")).groupBy("k", "h").agg(F.collect_list(F.struct("start", "end")).alias("edges"))
    edges = texts.join(edges, ["k", "h"]).select("k", "h", "z", "edges")
    later = edges.mapInArrow(_windows(length, ranges), blobs).repartitionById(ranges, "range").mapInArrow(_meet(length), FOUND)
    spans = found.filter("settled").unionByName(later).select("k", "h", "start", "end")
    return spans.groupBy("k", "h").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` of each document."""
    tune(docs.sparkSession)
    texts = dealt(keyed(docs, F.col("doc_id").cast("long").alias("doc_id")))
    rows = texts.join(repeats(docs, texts, length), ["k", "h"], "left").select("doc_id", "z", "spans")
    return rows.mapInArrow(
        _cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    )


def _shorten(columns: list[str]):
    def run(batches):
        settle()
        for b in batches:
            row = b.column("row")
            cols = dict(zip((f.name for f in row.type), row.flatten()))
            found = zip(*(b.column(c).to_pylist() for c in ("z", "null", "spans")))
            texts = [None if null else _left(_unzipped(z), spans)[0].decode("utf-8", "ignore") for z, null, spans in found]
            cols["text"] = pa.array(texts, pa.string())
            if "n_chars" in cols:
                cols["n_chars"] = pa.array([None if t is None else len(t) for t in texts], cols["n_chars"].type)
            yield pa.RecordBatch.from_arrays([cols[c] for c in columns], names=columns)

    return run


def shorten(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The documents, with all their columns, without the repeated bytes of their
    texts. A character that loses some of its bytes goes whole; a document may end
    up empty, but stays. ``n_chars``, if there, follows the text; null texts stay null.
    The columns travel as one, so their names do not matter."""
    tune(docs.sparkSession)
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    texts = dealt(keyed(docs, F.col("text").isNull().alias("null"), F.struct(*others).alias("row")))
    rows = texts.join(repeats(docs, texts, length), ["k", "h"], "left")
    return rows.mapInArrow(_shorten(docs.columns), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).drop("kept")
