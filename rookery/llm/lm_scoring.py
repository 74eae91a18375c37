"""Language-model scores by logistic mixing of hashed-context bit predictors.

Tokens are the words of a text (runs without ASCII white space, A-Z read as a-z) and
one end. A token is coded in binary decisions, the branches of canonical Huffman codes:
frequent words (``VOCABULARY`` times the square root of the training tokens and
``MOST_WORDS`` at most) have codes of their own, others that of an escape and then their
letters' in a second tree. Four predictors look at each decision, each a table of counts under a hash of
the code so far and its context: for words the last one, the last two, the last very
common one (which tells the language) alone and with the last one's kind; for letters
two and three before with the last very common word, five before, and the whole prefix.
A table has about as many slots as there are training tokens, up to 2 ** ``MOST_BITS``
(the memory that a task has for its counts; beyond that contexts share slots more
often). The counts cover all training documents; tasks sum them and their sums are
added up.

A mixer adds the predictors' log odds by weights, of which a set is chosen (gated) by
the kind of decision and how often the two longest contexts were seen. Weights start
from a fit to all training decisions: training texts are two halves by their hash (equal
texts in one), each decision is looked up in the counts of the half that its text is not
in, and noted by the predictors' odds in steps (``RUNGS``), its gate and its branch (the
second half's as they are counted). The notes are counts as well, which are added up like
the tables, and the weights are fitted to them. In every text a term of its own is added to the weights of all sets, and a bias,
both refined by all decisions after each ``CHUNK`` words or letters; a last map from odds
to rates, fitted to the notes too, corrects what is left. The score is the sum of the
decisions' log10 probabilities, a proper distribution over token sequences.

The base is exact: counts of frequent words travel to the texts, and the other words
travel to their counts, in arrays, one bucket of hashes a task.

Training documents are those whose crc32 of the doc_id as text is not 2 modulo 7.
Null and empty texts are one end. Rows that repeat a doc_id each get a row and count
each; a null doc_id is a training document. Words are told apart by 64-bit hashes. Only
doc_id and text are read; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rookery.llm.common import settle, stash, table, text_of, tune
from rookery.llm.near_dedup import _mix, _powers, word_hashes
from rookery.llm.words import chunks

#: Words with a code of their own, by the root of the tokens, and at most.
VOCABULARY, MOST_WORDS = 96, 1 << 20
LEAST_BITS, MOST_BITS = 14, 22
PREDICTORS = 4
#: Odds that training decisions are noted by, the nearest one each.
RUNGS = np.array([-9, -6.5, -4.5, -3, -1.8, -0.8, 0, 0.8, 1.8, 3, 4.5, 6.5, 9], np.float32)
#: Words and letters between two refinements.
CHUNK = 64
#: Words so common that the last of them tells the language.
TOP = 48
#: Step of the refinement.
RATE = 0.01
#: Text per bucket of word hashes.
BUCKET_BYTES = 16 << 20
#: Text per task that counts decisions.
TASK_BYTES = 64 << 20
#: Text coded together, text scored together, units expanded at a step, and texts scored
#: side by side.
BLOCK = 1 << 20
SCORE_BLOCK = 8 << 20
STEP = 1 << 13
LANES = 64
#: Words a task counts before it hands its counts on, and blocks of decisions that it adds
#: at once.
COUNT_WORDS = 1 << 21
COUNT_BLOCKS = 1 << 21

_U = np.uint64
END = _U(0x5DEECE66D)
_K = [_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_ODD = np.uint32(0x9E3779B1)
_CLAMP = 12.0
#: Odds are kept in steps of 1 / _STEP, above two bits that say how often a slot was seen.
_STEP = 512
#: By a block's branches below a leading one: of each of its decisions whether there is
#: one, its branch, and what its slot differs by.
_MASK, _LEAD = np.array([0, 1, 3, 7, 15], np.uint8), np.array([1, 2, 4, 8, 16], np.uint8)
_PATHS = [(p, p.bit_length() - 1) for p in range(32)]
_LIVE = np.array([[n > j for p, n in _PATHS] for j in range(4)])
_BIT = np.array([[p >> n - j - 1 & 1 if n > j else 0 for p, n in _PATHS] for j in range(4)], np.uint8)
_LOW = np.array([[p >> n - j if n > j else 1 for p, n in _PATHS] for j in range(4)], np.uint32)


def _found(tables: np.ndarray, path: np.ndarray, base: list[np.ndarray]) -> list[np.ndarray]:
    """What ``tables`` (predictors x slots) hold for decisions x blocks."""
    low = _LOW.take(path, axis=1, mode="clip")
    return [t.take(x ^ low, mode="clip") for t, x in zip(tables, base)]


def code_lengths(weights: np.ndarray) -> np.ndarray:
    """Huffman code lengths. Leaves in order of weight and nodes in order of birth are
    two queues, of which the lighter heads are joined."""
    n = len(weights)
    if n < 2:
        return np.zeros(n, np.int64)
    order = np.argsort(weights, kind="stable")
    leaf, born = weights[order].tolist(), []
    parent = [0] * (2 * n - 1)  # leaves in order, then nodes
    i = j = 0
    for node in range(n, 2 * n - 1):
        total = 0
        for _ in range(2):
            if j >= len(born) or (i < n and leaf[i] <= born[j]):
                total += leaf[i]
                parent[i] = node
                i += 1
            else:
                total += born[j]
                parent[n + j] = node
                j += 1
        born.append(total)
    depth = [0] * (2 * n - 1)
    for k in range(2 * n - 3, -1, -1):
        depth[k] = depth[parent[k]] + 1
    out = np.zeros(n, np.int64)
    out[order] = depth[:n]
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes below a leading one: the shorter first, then in order."""
    out, code, last = np.zeros(len(lengths), _U), 0, 0
    order = np.argsort(lengths, kind="stable")
    for size in np.unique(lengths).tolist():
        own = order[np.searchsorted(lengths[order], size) : np.searchsorted(lengths[order], size, "right")]
        code <<= size - last
        out[own] = _U(1 << size) + _U(code) + np.arange(len(own)).astype(_U)
        code, last = code + len(own), size
    return out


class Coder:
    """Codes of symbols: frequent words in hash order, the escape, then 256 letters and
    a word's end."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, rare: int, letters: np.ndarray, bits: int):
        order = np.argsort(keys)
        self.keys, self.counts, self.bits = keys[order], counts[order].astype(np.int64), bits
        self.escape = len(keys)
        self.top = np.zeros(len(keys) + 1, bool)
        self.top[np.argsort(-self.counts, kind="stable")[:TOP]] = True
        sizes = [code_lengths(np.append(self.counts, rare + 1).astype(np.float64)), code_lengths(letters + 0.01)]
        self.size = np.concatenate(sizes)
        narrow = self.size.max(initial=0) < 32
        self.code = np.concatenate([canonical(x) for x in sizes]).astype(np.uint32 if narrow else _U)

    @cached_property
    def begins(self) -> tuple[np.uint64, np.ndarray, np.ndarray]:
        """The first key of each range of hashes, some four ranges a key, and the keys with
        an end."""
        bits = len(self.keys).bit_length() + 2
        shift = _U(64 - bits)
        n = np.bincount((self.keys >> shift).astype(np.intp), minlength=1 << bits)
        return shift, (np.cumsum(n) - n).astype(np.int32), np.append(self.keys, _U(2**64 - 1))

    def lookup(self, w: np.ndarray) -> np.ndarray:
        shift, begins, keys = self.begins
        i = begins.take((w >> shift).astype(np.intp), mode="clip").astype(np.intp)
        found = keys.take(i, mode="clip")
        low = np.flatnonzero(found < w)
        while len(low):
            i[low] += 1
            found[low] = keys[i[low]]
            low = low[found[low] < w[low]]
        return np.where(found == w, i, self.escape)


class Tokens:
    """The tokens of some texts: hashes and texts, in order."""

    def __init__(self, texts: list[bytes]):
        w, at = word_hashes(texts)
        n = np.diff(at)
        ends = at[1:] + np.arange(len(texts))  # places of the ends among tokens
        self.w = np.full(len(w) + len(texts), END)
        self.word = np.ones(len(self.w), bool)
        self.word[ends] = False
        self.w[self.word] = w
        self.first = np.concatenate(([0], ends + 1))
        self.doc = np.repeat(np.arange(len(texts)), n + 1)


class Units:
    """Words, and after each rare one its letters and its end, with their codes and the
    slots of their contexts; ``first``: each text's first unit (and the total)."""

    def __init__(self, texts: list[bytes], coder: Coder, tokens: Tokens | None = None):
        t = tokens or Tokens(texts)
        total = len(t.w)
        self.tokens, self.symbol = t, coder.lookup(t.w)
        symbol, shift = self.symbol, _U(64 - coder.bits)
        rare = symbol == coder.escape
        number = np.arange(total)
        begin_of = t.first.take(t.doc, mode="clip")
        # places of rare words' bytes
        buf = np.frombuffer(b" ".join([b"", *texts, b""]), np.uint8)
        blank = (buf == 32) | ((buf >= 9) & (buf <= 13))
        edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1  # begins and ends in turn
        rare_word = rare[t.word]
        begin, end = edge[::2][rare_word], edge[1::2][rare_word]
        size = np.zeros(total, np.int64)
        size[rare] = end - begin + 1
        start = np.cumsum(size + 1) - (size + 1)
        self.count = total + int(size.sum())
        self.first = np.append(start, self.count)[t.first]
        self.word = start  # each token's unit
        what = np.empty(self.count, np.int64)
        what[start] = symbol
        letter = np.ones(self.count, bool)
        letter[start] = False
        self.kind = letter
        # contexts of words
        common = np.maximum.accumulate(np.where(coder.top.take(symbol, mode="clip"), number, -1)) if total else number
        common = np.concatenate(([-1], common))[:total]
        tongue = np.where(common >= begin_of, symbol.take(common, mode="clip") + 1, 0).astype(_U)
        kind = np.concatenate(([0, 0], rare)).astype(_U)
        kinds = kind[1 : total + 1] + kind[:total] * _U(2)
        place = number - begin_of
        one = np.where(place >= 1, np.concatenate((np.zeros(1, _U), t.w))[:total], _U(1))
        two = np.where(place >= 2, np.concatenate((np.zeros(2, _U), t.w))[:total], _U(2))
        of_words = (tongue + _U(1), one, tongue * _K[3] + kinds + _U(9), one * _K[1] + two * _K[2] + _U(7))
        # and of letters
        own = size[rare]
        who = np.repeat(np.arange(len(own)), own)
        first = np.cumsum(own) - own
        j = np.arange(len(who)) - first.take(who, mode="clip")
        at = begin.take(who, mode="clip") + j
        lower = np.where((buf >= 65) & (buf <= 90), buf + 32, buf).astype(np.uint8)
        last = j == own.take(who, mode="clip") - 1
        letters = np.flatnonzero(letter)
        what[letters] = coder.escape + 1 + np.where(last, 256, lower.take(at, mode="clip").astype(np.int64))
        back = [lower.take(at - k, mode="clip").astype(_U) for k in (1, 2, 3, 4, 5)]
        speak = (tongue[rare] * _K[2]).take(who, mode="clip")
        near = back[0] << _U(8) | back[1]
        # the prefix's hash is a difference of running sums, which wrap
        powers = _powers(_K[0], int(own.max(initial=0)) + 1)
        run = np.cumsum(np.where(j > 0, (back[0] + _U(1)) * powers.take(j, mode="clip"), _U(0)).astype(_U))
        of_letters = (
            near + _U(1 << 50) + speak,
            (near << _U(8) | back[2]) + _U(2 << 50) + speak,
            (near << _U(24) | back[2] << _U(16) | back[3] << _U(8) | back[4]) + _U(3 << 50),
            run - run[first].take(who, mode="clip") + _U(4 << 50),
        )
        self.context = np.empty((PREDICTORS, self.count), np.uint32)
        for k in range(PREDICTORS):
            self.context[k, start] = _mix(of_words[k]) >> shift
            self.context[k, letters] = _mix(of_letters[k]) >> shift
        self.code, self.size, self.shift = coder.code.take(what, mode="clip"), coder.size.astype(np.uint8).take(what, mode="clip"), np.uint32(32 - coder.bits)

    @classmethod
    def joined(cls, parts: list[Units]) -> Units:
        """The units of several lists of texts, to be scored together."""
        out = cls.__new__(cls)
        out.count = sum(u.count for u in parts)
        begin = np.cumsum([0, *(u.count for u in parts)])
        out.first = np.concatenate([*(u.first[:-1] + i for u, i in zip(parts, begin)), [out.count]])
        for name in ("kind", "code", "size"):
            setattr(out, name, np.concatenate([getattr(u, name) for u in parts]))
        out.context = np.concatenate([u.context for u in parts], axis=1)
        out.shift = parts[0].shift
        return out

    def blocks(self, units: np.ndarray | slice):
        """Four decisions of a unit in a row share a block of 16 slots, hashed by the code
        before them. Of these units in order: each block's unit (its position), its branches
        below a leading one, and by predictor the slot that its decisions' are told from."""
        size, code = self.size[units], self.code[units]
        many = size + np.uint8(3) >> 2
        which = np.repeat(np.arange(len(size)), many)
        begin = np.cumsum(many, dtype=np.int32) - many
        left = size.astype(np.int32)
        left += begin << 2
        left = left.take(which, mode="clip")
        left -= np.arange(0, 4 * len(which), 4, dtype=np.int32)  # decisions from here to the unit's end
        code = code.take(which, mode="clip")
        node = (code >> left.astype(code.dtype)).astype(np.uint32, copy=False)
        node *= _ODD
        node >>= self.shift
        node &= np.uint32(0xFFFFFFF0)
        have = np.minimum(left, 4)
        left -= have
        code >>= left.astype(code.dtype)
        path = code.astype(np.uint8) & _MASK.take(have, mode="clip")
        path |= _LEAD.take(have, mode="clip")
        base = [own[units].take(which, mode="clip") for own in self.context]
        for x in base:
            x ^= node
        return which, path, base

    def decisions(self, units: np.ndarray | slice):
        """Of these units in order: each decision's unit (its position), branch and slots."""
        size, code = self.size[units], self.code[units]
        which = np.repeat(np.arange(len(size)), size)
        end = np.cumsum(size, dtype=np.int32)
        number = np.arange(len(which), dtype=np.int32)
        step = number - (end - size.astype(np.int32)).take(which, mode="clip")  # decisions before each
        upto = code.take(which, mode="clip")
        upto >>= (end.take(which, mode="clip") - number - 1).astype(code.dtype)
        bit = (upto & 1).astype(np.uint32)
        upto >>= 1
        # four decisions in a row share a block of 16 slots, hashed by the code before them
        step &= 3
        step = step.astype(code.dtype)
        near = np.left_shift(1, step, dtype=code.dtype)
        node = (upto >> step).astype(np.uint32, copy=False)
        node *= _ODD
        node >>= self.shift
        node &= np.uint32(0xFFFFFFF0)
        node |= (upto & (near - 1) | near).astype(np.uint32, copy=False)
        slots = [self.context[k][units].take(which, mode="clip") for k in range(PREDICTORS)]
        for x in slots:
            x ^= node
        return which, bit, slots


def _portions(texts: list[bytes], limit: int = BLOCK):
    i = size = 0
    for j, x in enumerate(texts):
        size += len(x)
        if size >= limit:
            yield i, j + 1
            i, size = j + 1, 0
    if i < len(texts):
        yield i, len(texts)


def _blob(*arrays: np.ndarray) -> bytes:
    """Arrays with the bytes of all numbers by place, since most high ones are 0."""
    import zstandard

    head = np.array([len(arrays), *(a.nbytes for a in arrays)], "<i8").tobytes()
    planes = (np.ascontiguousarray(a.ravel().view(np.uint8).reshape(-1, a.itemsize).T).tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(planes))


def _arrays(blob: bytes, *kinds: str) -> list[np.ndarray]:
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(blob)
    sizes, at, out = np.frombuffer(data, "<i8", len(kinds), 8), 8 * (len(kinds) + 1), []
    for kind, size in zip(kinds, sizes.tolist()):
        planes = np.frombuffer(data, np.uint8, size, at).reshape(np.dtype(kind).itemsize, -1)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel())
        at += size
    return out


def _bucket(w: np.ndarray, buckets: int) -> np.ndarray:
    return ((w >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)


def _split(w: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """Ranges of sorted hashes by bucket."""
    b = _bucket(w, buckets)
    first = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1]))) if len(b) else np.zeros(0, int)
    return list(zip(b[first].tolist(), first.tolist(), [*first[1:].tolist(), len(b)]))


def _send(rows):
    for i in range(0, len(rows), 64):
        part = rows[i : i + 64]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in part], pa.int32()), pa.array([r[1] for r in part], pa.binary())], names=["bucket", "blob"]
        )


def _count(buckets: int):
    """Word counts of a task, in one array a bucket; the letters' counts (and the words')
    go into a bucket behind the others."""

    def run(batches):
        settle()
        held, size, letters = [], 0, np.zeros(257, np.int64)

        def out():
            w, n = np.unique(np.concatenate(held), return_counts=True)
            return _send([(b, _blob(w[i:j], n[i:j].astype("<i8"))) for b, i, j in _split(w, buckets)])

        for b in batches:
            texts = b.column("text").to_pylist()
            for i, j in _portions(texts, 1 << 21):
                t = Tokens(texts[i:j])
                held.append(t.w)
                size += len(t.w)
                letters[:256] += np.bincount(np.frombuffer(b"".join(texts[i:j]), np.uint8), minlength=256)
                letters[256] += len(t.w) - (j - i)
                if size >= COUNT_WORDS:
                    yield from out()
                    held, size = [], 0
        if held:
            yield from out()
        letters[97:123] += letters[65:91]
        letters[[*range(65, 91), 32, *range(9, 14)]] = 0
        yield from _send([(buckets, _blob(letters))])

    return run


def _add_up(buckets: int):
    """Sums of a bucket's counts: hashes, counts, tokens and words."""

    def run(batches):
        settle()
        held: dict[int, list] = {}
        letters = []
        for b in batches:
            for k, blob in zip(b.column("bucket").to_pylist(), b.column("blob").to_pylist()):
                if k == buckets:
                    letters.append(_arrays(blob, "<i8")[0])
                    continue
                parts = held.setdefault(k, [])
                parts.append(_arrays(blob, "<u8", "<i8"))
                if len(parts) > 64:
                    held[k] = [_merged(parts)]
        out = [(k, int(n.sum()), len(w), _blob(w, n)) for k, parts in held.items() for w, n in [_merged(parts)]]
        if letters:
            out.append((buckets, 0, 0, _blob(sum(letters))))
        for k, tokens, words, blob in out:
            yield pa.RecordBatch.from_arrays(
                [pa.array([k], pa.int32()), pa.array([tokens]), pa.array([words]), pa.array([blob], pa.binary())],
                names=["bucket", "tokens", "words", "blob"],
            )

    return run


def _merged(parts):
    w = np.concatenate([p[0] for p in parts])
    n = np.concatenate([p[1] for p in parts])
    order = np.argsort(w, kind="stable")
    w, n = w[order], n[order]
    new = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1])))
    return w[new], np.add.reduceat(n, new)


#: Counts are told apart up to here when the vocabulary is chosen.
LEVELS = 1 << 16


def _levels(batches):
    """How many words have each count."""
    for b in batches:
        for blob in b.column("blob").to_pylist():
            n, words = np.unique(np.minimum(_arrays(blob, "<u8", "<i8")[1], LEVELS), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(words)], names=["n", "words"])


def _frequent(least: int):
    def run(batches):
        for b in batches:
            for blob in b.column("blob").to_pylist():
                w, n = _arrays(blob, "<u8", "<i8")
                some = n >= least
                yield pa.RecordBatch.from_arrays(
                    [pa.array(w[some].view(np.int64)), pa.array(n[some])], names=["w", "n"]
                )

    return run


def vocabulary(counts: DataFrame, tokens: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of the most frequent words, ``VOCABULARY`` times the root of
    the tokens and ``MOST_WORDS`` at most, none seen once."""
    levels = counts.select("blob").mapInArrow(_levels, "n long, words long").groupBy("n").agg(F.sum("words").alias("words"))
    least, room = LEVELS, min(MOST_WORDS, VOCABULARY * math.isqrt(tokens))
    for n, words in sorted(map(tuple, levels.collect()), reverse=True):  # at most LEVELS rows
        room -= words
        if room < 0 or n < 2:
            break
        least = n
    found = counts.select("blob").mapInArrow(_frequent(least), "w long, n long").toArrow()
    return found["w"].to_numpy().view(_U), found["n"].to_numpy()


def _packed(counts: np.ndarray) -> np.ndarray:
    """Odds of slots x branch in steps of 1 / _STEP, above two bits that say how often the
    slot was seen."""
    a, b = counts[:, 0].astype(np.float32), counts[:, 1].astype(np.float32)
    n = a + b
    odds = np.log((b + np.float32(0.1)) / (a + np.float32(0.1)))
    odds = np.round(np.clip(odds, -_CLAMP, _CLAMP) * _STEP).astype(np.int16) << 2
    return odds | ((n >= 1).view(np.int8) + (n >= 4) + (n >= 32))


def _fill(coder: Coder, rungs: np.ndarray | None = None):
    """The predictors' counts over a task's texts, in pieces, and behind them the notes by
    ``rungs``, if these are given."""

    def run(batches):
        settle()
        counts = np.zeros((PREDICTORS, 2 << coder.bits), np.int32)
        notes = None if rungs is None else np.zeros(NOTED, np.int64)
        held, size = [], 0

        steps = (_LOW.astype(np.intp) << 1) | _BIT

        def add():
            for k in range(PREDICTORS):
                keys = np.concatenate([m[k] for m in held])
                keys.sort()  # equal blocks meet, and neighbours in the table are added one after the other
                first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
                n = np.diff(np.append(first, len(keys))).astype(np.int32)
                keys = keys[first]
                path, base = (keys & 31).astype(np.intp), (keys >> 5).astype(np.intp) << 1
                for j in range(4):
                    np.add.at(counts[k], base ^ steps[j].take(path), n * _LIVE[j].take(path))

        for b in batches:
            texts = b.column("text").to_pylist()
            for i, j in _portions(texts, BLOCK):
                u = Units(texts[i:j], coder)
                for at in range(0, u.count, STEP):
                    part = slice(at, at + STEP)
                    which, path, base = u.blocks(part)
                    if notes is not None:
                        _noted(notes, rungs, u.kind[part], which, path, base)
                    held.append([x << 5 | path for x in base])
                    size += len(path)
                    if size >= COUNT_BLOCKS:
                        add()
                        held, size = [], 0
        if held:
            add()
        if counts.any():
            flat = counts.astype("<i4", copy=False).reshape(PIECES, -1)
            for i in range(PIECES):
                yield from _send([(i, _blob(flat[i]))])
            del flat
            if notes is not None:
                yield from _pieces(notes, PIECES)
        del counts
        settle()  # the table's memory goes back before the next task begins

    return run


def _sum_tables(batches):
    settle()
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for k, blob in zip(b.column("bucket").to_pylist(), b.column("blob").to_pylist()):
            (a,) = _arrays(blob, "<i4")
            total[k] = total[k] + a if k in total else a.astype(np.int64)
    for k, a in total.items():
        yield from _send([(k, _blob(_narrowed(a)))])


def _by_rungs(batches):
    """A piece's rungs, for the other half of the texts."""
    settle()
    for b in batches:
        for k, blob in zip(b.column("bucket").to_pylist(), b.column("blob").to_pylist()):
            yield from _send([(k, _blob(_rungs(_packed(_arrays(blob, "<i4")[0].reshape(-1, 2)))))])


def _by_odds(batches):
    """A piece's odds by both halves of the texts."""
    for b in _sum_tables(batches):
        for k, blob in zip(b.column("bucket").to_pylist(), b.column("blob").to_pylist()):
            yield from _send([(k, _blob(_packed(_arrays(blob, "<i4")[0].reshape(-1, 2))))])


def _narrowed(a: np.ndarray) -> np.ndarray:
    """Pairs of counts as 32-bit numbers: odds depend on the ratio alone, so pairs of very
    common contexts are halved until they fit."""
    a = a.reshape(-1, 2)
    while len(far := np.flatnonzero(a.max(1) > np.iinfo(np.int32).max)):
        a[far] >>= 1
    return a.astype("<i4").ravel()


PIECES = 32
GATES = 32
BUCKETS = 33
#: Gates, rungs of all predictors and branches.
NOTED = GATES * len(RUNGS) ** PREDICTORS * 2


class Mixer:
    """Odds of the predictors, mixing weights and the last adaptive map."""

    def __init__(self, counts: np.ndarray):
        """``counts``: predictors x slots x branch, or their packed odds."""
        self.packed = counts if counts.dtype == np.int16 else np.stack([_packed(own) for own in counts])
        self.weights = np.full((GATES, PREDICTORS), 0.3, np.float32)
        self.map = np.zeros(BUCKETS * 2, np.float32)

    @staticmethod
    def odds(found: list[np.ndarray]):
        """Odds by predictor (the two lowest bits do not matter), and how often the two
        longest contexts were seen."""
        level = found[-2] & np.int16(3)
        level <<= 2
        level += found[-1] & np.int16(3)
        return [x * np.float32(0.25 / _STEP) for x in found], level

    @staticmethod
    def cell(z: np.ndarray) -> np.ndarray:
        """Cell of the last map, for words."""
        x = z * np.float32((BUCKETS - 1) / (2 * _CLAMP))
        x += np.float32(BUCKETS / 2)
        return x.astype(np.int16)

    def known(self, u: Units):
        """All decisions' branches, odds, gates and kinds."""
        _, bit, slots = u.decisions(slice(None))
        kind = np.repeat(u.kind, u.size)
        st, level = self.odds([self.packed[k].take(slots[k], mode="clip") for k in range(PREDICTORS)])
        return bit, st, level + kind * np.int16(16), kind

    def fit(self, portions) -> np.ndarray:
        """Weights by online Newton steps, one a portion of texts, then what the map is
        made of: decisions, branches and expected branches of each cell."""
        hess = np.repeat(np.eye(PREDICTORS)[None], GATES, 0)
        weights = self.weights.astype(np.float64)
        self.seen = np.zeros(GATES)
        for u in portions:
            bit, st, gate, _ = self.known(u)
            for g in np.unique(gate).tolist():
                own = np.flatnonzero(gate == g)
                x, y = np.stack([s[own] for s in st], 1).astype(np.float64), bit[own]
                p = 1 / (1 + np.exp(-np.clip(x @ weights[g], -30, 30)))
                hess[g] += (x * (p * (1 - p))[:, None]).T @ x
                step = np.linalg.solve(hess[g], x.T @ (y - p) - 0.01 * (weights[g] - 0.3))
                weights[g] += np.clip(step, -0.5, 0.5)
                self.seen[g] += len(own)
        self.weights = np.clip(weights, -2, 4).astype(np.float32)
        return self.weights

    def learn(self, notes: np.ndarray) -> None:
        """Weights and the last map from the notes of all training decisions."""
        notes = notes.reshape(GATES, -1, 2)
        tally = np.zeros((3, BUCKETS * 2))
        for g, own in enumerate(notes):
            at = np.flatnonzero(own.any(1))
            if not len(at):
                continue
            n, hits = own[at].sum(1).astype(np.float64), own[at, 1].astype(np.float64)
            x = np.stack([RUNGS[i] for i in np.unravel_index(at, (len(RUNGS),) * PREDICTORS)], 1).astype(np.float64)
            w = self.weights[g].astype(np.float64)
            for _ in range(25):
                p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
                hess = (x * (n * p * (1 - p))[:, None]).T @ x + np.eye(PREDICTORS)
                w += np.clip(np.linalg.solve(hess, x.T @ (hits - n * p) - (w - 0.3)), -0.5, 0.5)
            self.weights[g] = np.clip(w, -2, 4)
            z = np.clip(x.astype(np.float32) @ self.weights[g], -_CLAMP, _CLAMP)
            cell = self.cell(z) + g // 16 * BUCKETS
            tally += [np.bincount(cell, v, BUCKETS * 2) for v in (n, hits, n / (1 + np.exp(-z)))]
        self.correct(tally)

    def tally(self, u: Units) -> np.ndarray:
        """Decisions, branches and expected branches of each cell of the map."""
        bit, st, gate, kind = self.known(u)
        z = np.clip(sum(s * w[gate] for s, w in zip(st, self.weights.T)), -_CLAMP, _CLAMP)
        cell = self.cell(z) + kind * np.int16(BUCKETS)
        return np.stack([np.bincount(cell, w, BUCKETS * 2) for w in (None, bit, 1 / (1 + np.exp(-z)))])

    def correct(self, tally: np.ndarray) -> None:
        """The map from the tallies' sum."""
        n, hits, expected = tally
        share = 2 * expected / np.maximum(n, 1)
        more = np.log((hits + share + 0.02) / (expected + share + 0.02))
        less = np.log((n - hits + 0.5) / np.maximum(n - expected + 0.5, 0.5))
        self.map = np.clip(np.where(n > 50, more - less, 0), -1, 1).astype(np.float32)

    def costs(self, u: Units) -> np.ndarray:
        """Minus the natural log probability of each unit. Texts go side by side, chunk by
        chunk, each with refinements of its own; where one ends, the next begins."""
        out = np.zeros(u.count)
        own = np.zeros((PREDICTORS + 1, LANES), np.float32)  # what a text adds to the weights, and a bias
        for lanes, fresh, start, size in turns(u.first):
            own[:, lanes[fresh]] = 0
            self._refined(u, out, own, lanes, start, size)
        return out

    def _refined(self, u: Units, out: np.ndarray, own: np.ndarray, lanes: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        """Costs of a chunk of each lane's text, and refinements for the chunks to come."""
        units = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        which, path, base = u.blocks(units)
        if not len(which):  # a tree of one leaf
            return
        path = path.astype(np.intp)
        kind, lane = u.kind[units], np.repeat(np.arange(len(size)), size)
        st, level = self.odds(_found(self.packed, path, base))
        row = (lane * GATES + kind * np.intp(16)).take(which, mode="clip") + level
        lane = lane.take(which, mode="clip")
        z = np.empty(level.shape, np.float32)
        z[:] = own[-1, lanes].take(lane, mode="clip")
        for k in range(PREDICTORS):
            w = (self.weights[:, k] + own[k, lanes, None]).ravel().take(row, mode="clip")
            w *= st[k]
            z += w
        np.clip(z, -_CLAMP, _CLAMP, out=z)
        cell = self.cell(z)
        cell += (kind * np.int16(BUCKETS)).take(which, mode="clip")
        live = _LIVE.astype(np.float32).take(path, axis=1, mode="clip")
        sign = (1 - 2 * _BIT.astype(np.float32)).take(path, axis=1, mode="clip")
        y = self.map.take(cell, mode="clip")
        y += z
        y *= sign
        np.exp(y, out=y)
        y += np.float32(1)
        cost = np.log(y)
        cost *= live
        steps = np.concatenate(([0], np.flatnonzero(which[1:] != which[:-1]) + 1))
        out[units[which[steps]]] = np.add.reduceat(cost.sum(0).astype(np.float64), steps)
        miss = sign / y
        miss -= sign  # branch less its probability
        miss *= live
        first = np.concatenate(([0], np.flatnonzero(lane[1:] != lane[:-1]) + 1))
        rate = RATE / np.sqrt(np.add.reduceat(live.sum(0), first))
        sums = [np.add.reduceat(x, first) for x in (*(np.einsum("jn,jn->n", x, miss) for x in st), miss.sum(0))]
        some = lanes[lane[first]]
        own[:, some] = np.clip(own[:, some] + rate * np.stack(sums), -1, 1)

    def score(self, u: Units) -> np.ndarray:
        """log10 probability of each text."""
        return np.add.reduceat(self.costs(u), u.first[:-1]) / -math.log(10)


def turns(first: np.ndarray):
    """Texts, longest first, each in the lane that is free first: for each turn its lanes,
    which of them begin a text, and the first units and sizes of their chunks."""
    n = np.diff(first)
    many = -(-n // CHUNK)
    lane, begin = np.zeros(len(n), np.intp), np.zeros(len(n), np.intp)
    free = [(0, k) for k in range(min(LANES, len(n)))]
    for i in np.argsort(-many, kind="stable").tolist():
        begin[i], lane[i] = free[0]
        heapq.heapreplace(free, (int(begin[i] + many[i]), int(lane[i])))
    text = np.repeat(np.arange(len(n)), many)
    number = np.arange(len(text)) - (np.cumsum(many) - many)[text]
    turn = begin[text] + number
    order = np.argsort(turn, kind="stable")
    text, number = text[order], number[order]
    lane, start, size = lane[text], first[text] + number * CHUNK, np.minimum(n[text] - number * CHUNK, CHUNK)
    edges = np.searchsorted(turn[order], np.arange(turn.max(initial=-1) + 2))
    for i, j in zip(edges[:-1].tolist(), edges[1:].tolist()):
        yield lane[i:j], number[i:j] == 0, start[i:j], size[i:j]


def _rungs(packed: np.ndarray) -> np.ndarray:
    """The rungs nearest to packed odds, above the same two bits."""
    value = np.arange(1 << 16, dtype=np.uint16).view(np.int16)
    nearest = np.digitize((value >> 2) / _STEP, (RUNGS[1:] + RUNGS[:-1]) / 2)
    return (nearest << 2 | value & 3).astype(np.uint8).take(packed.view(np.uint16))


def _noted(notes: np.ndarray, rungs: np.ndarray, kind: np.ndarray, which: np.ndarray, path: np.ndarray, base: list[np.ndarray]) -> None:
    """Adds blocks' decisions to the notes: how often decisions met each gate, each rung of
    each predictor and each branch; ``rungs``: predictors x slots."""
    path = path.astype(np.intp)
    seen = _found(rungs, path, base)
    cell = ((seen[-2] & 3) << 2 | seen[-1] & 3) + (kind * np.int32(16)).take(which, mode="clip")
    for x in seen:
        cell *= np.int32(len(RUNGS))
        cell += x >> 2
    cell <<= 1
    cell += _BIT.take(path, axis=1, mode="clip")
    np.add.at(notes, cell[_LIVE.take(path, axis=1, mode="clip")], 1)


def _pieces(notes: np.ndarray, first: int):
    for i, part in enumerate(notes.reshape(PIECES, -1)):
        yield from _send([(first + i, _blob(_narrowed(part)))])


def _note(coder: Coder, rungs: np.ndarray):
    """The notes of a task's decisions, in pieces."""

    def run(batches):
        settle()
        notes = np.zeros(NOTED, np.int64)
        for b in batches:
            texts = b.column("text").to_pylist()
            for i, j in _portions(texts, BLOCK):
                u = Units(texts[i:j], coder)
                for at in range(0, u.count, STEP):
                    part = slice(at, at + STEP)
                    _noted(notes, rungs, u.kind[part], *u.blocks(part))
        if notes.any():
            yield from _pieces(notes, 0)

    return run


def _score(coder: Coder, mixer: Mixer, buckets: int):
    """Rows of documents, with what their frequent words give, and the other words'
    hashes on their way to the counts."""
    names = ["uid", "doc_id", "held_out", "n_bytes", "n_tokens", "n_known", "base", "score", "bucket", "blob"]

    def run(batches):
        settle()
        from pyspark import TaskContext

        uid = TaskContext.get().partitionId() << 40
        logs, seen = np.append(np.log10(coder.counts + 1.0), 0.0), np.append(coder.counts > 0, False)
        wait: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        waiting = 0

        def requests():
            w, who, times = (np.concatenate(x) for x in zip(*wait))
            order = np.argsort(w, kind="stable")
            w, who, times = w[order], who[order], times[order]
            rows = [(b, _blob(w[i:j], who[i:j], times[i:j])) for b, i, j in _split(w, buckets)]
            for i in range(0, len(rows), 64):
                part = rows[i : i + 64]
                none = [pa.nulls(len(part), k) for k in (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())]
                yield pa.RecordBatch.from_arrays(
                    [*none, pa.array([r[0] for r in part], pa.int32()), pa.array([r[1] for r in part], pa.binary())], names=names
                )

        for b in chunks(batches, SCORE_BLOCK):
            texts = b.column("text").to_pylist()
            parts = []
            for i, j in _portions(texts):
                u = Units(texts[i:j], coder)
                t, n = u.tokens, j - i
                base = np.bincount(t.doc, logs[u.symbol], n)
                rare = u.symbol == coder.escape
                pair = np.stack((t.doc[rare].astype(_U), t.w[rare]))
                order = np.lexsort(pair[::-1])
                pair = pair[:, order]
                new = np.flatnonzero(np.concatenate(([True], (pair[:, 1:] != pair[:, :-1]).any(0)))) if pair.shape[1] else np.zeros(0, int)
                times = np.diff(np.append(new, pair.shape[1])).astype("<u4")
                wait.append((pair[1, new], pair[0, new].astype("<i8") + (uid + i), times))
                waiting += len(new)
                parts.append((np.diff(t.first), np.bincount(t.doc, seen[u.symbol], n).astype(np.int64), base, u))
                del u.tokens, u.symbol, u.word
            *sums, parts = zip(*parts)
            tokens, known, base = map(np.concatenate, sums)
            n = len(texts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(uid, uid + n)),
                    b.column("doc_id").combine_chunks(),
                    b.column("held_out").combine_chunks(),
                    pa.array([len(x) for x in texts], pa.int64()),
                    pa.array(tokens),
                    pa.array(known),
                    pa.array(base),
                    pa.array(mixer.score(Units.joined(parts))),
                    pa.nulls(n, pa.int32()),
                    pa.nulls(n, pa.binary()),
                ],
                names=names,
            )
            uid += n
            del parts
            if waiting >= 1 << 20:
                yield from requests()
                wait, waiting = [], 0
        if waiting:
            yield from requests()

    return run


def _answer(batches):
    """Meets words with their counts: what they add to each document."""
    settle()
    counts: dict[int, tuple] = {}
    asked: dict[int, list[bytes]] = {}

    def met(k, blobs):
        w, n = counts.get(k, (np.zeros(0, _U), np.zeros(0, np.int64)))
        for blob in blobs:
            x, who, times = _arrays(blob, "<u8", "<i8", "<u4")
            if len(w):
                i = np.minimum(np.searchsorted(w, x), len(w) - 1)
                c = np.where(w[i] == x, n[i], 0)
            else:
                c = np.zeros(len(x), np.int64)
            hit = c > 0
            who, back = np.unique(who[hit], return_inverse=True)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(who),
                    pa.array(np.bincount(back, times[hit], len(who)).astype(np.int64)),
                    pa.array(np.bincount(back, times[hit] * np.log10(c[hit] + 1.0), len(who))),
                ],
                names=["uid", "more_known", "more_base"],
            )

    for b in batches:
        for k, blob, is_count in zip(*(b.column(c).to_pylist() for c in ("bucket", "blob", "counts"))):
            if is_count:
                counts[k] = tuple(_arrays(blob, "<u8", "<i8"))
            else:
                asked.setdefault(k, []).append(blob)
    for k, blobs in asked.items():
        yield from met(k, blobs)


def held_out():
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 2, F.lit(False))


def score(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` and
    ``bits_per_byte`` of each document (null for empty texts)."""
    tune(docs.sparkSession)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), text_of().cast("binary").alias("text")
    )
    train = rows.filter(~F.col("held_out")).select("text")
    halves = [train.filter(F.xxhash64("text", F.lit("half")) % 2 == 0), train.filter(F.xxhash64("text", F.lit("half")) % 2 != 0)]
    size, ends = rows.agg(F.sum(F.octet_length("text")), F.count_if(~F.col("held_out"))).first()
    buckets = max(1, -(-(size or 0) // BUCKET_BYTES))
    two = "bucket int, blob binary"
    counts = train.mapInArrow(_count(buckets), two).repartitionById(buckets + 1, "bucket")
    counts = counts.mapInArrow(_add_up(buckets), "bucket int, tokens long, words long, blob binary")
    counts = stash(counts, "lm-counts", compression="uncompressed")
    letters = np.zeros(257)
    for r in counts.filter(F.col("bucket") == buckets).collect():  # one row
        letters += _arrays(bytes(r["blob"]), "<i8")[0]
    counts = counts.filter(F.col("bucket") < buckets)
    total = counts.agg(F.sum("tokens"), F.sum("words")).first()
    tokens, words = total[0] or 0, total[1] or 0
    keys, often = vocabulary(counts, tokens)
    if END not in keys:  # of few texts; the end is no word to be spelled
        keys, often = np.append(keys, END), np.append(often, ends)
    bits = min(MOST_BITS, max(LEAST_BITS, round(math.log2(tokens + 1))))
    coder = Coder(keys, often, tokens - int(often.sum()), letters, bits)

    # a task hands on whole tables, so it reads enough to fill them
    tasks = max(2 * docs.sparkSession.sparkContext.defaultParallelism, -(-(size or 0) // TASK_BYTES))

    def summed(half: int, run, name: str, pieces: int = PIECES) -> DataFrame:
        found = halves[half].coalesce(tasks).mapInArrow(run, two).repartitionById(pieces, "bucket").mapInArrow(_sum_tables, two)
        return stash(found, name, compression="uncompressed")

    def looked_up(found: DataFrame, run, kind: str, empty: int = 0) -> np.ndarray:
        """Rungs by a half, or odds by both; 32 MB at most."""
        out = np.full((PIECES, (PREDICTORS << bits) // PIECES), empty, kind)
        for r in stash(found.mapInArrow(run, two), "lm-odds", compression="uncompressed").toLocalIterator():
            out[r[0]] = _arrays(bytes(r[1]), kind)[0]
        return out.reshape(PREDICTORS, 1 << bits)

    # the second half is noted as it is counted, the first one when the second is counted
    notes = np.zeros((PIECES, NOTED // PIECES), np.int64)

    def add(found: DataFrame) -> None:
        for r in found.toLocalIterator():
            notes[r[0] % PIECES] += _arrays(bytes(r[1]), "<i4")[0]

    neither = len(RUNGS) // 2 << 2
    one = summed(0, _fill(coder), "lm-tables")
    both = summed(1, _fill(coder, looked_up(one, _by_rungs, "u1", neither)), "lm-tables", 2 * PIECES)
    other = both.filter(F.col("bucket") < PIECES)
    add(both.filter(F.col("bucket") >= PIECES))
    add(summed(0, _note(coder, looked_up(other, _by_rungs, "u1", neither)), "lm-notes"))
    mixer = Mixer(looked_up(one.union(other).repartitionById(PIECES, "bucket"), _by_odds, "<i2"))
    mixer.learn(notes)
    del notes
    kinds = (
        "uid long, doc_id long, held_out boolean, n_bytes long, n_tokens long, n_known long, base double, score double, "
        "bucket int, blob binary"
    )
    scored = stash(rows.mapInArrow(_score(coder, mixer, buckets), kinds), "lm-scored")
    asked = scored.filter("bucket IS NOT NULL").select("bucket", "blob", F.lit(False).alias("counts"))
    known = counts.select("bucket", "blob", F.lit(True).alias("counts"))
    met = asked.union(known).repartitionById(buckets, "bucket")
    met = met.mapInArrow(_answer, "uid long, more_known long, more_base double")
    more = met.groupBy("uid").agg(F.sum("more_known").alias("more_known"), F.sum("more_base").alias("more_base"))
    out = scored.filter("bucket IS NULL").join(more, "uid", "left")
    scale = F.lit(math.log10(tokens + words + 1))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0)) - F.col("n_tokens") * scale).alias("base_score"),
        "score",
        (F.when(F.col("n_bytes") > 0, F.col("score") / F.col("n_bytes")) * (-math.log2(10))).alias("bits_per_byte"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
