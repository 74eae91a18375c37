"""The operators against brute force, and on nulls, empty tables, repeated rows, very
long texts and extra columns."""

import bisect
import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rookery.llm import (
    jpeg,
    lm_scoring,
    media,
    mixing,
    near_dedup,
    neighbours,
    packing,
    registry,
    sharding,
    suffix_dedup,
    token_files,
    tokens,
    toxicity,
)
from rookery.llm.common import shared_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k long, size int, score string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus():
    r = random.Random(3)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(400)]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage, base = say(60), say(120)
    texts = [say(r.randint(1, 200)) for _ in range(30)]
    texts += [f"{say(20)} {passage} {say(20)}" for _ in range(5)]
    for i in range(4):
        near = base.split()
        near[10 + i] = f"other{i}"
        texts.append(" ".join(near))
    texts += [base, base, "", None, "ab " * 300, "é" * 120, "  \n\t ", "x", say(6000), "<|endoftext|> a b", say(3) + "\x00\x1c z"]
    rows = [(i, t, "en", ["a", "b", None, "c"][i % 4], 0, 7, 1, "s") for i, t in enumerate(texts)]
    return rows + [(None, say(40), None, None, None, None, None, None), rows[3], rows[3]]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "d")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def none(docs):
    return docs.filter("false")


def raw(t):
    return (t or "").encode()


def distinct_rows(rows):
    return list(dict.fromkeys(rows))


def test_op1_against_brute_force(spark, docs, none, rows):
    key = lambda x: (x[0] is not None, x[0] or 0)
    seen, want = set(), {}
    for d in sorted(distinct_rows(rows), key=key):
        b = raw(d[1])
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            w = b[p : p + 100]
            if w in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(w)
        spans = sum(gone[i] and (i == 0 or not gone[i - 1]) for i in range(len(b)))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        want[d[0]] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    got = suffix_dedup.dedup(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want[r["doc_id"]]
    assert suffix_dedup.dedup(none).count() == 0
    short = suffix_dedup.shorten(docs).collect()
    assert Counter(r[:1] + r[2:4] + r[5:] for r in short) == Counter(r[:1] + r[2:4] + r[5:] for r in rows)
    for r in short:
        if r["text"] is not None and r["text"].isascii():
            assert hashlib.sha256(r["text"].encode()).hexdigest() == want[r["doc_id"]][3]


def test_op1_columns_of_any_name(spark):
    r = random.Random(2)
    text = "".join(r.choice("abcd") for _ in range(150))
    rows = [(1, text, 7777, 5, 6, 7, 8, 9), (-(1 << 63), text + "!", 1, 2, 3, 4, 5, 6), (2, None, 1, 2, 3, 4, 5, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k long, h long, z long, spans long, `a b` long, row long")
    got = {r[0]: r for r in suffix_dedup.shorten(docs).collect()}
    assert [got[r[0]][2:] for r in rows] == [r[2:] for r in rows]
    assert [got[i][1] for i in (1, -(1 << 63), 2)] == ["", text + "!", None]
    assert {r["doc_id"]: r["n_removed"] for r in suffix_dedup.dedup(docs).collect()} == {1: len(text), -(1 << 63): 0, 2: 0}


def test_op1_few_long_documents_make_many_ranges(spark, monkeypatch):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    passage = " ".join(word() for _ in range(40))
    texts = [" ".join(word() for _ in range(3000)) + passage for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    total = sum(map(len, texts))
    monkeypatch.setattr(suffix_dedup, "RANGE_BYTES", total // 64)
    rows = suffix_dedup.keyed(docs)
    cuts = suffix_dedup.splitters_of(rows, total, 64, 100)
    assert len(cuts) > 50
    a, _, _, prints = suffix_dedup.anchors(np.frombuffer("".join(texts).encode(), np.uint8), np.array([total]))
    strings = sorted(map(bytes, suffix_dedup._strings(np.frombuffer("".join(texts).encode(), np.uint8), a, prints)))
    at = [0, *(bisect.bisect_left(strings, c) for c in cuts), len(strings)]
    assert max(j - i for i, j in itertools.pairwise(at)) < 5 * len(strings) / 64
    got = {x["doc_id"]: x["n_removed"] for x in suffix_dedup.dedup(docs).collect()}
    assert got[0] == 0 and all(got[d] >= len(passage) for d in range(1, 40))
    # fewer strings than ranges: all of them cut
    few = spark.createDataFrame([(1, texts[0][:3000])], "doc_id long, text string")
    assert 0 < len(suffix_dedup.splitters_of(suffix_dedup.keyed(few), 3000, 64, 100)) < 64


def test_op1_merge_is_a_sort():
    r = random.Random(1)
    runs = []
    for n in (0, 5, 40, 1, 17):
        strings = sorted(bytes(r.choice(b"ab") for _ in range(suffix_dedup.WIDTH)) for _ in range(n))
        lcp = [0] + [next((i for i in range(suffix_dedup.WIDTH) if a[i] != b[i]), suffix_dedup.WIDTH) for a, b in itertools.pairwise(strings)]
        runs.append((b"".join(strings), lcp[:n]))
    out = [runs[w][0][i * suffix_dedup.WIDTH : (i + 1) * suffix_dedup.WIDTH] for _, w, i in suffix_dedup.merge(runs)]
    shared = [s for s, _, _ in suffix_dedup.merge(runs)]
    assert out == sorted(out) and len(out) == 63
    for n, (a, b) in enumerate(itertools.pairwise(out)):
        assert shared[n + 1] == next((i for i in range(suffix_dedup.WIDTH) if a[i] != b[i]), suffix_dedup.WIDTH)


def test_op2_links(spark, docs, none, rows):
    got = {r["k"]: r["root"] for r in near_dedup.classes(docs).collect()}
    assert set(got) == {r[0] for r in rows}
    sets = {}
    for r in rows:
        w = WORD.findall((r[1] or "").lower())
        sets[r[0]] = Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))
    same = lambda a, b: sum((a & b).values()) / sum((a | b).values())
    for a, b in itertools.combinations(sets, 2):
        j = same(sets[a], sets[b])
        if j >= 0.9:
            assert got[a] == got[b]
        if j < 0.3 and sets[a] and sets[b] and got[a] == got[b]:
            raise AssertionError((a, b, j))
    assert near_dedup.classes(none).count() == 0
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(got.values()))


def test_op2_null_and_repeated_ids(spark):
    r = random.Random(21)
    words = [f"w{i}" for i in range(3000)]
    say = lambda: " ".join(r.choice(words) for _ in range(60))
    texts = [say() for _ in range(12)]
    near = " ".join(["other", *texts[11].split()[1:]])
    pairs = [(None, t) for t in texts[:5]] + [(7, t) for t in texts[5:8]] + [(8, texts[8]), (8, texts[8])]
    pairs += [(None, texts[9]), (9, texts[9]), (7, texts[11]), (10, near)]
    kept = near_dedup.keep_one(spark.createDataFrame([(i, t, "en", "a", 0, 0, 0, "") for i, t in pairs], SCHEMA)).collect()
    want = [(None, t) for t in texts[:5]] + [(7, t) for t in texts[5:8]] + [(8, texts[8]), (9, texts[9]), (7, texts[11])]
    assert Counter((x["doc_id"], x["text"]) for x in kept) == Counter(want)


def test_op2_hot_bucket(spark):
    # a passage of all texts fills most samples: many pairs meet only in buckets that all share
    r = random.Random(31)
    words = [f"w{i}" for i in range(5000)]
    say = lambda n: [r.choice(words) for _ in range(n)]
    passage, rows = say(880), []
    for i in range(100):
        own = say(60)
        rows += [passage + own, passage + own[:35] + say(25)]
    docs = spark.createDataFrame([(k, " ".join(t), "en", "a", 0, 0, 0, "") for k, t in enumerate(rows)], SCHEMA)
    root = {x["k"]: x["root"] for x in near_dedup.classes(docs).collect()}
    weights = near_dedup.weigh(near_dedup.keyed(docs))
    same = lambda a, b: near_dedup.similarity(" ".join(rows[a]).encode(), " ".join(rows[b]).encode(), weights)
    pairs = [k for k in range(0, 200, 2) if same(k, k + 1) >= 0.8]
    assert len(pairs) > 80 and same(0, 2) < 0.75
    assert [k for k in pairs if root[k] != root[k + 1]] == []
    assert len(set(root.values())) >= 100


def test_op2_frequencies_are_exact(spark):
    # shingles of 1 to 9 of 400 documents, none common, each by its own frequency
    r = random.Random(41)
    texts = [" ".join(f"w{r.randrange(10**6)}" for _ in range(30)) for _ in range(400)]
    for n in range(1, 10):
        for i in range(n):
            texts[20 * n + i] += f" q{n} q{n}a q{n}b q{n}c q{n}d"
    docs = spark.createDataFrame([(i, t, "en", "a", 0, 0, 0, "") for i, t in enumerate(texts + [None])], SCHEMA)
    counts = Counter()
    held = [near_dedup.shingle_hashes([t.encode()])[0].tolist() for t in texts]
    for x in held:
        counts.update(x)
    documents, found = near_dedup.sketched(near_dedup.keyed(docs))
    assert documents == 401
    for row in found.filter("id < 400").collect():
        df = np.frombuffer(zlib.decompress(row["df"]), np.uint32).tolist()
        assert df == [counts[x] for x in held[row["id"]]]
    weights = near_dedup.weigh(near_dedup.keyed(docs))
    x = np.array([near_dedup.shingle_hashes([f"q{n} q{n}a q{n}b q{n}c q{n}d".encode()])[0][0] for n in range(1, 10)])
    assert np.allclose(weights(x, np.ones(9)), 1 + np.log10(402 / (np.arange(1, 10) + 1)))


def test_op2_components(spark):
    r = random.Random(43)
    links = [(k, k + 1) for k in range(100, 130)] + [(200 + r.randrange(9), 300 + k) for k in range(90)]
    links += [(r.randrange(400, 600), r.randrange(400, 600)) for _ in range(60)]
    root = {k: k for e in links for k in e}
    for _ in root:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    got = near_dedup.components(spark.createDataFrame([(min(e), max(e)) for e in links if e[0] != e[1]], "a long, b long"))
    want = {k: v for k, v in root.items() if any(k in e and e[0] != e[1] for e in links)}
    assert {x["k"]: x["root"] for x in got.collect()} == want


def test_op2_sampling_follows_weighted_jaccard():
    r = np.random.default_rng(2)
    x = np.unique(r.integers(1, 1 << 62, 600, dtype=np.int64)).astype(np.uint64)
    a, b = x[:500], np.concatenate((x[:400], x[500:]))
    s = near_dedup.Sampler(2000)
    va, vb = r.random(len(a)) * 3 + 0.2, r.random(len(b)) * 3 + 0.2
    vb[:400] = va[:400]
    wa, wb = dict(zip(a.tolist(), va)), dict(zip(b.tolist(), vb))
    j = sum(min(wa.get(k, 0), wb.get(k, 0)) for k in wa | wb) / sum(max(wa.get(k, 0), wb.get(k, 0)) for k in wa | wb)
    z = np.zeros(1, np.int64)
    agree = (s(a, va, z)[0] == s(b, vb, z)[0]).mean()
    assert abs(agree - j) < 0.05


def encoded(name, t):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(tokens.tokenizer_path(name)).encode(t or "", add_special_tokens=False).ids, 0]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op3_packs_every_piece_once(spark, docs, none, rows):
    got = packing.pack(docs).collect()
    want = Counter()
    for r in rows:
        ids = encoded("word_bpe_49k.json", r[1])
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want[(r[0], k, at, len(part), crc(part))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
    least = math.ceil(sum(r["length"] for r in got) / 2048)
    assert len(by) <= least + 1
    assert packing.pack(none).count() == 0


def test_op3_plan_uses_all_lengths():
    r = random.Random(5)
    counts = dict(Counter(r.randint(1, 2047) for _ in range(5000)))
    plan = packing.plan(counts)
    used = Counter()
    for times, lengths in plan:
        assert sum(lengths) <= 2048
        for x in lengths:
            used[x] += times
    assert used == Counter(counts)
    # a heuristic: half a percent above the bound at most (7 in 2,481 here)
    assert sum(t for t, _ in plan) <= 1.005 * martello_toth(counts, 2048)


def martello_toth(counts, size):
    """A lower bound on bins: long pieces stand apart, and what the others need
    beyond the room beside them."""
    best = 0
    for k in range(size // 2 + 1):
        long = sum(n for x, n in counts.items() if x > size - k)
        half = {x: n for x, n in counts.items() if size // 2 < x <= size - k}
        small = sum(x * n for x, n in counts.items() if k <= x <= size // 2)
        room = sum((size - x) * n for x, n in half.items())
        best = max(best, long + sum(half.values()) + max(0, math.ceil((small - room) / size)))
    return best


def test_op4_round_trip(spark, docs, none, rows):
    got = {}
    for r in media.features(media.store(docs)).collect():
        got[r["doc_id"]] = r
    for d in rows:
        p = media.padded(raw(d[1]))
        r = got[d[0]]
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw(d[1])), len(p)) and len(p) % 64 == 0 and p
        assert r["payload_sha256"] == hashlib.sha256(p).hexdigest() and r["tail_crc32"] == zlib.crc32(p[-64:])
    assert media.features(media.store(none)).count() == 0
    t = media.tensors(media.store(docs.limit(3))).first()
    assert len(t["rgb"]) == t["height"] * t["width"] * 3


def test_op4_jpeg_of_any_coefficients():
    r = np.random.default_rng(1)
    parts = (jpeg.Part(2, 2, 0), jpeg.Part(1, 1, 0), jpeg.Part(1, 1, 0))
    frames = [jpeg.Frame(w, h, parts) for w, h in ((40, 24), (17, 9), (16, 16))]
    n = sum(f.blocks for f in frames)
    c = (r.integers(-9, 10, (n, 64)) * (r.random((n, 64)) < 0.97)).astype(np.int32)
    c[:, 0] = r.integers(-900, 900, n)
    c[1, 1:] = 0
    _, d, bases = jpeg.decode(jpeg.encode(frames, c, [b""] * 3))
    for f, base in zip(frames, bases):
        for i in range(3):
            at = base + f.order((i,))[0]
            assert (c[at] == d[at]).all()


def test_op4_flat_image():
    f = jpeg.Frame(16, 16, (jpeg.Part(2, 2, 0), jpeg.Part(1, 1, 0), jpeg.Part(1, 1, 0)))
    c = np.zeros((f.blocks, 64), np.int32)
    c[:4, 0] = 8 * 20  # luminance 128 + 20, no chroma
    images, d, bases = jpeg.decode(jpeg.encode([f], c, [b""]))
    rgb = jpeg.rgb(images[0], jpeg.samples(images, d, bases))
    assert rgb.shape == (16, 16, 3) and (rgb == 148).all()


def test_op5_reads_back(spark, docs, none, rows):
    path = shared_path(spark, "t")
    token_files.write_tokens(docs, path)
    got = token_files.read_manifest(spark, path).collect()
    want = Counter((r[0], len(i := encoded("byte_bpe_50k.json", r[1])), crc(i)) for r in rows)
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
    path = shared_path(spark, "t")
    token_files.write_tokens(none, path)
    assert token_files.read_manifest(spark, path).count() == 0


def test_op6_budgets(spark, docs, none, rows):
    got = mixing.mix(docs).collect()
    size = defaultdict(int)
    for r in rows:
        size[r[3]] += len(WORD.findall(r[1] or ""))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, free = {}, 1.5 * sum(size.values()), set(names)
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * size[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * size[s]
            left -= target[s]
        free -= over
    taken = defaultdict(int)
    for r in got:
        assert r["source_size"] == size[r["source"]] and math.isclose(r["target"], target[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in names)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))
    assert mixing.mix(none).count() == 0
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    words = defaultdict(int)
    for r in mixed.collect():
        words[r["source"]] += len(WORD.findall(r["text"]))
    assert words == {s: n for s, n in taken.items() if n}


def test_op6_rows_that_share_an_id(spark):
    rows = [(i % 2, f"a{i} b c d", "x", "en", i, i, i) for i in range(7)] + [(None, f"n{i} b", "x", "en", i, i, i) for i in range(6)]
    rows += [(9, "p q r", "y", "en", 1, 2, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, _id long, size long, id long")
    plan = mixing.mix(docs).groupBy("source").agg(F.sum("taken")).collect()
    got = defaultdict(int)
    for r in mixing.mixed(docs).collect():
        got[r["source"]] += len(r["text"].split())
        assert r["_id"] == r["size"] == r["id"] or r["source"] == "y"
    assert got == dict(map(tuple, plan))


def test_op7_learns_the_lexicon(spark, none):
    r = random.Random(8)
    words = ["".join(r.choice("klmnoprst") for _ in range(5)) for _ in range(300)]
    bad = ["vile", "nasty", "horrid"]
    rows, labels = [], []
    for i in range(600):
        toxic = int(i % 5 == 0)
        t = [r.choice(words) for _ in range(30)] + ([r.choice(bad) for _ in range(4)] if toxic else [])
        rows.append((i, " ".join(t), "en", "a", 0, 0, 0, ""))
        labels.append((i, 1, toxic))
    rows += [(1000, None, "en", "a", 0, 0, 0, ""), (1001, "", "en", "a", 0, 0, 0, ""), rows[0]]
    docs = spark.createDataFrame(rows, SCHEMA)
    known = spark.createDataFrame(labels + [(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.score(docs, known).collect()
    assert len(got) == len(rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in got)
    right = [r["predicted"] == int(r["doc_id"] % 5 == 0) for r in got if r["doc_id"] < 600 and r["held_out"]]
    assert sum(right) / len(right) > 0.95
    assert {r["predicted"] for r in got if r["doc_id"] >= 1000} == {0}
    assert toxicity.score(docs, known.filter("false")).agg(F.max("score")).first()[0] == 0
    assert toxicity.score(none, known).count() == 0
    assert toxicity.reject(docs, known).columns == docs.columns


def test_op7_rare_telling_words_count(spark):
    r = random.Random(12)
    words = ["".join(r.choice("klmnoprst") for _ in range(5)) for _ in range(300)]
    bad = ["".join(r.choice("uvwxyz") for _ in range(6)) for _ in range(200)]
    texts = [[r.choice(words) for _ in range(30)] + (r.sample(bad, 4) if i % 5 == 0 else []) for i in range(600)]
    docs = spark.createDataFrame([(i, " ".join(t), "en", "a", 0, 0, 0, "") for i, t in enumerate(texts)], SCHEMA)
    known = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(600)], "doc_id long, quality int, toxic int")
    got = [r for r in toxicity.score(docs, known).collect() if r["held_out"]]
    toxic = [r["predicted"] for r in got if r["doc_id"] % 5 == 0]
    clean = [r["predicted"] for r in got if r["doc_id"] % 5]
    assert sum(toxic) > 0.7 * len(toxic) and sum(clean) < 0.05 * len(clean)


def test_op7_copies_are_one_example(spark):
    rows = [(i, "same text" if i < 30 else f"text number {i}", "en", "a", 0, 0, 0, "") for i in range(90)]
    known = spark.createDataFrame([(i, 1, 1) for i in range(90)], "doc_id long, quality int, toxic int")
    drawn, totals = toxicity.examples(spark.createDataFrame(rows, SCHEMA), known)
    assert len({t for t, _, _ in drawn}) == len(drawn) == totals[1]


def test_op7_nearest_is_exact():
    r = random.Random(4)
    words = [f"w{i}" for i in range(50)]
    found = [(Counter(r.choices(words, k=r.randint(1, 12))), r.randint(0, 1)) for _ in range(700)]
    m = toxicity.Memory(found, 700, {w: 20 + i for i, w in enumerate(words)}, Counter(y for _, y in found))
    for _ in range(30):
        ids, w = m.vector(Counter(r.choices(words, k=8)))
        q = dict(zip(ids.tolist(), w))
        dense = [sum(q.get(i, 0) * x for i, x in zip(o[0].tolist(), o[1])) for o in m.own]
        want = sorted(((-s, e) for e, s in enumerate(dense) if s > 0))[: toxicity.NEAREST]
        got = m.nearest(ids, w)
        assert np.allclose([s for s, _ in got], [-s for s, _ in want])


def test_op8_slots(spark, docs, none, rows):
    got = sharding.shard(docs, shards=5, slots=64).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter(
        (r[0], len(raw(r[1])) + 16, zlib.crc32(raw(r[1]))) for r in rows
    )
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert sharding.shard(none).count() == 0


def test_op8_law_groups_and_versions(spark):
    r = random.Random(14)
    texts = ["".join(r.choice("abc ") for _ in range(r.randint(10, 400))) for _ in range(3000)]
    texts += [t for t in texts[:200] for _ in range(3)] + ["a hot text " * 20] * 1500
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    path = shared_path(spark, "map")
    first = sharding.shard(docs, shards=8, slots=1024, map_path=path).collect()
    held, at = [0] * 8, defaultdict(set)
    for x in first:
        held[x["shard"]] += x["size"]
        at[texts[x["doc_id"]]].add(x["shard"])
    assert {x["law"] for x in first} == {"bytes"} and max(held) - min(held) < 0.02 * sum(held) / 8
    # equal texts share a shard, but for a group that is larger than one, which is split
    assert {t for t, s in at.items() if len(s) > 1} == {"a hot text " * 20}
    again = sharding.shard(docs, shards=8, slots=1024, map_path=path).collect()
    assert sorted(map(tuple, first)) == sorted(map(tuple, again))
    # rebalancing onto fewer shards edits the map, and no record changes its virtual slot
    placed, split = sharding.read_map(spark, path, 1)
    fewer = sharding.shard(docs, shards=6, slots=1024, map_path=path, previous=placed, split=split, version=2).collect()
    assert {x["doc_id"]: x["virtual_slot"] for x in fewer} == {x["doc_id"]: x["virtual_slot"] for x in first}
    assert max(x["shard"] for x in fewer) == 5 and len(fewer) == len(texts)
    same = {s: k for s, k in sharding.read_map(spark, path, 2)[0].items() if placed[s] == k}
    assert len(same) > 0.6 * 1024


def test_op8_groups_stay_together_in_small_tables(spark, data):
    docs = spark.read.parquet(data.replace("sf0.001", "sf0.01") + "/documents.parquet")
    got = sharding.shard(docs).collect()
    held, groups = Counter(), defaultdict(lambda: [0, 0, set()])
    for x in got:
        held[x["shard"]] += x["size"]
        g = groups[x["text_crc32"]]
        g[0], g[1] = g[0] + 1, g[1] + x["size"]
        g[2].add(x["shard"])
    mean = sum(held.values()) / 40
    several = [g for g in groups.values() if g[0] > 1]
    assert len(several) > 50 and all(len(g[2]) == 1 for g in several if g[1] <= mean)
    largest = max(r["size"] for r in got)
    assert max(held.values()) - mean <= max(0.02 * mean, largest, max(g[1] for g in several) - mean)


def test_op8_rebalance_moves_little():
    r = random.Random(2)
    size = {s: r.randint(1, 1000) for s in range(512)}
    first = sharding.first_map(size, 8, 512)
    held = [sum(size[s] for s in first if first[s] == k) for k in range(8)]
    assert max(held) - min(held) <= 1000
    size[0] += 5000
    then = sharding.rebalance(first, size, 8)
    held = [sum(size[s] for s in then if then[s] == k) for k in range(8)]
    assert max(held) - min(held) < 1500 and sum(first[s] != then[s] for s in first) < 40


def test_op9_against_brute_force(spark):
    r = np.random.default_rng(6)
    centres = r.normal(size=(12, 24)) * 3
    v = (centres[r.integers(0, 12, 1500)] + r.normal(size=(1500, 24))).astype(np.float32)
    v[40:80] = v[40]  # a common vector
    rows = [(i, v[i].tolist(), 0) for i in range(1500)]
    rows += [(1501, None, 0), (1502, [0.0] * 24, 0), (1503, [float("nan")] * 24, 0), (1504, [None] * 24, 0), (1505, [1.0], 0), rows[100]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = defaultdict(list)
    for x in neighbours.search(df, every=50, probed=1.0).collect():
        got[x["query_id"]].append((x["rank"], x["vec_id"], x["score"]))
    d = v.astype(float)
    for q in range(0, 1500, 50):
        far = np.sqrt(((d - d[q]) ** 2).sum(1))
        want = [int(i) for i in np.lexsort((np.arange(1500), far)) if i != q][:10]
        mine = sorted(got[q])
        assert [m[0] for m in mine] == list(range(1, 11))
        assert np.allclose([m[2] for m in mine], far[want], atol=1e-12)
        assert len({m[1] for m in mine} & set(want)) >= 9
    assert sorted(x[1] for x in got[50]) == [i for i in range(40, 51) if i != 50]
    assert neighbours.search(df.filter("false")).count() == 0
    assert neighbours.search(df.filter("vec_id IN (0, 1, 2)")).count() == 2


def test_op9_recall_as_shipped(spark, data):
    path = data.replace("sf0.001", "sf0.1")
    df = spark.read.parquet(f"{path}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.select("vec_id", "embedding").collect()]
    ids, v = np.array([i for i, _ in rows]), np.array([x for _, x in rows], float)
    got = defaultdict(set)
    for x in neighbours.search(df).collect():
        got[x["query_id"]].add(x["vec_id"])
    hits = total = 0
    for q in np.flatnonzero(ids % 100 == 0):
        far = ((v - v[q]) ** 2).sum(1)
        far[q] = np.inf
        want = set(ids[np.lexsort((ids, far))[:10]].tolist())
        hits, total = hits + len(want & got[int(ids[q])]), total + len(want)
    assert total >= 200 and hits >= 0.9 * total


def test_op9_probes_follow_the_structure():
    r = np.random.default_rng(3)
    centres = r.normal(size=(40, 16)) * 20
    v = centres[r.integers(0, 40, 4000)] + r.normal(size=(4000, 16))
    assert neighbours.Space(v, 40).probes(v, 10) < 8
    v = r.normal(size=(4000, 64))
    assert neighbours.Space(v, 40).probes(v, 10) > 15


def test_op10_base_and_distribution(spark, docs, none, rows):
    got = lm_scoring.score(docs).collect()
    fold = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    words = [(r[0], [*WORD.findall(fold(r[1])), None]) for r in rows]
    c = Counter(w for i, ws in words if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    want = Counter()
    for i, ws in words:
        base = sum(math.log10((c[w] + 1) / (n + 1 * (v + 1))) for w in ws)
        want[(i, held(i), len(ws), sum(c[w] > 0 for w in ws), n, round(base, 6))] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    assert lm_scoring.score(none).count() == 0


def model(texts, bits=12):
    """A small model of some texts, fitted on the first of them."""
    raws = [t.encode() for t in texts]
    words, counts = np.unique(lm_scoring.Tokens(raws).w, return_counts=True)
    own = counts > 1
    coder = lm_scoring.Coder(words[own], counts[own], int(counts[~own].sum()), np.ones(257), bits)
    tables = np.zeros((lm_scoring.PIECES, (lm_scoring.PREDICTORS << bits + 1) // lm_scoring.PIECES), np.int32)
    for b in lm_scoring._fill(coder)([pa.RecordBatch.from_arrays([pa.array(raws)], names=["text"])]):
        for k, blob in zip(b.column("bucket").to_pylist(), b.column("blob").to_pylist()):
            tables[k] = lm_scoring._arrays(blob, "<i4")[0]
    mixer = lm_scoring.Mixer(tables.reshape(lm_scoring.PREDICTORS, 1 << bits, 2))
    mixer.fit(lm_scoring.Units([t], coder) for t in raws[:20])
    mixer.correct(mixer.tally(lm_scoring.Units(raws[:20], coder)))
    return coder, mixer


def test_op10_probabilities_sum_to_one():
    r = random.Random(17)
    texts = [" ".join(r.choice("abcdefgh") * r.randint(1, 3) for _ in range(200)) + f" once{i}" for i in range(40)]
    coder, mixer = model(texts)
    start = " ".join(r.choice("abcdefgh") for _ in range(150)).encode()
    known = ["a" * n for n in (1, 2, 3)] + [c * n for c in "bcdefgh" for n in (1, 2, 3)]
    assert set(known) == {w for t in texts for w in t.split() if not w.startswith("once")}

    def last(text, back):  # the probability of a unit, counted from the text's last
        u = lm_scoring.Units([text], coder)
        return math.exp(-mixer.costs(u)[u.count - back])

    # each known word, the escape (before the letter of a new word, its end and the text's), and the end
    total = sum(last(start + b" " + w.encode(), 2) for w in known) + last(start + b" z", 4) + last(start, 1)
    assert math.isclose(total, 1, abs_tol=1e-4)
    # letters: each byte that a word may hold, or the word's end
    z = [bytes([b]) for b in range(256) if b not in b" \t\n\x0b\x0c\r" and not 65 <= b <= 90]
    some = sum(last(start + b" qz" + b, 3) for b in z) + last(start + b" qz", 2)
    blanks = 1 - some  # codes of bytes that no word holds
    assert 0 <= blanks < 0.2


def test_op10_learns():
    r = random.Random(18)
    pairs = [(f"left{i}", f"right{i}") for i in range(50)]
    texts = [" ".join(w for _ in range(30) for w in r.choice(pairs)) for _ in range(120)]
    coder, mixer = model(texts[:100], 18)
    held = [t.encode() for t in texts[100:]]
    scores = mixer.score(lm_scoring.Units(held, coder))
    # a pair costs about its first word, log10 of 50, and not that of both
    assert -1.65 * 30 * math.log10(50) < scores.mean() < -0.95 * 30 * math.log10(50)


def test_op10_weights_learn_from_all_training_texts(spark, monkeypatch):
    r = random.Random(19)
    rows = [(i, " ".join(r.choice("abcdefgh") * r.randint(1, 3) for _ in range(20)) + f" own{i}") for i in range(900)]
    found, note, learn = [], lm_scoring._note, lm_scoring.Mixer.learn
    monkeypatch.setattr(lm_scoring, "_note", lambda coder, rungs: found.append(coder) or note(coder, rungs))
    monkeypatch.setattr(lm_scoring.Mixer, "learn", lambda self, notes: found.append(notes.sum()) or learn(self, notes))
    lm_scoring.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).count()
    train = [t.encode() for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    assert found[-1] == lm_scoring.Units(train, found[0]).size.sum()


def test_op10_counts_blocks_and_not_each_decision():
    # decisions are counted by blocks, equal ones once: their table is that of all decisions
    r = random.Random(20)
    texts = [" ".join(r.choice("abcdefgh") * r.randint(1, 3) for _ in range(n)) + f" own{n}" for n in (0, 1, 30, 300)]
    coder, _ = model(texts)
    raws = [t.encode() for t in texts]
    u = lm_scoring.Units(raws, coder)
    _, bit, slots = u.decisions(slice(None))
    which, path, base = u.blocks(slice(None))
    assert len(which) == sum(-(-int(n) // 4) for n in u.size) < len(bit) / 2
    want = np.stack([np.bincount(s << 1 | bit, minlength=2 << coder.bits) for s in slots])
    got = np.zeros_like(want).reshape(lm_scoring.PIECES, -1)
    for b in lm_scoring._fill(coder)([pa.RecordBatch.from_arrays([pa.array(raws)], names=["text"])]):
        for k, blob in zip(b.column("bucket").to_pylist(), b.column("blob").to_pylist()):
            got[k] = lm_scoring._arrays(blob, "<i4")[0]
    assert (got.reshape(want.shape) == want).all()


def test_op10_scores_do_not_depend_on_neighbours(monkeypatch):
    # lanes go from one text to the next, whose refinements begin anew
    r = random.Random(21)
    texts = [" ".join(r.choice("abcdefgh") * r.randint(1, 3) for _ in range(r.choice((0, 5, 90, 700)))) for _ in range(60)]
    coder, mixer = model(texts, 14)
    raws = [t.encode() for t in texts]
    alone = np.array([mixer.score(lm_scoring.Units([t], coder))[0] for t in raws])
    monkeypatch.setattr(lm_scoring, "LANES", 7)
    parts = [lm_scoring.Units(raws[i : i + 25], coder) for i in (0, 25, 50)]
    assert np.allclose(mixer.score(lm_scoring.Units.joined(parts)), alone, rtol=1e-5)
    seen = [(at, size) for _, _, at, size in lm_scoring.turns(lm_scoring.Units(raws, coder).first)]
    assert all(len(at) <= 7 for at, _ in seen) and sum(int(n.sum()) for _, n in seen) == lm_scoring.Units(raws, coder).count


@pytest.mark.parametrize("ids", [[0], [2], [0, 2]])
def test_op10_few_training_texts(spark, ids):
    # the end is seen once or never, and is not spelled like a rare word
    ids = [next(i for i in range(99) if (zlib.crc32(str(i).encode()) % 7 == 2) == bool(k)) for k in ids]
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in ids}
    docs = spark.createDataFrame([(i, "one two one") for i in ids], "doc_id long, text string")
    got = lm_scoring.score(docs).collect()
    c = Counter(w for i in ids if not held[i] for w in ["one", "two", "one", None])
    n, v = sum(c.values()), len(c)
    base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ["one", "two", "one", None])
    assert sorted(r["doc_id"] for r in got) == sorted(ids)
    for r in got:
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (4, 4 if n else 0, n)
        assert math.isclose(r["base_score"], base, abs_tol=1e-9) and r["score"] < 0


def test_op10_learns_from_notes():
    # of two predictors that say the same by turns, the one that is right is told by all notes
    notes = np.zeros((lm_scoring.GATES, *[len(lm_scoring.RUNGS)] * lm_scoring.PREDICTORS, 2), np.int64)
    notes[3, 9, 3, 6, 6] = 1000, 9000
    notes[3, 3, 9, 6, 6] = 9000, 1000
    mixer = lm_scoring.Mixer(np.zeros((lm_scoring.PREDICTORS, 1 << 14), np.int16))
    mixer.learn(notes)
    assert mixer.weights[3, 0] - mixer.weights[3, 1] > 0.6 and abs(mixer.weights[4, 0] - 0.3) < 1e-6
    p = 1 / (1 + math.exp(-3 * (mixer.weights[3, 0] - mixer.weights[3, 1])))
    assert abs(p - 0.9) < 0.02


def test_op10_codes_are_prefix_free():
    sizes = lm_scoring.code_lengths(np.array([5.0, 1, 1, 2, 9, 0.5]))
    codes = {bin(c)[3:] for c in lm_scoring.canonical(sizes).tolist()}
    assert len(codes) == 6 and math.isclose(sum(2.0**-x for x in sizes), 1)
    assert sorted(map(len, codes)) == sorted(sizes.tolist())
    assert not any(a != b and b.startswith(a) for a in codes for b in codes)


def test_words_of_swapped_blocks_differ():
    a, b = "x" * 256, "y" * 256
    w, _ = near_dedup.word_hashes([f"{a}{b}z {b}{a}z {a}{b}z".encode()])
    assert w[0] != w[1] and w[0] == w[2]


def test_chunks_equal_the_tokenizer():
    texts = ["Foo's bar, baz.\n\n  Qux--é ñ 12ab", "a<|endoftext|>b", " x　y\x1cz  ", "İstanbul ΣΑΣ. éa", "", "it's 'twas I'll", "tab\t\tx \n"]
    for name, pattern in (("byte_bpe_50k.json", tokens.BYTE_LEVEL), ("word_bpe_49k.json", tokens.WORD_LEVEL)):
        e = tokens.encoder(tokens.tokenizer_path(name), pattern)
        for t in texts:
            assert np.frombuffer(e.encode(t), "<u4").tolist() == encoded(name, t)[:-1], (name, t)


def test_registry_names():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries()) == list(range(1, 11))
    assert set(registry.oracle_sql()) <= set(registry.queries())


def brute_links(texts):
    """Whether texts are copies or share 0.8 of their five-word shingles, by plain counts."""
    bags = []
    for t in texts:
        w = WORD.findall((t or "").lower())
        bags.append(Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))))
    return lambda a, b: sum((bags[a] & bags[b]).values()) / sum((bags[a] | bags[b]).values())


def test_pipeline_against_brute_force(spark, docs, none, rows):
    import corpus_pipeline as p

    labels = [(r[0], 1, int(r[0] % 9 == 0)) for r in rows if r[0] is not None][:40]
    folder = shared_path(spark, "labels")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    stage = dict(p.STAGES)
    clean = stage["toxicity"](spark, docs, folder)
    want = [r for r in toxicity.score(docs, spark.read.parquet(f"{folder}/labels.parquet")).collect() if r["score"] < 0.7]
    assert clean.columns == docs.columns and Counter(r["doc_id"] for r in clean.collect()) == Counter(r["doc_id"] for r in want)

    one = stage["minhash_near_dedup"](spark, docs, folder).collect()
    kept = [tuple(r) for r in one]
    assert set(kept) <= set(rows) and len(set(kept)) == len(kept)
    texts = [r[1] for r in kept] + [r[1] for r in rows]
    same = brute_links(texts)
    assert all(same(i, j) < 0.8 for i, j in itertools.combinations(range(len(kept)), 2))
    for j in range(len(kept), len(texts)):  # what went is like something that stayed
        assert max(same(i, j) for i in range(len(kept))) > 0.7

    short = {r["doc_id"]: r["text"] for r in stage["suffix_dedup"](spark, docs, folder).collect()}
    seen = set()
    for d in sorted(distinct_rows(rows), key=lambda x: (x[0] is not None, x[0] or 0)):
        b = raw(d[1])
        gone = bytearray(len(b))
        for at in range(len(b) - 99):
            if b[at : at + 100] in seen:
                gone[at : at + 100] = b"\1" * 100
            seen.add(b[at : at + 100])
        left = bytes(c for c, g in zip(b, gone) if not g).decode("utf-8", "ignore")
        assert short[d[0]] == (None if d[1] is None else left)

    packed = stage["best_fit_packing"](spark, stage["source_mixing"](spark, docs, folder), folder).collect()
    tokens_of = Counter()
    for r in stage["source_mixing"](spark, docs, folder).collect():
        tokens_of[r["doc_id"]] += len(encoded("word_bpe_49k.json", r["text"]))
    assert Counter({d: n for d, n in tokens_of.items()}) == sum((Counter({r["doc_id"]: r["length"]}) for r in packed), Counter())

    # an empty table, and columns of names that stages use themselves
    for _, run in p.STAGES:
        assert run(spark, none, folder).count() == 0
    named = docs.withColumnsRenamed({"k": "node", "size": "row", "score": "left"})
    for name in ("toxicity", "minhash_near_dedup", "suffix_dedup", "source_mixing"):
        assert stage[name](spark, named, folder).columns == named.columns
        assert stage[name](spark, named, folder).count() > 0


def test_pipeline_runs(spark, data):
    import corpus_pipeline as p

    out = p.run(spark, data)
    assert {"sequence_id", "offset"} <= set(out.columns) and out.count() > 0
    fill = out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert fill.filter("n <> end OR n > 2048").count() == 0
