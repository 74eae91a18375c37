"""Manifest, quality classifier and source divergence against brute force, and on nulls,
empty and long texts, ties, repeated rows, empty tables and extra columns."""

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

from rookery.llm import divergence, merkle, quality, registry, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, g string, idx long, h long, label int"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def corpus(n=130):
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 6))) for _ in range(90)]
    say = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    texts = [say(r.randint(1, 60)) for _ in range(n)] + ["", None, "É Ab,cD\x00éß 日本", "x" * 5000, say(30000), "A" + say(3), "1234 !!"]
    rows = [(i, t, ["en", "de", None, "zz"][i % 4 if i % 9 else 0], ["a", "b", None][i % 3], len(t or "") if i % 5 else None, "=en", 3, 4, 5) for i, t in enumerate(texts)]
    rows += [(None, say(20), None, None, None, None, None, None, None), rows[3], rows[3], (7, "other text", "en", "a", 1, None, None, None, None), (-5, "one", "alone", "a", 3, None, None, None, None)]
    r.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "d")
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(path)
    return spark.read.parquet(path)


# -- manifest -------------------------------------------------------------------------


def leaf_of(row, text):
    doc_id, _, lang, source, n_chars = row[:5]
    fields = [None if v is None else str(v) for v in (doc_id, source, lang, n_chars, text)]
    return H(*("-" if v is None else f"{len(v.encode())}:{v}" for v in fields))


def tree(leaves, fanout=8):
    """All levels, from the leaves up to the root."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + fanout]) for i in range(0, len(levels[-1]), fanout)])
    return levels


def path(levels, i, fanout=8):
    for level in levels[:-1]:
        at = i // fanout * fanout
        yield level[at:i], level[i + 1 : at + fanout]
        i //= fanout


def lower(t):
    return None if t is None else re.sub("[A-Z]", lambda m: m[0].lower(), t)


def expected(rows, fanout=8):
    langs = defaultdict(list)
    for r in rows:
        touched = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
        leaf = leaf_of(r, r[1])
        langs[r[2]].append((r[0] is not None, r[0] or 0, leaf, leaf_of(r, lower(r[1])) if touched else leaf, r[0]))
    names = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for n in names:
        langs[n].sort()
        trees[n] = tree([x[2] for x in langs[n]], fanout)
    top = tree([trees[n][-1][0] for n in names], fanout)
    out = []
    for t, n in enumerate(names):
        for i, (_, _, leaf, seen, doc_id) in enumerate(langs[n]):
            steps = [*path(trees[n], i, fanout), *path(top, t, fanout)]
            h = seen
            for left, right in steps:
                h = H(*left, h, *right)
            proof = H(*itertools.chain(*(a + b for a, b in steps)))
            out.append((doc_id, leaf, trees[n][-1][0], top[-1][0], proof, h, h == top[-1][0]))
    return Counter(out)


def touched(text="text"):
    low = merkle.leaf(F.translate(text, merkle.UPPER, merkle.UPPER.lower()))
    return F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, low)


@pytest.mark.parametrize("fanout, range_rows", [(8, 100_000), (3, 20)])
def test_op11_against_brute_force(docs, rows, fanout, range_rows):
    got = merkle.verify(docs, touched(), fanout=fanout, range_rows=range_rows)
    columns = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert got.columns == columns
    found = Counter(map(tuple, got.collect()))
    assert found == expected(rows, fanout)
    assert {r[-1] for r in found} == {True, False}


@pytest.mark.parametrize("n", [1, 7, 8, 9, 64, 65])
def test_op11_sizes_of_one_lang(spark, n):
    rows = [(i, f"Text {i}", "en", "a", 1) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert Counter(map(tuple, merkle.verify(docs, touched(), range_rows=5).collect())) == expected(rows)


def test_op11_many_langs_and_none(spark, docs):
    rows = [(i, "T", f"l{i:02d}", "a", 1) for i in range(20)]
    many = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert Counter(map(tuple, merkle.verify(many, touched()).collect())) == expected(rows)
    none = docs.filter("false")
    assert merkle.verify(none, touched()).count() == 0
    assert merkle.build(none).root() is None


def test_op11_manifest_is_of_content_not_of_partitions(docs):
    a, b = merkle.build(docs), merkle.build(docs.repartition(9), range_rows=11)
    assert a.root() == b.root()
    # what every range has left open is little, and all of it is merged
    open_nodes = b.nodes.filter("open").groupBy("level").count().collect()
    assert all(r["count"] <= 14 * 60 for r in open_nodes)
    changed = docs.withColumn("text", F.when(F.col("doc_id") == 9, "other").otherwise(F.col("text")))
    assert merkle.build(changed).root() != a.root()


def test_peaks_carry_like_digits():
    peaks = merkle.Peaks(2)
    for i in range(3, 9):  # 3 is unaligned, 4-7 complete a node of two levels, 8 is left
        peaks.push("x", i, (f"{i}", i, None))
    peaks.flush()
    done = [(level, idx) for _, level, idx, _, _, _, _, open_ in peaks.out if not open_]
    left = [(level, idx) for _, level, idx, _, _, _, _, open_ in peaks.out if open_]
    assert done == [(1, 2), (1, 3), (2, 1)] and left == [(0, 3), (2, 1), (0, 8)][:1] + left[1:]
    assert set(left) == {(0, 3), (2, 1), (0, 8)}


# -- quality --------------------------------------------------------------------------


def labelled(spark, n=240):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9)))
    kinds = [
        lambda k: " ".join(word() + r.choice(["", "", ",", "."]) for _ in range(k)),
        lambda k: " ".join(word().upper() + "!!" for _ in range(k)),
        lambda k: " ".join(word() + "&&&" for _ in range(k)),
        lambda k: " ".join([word()] * k),
    ]
    rows, labels = [], []
    for i in range(n):
        kind = r.choice([0, 0, 0, 1, 2, 3])
        rows.append((i, kinds[kind](r.randint(8, 80)), "en", "a", 0, None, None, None, None))
        labels.append((i, int(kind == 0), 0))
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), dict((x[0], x[1]) for x in labels)


def test_op12_held_out_accuracy(spark):
    docs, labels, truth = labelled(spark)
    got = quality.classify(docs, labels).collect()
    assert len(got) == len(truth)
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1}
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)


def test_op12_learns_from_its_part_only(spark):
    docs, labels, _ = labelled(spark)
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    key = lambda df: sorted((r["doc_id"], r["score"]) for r in df.collect())
    assert key(quality.classify(docs, labels)) == key(quality.classify(docs.withColumn("lang", F.lit("x")).repartition(7), flipped))


def test_op12_odd_rows(spark, docs, rows):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(100)] + [(3, 0, 1), (5, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, labels).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    assert all(not math.isnan(r["score"]) for r in got)
    assert [r["held_out"] for r in got if r["doc_id"] is None] == [False]
    none = quality.classify(docs, labels.filter("false")).collect()
    assert {r["score"] for r in none} == {0.5} and len(none) == len(rows)
    assert quality.classify(docs.filter("false"), labels).count() == 0


def test_op12_score_is_a_sparse_dot_product():
    texts = ["Aa bb, bb", "", "ÉÉ 12 !! x x x", " "]
    weights = np.random.default_rng(1).normal(size=(1 << 10) + 1)
    grams, lengths = quality.features(pa.array(texts), 10)
    want, at = [], 0
    for n in lengths:
        counts = Counter(grams[at : at + n].ravel().tolist())
        at += n
        want.append(1 / (1 + math.exp(-(weights[-1] + sum(weights[b] * c / n for b, c in counts.items())))))
    assert np.allclose(quality.scored(pa.array(texts), weights), want)
    assert list(lengths) == [5, 1, 7, 1]  # tokens, and an end


def test_op12_learner_separates():
    leader = quality.Leader.fresh(4)
    for _ in range(50):
        leader.learn(np.array([1, 16]), np.array([1.0, 1.0]), 1)
        leader.learn(np.array([2, 16]), np.array([1.0, 1.0]), 0)
    w = leader.weights()
    assert w[1] > 1 and w[2] < -1 and not w[3:16].any()


# -- divergence -----------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def audit_of(rows, least):
    terms = [(r[2] or "", r[3] or "", TERM.findall(lower(r[1] or ""))) for r in rows]
    groups = {(lang, s) for lang, s, _ in terms}
    out = set()
    for lang in {g[0] for g in groups}:
        held, counts, total = Counter(), defaultdict(Counter), Counter()
        for _, s, t in (x for x in terms if x[0] == lang):
            held.update(set(t))
            counts[s].update(t)
            total.update(t)
        kept = sorted(t for t, n in held.items() if n >= least)
        v = len(kept)

        def p(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * v) for t in kept}

        q, own = p(total), {s: p(counts[s]) for _, s in (g for g in groups if g[0] == lang)}
        for s in own:
            pairs = sorted(((-sum(abs(own[s][t] - own[o][t]) for t in kept), o.encode(), o) for o in own if o != s))
            out |= {(lang, s, "pair", o, -d, i) for i, (d, _, o) in enumerate(pairs, 1)}
            more = sorted((q[t] - own[s][t], t.encode(), t) for t in kept if counts[s][t] and own[s][t] > q[t])
            out |= {(lang, s, "term", t, -d, i) for i, (d, _, t) in enumerate(more[:50], 1)}
    return out


@pytest.mark.parametrize("least", [1, 6, 30, 10_000])
def test_op13_against_brute_force(docs, rows, least):
    got = divergence.audit(docs, least=least)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == audit_of(rows, least)


def test_op13_empty_and_without_terms(spark, docs):
    assert divergence.audit(docs.filter("false")).count() == 0
    rows = [(1, None, "en", "a", 0), (2, "12 34", "en", "b", 0)]
    got = divergence.audit(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()
    assert sorted(map(tuple, got)) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_op13_sketch_never_underestimates(docs, rows):
    least = 6
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"))
    held = defaultdict(Counter)
    for r in rows:
        held[r[2] or ""].update(set(TERM.findall(lower(r[1] or ""))))
    for width in (64, 1 << 18):  # so small that cells collide, and large
        bits = divergence.sketch_bits(texts, width, least)
        passed = 0
        for lang, counts in held.items():
            names = pa.array([t.encode() for t in counts], pa.large_binary())
            h = divergence._hashes(names)
            of = np.full(len(h), divergence.xxhash.xxh3_64_intdigest(lang.encode()), np.uint64)
            ok = np.logical_and.reduce([(bits[c >> 3] >> (c & 7)) & 1 == 1 for c in divergence._cells(of, h, width)])
            assert all(o for o, n in zip(ok, counts.values()) if n >= least)
            passed += int(ok.sum())
        kept = sum(n >= least for c in held.values() for n in c.values())
        assert passed >= kept and (width == 64 or passed == kept)


def test_op13_shares_are_exact(spark):
    big = 4 * 10**14
    rows = spark.createDataFrame([(c, n, v) for c in (0, 1, 7, big) for n in (0, 10, big, 9 * 10**14) for v in (1, 1000) if c <= n], "c long, n long, v long")
    for r in rows.withColumn("p", divergence.share(F.col("c"), F.col("n"), F.col("v"))).collect():
        assert r["p"] == 1 + 10**9 * (r["c"] + 5) // (r["n"] + 5 * r["v"])


def test_runs_of_classes():
    texts = ["", "aB c,dé", " É", "x", "", "日本 語Z9z", "\x00a"]
    found, counts = words.runs(pa.array(texts), divergence.TERM, words.LOWER)
    want = [TERM.findall(lower(t)) for t in texts]
    assert [t.decode() for t in found.to_pylist()] == sum(want, []) and list(counts) == list(map(len, want))
    sliced = pa.array(["zzz", *texts, "q"]).slice(1, len(texts))
    assert words.runs(sliced, divergence.TERM, words.LOWER)[0].to_pylist() == found.to_pylist()
    assert len(words.runs(pa.array([], pa.string()), divergence.TERM)[1]) == 0


def test_new_queries_are_registered():
    assert {"op11_merkle_manifest", "op12_quality_classifier", "op13_source_divergence"} <= set(registry.queries())
    assert {"op11_merkle_manifest", "op13_source_divergence"} <= set(registry.oracle_sql())


# -- token files ----------------------------------------------------------------------


def tokenizer():
    from rookery.llm.byte_level import ByteLevel
    from rookery.llm.tokens import tokenizer_path

    return ByteLevel(tokenizer_path("byte_bpe_50k.json"))


def test_byte_level_batches_agree_with_the_tokenizer():
    b, r = tokenizer(), random.Random(1)
    bits = ["a", " ", "  ", "\n", "\t", "word", "é", "ß", "日本", " don't", "'s", "!!", "12", "  x", "\r\n", "\u3000", "\xa0", "Σ", "_", ".", " ,"]
    bits += ["'", "''", "x'", "\x1c", "\x85", "3a", "' s", "“", "”.", "'LL", "I'm", "\x00", "\x7f", "<|endoftext|>"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 30))) for _ in range(4000)] + ["", "x " * 9000, "\n" * 3000, "é" * 5000]
    ids, n = b.encode(pa.array(["zz", *texts]).slice(1))
    at = np.append(0, np.cumsum(n))
    assert b._cuts and len(n) == len(texts)
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == b._tok.encode(t, add_special_tokens=False).ids, repr(t)
    assert [len(x) for x in b.encode(pa.array([], pa.string()))] == [0, 0]


def test_another_vocabulary_gives_its_own_ids():
    from rookery.llm.byte_level import ByteLevel
    from rookery.llm.tokens import tokenizer_path

    b = ByteLevel(tokenizer_path("word_bpe_49k.json"))
    texts = ["Ab, cd  ef", "", "x!!", "Don't\n\nstop  3rd \u00c9t\u00e9"]
    ids, n = b.encode(pa.array(texts))
    at = np.append(0, np.cumsum(n))
    assert [ids[i:j].tolist() for i, j in zip(at, at[1:])] == [b._tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_op5_files_are_read_selectively(spark, docs, tmp_path):
    import pyarrow.parquet as pq

    from rookery.llm import token_files

    path = str(tmp_path / "tokens")
    many = docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 1000)).filter("doc_id IS NOT NULL")
    token_files.write_tokens(many, path, row_group_bytes=1 << 14, page_bytes=1 << 10)
    groups, indexed, encodings = 0, 0, set()
    for f in (tmp_path / "tokens").glob("*.parquet"):
        m = pq.ParquetFile(f).metadata
        for g in range(m.num_row_groups):
            groups += 1
            for c in range(m.num_columns):
                column = m.row_group(g).column(c)
                indexed += column.has_offset_index and column.has_column_index
                if column.path_in_schema.startswith("tokens"):
                    encodings |= set(column.encodings)
    assert groups > 1 and indexed >= 4 * groups and encodings & {"DELTA_BINARY_PACKED", "RLE_DICTIONARY", "PLAIN_DICTIONARY"}
    found = token_files.read_tokens(spark, path, [3, 1003, 99_999])
    assert "PushedFilters: [In(doc_id" in found._jdf.queryExecution().executedPlan().toString()
    texts = {r["doc_id"]: r["text"] for r in many.filter("doc_id IN (3, 1003)").select("doc_id", "text").distinct().collect()}
    tok = tokenizer()._tok
    for r in found.collect():
        assert r["tokens"] == [*tok.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids, 0]
    assert {r["doc_id"] for r in found.collect()} == {3, 1003}
