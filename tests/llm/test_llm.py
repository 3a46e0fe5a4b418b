"""Operators against brute force, exact round trips and held-out accuracy, with nulls, empties, ties and odd columns."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from palimpsest.llm import bpe, chat, common, langid, lm, mixing, neardup, quality, queries, topk, toxicity, warc

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path(queries.RANKS)
DOCS = "doc_id long, text string, lang string, source string, n_chars long, __row string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i * i % 9973}" for i in range(30000))
ODD = [
    (None, "a text without an id, of some words", "en", "s1", 1, "x"), (9000001, None, None, None, None, None), (9000002, "", "en", "s1", 0, ""),
    (9000003, " \t\n\x0b\x0c\r ", "de", None, 1, "x"), (9000004, "%%% 123 !!", None, "s1", 1, "x"), (9000005, LONG, "en", "s1", 1, "x"),
    (9000006, "one two", "en", "s1", 1, "x"), (9000006, "one two", "en", "s1", 1, "x"), (9000007, "ONE two", "en", "s2", 1, "x"),
]


@pytest.fixture(scope="module")
def docs(spark):
    own = spark.read.parquet(f"{SF}/documents.parquet").withColumn("__row", F.lit("clash"))
    return own.union(spark.createDataFrame(ODD, DOCS).select(own.columns)).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def shingles(text, n):
    w = WORD.findall((text or "").translate({65 + i: 97 + i for i in range(26)}))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute_components(rows, n=4):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(shingles(t, n))
    ids = sorted(i for i in sets if i is not None)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x in ids:
        for y in ids:
            if x < y and any(100 * len(a & b) >= 80 * len(a | b) > 0 for a in sets[x] for b in sets[y]):
                a, b = sorted((find(x), find(y)))
                root[b] = a
    return {i: find(i) for i in ids}


def test_near_duplicates(spark, docs, empty):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = neardup.near_duplicates(docs, 4).collect()
    want = brute_components(rows)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.component_id, r.kept) == (want[r.doc_id], want[r.doc_id] == r.doc_id), r
    size = Counter((i, len(shingles(t, 4))) for i, t in rows)
    assert size == Counter((r.doc_id, r.n_shingles) for r in got)
    assert neardup.near_duplicates(empty, 4).count() == 0
    kept = neardup.deduplicated(docs, 4)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.select("doc_id").collect() if r.doc_id is not None) == sorted(i for i, c in want.items() if i == c)


def test_near_duplicates_of_large_groups(spark):
    rng = random.Random(4)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.choice((0, 0, 1, 1, 2, 3, 4, 6, 9))):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    passage = " ".join(f"p{i}" for i in range(60))
    rows += [(1000 + i, passage + " " + " ".join(f"q{i}_{j}" for j in range(rng.choice((3, 30, 90))))) for i in range(80)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    assert {r.doc_id: r.component_id for r in got} == brute_components(rows)


def test_least_shared_against_brute_force():
    """Every size of a second set: the fewest common values at the threshold, less those that its sketch can drop."""
    t = neardup.Fraction("0.8")
    for n in range(1, neardup.K + 1):
        shared = []
        for m in range(1, 2 * neardup.K):
            for c in range(1, min(n, m) + 1):
                if c * t.denominator >= (n + m - c) * t.numerator:
                    shared.append(c - max(0, m - neardup.K))
        assert neardup.least_shared(n, t) == min(shared), n


def test_near_duplicates_around_the_sketch_size(spark):
    """Texts of about K shingles, and each with words added until just below and just above the threshold."""
    rng = random.Random(8)
    rows = []
    for i in range(240):
        w = [f"v{i}_{j}" for j in range(rng.choice((31, 32, 32, 32, 33)) + 3)]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(w + [f"z{i}_{j}" for j in range(rng.choice((6, 7, 8, 8, 9)))]))]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    assert {r.doc_id: r.component_id for r in got} == brute_components(rows)


def test_late_members_look_in_every_list(spark, monkeypatch):
    """Two texts that are in eight long lists, and outside the largest component of all: the partner is found whichever list they share."""
    words = lambda name, n: [f"{name}{i}" for i in range(n)]
    twin = words("t", 60)
    docs = spark.createDataFrame([(1, " ".join(twin)), (2, " ".join(twin + ["u"])), (3, " ".join(words("o", 60)))], "doc_id long, text string")
    short = {r.doc_id: (r.n, [x >> 32 for x in r.sketch]) for r in neardup.sketches(docs, 4).collect()}
    for which in range(8):
        lists = {1: list(range(8)), 2: sorted([*range(100, 107), which]), 3: [which]}
        rows = [(i, *short[i], own[:j], v, i, 9, 2, 2) for i, own in lists.items() for j, v in enumerate(own)]
        opened = spark.createDataFrame(rows, "id long, n long, sketch array<int>, before array<long>, value long, comp long, main long, members long, seekers long")
        links = neardup._late_links(opened, docs, 4, neardup.Fraction("0.8"), neardup.Scratch(spark, "t"))
        assert {frozenset((r.a, r.b)) for r in links.collect()} == {frozenset((1, 2))}, which


def test_shared_values_of_pairs():
    rng = random.Random(5)
    lists = [sorted({rng.choice((rng.randrange(6), rng.randrange(400))) for _ in range(20)}) for _ in range(90)]
    a, b = np.arange(0, 90, 2), np.arange(1, 90, 2)
    got = neardup._shared(pa.chunked_array([pa.array(lists, pa.list_(pa.int64()))]), a, b)
    assert got.tolist() == [[len(set(lists[i]) & set(lists[j])) for j in b] for i in a] and got.max() > 3


def test_near_duplicates_across_blocks_and_parts(spark, monkeypatch):
    """Lists of many blocks and parts, groups beyond the broadcast share, and small groups: the same links as by brute force."""
    monkeypatch.setattr(neardup, "BLOCK", 8)
    monkeypatch.setattr(neardup, "PART", 200)
    monkeypatch.setattr(common, "HEAVY", 3)
    rng = random.Random(12)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for i in range(120):
        own = [f"q{i // 2}_{j}" for j in range(rng.choice((4, 12, 14, 25)))]
        rows.append((i, " ".join(passage + own + ([f"z{i}"] if i % 2 else []))))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    assert {r.doc_id: r.component_id for r in got} == brute_components(rows)


def test_near_duplicate_rows_with_clashing_names(spark):
    rows = [(2, "a b c d e f", "x", 1, 1, 1), (1, "a b c d e f", "y", 2, 2, 2), (1, "A B C D E F", "z", 3, 3, 3), (None, "q", "n", 4, 4, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string, key long, kept_id long, __id long")
    kept = neardup.deduplicated(df)
    assert kept.columns == df.columns and sorted(map(str, kept.collect())) == sorted(str(r) for r in df.collect() if r.row in "zn")


def test_bpe_equals_the_library(spark, docs, empty):
    ranks = bpe.load_ranks(PATH)
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = bpe.Encoder(ranks, public_tokenizers.PATTERN)
    rng = random.Random(1)
    texts = ["", "a", "aaaa" * 500, "é" * 999, "日本🙂\x00 don't", "  \n\n x "] + ["".join(rng.choice("ab é\n\t%1ßñ日🙂") for _ in range(rng.randrange(150))) for _ in range(200)]
    for t in texts:
        assert own.encode(t) == other.encode_ordinary(t) and own.decode(own.encode(t)) == t.encode()
    for r in bpe.encode_documents(docs, PATH, public_tokenizers.PATTERN).join(docs.dropDuplicates(["doc_id"]).select("doc_id", "text"), "doc_id").collect():
        ids = other.encode_ordinary(r.text or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
    assert bpe.encode_documents(empty, PATH, public_tokenizers.PATTERN).count() == 0


def test_langid(spark, docs, empty):
    net = langid.train(docs)
    got = langid.identify(docs, net).collect()
    assert len(got) == docs.count()
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
    lang = {r.doc_id: r.lang for r in docs.collect()}
    sure = [r for r in got if r.held_out and r.doc_id < 9000000]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in sure]) > 0.95
    assert {r.lang_pred for r in got if r.doc_id in (9000001, 9000002, 9000003, 9000004)} == {"und"}
    kept = langid.accept(docs, net)
    assert kept.columns == docs.columns and not {9000001, 9000002, 9000003, 9000004} & {r.doc_id for r in kept.collect()}
    assert langid.train(empty) is None and langid.identify(empty, None).count() == 0
    assert {r.lang_pred for r in langid.identify(docs, None).collect()} == {"und"}


def test_langid_against_a_naive_pass():
    """Sums of overlapping windows equal a pass over the whole text, state by state; beyond a window's size up to what a start still matters."""
    rng = random.Random(3)
    net = langid.ByteTagger(["a", "b", "c"])
    pieces = ["".join(rng.choice(x) for _ in range(90)).encode() for x in ("abcd efg", "efgh  ij", "xyz é ab") for _ in range(60)]
    net.train(pieces, np.repeat([0, 1, 2], 60), np.ones(180, np.float32), epochs=3)
    texts = ["".join(rng.choice("abcdefghijxyz é\n") for _ in range(n)).encode() for n in (1, 2, 5, 63, 64, 300, 895, 896, 897, 960, 2500, 2 * langid.CORE)]

    def naive(text):
        """One byte after the other, in plain formulas."""
        states = {}
        for d in "fb":
            h, out = np.zeros(langid.HIDDEN), []
            for c in text if d == "f" else text[::-1]:
                x = net.p["embed"][c] @ net.p[f"{d}x"] + net.p[f"{d}c"]
                H = langid.HIDDEN
                z, r = (1 / (1 + np.exp(-(x[i * H : (i + 1) * H] + h @ net.p[f"{d}h"][:, i * H : (i + 1) * H]))) for i in (0, 1))
                n = np.tanh(x[2 * H :] + (r * h) @ net.p[f"{d}h"][:, 2 * H :])
                h = h + z * (n - h)
                out.append(h)
            states[d] = np.array(out if d == "f" else out[::-1])
        logits = np.concatenate([states["f"], states["b"]], 1) @ net.p["out"] + net.p["bias"]
        p = np.exp(logits - logits.max(1, keepdims=True))
        return (p / p.sum(1, keepdims=True)).sum(0)

    got = net.position_sums(texts)
    assert got[:, -1].tolist() == [len(t) for t in texts]
    for t, sums in zip(texts, got):
        assert np.allclose(sums[:-1] / len(t), naive(t) / len(t), atol=2e-3 if len(t) > langid.CORE else 1e-5), len(t)
    assert np.allclose(net.position_sums(texts[3:5]), got[3:5], atol=1e-4)


def test_langid_gradient():
    net = langid.ByteTagger(["a", "b", "c"])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    codes, live = langid.pack([b"hello", b"ab", b"xyz1"])
    args = codes, live.astype(np.float64), np.array([0, 1, 2]), np.array([1.0, 2.0, 0.5])
    _, grad = net.gradients(*args)
    for k, g in grad.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        net.p[k][at] += 1e-4
        up = net.gradients(*args)[0]
        net.p[k][at] -= 2e-4
        down = net.gradients(*args)[0]
        net.p[k][at] += 1e-4
        assert abs((up - down) / 2e-4 - g[at]) < 1e-3


def test_toxicity(spark, docs, empty):
    rng = random.Random(2)
    words = [f"clean{i}" for i in range(300)]
    rows, marks = [], []
    for i in range(600):
        w = [rng.choice(words) for _ in range(60)]
        if i % 3 == 0:
            w[rng.randrange(60)] = rng.choice(("wretched", "wretchedly", "vilest"))
        rows.append((i, " ".join(w)))
        marks.append((i, int(i % 3 == 0)))
    own, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    scorer = toxicity.train(own, labels)
    got = toxicity.score(own, scorer).collect()
    held = [r for r in got if r.held_out]
    assert np.mean([r.predicted == int(r.doc_id % 3 == 0) for r in held]) > 0.95
    a, b = scorer.score(["clean1 clean2 clean3 wretchd", "clean1 clean2 clean3 clean4"])
    assert a > b
    odd = toxicity.score(docs, scorer).collect()
    assert len(odd) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in odd)
    none = toxicity.train(empty.select("doc_id", "text"), labels.limit(0))
    assert none.score([""])[0] < 0.5 and toxicity.score(empty, none).count() == 0


def test_toxicity_against_plain_formulas(monkeypatch):
    """Features, loss, gradient and score, word by word; and a sample that is read in many chunks."""
    texts = ["Vile vilest words", "kind words kind", "é🙂 ok", "", " ".join(f"w{i % 50}" for i in range(400))]
    model = toxicity.SubwordSoftmax()
    for k in ("embed", "out", "bias"):
        setattr(model, k, getattr(model, k).astype(np.float64))
    model.embed *= 30

    def vector(text):
        words = WORD.findall(text.lower())
        out = np.zeros(toxicity.DIM)
        for w in words:
            buckets, _ = toxicity.subwords([w.encode()])
            marked = len(w) + 2
            assert len(buckets) == 1 + sum(max(0, marked - n + 1) for n in toxicity.GRAMS)
            out += model.embed[buckets].mean(0)
        return out * toxicity.GAIN / max(1, len(words))

    logits = np.array([vector(t) @ model.out + model.bias for t in texts])
    prob = np.exp(logits) / np.exp(logits).sum(1, keepdims=True)
    assert np.allclose(model.word_scorer().score(texts), prob[:, 1], atol=1e-5)
    rows, label = toxicity.features(texts), np.array([1, 0, 0, 1, 1])
    loss, grads = model.gradients(rows, label)
    assert np.isclose(loss, -np.log(prob[np.arange(5), label]).mean())
    for name, g, at in grads:
        place = np.unravel_index(np.abs(g).argmax(), g.shape)
        own = (at[place[0]], *place[1:]) if name == "embed" else place
        values = getattr(model, name)
        values[own] += 1e-5
        up = model.gradients(rows, label)[0]
        values[own] -= 2e-5
        assert abs((up - model.gradients(rows, label)[0]) / 2e-5 - g[place]) < 1e-6, name
        values[own] += 1e-5
    spelled, other = (model.embed[toxicity.subwords([w])[0]].mean(0) for w in (b"vilest", b"vilesst"))
    assert np.dot(spelled, other) > 0.3 * np.dot(spelled, spelled)


def test_toxicity_sample_in_chunks(spark, monkeypatch):
    rows = [(i, " ".join(f"{'bad' if i % 2 else 'good'}{(i * j) % 7}" for j in range(30))) for i in range(120)]
    own, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "CHUNK_BYTES", 4000)
    monkeypatch.setattr(toxicity, "SENT", 40)
    monkeypatch.setattr(toxicity, "LEAST_STEPS", 30)
    got = toxicity.score(own, toxicity.train(own, labels)).collect()
    assert np.mean([r.predicted == r.doc_id % 2 for r in got if r.held_out]) == 1.0


def base_statistics(text):
    text = text or ""
    w = WORD.findall(text)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality(spark, docs, empty, monkeypatch):
    monkeypatch.setattr(quality, "STEPS", 3)  # for time; test_quality_verdicts_against_numpy takes all
    extra = [(9100000 + i, t, "en", "s1", 1, "x") for i, t in enumerate(["a b c a b c", "x\nx\n\n x\nx", "a a a a a", "é|🙂 <b> é|🙂 <b> z", "p q r p q r p q s"])]
    all_docs = docs.union(spark.createDataFrame(extra, DOCS).select(docs.columns))
    got = quality.judge(all_docs).collect()
    want = Counter((r.doc_id, *base_statistics(r.text)) for r in all_docs.collect())
    assert want == Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got)
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    passed = [r for r in got if not r.base_failed and r.doc_id in labels]
    assert all(r.kept == bool(labels[r.doc_id]) for r in passed)
    kept = quality.accepted(all_docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in got if r.kept)
    assert quality.judge(empty).count() == 0


def brute_mcd(x):
    """Mean, factor and consistency of one group's rows, from all starts."""
    x, p = np.asarray(x), len(quality.FLOOR)
    floor = np.array(list(quality.FLOOR.values())) * quality.UNIT
    s = np.sort(x, axis=0)
    q = lambda a: s[int(np.ceil(len(x) * a)) - 1]
    wide = np.sqrt(((q(0.75) - q(0.25)) / 1.349) ** 2 + floor**2)
    u = (x - q(0.5)) / wide
    size = np.linalg.norm(u, axis=1, keepdims=True)
    u = np.divide(u, size, out=np.zeros_like(u), where=size > 0)
    signs = np.rint(u[:, :, None] * u[:, None, :] * 1e6).sum(0)
    corr = 0.9 * signs / np.sqrt(np.maximum(np.outer(np.diag(signs), np.diag(signs)), 1))
    np.fill_diagonal(corr, 1)

    def step(mean, low):
        d2 = (np.linalg.solve(low, (x - mean).T) ** 2).sum(0)
        cell = np.minimum(np.floor(np.log(1 + d2) * quality.CELLS), quality.LAST_CELL)
        near = x[cell <= np.sort(cell)[int(np.ceil(len(x) * quality.SHARE)) - 1]]
        return near.mean(0), np.linalg.cholesky(np.cov(near.T, bias=True) + np.diag(floor**2))

    found = []
    for low in (np.diag(wide), np.diag(floor), np.linalg.cholesky(corr * np.outer(wide, wide))):
        mean = q(0.5).astype(float)
        for _ in range(quality.TRIAL):
            mean, low = step(mean, low)
        found.append((round(np.log(np.diag(low)).sum(), 9), len(found), mean, low))
    _, _, mean, low = min(found, key=lambda f: f[:2])
    for _ in range(quality.STEPS):
        old, (mean, low) = mean, step(mean, low)
        if np.array_equal(old, mean):
            break
    cell = np.floor(np.log(1 + (np.linalg.solve(low, (x - mean).T) ** 2).sum(0)) * quality.CELLS)
    mid = np.sort(np.minimum(cell, quality.LAST_CELL))[int(np.ceil(len(x) * 0.5)) - 1]
    return mean, low, max(1.0, (np.exp((mid + 1) / quality.CELLS) - 1) / quality.CHI2_MEDIAN)


def test_quality_estimate_against_numpy(spark):
    """Starts, concentration steps and the choice by determinant, recomputed in numpy from the same integers; two groups, one with two cores."""
    rng = np.random.default_rng(1)
    p = len(quality.FLOOR)
    one = np.rint(rng.multivariate_normal(np.zeros(p), np.diag([900, 100, 300, 200, 400.0]) * 100, 400) + 3000).astype(int)
    one[:40, 2] += 4000
    two = np.rint(np.concatenate([rng.normal(2000, 900, (150, p)), rng.normal(2600, 60, (130, p))])).astype(int)
    rows = spark.createDataFrame([("=a", g, *map(int, r)) for g, x in (("=b", one), ("null", two)) for r in x], "gl string, gs string, " + ", ".join(f"{k} long" for k in quality.FLOOR))
    fits = {r.gs: r for r in quality._estimate(rows, quality.Scratch(spark, "t")).collect()}
    for g, x in (("=b", one), ("null", two)):
        mean, low, factor = brute_mcd(x)
        assert np.allclose([fits[g][f"m_{i}"] for i in range(p)], mean)
        assert np.allclose([fits[g][f"l_{i}_{j}"] for i in range(p) for j in range(i + 1)], [low[i, j] for i in range(p) for j in range(i + 1)])
        assert np.isclose(fits[g]["factor"], factor)


def test_quality_verdicts_against_numpy(spark):
    """Fixed limits, groups, pooled groups, distances and verdicts of a whole table."""
    rng = random.Random(16)
    rows = []
    for lang, source, n in (("en", "web", 130), ("en", None, 60), ("en", "few", 9), ("de", "web", 70), ("de", "x", 12), (None, "web", 8), ("fr", "y", 20)):
        for _ in range(n):
            words = [rng.choice("abcdefgh") * rng.randrange(2, 9) + str(rng.randrange(10**4)) for _ in range(rng.randrange(40, 260))]
            words += ["%%#|"] * (rng.randrange(60) if rng.random() < 0.1 else 0)
            rows.append((len(rows), "\n".join(" ".join(words[i : i + 12]) for i in range(0, len(words), 12)) + ("\nsame line\nsame line" if rng.random() < 0.2 else ""), lang, source))
    rows += rows[:3]
    got = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    held = []
    for i, text, lang, source in rows:
        w, chars, symbols, lines, repeats = base_statistics(text)
        failed = w < 50 or 100 * repeats > 50 * w
        x = [np.log(w), np.log(chars / w), np.log(1 + 20 * symbols / w), np.log(1.0 + lines), np.log(1 + 10 * repeats / w)]
        held.append((i, failed, lang, source, [int(np.floor(v * quality.UNIT + 0.5)) for v in x]))
    passed = [r for r in held if not r[1]]
    group = lambda r: (r[2], r[3])
    each, langs = Counter(map(group, passed)), Counter(r[2] for r in passed)
    fits, want = {}, Counter()
    for r in held:
        level = 2 if each[group(r)] >= quality.SMALL else 1 if langs[r[2]] >= quality.SMALL else 0
        key = (level, *group(r)[:level])
        if key not in fits:
            fits[key] = brute_mcd([q[4] for q in passed if group(q)[:level] == group(r)[:level]])
        mean, low, factor = fits[key]
        d2 = (np.linalg.solve(low, np.array(r[4]) - mean) ** 2).sum() / factor
        want[(r[0], r[1], not r[1] and d2 <= quality.CUTOFF)] += 1
    assert Counter((r.doc_id, r.base_failed, r.kept) for r in got) == want
    assert {k[0] for k in fits} == {0, 1, 2} and 10 < sum(not r.kept and not r.base_failed for r in got) < 60


def test_quality_judges_small_groups(spark, monkeypatch):
    """A small source is judged by its whole language, a small language by the whole corpus; a tiny corpus isn't judged."""
    monkeypatch.setattr(quality, "STEPS", 3)
    rng = random.Random(6)
    text = lambda: " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(10**5)}" for _ in range(rng.randrange(60, 200)))
    junk = lambda: " ".join(f"#$%{rng.randrange(10**5)}*&|" for _ in range(100))
    rows = [(i, text(), "de", "large") for i in range(150)] + [(1000 + i, text(), "de", "small") for i in range(5)]
    rows += [(2000, junk(), "de", "small"), (2001, junk(), "fr", None), (2002, junk(), None, "x"), (3000, text(), "fr", "one")]
    schema = "doc_id long, text string, lang string, source string"
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, schema)).collect()}
    assert all(r.distance is not None for r in got.values())
    assert {i for i, r in got.items() if not r.kept} == {2000, 2001, 2002}
    few = quality.judge(spark.createDataFrame(rows[145:], schema)).collect()
    assert len(few) < quality.SMALL and all(r.kept and r.distance is None for r in few)


def test_quality_estimate_withstands_much_junk(spark):
    """Two fifths of a group are junk: all of it is far, no clean row is, and the steps have come to rest."""
    rng = np.random.default_rng(2)
    clean = rng.normal([5500, 1750, 0, 0, 300], [500, 60, 20, 20, 200], (240, 5))
    junk = rng.normal([5500, 1750, 3000, 0, 300], [500, 60, 500, 20, 200], (160, 5))
    x = np.rint(np.concatenate([clean, junk])).astype(int)
    fields = "gl string, gs string, " + ", ".join(f"{k} long" for k in quality.FLOOR)
    rows = spark.createDataFrame([("=a", "=b", *map(int, r)) for r in x], fields).coalesce(1)
    fit = quality._estimate(rows, quality.Scratch(spark, "t")).first()
    mean = np.array([fit[f"m_{i}"] for i in range(5)])
    low = np.array([[fit[f"l_{i}_{j}"] if j <= i else 0.0 for j in range(5)] for i in range(5)])
    d2 = (np.linalg.solve(low, (x - mean).T) ** 2).sum(0)
    assert (d2 / fit["factor"] > quality.CUTOFF).tolist() == [False] * 240 + [True] * 160
    cell = np.minimum(np.floor(np.log(1 + d2) * quality.CELLS), quality.LAST_CELL)
    near = x[cell <= np.sort(cell)[int(np.ceil(len(x) * quality.SHARE)) - 1]]
    assert np.allclose(near.mean(0), mean)


def test_quality_steps_spare_the_driver(spark, monkeypatch):
    """A step is one job that sends its fits once, and reads vectors instead of joining rows and groups anew: the driver's memory holds every plan and broadcast."""
    monkeypatch.setattr(quality, "STEPS", 2)
    held = spark._jsparkSession.sharedState().statusStore()

    def ran(work):
        settle = spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty
        settle()
        first = held.executionsCount()
        out = work()
        settle()
        plans = [held.executionsList(i, 1).apply(0) for i in range(first, held.executionsCount())]
        return out, [x.physicalPlanDescription().split("Initial Plan")[0].split("\n\n\n")[0] for x in plans]

    scratch = quality.Scratch(spark, "t")
    stats = scratch.cut(quality._stats(spark.read.parquet(f"{SF}/documents.parquet")))
    sent = lambda plan: len(re.findall(r"(?<!Reused)BroadcastExchange \(", plan))
    (_, fit), plans = ran(lambda: quality.estimates(stats, scratch))
    assert fit.count() > 1 and len(plans) <= 14 and sum(map(sent, plans)) <= 16
    rows = spark.createDataFrame([("=a", "=b", *[1000 + i * i * (k + 3) % 997 for k in range(len(quality.FLOOR))]) for i in range(200)], "gl string, gs string, " + ", ".join(f"{k} long" for k in quality.FLOOR))
    start = scratch.cut(quality._starts(rows, scratch).filter("gs like '%#0'").withColumn("gs", F.lit("=b")))
    new, plans = ran(lambda: quality._step(scratch.cut(rows), start, scratch))
    assert new.first()["moved"] and len(plans) == 2 and sum(map(sent, plans)) == 1


def test_mixing_budgets_and_prefixes(spark, docs, empty):
    leaves = spark.createDataFrame([("a", "x", 100), ("a", "y", 10), ("b", "x", 1000), ("b", "z", 1000)], "l0 string, l1 string, supply long")
    got = {(r.l0, r.l1): r.budget for r in mixing.budgets(leaves, 2, {("a",): 3.0}, mixing.Fraction("0.5"), 1).collect()}
    # a may have 110 in all; its shortage goes to b, and within a all is used.
    assert got == {("a", "x"): 100, ("a", "y"): 10, ("b", "x"): 472, ("b", "z"): 472}
    levels = {"lang": F.col("lang"), "source": F.col("source")}
    rows = mixing.mix(docs, levels, {("en",): 0.5}, "0.7", 3).collect()
    size = {r.doc_id: len(WORD.findall(r.text or "")) for r in docs.collect()}
    planned, _ = mixing.plan(docs, levels, {("en",): 0.5}, "0.7", 3, 1, mixing.Scratch(spark, "t"))
    budget = {(r.l0, r.l1): (r.budget, r.supply) for r in planned.collect()}
    used = Counter()
    for r in rows:
        assert r.tokens == size[r.doc_id]
        used[(r.lang or mixing.NULL, r.source or mixing.NULL)] += r.tokens
    for leaf, n in used.items():
        assert n <= budget[leaf][0]
    kept = mixing.mixed_documents(docs, levels, {}, "0.8", 1)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    assert mixing.mixed_documents(docs, levels, {}, "1.0", 1).count() == docs.count()
    assert mixing.mix(empty, levels, {}).count() == 0


def test_mixing_prefix_is_the_seeded_order(spark):
    rows = [(i, "w " * (i % 7 + 1), "en", "s") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    taken = {r.doc_id for r in mixing.mix(df, {"lang": F.col("lang")}, {}, "0.37", 1).collect()}
    order = df.select("doc_id", mixing.place(1, F.lit(0), F.col("doc_id")).alias("h")).collect()
    budget, want = sum(i % 7 + 1 for i in range(400)) * 37 // 100, set()
    for r in sorted(order, key=lambda r: (r.h & (2**64 - 1), r.doc_id)):
        budget -= r.doc_id % 7 + 1
        if budget < 0:
            break
        want.add(r.doc_id)
    assert taken == want


def test_mixing_against_brute_force(spark):
    """Three levels, weights, shortages and several passes: budgets by filling one step at a time, then whole passes and a prefix."""
    rng = random.Random(21)
    rows = []
    for i in range(700):
        domain = rng.choice("aab")
        lang = rng.choice(("en", "en", "de", None))
        rows.append((i, "w " * rng.randrange(1, 40), domain, lang, f"{domain}{rng.randrange(3)}"))
    df = spark.createDataFrame(rows, "doc_id long, text string, domain string, lang string, source string")
    levels = {"domain": F.col("domain"), "lang": F.col("lang"), "source": F.col("source")}
    weights = {("b",): 2.0, ("*", "en"): 0.2, ("*", "de"): 1.0, ("a", "de", "a1"): 5.0}
    size = {r[0]: len(r[1].split()) for r in rows}
    path = {r[0]: tuple(x if x is not None else mixing.NULL for x in r[2:]) for r in rows}
    supply = Counter()
    for i, p in path.items():
        supply[p] += size[i]
    for share, passes in (("0.5", 2), ("1.6", 2), ("0.9", 3)):

        def fill(node, give):
            """Leaf budgets: what a full child can't take is shared by the others, again and again."""
            if len(node) == 3:
                return {node: give}
            room = Counter()
            for p, n in supply.items():
                if p[: len(node)] == node:
                    room[p[: len(node) + 1]] += n * passes
            weight = {c: next((w for key, w in reversed(weights.items()) if len(key) == len(c) and all(k in ("*", x) for k, x in zip(key, c))), 1.0) for c in room}
            got, left, open_ = dict.fromkeys(room, 0.0), give, set(room)
            while open_ and left > 1e-9:
                rate = left / sum(weight[c] for c in open_)
                full = {c for c in open_ if room[c] <= rate * weight[c]}
                for c in full or open_:
                    got[c] = min(room[c], rate * weight[c])
                    left -= got[c]
                open_ = open_ - full if full else set()
            return {k: v for c, g in got.items() for k, v in fill(c, g).items()}

        total = sum(supply.values()) * mixing.Fraction(share)
        budgets = fill((), float(int(total)))
        planned, _ = mixing.plan(df, levels, weights, share, passes, 1, mixing.Scratch(spark, "t"))
        for r in planned.collect():
            assert abs(r.budget - budgets[(r.l0, r.l1, r.l2)]) <= 1, (share, r)
        exact = {(r.l0, r.l1, r.l2): r.budget for r in planned.collect()}
        place = {(r.doc_id, e): r[f"p{e}"] & (2**64 - 1) for r in df.select("doc_id", *[mixing.place(1, F.lit(e), F.col("doc_id")).alias(f"p{e}") for e in range(passes)]).collect() for e in range(passes)}
        want = Counter()
        for leaf, budget in exact.items():
            own = [i for i in path if path[i] == leaf]
            whole = min(passes, budget // supply[leaf])
            for e in range(whole):
                want.update((i, e) for i in own)
            rest = budget - whole * supply[leaf]
            if whole < passes:
                for i in sorted(own, key=lambda i: (place[(i, whole)], i)):
                    rest -= size[i]
                    if rest < 0:
                        break
                    want[(i, whole)] += 1
        assert Counter((r.doc_id, r.epoch) for r in mixing.mix(df, levels, weights, share, passes).collect()) == want, share


def test_warc(spark):
    rows = [(1, "http://a/\r\nx", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "http://c", None), (4, "u", ""), (5, "u", "z"), (5, "u", "z"), (None, "n", "z"), (7, "u", "a\r\n\r\nb WARC-Type: revisit")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {(r.page_id, r.record_type): r for r in warc.round_trip(pages).collect()}
    assert len(got) == 8
    sha = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    for page, kind, text, refers in ((1, "revisit", "<p>é</p>", 2), (2, "response", "<p>é</p>", None), (3, "revisit", "", 4), (4, "response", "", None), (5, "response", "z", None), (5, "revisit", "z", 5), (None, "revisit", "z", 5), (7, "response", rows[7][2], None)):
        r = got[(page, kind)]
        assert (r.payload_bytes, r.payload_digest, r.refers_to) == (len(text.encode()), sha(text), refers)
    scratch = warc.Scratch(spark, "t")
    records, payloads = warc.write_archive(pages, scratch)
    assert payloads.count() == 4
    full = sorted(bytes(r.payload) for r in warc.original_payloads(records, payloads, scratch).collect())
    assert full == sorted((r[2] or "").encode() for r in rows)
    bad = payloads.withColumn("payload", F.encode(F.lit("forged"), "UTF-8"))
    with pytest.raises(Exception, match="does not match"):
        warc.read_records(records, bad).collect()
    assert warc.round_trip(pages.limit(0)).count() == 0


def shuffled(spark, work):
    """Bytes that the stages of ``work`` write to shuffles, and its result."""
    sc = spark.sparkContext
    context, jvm = sc._jsc.sc(), sc._jvm

    def stages():
        context.listenerBus().waitUntilEmpty()
        found = context.statusStore().stageList(None, False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {x.stageId(): x.shuffleWriteBytes() for x in (found.apply(i) for i in range(found.size()))}

    before = stages()
    out = work()
    return sum(n for i, n in stages().items() if i not in before), out


@pytest.mark.parametrize("seen", [1, 1 << 18])
def test_archive_moves_payloads_once(spark, monkeypatch, seen):
    """A payload crosses one shuffle, and its copies stay behind; whatever a task remembers, and where small responses share a payload, rows and records are right."""
    monkeypatch.setattr(warc, "SEEN", seen)
    rng = random.Random(5)
    texts = [rng.randbytes(15_000).hex() for _ in range(300)]
    rows = [(i, f"u{i}", t) for i, t in enumerate(texts)] + [(1000 + i, "hot", texts[7]) for i in range(300)] + [(2000 + i, "small", "s") for i in range(20)]
    rng.shuffle(rows)
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.execution.arrow.maxRecordsPerBatch": "40"}
    kept = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        pages = spark.createDataFrame(spark.sparkContext.parallelize(rows, 6), "page_id long, url string, html string")
        moved, got = shuffled(spark, lambda: warc.round_trip(pages, least_bytes=10).collect())
        records, payloads = warc.write_archive(pages, warc.Scratch(spark, "t"), 10)
        stored, known = payloads.select("digest", "payload").collect(), records.count()
        whole = [bytes(r.record) for r in warc.read_records(records, payloads).collect()]
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    top = {}
    for page, _, t in rows:
        top[t] = max(page, top.get(t, -1))
    want = {page: (len(t), "revisit" if len(t) >= 10 and page != top[t] else "response", top[t] if len(t) >= 10 and page != top[t] else None) for page, _, t in rows}
    assert {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in got} == want and len(got) == len(rows)
    assert sorted(zlib.decompress(bytes(r.payload)).decode() for r in stored) == sorted({t for _, _, t in rows})
    assert known == len(whole) == len(rows)
    assert sum(x.endswith(b"\r\n\r\ns\r\n\r\n") for x in whole) == 20
    if seen > 1:
        assert moved < 1.5 * sum(len(r.payload) for r in stored), moved


def test_chat(spark):
    rng = random.Random(3)
    bits = ["<", "|", "turn", "|>", "\\", "</s>", "[INST]", "[", "/INST]", "n", "\n", "<|end|>", "é", "s>", "<s>", "🙂"]
    rows = []
    for c in (1, 2, 3, None):
        for t in range(8):
            rows.append((c, t, rng.choice(("user", "assistant", "assistant", "sys\ntem", None)), rng.choice((None, "".join(rng.choice(bits) for _ in range(30))))))
    rows += [(5, i, "assistant", "x" * 3000) for i in range(600)]
    for x in (r[3] or "" for r in rows):
        assert chat.unescape(chat.escape(x)) == x and not any(c in chat.escape(x) for c in chat.CONTROL)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formatted = chat.format_conversations(df, PATH, public_tokenizers.PATTERN)
    assert formatted.filter("conv_id = 5").count() > 1
    for r in chat.digests(formatted, PATH, public_tokenizers.PATTERN).collect():
        own = sorted((x for x in rows if x[0] == r.conv_id), key=lambda x: x[1])
        loss = "".join(x[3] or "" for x in own if x[2] == "assistant")
        turns = "".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in own)
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(own), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.digests(chat.format_conversations(df.limit(0), PATH, public_tokenizers.PATTERN), PATH, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("held", [100, 20_000, 4 << 20])
def test_conversations_over_many_tasks(spark, monkeypatch, held):
    """One conversation holds most turns and lies in several tasks, turns are missing or equal; whatever a task holds, the digests are those of the whole."""
    monkeypatch.setattr(chat, "HELD_BYTES", held)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rng = random.Random(17)
        rows = [(7, t // 3, rng.choice(("user", "assistant")), f"{t} " + "é [INST] " * rng.randrange(40)) for t in range(3000)]
        rows += [(c, t, rng.choice(("user", "assistant")), f"{c} \\ {t}") for c in range(-20, 60) if c != 7 for t in range(rng.randrange(1, 5))]
        rows += [(7, None, "assistant", "first"), (None, 1, "assistant", "nobody's"), (None, None, "user", None)]
        rng.shuffle(rows)
        df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
        formatted = chat.format_conversations(df, PATH, public_tokenizers.PATTERN)
        assert formatted.filter("conv_id = 7").select(F.spark_partition_id()).distinct().count() > 1
        found = chat.digests(formatted, PATH, public_tokenizers.PATTERN).collect()
        assert len(found) == len({x[0] for x in rows})
        for r in found:
            own = sorted((x for x in rows if x[0] == r.conv_id), key=lambda x: (x[1] is not None, x[1] or 0, x[2], x[3] or ""))
            loss = "".join(x[3] or "" for x in own if x[2] == "assistant")
            turns = "".join(f"{x[2]}\n{x[3] or ''}\n" for x in own)
            assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(own), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
            assert r.formatted_chars == len(chat.render([(x[2], x[3] or "") for x in own])[0])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_topk(spark, monkeypatch):
    """Ties, repeated and odd rows, other columns, and blocks of queries and codes: as by brute force."""
    monkeypatch.setattr(topk, "INDEX_BLOCK", 64)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(2)
    x = rng.standard_normal((400, 64))
    x[50:150] = x[50]
    x[300:] = np.where(rng.random((100, 64)) < 0.06, -x[7], x[7])
    rows = [(i, [float(v) for v in r], i, "x") for i, r in enumerate(x)] + [(1000, None, 0, ""), (1001, [1.0], 0, ""), (None, [1.0] * 64, 0, "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, code long, id string")
    got = topk.nearest(df.coalesce(2), df.filter("vec_id % 25 = 7 or vec_id = 50"), k=7).collect()
    asked = [q for q in range(400) if q % 25 == 7 or q == 50]
    for q in asked:
        d = ((x > 0) != (x[q] > 0)).sum(1)
        best = np.lexsort((np.arange(400), d))[:7]
        assert [(r.vec_id, r.distance) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == [(int(i), int(d[i])) for i in best]
    assert len(got) == 7 * len(asked)
    two = spark.createDataFrame([(5, [1.0] * 64), (5, [-1.0] * 64)], "vec_id long, embedding array<float>")
    assert sorted((r.vec_id, r.distance) for r in topk.nearest(two, two, k=2).collect()) == [(5, 0), (5, 64)]
    assert topk.nearest(df.limit(0), df.limit(0)).count() == 0 == topk.nearest(df.limit(0), df).count()


def test_loss_mask_token_by_token():
    """The overlap of every token with every assistant's text, one by one; and ids of parts are those of the whole."""
    rng = random.Random(9)
    ranks = bpe.load_ranks(PATH)
    own = bpe.Encoder(ranks, public_tokenizers.PATTERN)
    library = bpe.Encoder(ranks, public_tokenizers.PATTERN, bpe.library_merge(ranks))
    edge = "".join(rng.choice("abcdefgh") for _ in range(1 << 17))
    for n in (bpe.LIBRARY_PIECE_BYTES - 1, bpe.LIBRARY_PIECE_BYTES, bpe.LIBRARY_PIECE_BYTES + 1, len(edge)):
        assert library.encode(edge[:n]) == own.encode(edge[:n])
    bits = ["a", " word", "\n", "  ", "é", "🙂", "<", "[INST]", "'s", "1", "", "\r\n", "|>", "\t", "…"]
    for _ in range(60):
        turns = [(rng.choice(("user", "assistant", "", "as\nsistant")), "".join(rng.choice(bits) for _ in range(rng.randrange(12)))) for _ in range(rng.randrange(1, 9))]
        text, spans = chat.render(turns)
        ids, offsets = own.encode_with_offsets(text)
        assert library.encode(text) == ids.tolist()
        tokens, starts, ends = chat.loss_mask(offsets, spans)
        want = [(t, max(int(offsets[t]), s), min(int(offsets[t + 1]), e)) for s, e in spans for t in range(len(ids)) if max(offsets[t], s) < min(offsets[t + 1], e)]
        assert list(zip(tokens.tolist(), starts.tolist(), ends.tolist())) == want
        cut = rng.randrange(len(turns) + 1)
        parts = [own.encode_with_offsets(chat.render(t)[0])[0].tolist() for t in (turns[:cut], turns[cut:])]
        assert ids.tolist() == parts[0] + parts[1]


def test_other_columns_and_long_values(spark):
    """Columns that an operator doesn't know, under names that it uses, and values of a million characters."""
    long_text = "very long <p>text</p> é\n" * 50_000
    pages = spark.createDataFrame([(1, "u", long_text, "x", 9, "h"), (2, "u", long_text, "x", 9, "h")], "page_id long, url string, html string, payload string, uid long, digest string")
    assert sorted((r.page_id, r.record_type, r.payload_bytes) for r in warc.round_trip(pages).collect()) == [(1, "revisit", len(long_text.encode())), (2, "response", len(long_text.encode()))]
    rows = [(1, 0, "user", "q", "x", 3), (1, 1, "assistant", long_text, "x", 3)]
    talk = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part string, formatted long")
    r = chat.digests(chat.format_conversations(talk, PATH, public_tokenizers.PATTERN), PATH, public_tokenizers.PATTERN).first()
    assert (r.n_turns, r.loss_chars, r.loss_sha256) == (2, len(long_text), hashlib.sha256(long_text.encode()).hexdigest())


def test_pseudo_likelihood_network():
    """Probabilities of all tokens sum to 1, agree with plain formulas, and steps follow the numeric gradient."""
    rng = np.random.default_rng(0)
    context, target = rng.integers(0, 1024, (4, 50)), rng.integers(0, 1024, 50)
    net = lm.WindowNetwork()
    for store in (net.p, net.square):
        for k in store:
            store[k] = store[k].astype(np.float64)
    each = lm.VOCABULARY // lm.GROUPS

    def naive(i):
        h = np.tanh(sum(net.p["embed"][j][context[j, i]] for j in range(4)) + net.p["hidden"])
        soft = lambda x: np.exp(x) / np.exp(x).sum()
        g = target[i] // each
        return np.log(soft(h @ net.p["group"] + net.p["group_b"])[g]) + np.log(soft(h @ net.p["inner"][g] + net.p["inner_b"][g])[target[i] % each])

    assert np.allclose(net.log_probs(context, target), [naive(i) for i in range(50)], atol=1e-6)
    assert np.allclose(sum(np.exp(net.log_probs(context, np.full(50, w))) for w in range(lm.VOCABULARY)), 1, atol=1e-6)
    loss = lambda: -net.log_probs(context, target).mean()
    numeric = {}
    for k, v in net.p.items():
        at = {"embed": (1, context[1, 0], 3), "inner": (target[0] // each, 3, target[0] % each), "inner_b": (target[0] // each, target[0] % each)}.get(k, (0,) * v.ndim)
        v[at] += 1e-5
        up = loss()
        v[at] -= 2e-5
        numeric[k] = at, (up - loss()) / 2e-5
        v[at] += 1e-5
    before, square = {k: v.copy() for k, v in net.p.items()}, {k: v.copy() for k, v in net.square.items()}
    net.log_probs(context, target, learn=True)
    for k, (at, g) in numeric.items():
        used = np.sqrt(net.square[k][at] - square[k][at]) * np.sign(before[k][at] - net.p[k][at])
        assert abs(used - g) < 1e-6, k
    first = loss()
    for _ in range(20):
        net.log_probs(context, target, learn=True)
    assert loss() < first


def test_pseudo_likelihood(spark, docs, empty, monkeypatch):
    monkeypatch.setattr(lm, "SHARD", 20000)
    monkeypatch.setattr(lm, "PART", 9000)
    model = lm.fit(docs, common.Scratch(spark, "t"))
    got = lm.score(docs, model).collect()
    assert len(got) == docs.count()
    by = {r.doc_id: r for r in got}
    assert by[9000002].log_likelihood == 0.0 and by[9000002].mean_log_likelihood is None and by[9000006].n_tokens == 2
    # Counts, tokens and windows, naively.
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    texts = {r.doc_id: WORD.findall((r.text or "").translate(lower)) for r in docs.collect()}
    count = Counter(w for r in docs.collect() for w in WORD.findall((r.text or "").translate(lower)))
    found = lm.scan([w.encode() for w in count])
    token = dict(zip(count, model.tokens(found).tolist()))
    often = sorted(count, key=lambda w: -count[w])[: lm.VOCABULARY - 1 - lm.BUCKETS]
    assert sum(count[w] for w in often) == sum(count[w] for w in count if token[w] > lm.BUCKETS)
    total, kinds = Counter(), Counter()
    for w, n in count.items():
        total[token[w]] += n
        kinds[token[w]] += 1
    net = lm.WindowNetwork().load(model.flat)
    for doc in (9000001, 9000005, 9000006, 0, 7):
        words = texts[doc]
        ids = [token[w] for w in words]
        pad = [0, 0, *ids, 0, 0]
        want = sum(
            (float(net.log_probs(np.array([[pad[i]], [pad[i + 1]], [pad[i + 3]], [pad[i + 4]]]), np.array([t]))[0]) if len(ids) < 2000 else 0.0)
            + (np.log((count[w] + 1) / (total[t] + kinds[t] + 1)) if t <= lm.BUCKETS else 0.0)
            for i, (w, t) in enumerate(zip(words, ids))
        )
        if len(ids) >= 2000:
            want += lm.network_scores(np.array(ids), np.zeros(len(ids), np.int64), 1, net)[0]
        assert abs(by[doc].log_likelihood - want) < 1e-3 + 1e-5 * abs(want), doc
    assert sum(lm.network_scores(np.array([token[w] for w in texts[i]]), np.zeros(len(texts[i]), np.int64), 1, net)[0] for i in (0, 7)) > sum(lm.network_scores(np.array([token[w] for w in texts[i]]), np.zeros(len(texts[i]), np.int64), 1, lm.WindowNetwork())[0] for i in (0, 7))
    # A word that the corpus lacks has a share of its class; and other partitions give the same scores.
    odd = lm.score(spark.createDataFrame([(1, "qzqzqz")], "doc_id long, text string"), model).first()
    assert odd.log_likelihood < -3 and odd.n_tokens == 1
    for n in (2, 8):
        again = lm.fit(docs.repartition(n), common.Scratch(spark, "t"))
        other = sorted(lm.score(docs.repartition(n), again).collect(), key=str)
        for x, y in zip(sorted(got, key=str), other):
            assert x.doc_id == y.doc_id and abs(x.log_likelihood - y.log_likelihood) <= 1e-6 * abs(x.log_likelihood) + 1e-6
    assert lm.score(empty, lm.fit(empty, common.Scratch(spark, "t"))).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    found = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    got = queries.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(str(tuple(r[c] for c in columns)) for r in got.collect()) == sorted(map(str, found.fetchall()))


def test_pipeline(spark, docs):
    ids, frame = None, docs.drop("__row")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, frame, SF)
        if name != "byte-level BPE":
            assert out.columns == frame.columns
        now = {r.doc_id for r in out.select("doc_id").collect()}
        assert now and (ids is None or now <= ids)
        ids, frame = now, out
    assert "ids" in frame.columns and corpus_pipeline.run(spark, SF).count() > 0
