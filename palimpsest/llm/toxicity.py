"""Toxicity by a bag of subwords: averaged embeddings and a linear softmax, trained jointly in numpy.

A word's vector is the mean of the vectors of its character n-grams and of the word itself (hashed into
``BUCKETS``), a text's vector the mean of its words' vectors times ``GAIN``. Misspellings that were never seen share
n-grams with seen words. Because the softmax is linear, a word adds one number to the score of its text; a
worker computes it once per distinct word.

Learning uses a bounded sample: at most ``SAMPLE`` labelled documents of each class, none held out. Its features are written once and
sent to the driver in the order of a hash, ``CHUNK_BYTES`` at a time.

Defined results: null and empty texts get the score of the zero vector; without both labels in the sample the
score is the share of toxic labels (0.0 without labels); a document labelled twice is toxic if any label is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import Scratch, held_out, map_text
from palimpsest.llm.textscan import WordMemo, Words, mix, scan, span_hash

#: Documents of a sample: clean and toxic.
SAMPLE = {0: 4000, 1: 2000}
BUCKETS, DIM, GRAMS = 1 << 16, 8, (3, 4, 5)
#: Factor of the average; passes, texts of a step, rate, shrinkage and damping of the training.
GAIN, EPOCHS, BATCH, RATE, DECAY, EASE = 32.0, 6, 50, 0.03, 0.5, 1e-3
#: Bytes of features that the driver holds at a time, and texts that are sent to it at once.
CHUNK_BYTES, SENT = 128 << 20, 200
#: Steps that a small sample gets at least.
LEAST_STEPS = 500

#: Buckets and weights of texts, and their labels.
Chunk = tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]

_OPEN, _CLOSE = 0xFFFFFFF0, 0xFFFFFFF1


def subwords(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all subwords of all words, and the word that each belongs to."""
    flat = np.frombuffer(" ".join(w.decode("utf-8", "replace") for w in words).encode("utf-32-le") + b"\x20\0\0\0", np.uint32)
    ends = np.flatnonzero(flat == 0x20)
    size = np.diff(np.concatenate([[-1], ends])) - 1
    begin = np.concatenate([[0], np.cumsum(size + 2)])
    codes = np.empty(begin[-1], np.uint64)
    inner = np.ones(begin[-1], bool)
    inner[begin[:-1]] = inner[begin[1:] - 1] = False
    codes[inner] = flat[flat != 0x20]
    codes[begin[:-1]], codes[begin[1:] - 1] = _OPEN, _CLOSE
    codes = mix(codes + np.uint64(0x51ED270B))
    own = np.repeat(np.arange(len(words)), size + 2)
    stop = begin[1:][own]
    at = np.arange(len(codes))
    starts, stops, owners = [begin[:-1]], [begin[1:]], [np.arange(len(words))]
    for n in GRAMS:
        fits = at + n <= stop
        starts.append(at[fits])
        stops.append(at[fits] + n)
        owners.append(own[fits])
    s, e, o = np.concatenate(starts), np.concatenate(stops), np.concatenate(owners)
    return (span_hash(codes, s, e) % np.uint64(BUCKETS)).astype(np.int64), o


def _scanned(texts: list[str | None]) -> Words:
    return scan([(t or "").lower().encode() for t in texts], lower=False)


def features(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text the buckets of its vector and their weights, which sum to 1."""
    words = _scanned(texts)
    out = []
    for d in range(len(texts)):
        lo, hi = np.searchsorted(words.doc, [d, d + 1])
        if lo == hi:
            out.append((np.zeros(0, np.int64), np.zeros(0)))
            continue
        _, first, count = np.unique(words.hash[lo:hi], return_index=True, return_counts=True)
        bucket, owner = subwords([words.text(lo + i) for i in first])
        weight = (count / (hi - lo) / np.bincount(owner))[owner]
        which, inverse = np.unique(bucket, return_inverse=True)
        out.append((which, np.bincount(inverse, weights=weight)))
    return out


class SubwordSoftmax:
    """Embeddings of buckets, and a softmax over two classes of their average."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.embed = rng.standard_normal((BUCKETS, DIM)).astype(np.float32) * np.float32(0.01)
        self.out = rng.standard_normal((DIM, 2)).astype(np.float32) * 0.5
        self.bias = np.zeros(2, np.float32)

    def train(self, chunks: Callable[[], Iterator[Chunk]], texts: int, seed: int = 9) -> list[float]:
        """Mean losses of the passes over ``chunks()``, which hold ``texts`` texts in all."""
        rng = np.random.default_rng(seed)
        p = {"embed": self.embed, "out": self.out, "bias": self.bias}
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.v2 = {k: np.zeros_like(v) for k, v in p.items()}
        step, losses = 0, []
        each = -(-texts // BATCH)
        epochs = max(EPOCHS, -(-LEAST_STEPS // each))
        for _ in range(epochs):
            seen = []
            for rows, label in chunks():
                order = rng.permutation(len(rows))
                for a in range(0, len(order), BATCH):
                    own = order[a : a + BATCH]
                    loss, grads = self.gradients([rows[i] for i in own], label[own])
                    step += 1
                    self._move(grads, step, RATE * max(0.0, 1 - step / (epochs * each + 1)))
                    seen.append(loss)
            losses.append(float(np.mean(seen)))
        return losses

    def gradients(self, rows: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray) -> tuple[float, list[tuple]]:
        """The mean cross-entropy of some texts, and (name, gradient, rows that it is for) of every parameter."""
        which = np.concatenate([r[0] for r in rows]).astype(np.int64)
        weight = np.concatenate([r[1] for r in rows]) * GAIN
        doc = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
        used, slot = np.unique(which, return_inverse=True)
        vec = np.stack([np.bincount(doc, weights=self.embed[which, k] * weight, minlength=len(rows)) for k in range(DIM)], 1)
        logit = vec @ self.out + self.bias
        prob = np.exp(logit - logit.max(1, keepdims=True))
        prob /= prob.sum(1, keepdims=True)
        loss = float(-np.log(prob[np.arange(len(rows)), label] + 1e-12).mean())
        prob[np.arange(len(rows)), label] -= 1
        prob /= len(rows)
        dvec = prob @ self.out.T
        bag = np.stack([np.bincount(slot, weights=dvec[doc, k] * weight, minlength=len(used)) for k in range(DIM)], 1)
        return loss, [("embed", bag, used), ("out", vec.T @ prob, slice(None)), ("bias", prob.sum(0), slice(None))]

    def _move(self, grads: list[tuple], step: int, rate: float) -> None:
        for k, g, at in grads:
            p, m, v2 = getattr(self, k), self.m[k], self.v2[k]
            m[at] += 0.1 * (g - m[at])
            v2[at] += 0.01 * (g * g - v2[at])
            p[at] -= rate * (m[at] / (1 - 0.9**step)) / (np.sqrt(v2[at] / (1 - 0.99**step)) + EASE)
        self.embed[grads[0][2]] *= 1 - rate * DECAY

    def word_scorer(self) -> WordScorer:
        direction = self.out[:, 1] - self.out[:, 0]
        return WordScorer((self.embed @ direction * GAIN).astype(np.float32), float(self.bias[1] - self.bias[0]))


class WordScorer:
    """What scoring needs of a trained model: a number per bucket, and the bias."""

    def __init__(self, bucket: np.ndarray, bias: float):
        self.bucket, self.bias = bucket, bias
        self.key = (hash(bucket.tobytes()), bias)

    def values(self, words: list[bytes]) -> np.ndarray:
        which, owner = subwords(words)
        total = np.bincount(owner, weights=self.bucket[which], minlength=len(words))
        return (total / np.bincount(owner, minlength=len(words)))[:, None]

    def score(self, texts: list[str | None]) -> np.ndarray:
        words = _scanned(texts)
        place, table = _memo(self).lookup(words, self.values)
        total = np.bincount(words.doc, weights=table[:, 0][place].astype(np.float64) if len(table) else None, minlength=len(texts))
        logit = total / np.maximum(np.bincount(words.doc, minlength=len(texts)), 1) + self.bias
        return 0.5 * (1 + np.tanh(logit / 2))


_memos: dict[object, WordMemo] = {}


def _memo(scorer: WordScorer) -> WordMemo:
    if scorer.key not in _memos:
        _memos.clear()
        _memos[scorer.key] = WordMemo(1)
    return _memos[scorer.key]


def train(docs: DataFrame, labels: DataFrame) -> WordScorer:
    """A scorer trained on a bounded sample of labelled documents that are not held out."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    sample = [r for c, n in SAMPLE.items() for r in known.filter(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).collect()]
    spark = docs.sparkSession
    ids = spark.createDataFrame(sample, known.schema)

    def work(part: pa.RecordBatch) -> dict:
        rows = features(part.column(1).to_pylist())
        return {"doc_id": part.column(0), "toxic": part.column(2), "which": [r[0].astype("<u2").tobytes() for r in rows], "weight": [r[1].astype("<f4").tobytes() for r in rows]}

    # The sample has at most sum(SAMPLE.values()) ids, so it can be broadcast.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id").select("doc_id", "text", "toxic")
    scratch = Scratch(spark, "toxicity")
    found = scratch.cut(map_text(texts, work, "doc_id long, toxic int, which binary, weight binary"))
    count = {r["toxic"]: r["n"] for r in found.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    texts_n = sum(count.values())
    if len(count) < 2:
        share = count.get(1, 0) / texts_n if texts_n else 0.0
        return WordScorer(np.zeros(BUCKETS, np.float32), float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    h = F.xxhash64("doc_id")
    sorted_rows = found.withColumn("h", h).repartitionByRange(-(-texts_n // SENT), "h").sortWithinPartitions("h", "doc_id", "which")
    model = SubwordSoftmax()
    model.train(_Chunks(sorted_rows), texts_n)
    scratch.drop(found)
    return model.word_scorer()


class _Chunks:
    """Passes over a written sample in the order of a hash, at most ``CHUNK_BYTES`` of it at a time. What fits in whole is read once."""

    def __init__(self, rows: DataFrame):
        self.rows, self.whole = rows, None

    def __call__(self) -> Iterator[Chunk]:
        if self.whole:
            yield self.whole
            return
        held, label, size, sent = [], [], 0, 0
        for r in self.rows.toLocalIterator():
            held.append((np.frombuffer(r["which"], "<u2"), np.frombuffer(r["weight"], "<f4")))
            label.append(r["toxic"])
            size += len(r["which"]) + len(r["weight"])
            if size >= CHUNK_BYTES:
                yield held, np.array(label, np.int64)
                held, label, size, sent = [], [], 0, sent + 1
        if held:
            if not sent:
                self.whole = held, np.array(label, np.int64)
            yield held, np.array(label, np.int64)


def score(docs: DataFrame, scorer: WordScorer) -> DataFrame:
    """doc_id, held_out, score, predicted: a row per row of ``docs`` (doc_id, text, ...)."""

    def work(part: pa.RecordBatch) -> dict:
        return {"doc_id": part.column(0), "score": scorer.score(part.column(1).to_pylist())}

    rows = map_text(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), work, "doc_id long, score double")
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
