"""Scoring by masked pseudo-likelihood: a bidirectional window network predicts every token from both sides.

A token is a word, and its probability a product along a tree. The network sums position-wise embeddings of ``SIDE`` tokens on either
side, applies tanh, and predicts by two softmaxes a group, then within it one of the most frequent words of the whole corpus or one of
``BUCKETS`` classes of all other words (by ending). Within a class a word has the share that it has in the corpus: counts of all
words, one row each, form a distributed table that grows with the input and meets the tokens by a shuffle. A document's score is the
sum of the conditional log-probabilities of all its tokens.

Training reads every document: documents are dealt by a hash of id and text into shards of about ``SHARD`` tokens, each shard trains
a copy in numpy, one pass in the order of that hash in steps of ``STEP``, and the copies are averaged by tokens, on the
executors, piece by piece, in memory bounded by the model. So a score does not depend on how the input is partitioned. The driver
receives the frequent words, the classes' totals and one model, all of fixed size.

Counts in a class are raised by one, and one share is left for a word that the corpus lacks, so a model scores other documents too.

Defined results: null and blank texts have no tokens and score 0.0, with a null mean; a corpus without words gives
an untrained network; of words of equal count those of smaller hash are the frequent ones. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import SLICE_BYTES, Scratch, text_slices
from palimpsest.llm.textscan import Words, mix, scan

#: Tokens of the network, of them classes of other words; groups of the softmax; width of the network; window on a side.
VOCABULARY, BUCKETS, GROUPS, WIDTH, SIDE = 1024, 255, 32, 16, 2
STEP, RATE = 8192, 0.1
#: Numbers of the model in a row of the averaging; tokens of a training shard; rare words of a part of the table of words.
PIECE, SHARD, PART = 4096, 1 << 22, 1 << 20
EDGE = 0


class WindowNetwork:
    """Parameters and passes of the network."""

    SHAPES = {"embed": (2 * SIDE, VOCABULARY, WIDTH), "hidden": (WIDTH,), "group": (WIDTH, GROUPS), "group_b": (GROUPS,), "inner": (GROUPS, WIDTH, VOCABULARY // GROUPS), "inner_b": (GROUPS, VOCABULARY // GROUPS)}

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.p = {k: (rng.standard_normal(s) * (0.0 if k.endswith("_b") or k == "hidden" else 0.1)).astype(np.float32) for k, s in self.SHAPES.items()}
        self.square = {k: np.full(s, 1e-3, np.float32) for k, s in self.SHAPES.items()}

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in self.SHAPES])

    def load(self, flat: np.ndarray) -> WindowNetwork:
        at = 0
        for k, s in self.SHAPES.items():
            n = int(np.prod(s))
            self.p[k] = np.ascontiguousarray(flat[at : at + n], np.float32).reshape(s)
            at += n
        return self

    def log_probs(self, context: np.ndarray, target: np.ndarray, learn: bool = False) -> np.ndarray:
        """Log-probability of each target given its context (2 * SIDE, rows); a gradient step if ``learn``."""
        p, rows = self.p, np.arange(len(target))
        total = p["embed"][0].take(context[0], 0)
        for j in range(1, 2 * SIDE):
            total += p["embed"][j].take(context[j], 0)
        total += p["hidden"]
        h = np.tanh(total, out=total)
        each = VOCABULARY // GROUPS
        g, w = target // each, target % each
        gp = _softmax(h @ p["group"] + p["group_b"])
        out = np.log(gp[rows, g] + 1e-12)
        order = np.argsort(g.astype(np.uint8), kind="stable")
        ends = np.searchsorted(g[order], np.arange(GROUPS + 1))
        if learn:
            n = len(target)
            gp[rows, g] -= 1
            gp /= n
            dh = gp @ p["group"].T
            step = {"group": h.T @ gp, "group_b": gp.sum(0), "inner": np.zeros_like(p["inner"]), "inner_b": np.zeros_like(p["inner_b"])}
        for k in range(GROUPS):
            own = order[ends[k] : ends[k + 1]]
            if not len(own):
                continue
            ho = h.take(own, 0)
            ip = _softmax(ho @ p["inner"][k] + p["inner_b"][k])
            at = (np.arange(len(own)), w[own])
            out[own] += np.log(ip[at] + 1e-12)
            if learn:
                ip[at] -= 1
                ip /= n
                step["inner"][k], step["inner_b"][k] = ho.T @ ip, ip.sum(0)
                dh[own] += ip @ p["inner"][k].T
        if learn:
            dh *= 1 - h * h
            step["hidden"] = dh.sum(0)
            for k, gr in step.items():
                self.square[k] += gr * gr
                p[k] -= RATE * gr / np.sqrt(self.square[k])
            for j in range(2 * SIDE):
                order = np.argsort(context[j].astype(np.uint16), kind="stable")
                sorted_ids = context[j].take(order)
                first = np.flatnonzero(np.concatenate([[True], sorted_ids[1:] != sorted_ids[:-1]]))
                used = sorted_ids[first]
                gr = np.add.reduceat(dh.take(order, 0), first, axis=0)
                self.square["embed"][j][used] += gr * gr
                p["embed"][j][used] -= RATE * gr / np.sqrt(self.square["embed"][j][used])
        return out


def _softmax(x: np.ndarray) -> np.ndarray:
    """Softmax of rows. States lie within -1 and 1, so logits are small; the clip only guards against overflow."""
    np.clip(x, -80, 80, out=x)
    np.exp(x, out=x)
    x /= (x @ np.ones(x.shape[1], np.float32))[:, None]
    return x


@dataclass
class Model:
    """Hashes of the frequent words, ascending, with their tokens; the network's numbers; per token its count and number of words; the table of all words."""

    known: np.ndarray
    token: np.ndarray
    flat: np.ndarray
    count: np.ndarray
    distinct: np.ndarray
    words: DataFrame

    def tokens(self, found: Words) -> np.ndarray:
        return tokens_of(found, self.known, self.token)


def class_of(found: Words) -> np.ndarray:
    """1 to ``BUCKETS`` by the last three bytes of each word."""
    size, code = found.end - found.start, np.zeros(len(found.end), np.uint64)
    for j in range(1, 4):
        byte = found.data[np.maximum(found.end - j, 0)].astype(np.uint64) + np.uint64(1)
        code = code * np.uint64(257) + np.where(size >= j, byte, np.uint64(0))
    return 1 + (mix(code) % np.uint64(BUCKETS)).astype(np.int64)


def tokens_of(found: Words, known: np.ndarray, token: np.ndarray) -> np.ndarray:
    out = class_of(found)
    if len(known):
        at = np.searchsorted(known, found.hash)
        at[at == len(known)] = 0
        hit = known[at] == found.hash
        out[hit] = token[at[hit]]
    return out


def contexts(token: np.ndarray, doc: np.ndarray, texts: int) -> np.ndarray:
    """The ids of ``SIDE`` tokens before and after each token (2 * SIDE, tokens). Texts are set apart by SIDE edges."""
    pad = np.full(len(token) + SIDE * (texts + 1), EDGE, np.int64)
    at = np.arange(len(token)) + SIDE * (doc + 1)
    pad[at] = token
    return np.stack([pad[at + o] for o in (*range(-SIDE, 0), *range(1, SIDE + 1))])


def _slices(batches, column: int):
    for part in text_slices(batches, column, SLICE_BYTES):
        yield part, scan(part.column(column).cast(pa.binary()).to_pylist())


def count_words(docs: DataFrame) -> DataFrame:
    """h, class, n: a row per distinct word of all texts."""

    def run(batches):
        for _, found in _slices(batches, 0):
            h, first, n = np.unique(found.hash, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_pydict({"h": h.view(np.int64), "class": class_of(found)[first], "n": n})

    parts = docs.select("text").mapInArrow(run, "h long, class long, n long")
    return parts.groupBy("h", "class").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, scratch: Scratch) -> Model:
    """A model of all texts of ``docs``."""
    words = scratch.cut(count_words(docs))
    top = words.orderBy(F.desc("n"), "h").limit(VOCABULARY - 1 - BUCKETS).collect()
    known = np.array([r["h"] for r in top], np.int64).view(np.uint64)
    order = np.argsort(known)
    count, distinct = np.zeros(VOCABULARY, np.int64), np.zeros(VOCABULARY, np.int64)
    for r in words.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("d")).collect():
        count[r["class"]], distinct[r["class"]] = r["n"], r["d"]
    total = int(count.sum())
    for r in top:
        count[r["class"]] -= r["n"]
        distinct[r["class"]] -= 1
    model = Model(known[order], (1 + BUCKETS + np.arange(len(top)))[order], WindowNetwork().flat(), count, distinct, words)
    if total:
        model.flat = _trained(docs, model, max(1, round(total / SHARD)))
    return model


def _trained(docs: DataFrame, model: Model, shards: int) -> np.ndarray:
    """The average of the networks of all shards, weighted by their tokens."""
    known, token = model.known, model.token

    def code(batches):
        for part, found in _slices(batches, 1):
            ids = tokens_of(found, known, token).astype(np.uint16)
            at = np.searchsorted(found.doc, np.arange(part.num_rows + 1))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([ids[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary())], ["key", "ids"])

    def learn(batches):
        net, seen, shard = WindowNetwork(), 0, None
        held: list[np.ndarray] = []

        def step() -> int:
            ids = np.concatenate(held).astype(np.int64)
            doc = np.repeat(np.arange(len(held)), [len(x) for x in held])
            context = contexts(ids, doc, len(held))
            for a in range(0, len(ids), STEP):
                net.log_probs(context[:, a : a + STEP], ids[a : a + STEP], learn=True)
            held.clear()
            return len(ids)

        def done():
            flat = net.flat().astype(np.float64)
            cut = [flat[a : a + PIECE] for a in range(0, len(flat), PIECE)]
            return pa.RecordBatch.from_pydict({"piece": np.arange(len(cut)), "weight": np.full(len(cut), float(seen)), "numbers": [c * seen for c in cut]})

        size = 0
        for batch in batches:
            for own, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
                if own != shard and shard is not None:
                    seen += step() if held else 0
                    yield done()
                    net, seen, size = WindowNetwork(), 0, 0
                shard = own
                held.append(np.frombuffer(ids.as_buffer(), np.uint16))
                size += len(held[-1])
                if size >= 16 * STEP:
                    seen, size = seen + step(), 0
        if shard is not None:
            seen += step() if held else 0
            yield done()

    def add(batches):
        sums: dict[int, list] = {}
        for batch in batches:
            for piece, weight, numbers in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                have = sums.setdefault(piece, [0.0, 0.0])
                have[0] += weight
                have[1] = have[1] + numbers.values.to_numpy()
        if sums:
            yield pa.RecordBatch.from_pydict({"piece": list(sums), "weight": [s[0] for s in sums.values()], "numbers": [s[1] for s in sums.values()]})

    schema = "piece long, weight double, numbers array<double>"
    coded = docs.select(F.xxhash64("doc_id", "text").alias("key"), "text").mapInArrow(code, "key long, ids binary").filter(F.length("ids") > 0)
    dealt = coded.select(F.pmod("key", F.lit(shards)).alias("shard"), "ids", "key").repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("shard", "key", "ids")
    copies = dealt.select("shard", "ids").mapInArrow(learn, schema)
    # Partial sums first: a piece's copies are spread over up to 16 tasks, whatever their number.
    partial = copies.repartition(F.col("piece"), F.pmod(F.spark_partition_id(), F.lit(16))).mapInArrow(add, schema)
    weight: dict[int, float] = {}
    total: dict[int, np.ndarray] = {}
    for r in partial.repartition("piece").mapInArrow(add, schema).orderBy("piece").collect():
        weight[r["piece"]] = weight.get(r["piece"], 0.0) + r["weight"]
        total[r["piece"]] = total.get(r["piece"], 0.0) + np.array(r["numbers"])
    return np.concatenate([total[k] / weight[k] for k in sorted(total)]).astype(np.float32)


def network_scores(token: np.ndarray, doc: np.ndarray, texts: int, net: WindowNetwork) -> np.ndarray:
    """Per text the summed log-probabilities of its tokens as the network has them."""
    total, context = np.zeros(texts), contexts(token, doc, texts)
    for a in range(0, len(token), STEP):
        part = slice(a, a + STEP)
        total += np.bincount(doc[part], weights=net.log_probs(context[:, part], token[part]), minlength=texts)
    return total


#: A rare word's place in its slice, and its hash.
_AT = np.dtype([("h", "<u8"), ("doc", "<u2")])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, log_likelihood, mean_log_likelihood: a row per row of ``docs`` (doc_id, text, ...).

    A slice of texts sends its rare words to the parts of the table of words, dealt by hash, and gets back a sum for each text. No rare
    word makes up more than 1 / (``VOCABULARY`` - ``BUCKETS``) of the corpus, so no part is hot.
    """
    known, token, flat = model.known, model.token, model.flat
    parts = max(1, -(-int(model.count.sum()) // PART))
    # Of a class's words together with one that is not there.
    norm = np.log(np.maximum(model.count + model.distinct + 1, 1))
    pack = "part int, kind int, slice long, body binary"

    def code(batches):
        net, place = WindowNetwork().load(flat), TaskContext.get().partitionId() << 32
        for k, (part, found) in enumerate(_slices(batches, 1)):
            ids, rows = tokens_of(found, known, token), part.num_rows
            rare = ids <= BUCKETS
            total = network_scores(ids, found.doc, rows, net) - np.bincount(found.doc[rare], weights=norm[ids[rare]], minlength=rows)
            head = pa.RecordBatch.from_arrays([part.column(0), pa.array(np.bincount(found.doc, minlength=rows)), pa.array(total)], ["doc_id", "n", "total"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, head.schema) as out:
                out.write_batch(head)
            at = np.zeros(int(rare.sum()), _AT)
            at["h"], at["doc"] = found.hash[rare], found.doc[rare]
            own = (at["h"] % np.uint64(parts)).astype(np.int64)
            order = np.argsort(own, kind="stable")
            at, ends = at[order], np.searchsorted(own[order], np.arange(parts + 1))
            some = np.flatnonzero(np.diff(ends))
            bodies = [at[ends[p] : ends[p + 1]].tobytes() for p in some]
            n = len(some) + 1
            yield pa.RecordBatch.from_pydict({"part": pa.array([int(place + k) % parts, *some.tolist()], pa.int32()), "kind": pa.array([2] + [1] * (n - 1), pa.int32()), "slice": [place + k] * n, "body": [sink.getvalue().to_pybytes(), *bodies]})

    def table(batches):
        for batch in batches:
            h = batch.column(0).to_numpy().view(np.uint64)
            own = (h % np.uint64(parts)).astype(np.int64)
            order = np.argsort(own, kind="stable")
            rows = np.stack([h.view(np.int64), batch.column(1).to_numpy()], 1)[order]
            ends = np.searchsorted(own[order], np.arange(parts + 1))
            some = np.flatnonzero(np.diff(ends))
            yield pa.RecordBatch.from_pydict({"part": pa.array(some, pa.int32()), "kind": pa.array(np.zeros(len(some)), pa.int32()), "slice": np.zeros(len(some), np.int64), "body": [rows[ends[p] : ends[p + 1]].tobytes() for p in some]})

    def look(batches):
        part, held, h, logs = None, [], None, None
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for own, kind, place, body in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3)):
                if own != part:
                    part, held, h = own, [], None
                if kind == 0:
                    held.append(np.frombuffer(body.as_buffer(), np.int64).reshape(-1, 2))
                    continue
                if kind == 1:
                    if h is None:
                        rows = np.concatenate(held) if held else np.zeros((0, 2), np.int64)
                        h = rows[:, 0].copy().view(np.uint64)
                        order = np.argsort(h)
                        h, logs, held = h[order], np.log(rows[order, 1] + 1.0), []
                    at = np.frombuffer(body.as_buffer(), _AT)
                    where = np.searchsorted(h, at["h"])
                    where[where == len(h)] = 0
                    gain = np.where(h[where] == at["h"], logs[where], 0.0) if len(h) else np.zeros(len(at))
                    body = np.bincount(at["doc"], weights=gain).tobytes()
                else:
                    body = body.as_py()
                out[0].append(kind)
                out[1].append(place)
                out[2].append(body)
            if out[0]:
                yield pa.RecordBatch.from_pydict({"kind": pa.array(out[0], pa.int32()), "slice": out[1], "body": out[2]})

    def total(batches):
        place, sums = None, np.zeros(0)
        for batch in batches:
            for kind, own, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if own != place:
                    place, sums = own, np.zeros(4096)  # texts of a slice at most
                if kind == 1:
                    more = np.frombuffer(body.as_buffer(), np.float64)
                    sums[: len(more)] += more
                    continue
                head = pa.ipc.open_stream(body.as_buffer()).read_all().combine_chunks().to_batches()[0]
                n = head.column(1).to_numpy()
                ll = head.column(2).to_numpy() + sums[: len(n)]
                mean = pa.array(np.divide(ll, n, out=np.zeros(len(n)), where=n > 0), mask=n == 0)
                yield pa.RecordBatch.from_arrays([head.column(0), pa.array(n, pa.int64()), pa.array(ll), mean], ["doc_id", "n_tokens", "log_likelihood", "mean_log_likelihood"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(code, pack)
    words = model.words.select("h", "n").mapInArrow(table, pack)
    met = texts.union(words).repartition(parts, "part").sortWithinPartitions("part", "kind").mapInArrow(look, "kind int, slice long, body binary")
    back = met.repartition("slice").sortWithinPartitions("slice", "kind")
    return back.mapInArrow(total, "doc_id long, n_tokens long, log_likelihood double, mean_log_likelihood double")
