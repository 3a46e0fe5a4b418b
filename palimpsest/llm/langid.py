"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the bytes of a text, separators included, forwards and backwards, labels every byte position with language
probabilities, and is trained in numpy by backpropagation through time. Its state runs on across words. A text is read in
windows that overlap: a window labels ``CORE`` positions, and its two directions start ``CONTEXT`` bytes before and behind
them (at the text's ends where these are nearer), after which a start has no effect that counts. A document's probabilities are
the mean over all byte positions of its whole text.

Learning uses a bounded sample: of documents that are not held out, at most ``SAMPLE_DOCS`` per language, and of all their
pieces of ``PIECE`` bytes at most ``SAMPLE_PIECES`` per language, both chosen by hash. Every non-null ``lang`` is learned;
the driver holds a label, an output column and a sample for each.

Defined results: null text or text without a letter is ``und`` with score 0; without any labelled text
everything is ``und``; ties go to the alphabetically first language.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import held_out, map_text, text_slices

#: The sample of a language: documents, pieces of them, and bytes of a piece.
SAMPLE_DOCS, SAMPLE_PIECES, PIECE = 400, 1200, 96
#: Positions that a window labels, bytes of context on either side, and states that a batch of windows holds.
CORE, CONTEXT, STATES = 896, 64, 1 << 23
#: Sizes of the network and its training.
EMBED, HIDDEN = 8, 8
EPOCHS, BATCH, RATE = 8, 64, 0.01

_LETTER = regex.compile(r"\p{L}")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1.0)


class ByteTagger:
    """The network: embedding, two gated recurrent layers of opposite direction, a softmax per position."""

    def __init__(self, labels: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        w = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.labels = labels
        self.p = {"embed": w(256, EMBED) * 4, "out": w(2 * HIDDEN, len(labels)), "bias": np.zeros(len(labels), np.float32)}
        for d in "fb":
            self.p |= {f"{d}x": w(EMBED, 3 * HIDDEN), f"{d}h": w(HIDDEN, 3 * HIDDEN), f"{d}c": np.zeros(3 * HIDDEN, np.float32)}

    def _run(self, d: str, codes: np.ndarray, live: np.ndarray, keep: list | None) -> np.ndarray:
        """States (time, rows, HIDDEN) of one direction; a row's state stays zero outside its window."""
        steps, rows = codes.shape
        p, H = self.p, HIDDEN
        table = p["embed"] @ p[f"{d}x"] + p[f"{d}c"]
        states = np.zeros((steps, rows, H), np.float32)
        h = np.zeros((rows, H), np.float32)
        wr, wn = p[f"{d}h"][:, : 2 * H], p[f"{d}h"][:, 2 * H :]
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            x = table[codes[t]]
            g = _sigmoid(x[:, : 2 * H] + h @ wr)
            z, r = g[:, :H], g[:, H:]
            n = np.tanh(x[:, 2 * H :] + (r * h) @ wn)
            new = (h + z * (n - h)) * live[t][:, None]
            if keep is not None:
                keep.append((t, h, z, r, n))
            h = states[t] = new
        return states

    def forward(self, codes: np.ndarray, live: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Probabilities (time, rows, labels) for codes and live flags of shape (time, rows)."""
        f = self._run("f", codes, live, None if keep is None else keep.setdefault("f", []))
        b = self._run("b", codes, live, None if keep is None else keep.setdefault("b", []))
        states = np.concatenate([f, b], axis=2)
        logits = states @ self.p["out"] + self.p["bias"]
        logits -= logits.max(axis=2, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=2, keepdims=True)
        if keep is not None:
            keep["states"] = states
        return logits

    def gradients(self, codes: np.ndarray, live: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[float, dict]:
        """Mean weighted cross-entropy over live positions, and its gradients, back through time."""
        keep: dict = {}
        prob = self.forward(codes, live, keep)
        p, H = self.p, HIDDEN
        share = live * weight[None, :]
        share = share / max(share.sum(), 1e-9)
        hit = np.take_along_axis(prob, np.broadcast_to(target[None, :, None], (*codes.shape, 1)), 2)[:, :, 0]
        loss = float(-(np.log(hit + 1e-12) * share).sum())
        d = prob * share[:, :, None]
        d[:, np.arange(len(target)), target] -= share
        grad = {"out": np.tensordot(keep["states"], d, ([0, 1], [0, 1])), "bias": d.sum((0, 1)), "embed": np.zeros_like(p["embed"])}
        back = d @ p["out"].T
        for k, side in enumerate("fb"):
            gx, gh = np.zeros_like(p[f"{side}x"]), np.zeros_like(p[f"{side}h"])
            gtable = np.zeros((256, 3 * H), np.float32)
            wh = p[f"{side}h"]
            dh = np.zeros((codes.shape[1], H), np.float32)
            for t, h, z, r, n in reversed(keep[side]):
                dnew = (dh + back[t][:, k * H : (k + 1) * H]) * live[t][:, None]
                dn = dnew * z * (1 - n * n)
                dz = dnew * (n - h) * z * (1 - z)
                drh = dn @ wh[:, 2 * H :].T
                dr = drh * h * r * (1 - r)
                da = np.concatenate([dz, dr, dn], axis=1)
                dh = dnew * (1 - z) + drh * r + da[:, : 2 * H] @ wh[:, : 2 * H].T
                gh[:, : 2 * H] += h.T @ da[:, : 2 * H]
                gh[:, 2 * H :] += (r * h).T @ dn
                np.add.at(gtable, codes[t], da)
            gx = p["embed"].T @ gtable
            grad |= {f"{side}x": gx, f"{side}h": gh, f"{side}c": gtable.sum(0)}
            grad["embed"] += gtable @ p[f"{side}x"].T
        return loss, grad

    def train(self, windows: list[bytes], target: np.ndarray, weight: np.ndarray, epochs: int = EPOCHS, seed: int = 11) -> list[float]:
        rng = np.random.default_rng(seed)
        codes, live = pack(windows)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        step, losses = 0, []
        total = epochs * (-(-len(windows) // BATCH))
        for _ in range(epochs):
            order, seen = rng.permutation(len(windows)), []
            for a in range(0, len(order), BATCH):
                rows = order[a : a + BATCH]
                long = int(live[:, rows].sum(0).max())
                loss, grad = self.gradients(codes[:long, rows], live[:long, rows], target[rows], weight[rows])
                step += 1
                rate = RATE * (1 - step / (total + 1))
                for k, g in grad.items():
                    m[k] += 0.1 * (g - m[k])
                    v2[k] += 0.005 * (g * g - v2[k])
                    self.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.995**step)) + 1e-8)).astype(np.float32)
                seen.append(loss)
            losses.append(float(np.mean(seen)))
        return losses

    def position_sums(self, texts: list[bytes]) -> np.ndarray:
        """Per text the label probabilities summed over its byte positions, then the number of positions."""
        out = np.zeros((len(texts), len(self.labels) + 1))
        out[:, -1] = [len(t) for t in texts]
        cut = [(len(t[lo:hi]), i, a - lo, min(a + CORE, len(t)) - lo, t[lo:hi]) for i, t in enumerate(texts) for a in range(0, len(t), CORE) for lo, hi in [(max(0, a - CONTEXT), a + CORE + CONTEXT)]]
        cut.sort(key=lambda w: -w[0])
        at = 0
        while at < len(cut):
            rows = min(512, max(1, STATES // (cut[at][0] * (2 * HIDDEN + 2 * len(self.labels)))))
            own = cut[at : at + rows]
            for (_, i, _, _, _), sums in zip(own, self._window_sums(own)):
                out[i, :-1] += sums
            at += rows
        return out

    def _window_sums(self, windows: list[tuple]) -> np.ndarray:
        """Summed probabilities of the labelled positions of windows (size, text, from, to, bytes), longest first.

        Both directions run side by side, the second over reversed bytes. Weights of the gates are halved, as a sigmoid is half a tanh.
        """
        p, H, rows = self.p, HIDDEN, len(windows)
        size = np.array([w[0] for w in windows])
        steps = int(size[0])
        codes = np.zeros((2, rows, steps), np.uint8)
        for i, w in enumerate(windows):
            codes[0, i, : w[0]] = np.frombuffer(w[4], np.uint8)
            codes[1, i, : w[0]] = codes[0, i, w[0] - 1 :: -1]
        codes = np.ascontiguousarray(codes.transpose(2, 0, 1))
        half = np.repeat(np.float32([0.5, 0.5, 1.0]), H)
        tables = [((p["embed"] @ p[f"{d}x"] + p[f"{d}c"]) * half).astype(np.float32) for d in "fb"]
        gates = np.stack([p[f"{d}h"][:, : 2 * H] * 0.5 for d in "fb"])
        inner = np.stack([p[f"{d}h"][:, 2 * H :] * 0.5 for d in "fb"])
        states = np.zeros((steps, 2, rows, H), np.float32)
        live = np.searchsorted(-size, -np.arange(steps), "left")
        h = np.zeros((2, rows, H), np.float32)
        x = np.empty((2, rows, 3 * H), np.float32)
        for t in range(steps):
            m = live[t]
            if m < h.shape[1]:
                h = np.ascontiguousarray(h[:, :m])
                x = np.empty((2, m, 3 * H), np.float32)
            np.take(tables[0], codes[t, 0, :m], 0, out=x[0], mode="clip")
            np.take(tables[1], codes[t, 1, :m], 0, out=x[1], mode="clip")
            g = np.matmul(h, gates)
            g += x[:, :, : 2 * H]
            np.tanh(g, out=g)
            g += 1
            n = np.matmul(g[:, :, H:] * h, inner)
            n += x[:, :, 2 * H :]
            np.tanh(n, out=n)
            n -= h
            n *= g[:, :, :H]
            n *= 0.5
            h += n
            states[t, :, :m] = h
        logits = np.empty((steps, rows, len(self.labels)), np.float32)
        np.matmul(states[:, 0], p["out"][:H], out=logits)
        back = np.matmul(states[:, 1], p["out"][H:])
        for i, n in enumerate(size):
            logits[:n, i] += back[n - 1 :: -1, i]
        logits += p["bias"]
        logits -= logits.max(axis=2, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=2, keepdims=True)
        place = np.arange(steps)[:, None]
        own = (place >= np.array([w[2] for w in windows])) & (place < np.array([w[3] for w in windows]))
        return np.einsum("trl,tr->rl", logits, own.astype(np.float32)).astype(np.float64)


def pack(windows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes and live flags, (time, rows), of byte windows."""
    sizes = np.array([len(w) for w in windows])
    steps = int(sizes.max(initial=1))
    flat = np.frombuffer(b"".join(w.ljust(steps, b"\0") for w in windows), np.uint8).reshape(len(windows), steps)
    live = np.arange(steps)[:, None] < sizes[None, :]
    return np.ascontiguousarray(flat.T), live.astype(np.float32)


def train(docs: DataFrame) -> ByteTagger | None:
    """A network trained on a bounded sample of labelled documents that are not held out."""
    known = docs.select("doc_id", "lang", "text").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    every = F.element_at(F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, max(1, n // SAMPLE_DOCS))]), F.col("lang"))
    order = F.xxhash64("doc_id", "text")
    first = Window.partitionBy("lang").orderBy("h", "doc_id")
    chosen = known.withColumn("h", order).filter(F.pmod(F.col("h"), every) == 0).withColumn("place", F.row_number().over(first)).filter(F.col("place") <= SAMPLE_DOCS)

    def cut(batches):
        for batch in batches:
            for part in text_slices([batch], 1):
                rows = [(lang, a, raw[a : a + PIECE]) for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) for raw in [text.lower().encode()] for a in range(0, len(raw), PIECE)]
                yield pa.RecordBatch.from_pydict({"lang": [r[0] for r in rows], "at": [r[1] for r in rows], "piece": [r[2] for r in rows]}, schema=pa.schema([("lang", pa.string()), ("at", pa.int64()), ("piece", pa.binary())]))

    pieces = chosen.select("lang", "text").mapInArrow(cut, "lang string, at long, piece binary")
    pick = Window.partitionBy("lang").orderBy(F.xxhash64("piece", "at"), "piece")
    rows = pieces.withColumn("place", F.row_number().over(pick)).filter(F.col("place") <= SAMPLE_PIECES).orderBy("lang", "place").collect()
    labels = sorted({r["lang"] for r in rows})
    if not labels:
        return None
    at = {lang: i for i, lang in enumerate(labels)}
    net = ByteTagger(labels)
    net.train([bytes(r["piece"]) for r in rows], np.array([at[r["lang"]] for r in rows]), np.ones(len(rows), np.float32))
    return net


def predict(texts: list[str | None], net: ByteTagger | None) -> tuple[list[str], np.ndarray]:
    """Language and score of whole texts."""
    lang, score = ["und"] * len(texts), np.zeros(len(texts))
    some = [i for i, t in enumerate(texts) if t and _LETTER.search(t)] if net is not None else []
    sums = net.position_sums([texts[i].lower().encode() for i in some]) if some else np.zeros((0, 2))
    mean = sums[:, :-1] / sums[:, -1:]
    for i, m in zip(some, mean):
        lang[i], score[i] = net.labels[m.argmax()], min(1.0, float(m.max()))
    return lang, score


def identify(docs: DataFrame, net: ByteTagger | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score: a row per row of ``docs`` (doc_id, text, ...)."""

    def work(part: pa.RecordBatch) -> dict:
        lang, score = predict(part.column(1).to_pylist(), net)
        return {"doc_id": part.column(0), "lang_pred": lang, "score": score}

    rows = map_text(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), work, "doc_id long, lang_pred string, score double")
    return rows.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def accept(docs: DataFrame, net: ByteTagger | None, sure: float = 0.8) -> DataFrame:
    """The rows of ``docs``, with its columns, whose text has a language that does not plainly contradict ``lang``.

    Rejected are texts without a language, and texts whose non-null ``lang`` is a learned one, other than
    the prediction, whose score is at least ``sure``. Without a network only texts without letters are rejected.
    """
    names = docs.columns
    at, tag = names.index("text"), names.index("lang")

    def run(batches):
        for part in text_slices(batches, at):
            texts, given = part.column(at).to_pylist(), part.column(tag).to_pylist()
            lang, score = predict(texts, net)
            if net is None:
                keep = [bool(t and _LETTER.search(t)) for t in texts]
            else:
                keep = [p != "und" and (g is None or g not in net.labels or g == p or s < sure) for p, s, g in zip(lang, score, given)]
            yield part.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
