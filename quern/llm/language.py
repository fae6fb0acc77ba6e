"""Language identification by a bidirectional gated recurrent network over bytes.

The UTF-8 bytes of a text run through two gated recurrent layers, one forward and one backward, in windows of
``WINDOW`` bytes that start from a zero state. The gate is the update gate of a gated recurrent unit without reset
(h = z*h + (1-z)*n), which needs one matrix product for each of gate and candidate. Every position is labelled by a
softmax over both states, and a document's probabilities are the mean over all its positions. The network is trained in
numpy by backpropagation through time on the position labels, from a bounded sample of documents.

Edge cases: a null text, or one without a letter (``½`` and ``²`` are none), is ``und`` with score 0; so is every text
where nothing was learned. Repeated rows are labelled each on their own. Whole texts are read, and no other column,
whatever its name. Only learning is bounded: texts of over ``max_chars`` characters are not taken into the sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import blocks, crc_mod

WINDOW = 64
PAD = 256


@dataclass
class ByteNetwork:
    """Weights: index 0 of the first axis is the forward layer, 1 the backward one."""

    langs: list[str] = field(default_factory=list)
    gate_in: np.ndarray | None = None  # (2, 257, H)
    cand_in: np.ndarray | None = None  # (2, 257, H)
    gate_rec: np.ndarray | None = None  # (2, H, H)
    cand_rec: np.ndarray | None = None  # (2, H, H)
    out: np.ndarray | None = None  # (2, H, C)
    bias: np.ndarray | None = None  # (C,)

    @classmethod
    def fresh(cls, langs: list[str], hidden: int, rng: np.random.Generator) -> ByteNetwork:
        normal = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
        net = cls(langs, normal(2, 257, hidden), normal(2, 257, hidden), normal(2, hidden, hidden), normal(2, hidden, hidden), normal(2, hidden, len(langs)), np.zeros(len(langs), np.float32))
        return net

    def weights(self) -> list[np.ndarray]:
        return [self.gate_in, self.cand_in, self.gate_rec, self.cand_rec, self.out, self.bias]

    def hold_padding(self) -> None:
        """Padding shuts the gate: the state passes unchanged."""
        self.gate_in[:, PAD], self.cand_in[:, PAD] = 30.0, 0.0


def _tables(net: ByteNetwork) -> tuple[np.ndarray, np.ndarray]:
    """Input tables of both layers one below the other; the gate's is halved, since sigmoid(x) = (1 + tanh(x / 2)) / 2."""
    hidden = net.gate_in.shape[2]
    return (0.5 * net.gate_in).reshape(-1, hidden), net.cand_in.reshape(-1, hidden)


def position_probabilities(net: ByteNetwork, windows: np.ndarray) -> np.ndarray:
    """(B, WINDOW) byte codes to (WINDOW, B, C) label probabilities."""
    n, steps = windows.shape
    hidden, classes = net.gate_in.shape[2], len(net.langs)
    gate_in, cand_in = _tables(net)
    gate_rec, cand_rec = 0.5 * net.gate_rec, net.cand_rec
    codes = np.ascontiguousarray(windows.T.astype(np.intp))
    scores = np.empty((steps, n, classes), np.float32)
    scores[:] = net.bias
    h = np.zeros((2, n, hidden), np.float32)
    z, c, x = np.empty_like(h), np.empty_like(h), np.empty_like(h)
    at = np.empty((2, n), np.intp)
    for t in range(steps):
        at[0], at[1] = codes[t], codes[steps - 1 - t]
        at[1] += 257
        np.matmul(h, gate_rec, out=z)
        np.take(gate_in, at, axis=0, out=x, mode="clip")
        z += x
        np.tanh(z, out=z)
        z *= 0.5
        z += 0.5
        np.matmul(h, cand_rec, out=c)
        np.take(cand_in, at, axis=0, out=x, mode="clip")
        c += x
        np.tanh(c, out=c)
        h -= c
        h *= z
        h += c
        both = h @ net.out
        scores[t] += both[0]
        scores[steps - 1 - t] += both[1]
    scores -= scores.max(axis=2, keepdims=True)
    np.exp(scores, out=scores)
    scores /= scores.sum(axis=2, keepdims=True)
    return scores


def gradients(net: ByteNetwork, windows: np.ndarray, target: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean position cross-entropy of the windows and its gradient, by backpropagation through time."""
    n, steps = windows.shape
    hidden = net.gate_in.shape[2]
    codes = windows.T.astype(np.intp)
    order = np.stack([codes, codes[::-1]])  # (2, T, B), each in the order its layer reads
    valid = (order != PAD).astype(np.float32)
    hs = np.zeros((steps + 1, 2, n, hidden), np.float32)
    zs, cs = np.empty((steps, 2, n, hidden), np.float32), np.empty((steps, 2, n, hidden), np.float32)
    layer = np.arange(2)[:, None]
    for t in range(steps):
        at = order[:, t]
        zs[t] = 1 / (1 + np.exp(-np.clip(net.gate_in[layer, at] + hs[t] @ net.gate_rec, -30, 30)))
        cs[t] = np.tanh(net.cand_in[layer, at] + hs[t] @ net.cand_rec)
        hs[t + 1] = cs[t] + zs[t] * (hs[t] - cs[t])
    forward, backward = hs[1:, 0], hs[:0:-1, 1]
    scores = forward @ net.out[0] + backward @ net.out[1] + net.bias
    scores -= scores.max(axis=2, keepdims=True)
    p = np.exp(scores)
    p /= p.sum(axis=2, keepdims=True)
    weight = valid[0] / max(1.0, float(valid[0].sum()))
    rows = np.arange(n)
    loss = -float((np.log(p[:, rows, target] + 1e-12) * weight).sum())
    p[:, rows, target] -= 1
    delta = p * weight[:, :, None]
    g = [np.zeros_like(w) for w in net.weights()]
    g[4][0] = np.einsum("tbh,tbc->hc", forward, delta)
    g[4][1] = np.einsum("tbh,tbc->hc", backward, delta)
    g[5][:] = delta.sum(axis=(0, 1))
    into = np.stack([delta @ net.out[0].T, (delta @ net.out[1].T)[::-1]], axis=1)  # (T, 2, B, H)
    carry = np.zeros((2, n, hidden), np.float32)
    for t in range(steps - 1, -1, -1):
        dh = carry + into[t]
        dz = dh * (hs[t] - cs[t]) * zs[t] * (1 - zs[t])
        dc = dh * (1 - zs[t]) * (1 - cs[t] ** 2)
        at = order[:, t]
        for d in range(2):
            np.add.at(g[0][d], at[d], dz[d])
            np.add.at(g[1][d], at[d], dc[d])
            g[2][d] += hs[t, d].T @ dz[d]
            g[3][d] += hs[t, d].T @ dc[d]
        carry = dh * zs[t] + dz @ net.gate_rec.transpose(0, 2, 1) + dc @ net.cand_rec.transpose(0, 2, 1)
    return loss, g


def cut_windows(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All windows of all texts, padded at the end of each text, and the text that each belongs to."""
    counts = np.array([-(-len(b) // WINDOW) for b in data], np.int64)
    lengths = np.array([len(b) for b in data], np.int64)
    codes = np.full(int(counts.sum()) * WINDOW, PAD, np.int16)
    joined = np.frombuffer(b"".join(data), np.uint8)
    starts = (np.cumsum(counts) - counts) * WINDOW
    where = np.arange(len(joined)) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    codes[where] = joined
    return codes.reshape(-1, WINDOW), np.repeat(np.arange(len(data)), counts)


def train(texts: list[str], langs: list[str], hidden: int = 8, epochs: int = 6, windows_per_text: int = 12, batch: int = 256, seed: int = 7) -> ByteNetwork:
    """Train on windows at random places of the given texts, as many of each text at most; driver-side, bounded."""
    known = sorted(set(langs))
    if not known:
        return ByteNetwork()
    rng = np.random.default_rng(seed)
    net = ByteNetwork.fresh(known, hidden, rng)
    net.hold_padding()
    windows, owner = cut_windows([t.encode() for t in texts])
    order = rng.permutation(len(windows))
    rank = np.zeros(len(texts), np.int64)
    chosen = []
    for i in order.tolist():
        if rank[owner[i]] < windows_per_text:
            rank[owner[i]] += 1
            chosen.append(i)
    windows, target = windows[chosen], np.array([known.index(langs[owner[i]]) for i in chosen])
    first = [np.zeros_like(w) for w in net.weights()]
    second = [np.zeros_like(w) for w in net.weights()]
    step = 0
    total = epochs * -(-len(windows) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for a in range(0, len(windows), batch):
            step += 1
            at = order[a : a + batch]
            _, grads = gradients(net, windows[at], target[at])
            norm = float(np.sqrt(sum((g**2).sum() for g in grads)))
            rate = 0.02 * (1 - 0.9 * step / total)
            for w, g, m, v in zip(net.weights(), grads, first, second, strict=True):
                g *= min(1.0, 1.0 / (norm + 1e-9))
                m += 0.1 * (g - m)
                v += 0.01 * (g**2 - v)
                w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
            net.hold_padding()
    return net


def labelled_sample(docs: DataFrame, held_out_mod: tuple[int, int] = (5, 0), per_lang: int = 250, max_chars: int = 200_000) -> tuple[list[str], list[str]]:
    """At most ``per_lang`` texts of each language, of at most ``max_chars`` characters each, by hash order of the id, none
    from the held-out remainder; so rows and bytes that reach the driver are bounded."""
    n, remainder = held_out_mod
    known = docs.where(F.col("lang").isNotNull() & (F.char_length("text") <= max_chars) & F.col("doc_id").isNotNull() & (crc_mod("doc_id", n) != remainder))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    picked = known.select("doc_id", "lang").withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_lang).select("doc_id", "lang")
    # an id that repeats sends one of its texts only, the first in order
    rows = known.select("doc_id", "lang", "text").join(F.broadcast(picked.distinct()), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text")).toPandas()
    rows = rows.sort_values(["lang", "doc_id"], kind="stable")
    return rows["text"].tolist(), rows["lang"].tolist()


def document_probabilities(net: ByteNetwork, texts: list[str], lot: int = 2048) -> np.ndarray:
    """(documents, languages): mean of the position probabilities over the whole text; zero rows for empty texts."""
    windows, owner = cut_windows([t.encode() for t in texts])
    total = np.zeros((len(texts), len(net.langs)))
    for a in range(0, len(windows), lot):
        part = windows[a : a + lot]
        p = position_probabilities(net, part)
        if (part[:, -1] == PAD).any():
            p *= (part.T != PAD)[:, :, None]
        sums = p.sum(axis=0)
        for c in range(len(net.langs)):
            total[:, c] += np.bincount(owner[a : a + lot], weights=sums[:, c], minlength=len(texts))
    return total / np.maximum(total.sum(axis=1, keepdims=True), 1e-9)


def identify(docs: DataFrame, net: ByteNetwork) -> DataFrame:
    """``doc_id``, ``lang_pred`` and ``score`` (pooled probability of that language) of every row; one Arrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in blocks(batch, "text", 1_000_000):
                texts = [t or "" for t in texts]
                names, scores = ["und"] * len(texts), [0.0] * len(texts)
                if net.langs:
                    p = document_probabilities(net, texts)
                    best = p.argmax(axis=1)
                    for i, text in enumerate(texts):
                        if any(map(str.isalpha, text)):
                            names[i], scores[i] = net.langs[best[i]], min(1.0, float(p[i, best[i]]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, lang_pred string, score double")
