"""Document quality by hashed word n-grams and logistic regression, trained with follow-the-regularised-leader updates.

A text is cut into words and runs of marks. Its features are the hashes of single words, of pairs of neighbours, and of
runs of one to three word classes (letter case, digits, the mark itself, and whether the word repeats one of the two
before it), each with weight log(1 + count), scaled to length one. Training goes through the labelled texts one by one
and updates only the coordinates that a text holds (FTRL-proximal: per-coordinate rates, L1 for sparsity), so the model
is a short list of hashes with weights. Scoring is a sparse dot product and one Arrow pass: no shuffle.

Edge cases: a null or empty text, or one of white space only, has no feature; its score is that of the bias alone.
Without labelled rows of both classes every score is the share of label 1 among the rows there are (0.5 with none).
Repeated rows and ids are scored each on their own; texts of any length are scored whole. Only learning is bounded: at
most ``max_rows`` labelled rows, and none of over ``max_chars`` characters, reach the driver; of an id that repeats, one
text is learned from. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import blocks, crc_mod

TOKEN = re.compile(r"\w+|[^\w\s]+")
BITS = 20
_MASK = np.uint64((1 << BITS) - 1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shape(token: str) -> str:
    """Class of a token: a mark is itself, a word its case (upper, capital, lower), digits, or mixed."""
    if not (token[0].isalnum() or token[0] == "_"):
        return token[:4]
    if token.isalpha():
        return "A" if token.isupper() and len(token) > 1 else "Aa" if token[0].isupper() else "a"
    return "9" if token.isdigit() else "a9"


class Vocabulary:
    """64-bit codes of tokens and of their classes; forgotten when it grows past ``most`` tokens."""

    def __init__(self, most: int = 200_000):
        self.most = most
        self.known: dict[str, int] = {}
        self.table = np.zeros((2, 0), np.uint64)

    def codes(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > self.most:
            self.known, self.table = {}, np.zeros((2, 0), np.uint64)
        new = list(set(tokens).difference(self.known))
        if new:
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            word = [xxhash.xxh64_intdigest(t.lower()) for t in new]
            kind = [xxhash.xxh64_intdigest(shape(t), seed=1) for t in new]
            self.table = np.concatenate([self.table, np.array([word, kind], np.uint64)], axis=1)
        at = np.fromiter(map(self.known.__getitem__, tokens), np.int64, len(tokens))
        return self.table[0][at], self.table[1][at]


def _mix(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    """A hash of two hashes, in 64-bit arithmetic that wraps."""
    b = b * _STEP if isinstance(b, np.ndarray) else np.uint64(b * int(_STEP) % 2**64)
    x = (a ^ b) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def features(texts: list[str], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``doc``, ``slot``, ``value`` of all features of many texts, sorted by document; every document's values have length one."""
    tokens = [TOKEN.findall(t) for t in texts]
    lengths = np.array([len(t) for t in tokens], dtype=np.int64)
    if not lengths.sum():
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    word, kind = vocabulary.codes([x for t in tokens for x in t])
    doc = np.repeat(np.arange(len(texts)), lengths)
    same = [np.zeros(len(doc), bool) for _ in range(2)]
    for back in (1, 2):
        same[back - 1][back:] = (word[back:] == word[:-back]) & (doc[back:] == doc[:-back])
    kind = np.where(same[0], np.uint64(11), np.where(same[1], _mix(kind, 12), kind))
    parts = [(doc, _mix(word, 1)), (doc, _mix(kind, 2))]
    for seq, n, tag in ((word, 2, 3), (kind, 2, 4), (kind, 3, 5)):
        if len(doc) >= n:
            h = seq[: len(doc) - n + 1]
            for k in range(1, n):
                h = _mix(h, seq[k : len(doc) - n + 1 + k])
            inside = doc[: len(h)] == doc[n - 1 :]
            parts.append((doc[: len(h)][inside], _mix(h, tag)[inside]))
    key = np.concatenate([(d.astype(np.uint64) << np.uint64(BITS)) | (h & _MASK) for d, h in parts])
    key.sort()
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    key, count = key[first], np.diff(np.append(first, len(key)))
    at, slot = (key >> np.uint64(BITS)).astype(np.int64), (key & _MASK).astype(np.int64)
    value = np.log1p(count)
    return at, slot, value / np.sqrt(np.bincount(at, weights=value * value, minlength=len(texts)))[at]


@dataclass
class QualityModel:
    """Slots with a weight (sorted), their weights, and the bias."""

    slots: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0

    def score(self, texts: list[str], vocabulary: Vocabulary) -> np.ndarray:
        total = np.full(len(texts), self.bias)
        if len(self.slots):
            at, slot, value = features(texts, vocabulary)
            place = np.minimum(np.searchsorted(self.slots, slot), len(self.slots) - 1)
            hit = self.slots[place] == slot
            total += np.bincount(at[hit], weights=value[hit] * self.weights[place[hit]], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


class Leader:
    """Follow-the-regularised-leader state: the sums ``z`` and squared-gradient sums ``n`` of every slot; the last one is the bias."""

    def __init__(self, size: int, alpha: float, beta: float, l1: float, l2: float):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        l1 = np.where(at == len(self.z) - 1, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def update(self, at: np.ndarray, value: np.ndarray, label: int) -> float:
        """One text's step; returns the probability given before it."""
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w @ value, -30, 30)))
        g = (p - label) * value
        self.z[at] += g - (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha * w
        self.n[at] += g * g
        return float(p)


def fit(texts: list[str], labels: list[int], epochs: int = 4, alpha: float = 2.0, beta: float = 1.0, l1: float = 0.1, l2: float = 0.01, seed: int = 11) -> QualityModel:
    """Train on whole labelled texts, on the driver; the caller bounds the sample."""
    y = np.asarray(labels, dtype=np.int64)
    if not len(y) or y.min() == y.max():
        share = min(max(float(y.mean()) if len(y) else 0.5, 1e-6), 1 - 1e-6)
        return QualityModel(bias=float(np.log(share / (1 - share))))
    vocabulary, rows = Vocabulary(), []
    for start in range(0, len(texts), 100):
        at, slot, value = features(texts[start : start + 100], vocabulary)
        cuts = np.searchsorted(at, np.arange(1, len(texts[start : start + 100])))
        for s, v in zip(np.split(slot, cuts), np.split(value, cuts), strict=True):
            rows.append((np.append(s, 1 << BITS).astype(np.int32), np.append(v, 1.0).astype(np.float32)))
    state = Leader(1 << BITS, alpha, beta, l1, l2)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            state.update(*rows[i], int(y[i]))
    w = state.weights(np.arange((1 << BITS) + 1))
    slots = np.flatnonzero(w[:-1])
    return QualityModel(slots, w[slots], float(w[-1]))


def labelled_sample(docs: DataFrame, labels: DataFrame, held_out_mod: tuple[int, int] = (5, 0), max_rows: int = 4000, max_chars: int = 20_000) -> tuple[list[str], list[int]]:
    """At most ``max_rows`` labelled texts of at most ``max_chars`` characters by hash order, none from the held-out
    remainder; classes keep their natural shares, so that scores are probabilities."""
    n, remainder = held_out_mod
    marks = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (crc_mod("doc_id", n) != remainder))
    marks = marks.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    chosen = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    known = docs.where(F.char_length("text") <= max_chars).select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = known.groupBy("doc_id", "quality").agg(F.min("text").alias("text")).toPandas().sort_values("doc_id", kind="stable")
    return rows["text"].tolist(), rows["quality"].astype(int).tolist()


def score_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """``doc_id`` and ``score`` (0 to 1, higher: label 1 likelier) of every whole text."""
    kind = dict(docs.dtypes)["doc_id"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary()
        for batch in batches:
            for part, texts in blocks(batch, "text", 1_000_000):
                found = model.score([t or "" for t in texts], vocabulary)
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("doc_id")), pa.array(found, pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(score, f"doc_id {kind}, score double")
