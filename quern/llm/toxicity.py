"""Toxicity by a linear-chain conditional random field over words.

Two states, clean and toxic, run along the words of a document. Word labels are derived from document labels: in a
document marked toxic, a word is toxic if it, or one of its first 3 to 5 letters, is strongly tied to toxic
documents. The field is fitted on those labelled words by gradient ascent on the conditional likelihood, with
expectations from forward-backward. At scoring time the forward-backward marginals of every word of the whole text
are pooled to a document score by a small logistic model, and words whose marginal is at least 0.5 are returned as
offsets.

Edge cases: a null or empty text, or one without a word, has no marginals; its score is that of zero toxic words.
Without labelled rows of both classes every score is 0. Repeated rows and ids are scored each on their own. Only learning
is bounded: texts of over ``max_chars`` characters are not taken into the sample. Other columns are not read, whatever
their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import blocks

WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (3, 4, 5)
SCHEMA = "score double, n_words long, spans string"


def features(word: str) -> list[str]:
    """The word itself and its openings, the only evidence a word gives."""
    return [f"w{word}", *(f"{n}{word[:n]}" for n in PREFIXES)]


@dataclass
class ToxicField:
    """Weights of the field and of the pooling model; ``weights`` is bounded by the labelled sample."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -6.0
    # log potentials: enter (clean to toxic), leave (toxic to clean), stay (toxic to toxic); clean to clean is zero
    chain: tuple[float, float, float] = (0.0, 0.0, 0.0)
    pool: tuple[float, ...] = ()

    def emission(self, word: str) -> float:
        get = self.weights.get
        return self.bias + get(f"w{word}", 0.0) + get(f"3{word[:3]}", 0.0) + get(f"4{word[:4]}", 0.0) + get(f"5{word[:5]}", 0.0)


def marginals(odds: np.ndarray, lengths: np.ndarray, chain: tuple[float, float, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward on many chains at once.

    ``odds`` holds exp(emission) of the words, chain after chain. Messages are kept as the ratio of the toxic to the
    clean state, so each step is one expression over all chains that reach that far. Returns the probability of the
    toxic state per word and the forward and backward ratios.
    """
    enter, leave, stay = np.exp(np.asarray(chain, dtype=np.float64))
    starts = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    starts, sizes = starts[order], lengths[order]
    steps = int(sizes[0]) if len(sizes) else 0
    # active[t]: how many chains have more than t words
    active = np.searchsorted(-sizes, -np.arange(steps), side="left") if steps else np.zeros(0, int)
    ahead, behind = np.empty(len(odds)), np.ones(len(odds))
    ratio = np.empty(0)
    for t in range(steps):
        at = starts[: active[t]] + t
        ratio = odds[at] if t == 0 else odds[at] * (enter + stay * ratio[: len(at)]) / (1.0 + leave * ratio[: len(at)])
        ahead[at] = ratio
    back = np.ones(0)
    for t in range(steps - 2, -1, -1):
        n = active[t + 1]
        full = np.ones(n)
        full[: len(back)] = back[:n]
        at = starts[:n] + t
        after = odds[at + 1] * full
        back = (leave + stay * after) / (1.0 + enter * after)
        behind[at] = back
    joint = ahead * behind
    return joint / (1.0 + joint), ahead, behind


def pooled(probability: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Per document: strongest word, expected number of toxic words, and their share, on log scales."""
    n = len(lengths)
    out = np.zeros((n, 4))
    out[:, 0] = 1.0
    doc = np.repeat(np.arange(n), lengths)
    top = np.zeros(n)
    np.maximum.at(top, doc, probability)
    total = np.bincount(doc, weights=probability, minlength=n)
    out[:, 1] = top
    out[:, 2] = np.log1p(total)
    out[:, 3] = np.log1p(100.0 * total / np.maximum(lengths, 1))
    return out


def tie_strength(texts: list[list[str]], labels: np.ndarray, min_ratio: float = 6.0) -> set[str]:
    """Features ``min_ratio`` times likelier in toxic documents, in more of them than chance gives any feature.

    A feature unrelated to the label lies in toxic documents only with probability share**n; the least n makes that
    unlikely (0.1 in all) over every feature there is.
    """
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    for words, label in zip(texts, labels, strict=True):
        seen[int(label)].update({f for w in set(words) for f in features(w)})
    clean, toxic = max(1, int((labels == 0).sum())), max(1, int((labels == 1).sum()))
    common = sum(n > 1 for n in seen[1].values()) + 1
    least = max(3, math.ceil(math.log(common / 0.1) / math.log((clean + toxic) / toxic)))
    return {f for f, n in seen[1].items() if n >= least and (n / toxic) >= min_ratio * ((seen[0][f] + 0.5) / clean)}


def without_copies(words: list[list[str]], n_sketches: int = 8) -> list[int]:
    """Positions of texts that are no near copy of an earlier one: a copied text must not count as many witnesses.

    Two texts with 80 % of their 3-word shingles in common share one of eight minima almost surely.
    """
    seen: set[tuple[int, int]] = set()
    kept = []
    for i, ws in enumerate(words):
        grams = {" ".join(ws[j : j + 3]) for j in range(max(1, len(ws) - 2))}
        hashes = np.array([xxhash.xxh64_intdigest(g) for g in grams], dtype=np.uint64)
        keys = {(k, int((hashes ^ np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)).min())) for k in range(n_sketches)}
        if not keys & seen:
            kept.append(i)
        seen |= keys
    return kept


def fit(texts: list[str], labels: list[int], epochs: int = 30) -> ToxicField:
    """Fit the field and the pooling model on whole labelled texts, on the driver; the caller bounds the sample."""
    words = [WORD.findall(t.lower()) for t in texts]
    kept = without_copies(words)
    words, target = [words[i] for i in kept], np.asarray([labels[i] for i in kept], dtype=np.int64)
    model = ToxicField()
    if not len(target) or target.min() == target.max():
        return model
    strong = tie_strength(words, target)
    names = sorted(strong)
    index = {f: i for i, f in enumerate(names)}
    lengths = np.array([len(w) for w in words])
    # Only words with a strong feature differ in emission, so a word's features are a short list of ids.
    cache: dict[str, list[int]] = {}

    def ids(word: str) -> list[int]:
        if word not in cache:
            cache[word] = [index[f] for f in features(word) if f in index]
        return cache[word]

    flat = [ids(w) for ws in words for w in ws]
    where = np.repeat(np.arange(len(flat)), [len(x) for x in flat])
    which = np.array([i for x in flat for i in x], dtype=np.int64)
    gold = np.zeros(len(flat))
    has = np.zeros(len(flat), bool)
    has[where] = True
    gold[has & (np.repeat(target, lengths) == 1)] = 1.0
    last = np.zeros(len(flat), bool)
    last[np.cumsum(lengths[lengths > 0]) - 1] = True
    inner = np.flatnonzero(~last)
    pair_gold = np.array([((1 - gold[inner]) * gold[inner + 1]).sum(), (gold[inner] * (1 - gold[inner + 1])).sum(), (gold[inner] * gold[inner + 1]).sum()])
    theta = np.zeros(len(names) + 4)
    theta[-4] = model.bias
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, epochs + 1):
        emission = np.full(len(flat), theta[-4])
        np.add.at(emission, where, theta[which])
        odds = np.exp(np.clip(emission, -30, 30))
        p, ahead, behind = marginals(odds, lengths, tuple(theta[-3:]))
        enter, leave, stay = np.exp(theta[-3:])
        # Pair marginals from the ratios on both sides of a gap.
        a, b = ahead[inner], odds[inner + 1] * behind[inner + 1]
        z = 1 + enter * b + leave * a + stay * a * b
        pair = np.array([(enter * b / z).sum(), (leave * a / z).sum(), (stay * a * b / z).sum()])
        gradient = np.empty_like(theta)
        gradient[: len(names)] = np.bincount(which, weights=(gold - p)[where], minlength=len(names))[: len(names)] - 0.01 * theta[: len(names)]
        gradient[-4] = (gold - p).sum()
        gradient[-3:] = pair_gold - pair - 1.0 * theta[-3:]
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        theta += 0.3 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    model.weights = {f: float(theta[i]) for f, i in index.items()}
    model.bias, model.chain = float(theta[-4]), tuple(float(x) for x in theta[-3:])
    emission = np.full(len(flat), theta[-4])
    np.add.at(emission, where, theta[which])
    p, _, _ = marginals(np.exp(np.clip(emission, -30, 30)), lengths, model.chain)
    x = pooled(p, lengths)
    w = np.zeros(x.shape[1])
    for _ in range(50):  # Newton steps of a ridge logistic regression
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (q * (1 - q))[:, None]).T @ x + 0.05 * np.eye(x.shape[1])
        w += np.linalg.solve(h, x.T @ (target - q) - 0.05 * w)
    model.pool = tuple(float(v) for v in w)
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, held_out_mod: tuple[int, int] = (3, 1), max_toxic: int = 400, max_clean: int = 1600, max_chars: int = 200_000) -> tuple[list[str], list[int]]:
    """At most ``max_toxic`` and ``max_clean`` whole labelled texts of at most ``max_chars`` characters each, by hash
    order, none from the held-out remainder; so rows and bytes that reach the driver are bounded."""
    from quern.llm.common import crc_mod

    n, remainder = held_out_mod
    marks = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (crc_mod("doc_id", n) != remainder))
    marks = marks.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).withColumn("order", F.xxhash64("doc_id"))
    picked = [marks.where(F.col("toxic") == k).orderBy("order", "doc_id").limit(n) for k, n in ((0, max_clean), (1, max_toxic))]
    chosen = picked[0].unionAll(picked[1]).select("doc_id", "toxic")
    known = docs.where(F.char_length("text") <= max_chars).select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # an id that repeats sends one of its texts only, the first in order
    rows = known.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).toPandas().sort_values(["doc_id"], kind="stable")
    return rows["text"].tolist(), rows["toxic"].astype(int).tolist()


def _scorer(model: ToxicField, keep: list[str]):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        pool = np.array(model.pool)
        base = float(np.exp(np.clip(model.bias, -30, 30)))
        for batch in batches:
            for part, texts in blocks(batch, "text", 2_000_000):
                lowered = [(t or "").lower() for t in texts]
                words = [WORD.findall(t) for t in lowered]
                lengths = np.array([len(w) for w in words], dtype=np.int64)
                flat: list[float] = []
                for ws in words:
                    for w in set(ws).difference(known):
                        e = model.emission(w)
                        known[w] = base if e == model.bias else float(np.exp(np.clip(e, -30, 30)))
                    flat += map(known.__getitem__, ws)
                if len(known) > 250_000:
                    known.clear()
                p, _, _ = marginals(np.array(flat), lengths, model.chain)
                if len(pool):
                    scores = 1 / (1 + np.exp(-np.clip(pooled(p, lengths) @ pool, -30, 30)))
                else:
                    scores = np.zeros(len(texts))
                ends = np.cumsum(lengths)
                spans = []
                hit = np.zeros(len(texts), bool)
                hit[np.repeat(np.arange(len(texts)), lengths)[p >= 0.5]] = True
                for i, text in enumerate(texts):
                    if not hit[i]:
                        spans.append("")
                        continue
                    marked = p[ends[i] - lengths[i] : ends[i]] >= 0.5
                    source = text if len(text) == len(lowered[i]) else lowered[i]
                    at = source.lower() if source is text else source
                    spans.append(",".join(f"{m.start()}:{m.end()}" for m, y in zip(WORD.finditer(at), marked, strict=False) if y))
                kept = [part.column(part.schema.get_field_index(c)) for c in keep]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(scores, pa.float64()), pa.array(lengths), pa.array(spans, pa.string())], names=[*keep, "score", "n_words", "spans"])

    return score


def score_toxicity(docs: DataFrame, model: ToxicField) -> DataFrame:
    """Score every whole text: ``doc_id``, ``score`` (0 to 1), ``n_words``, ``spans`` (start:end of toxic words, comma-joined).

    Offsets count code points of the text (of its lower-cased form in the rare case that lower-casing changes its
    length). Narrow: no shuffle, one Arrow pass.
    """
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(_scorer(model, ["doc_id"]), f"doc_id {kind}, {SCHEMA}")


def reject_toxic(docs: DataFrame, model: ToxicField, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is under ``threshold``; one Arrow pass, no join."""
    scored = _scorer(model, [])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            small = pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("text"))], names=["text"])
            low = [s < threshold for out in scored(iter([small])) for s in out.column(0).to_pylist()]
            yield batch.filter(pa.array(low, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
