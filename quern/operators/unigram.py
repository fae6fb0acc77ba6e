"""Unigram subword models by expectation-maximisation over all segmentations, pruned by the likelihood each token is worth.

The corpus is a table of distinct words with counts. A round sends the vocabulary (bounded by ``start``) to the tasks;
the lattices of words of one length are run forwards and backwards together as arrays, and only sums by token come back.
Encoding takes the best path and is in ``tokenize``.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.dedup import persisted
from quern.operators.tokenize import substrings

NONE = float("-inf")


def _log_sum(rows: list[np.ndarray]) -> np.ndarray:
    every = np.array(rows)
    top = every.max(axis=0)
    return top + np.log(np.exp(every - top).sum(axis=0))


class Vocabulary:
    """Tokens with log-probabilities, and a tree of their characters as sorted keys (node, character)."""

    def __init__(self, log_p: dict[str, float]):
        self.tokens = list(log_p)
        self.log_p = np.array([*log_p.values(), NONE])  # the last place stands for no token
        self.longest, self.worst = max(map(len, log_p), default=1), min(log_p.values(), default=0.0) - 10
        self.points = np.array(sorted({ord(c) for t in log_p for c in t}), np.int64)
        place, nodes = {int(p): i for i, p in enumerate(self.points)}, {}
        ends = {0: -1}
        for i, token in enumerate(self.tokens):
            node = 0
            for c in token:
                node = nodes.setdefault((node, place[ord(c)]), len(nodes) + 1)
                ends.setdefault(node, -1)
            ends[node] = i
        steps = sorted((node * len(self.points) + c, to) for (node, c), to in nodes.items())
        self.keys, self.to = np.array([k for k, _ in steps], np.int64), np.array([t for _, t in steps], np.int64)
        self.ends = np.array([ends[n] for n in range(len(ends))], np.int64)

    def _find(self, keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Places of ``wanted`` among the sorted ``keys``; -1 where it is missing."""
        if not len(keys):
            return np.full(wanted.shape, -1)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, at, -1)

    def arcs(self, letters: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For each length from 1: the token (or -1) that starts at each place of each word, and its log-probability."""
        place = self._find(self.points, letters)
        node = np.zeros(letters.shape, np.int64)
        tokens, log_p = [], []
        for n in range(1, min(self.longest, letters.shape[1]) + 1):
            node, c = node[:, : letters.shape[1] - n + 1], place[:, n - 1 :]
            key = np.where((node >= 0) & (c >= 0), node * len(self.points) + c, -1)
            at = self._find(self.keys, key)
            node = np.where(at >= 0, self.to[at], -1) if len(self.keys) else np.full(key.shape, -1)
            tokens.append(np.where(node >= 0, self.ends[node], -1))
            log_p.append(self.log_p[tokens[-1]])
        # a character that is no token stands for itself, so every word has a segmentation
        log_p[0] = np.where(tokens[0] < 0, self.worst, log_p[0])
        return tokens, log_p


def _forward(log_p: list[np.ndarray]) -> np.ndarray:
    """Log-probability of all segmentations of each opening part of each word: a row for each length."""
    words, size = log_p[0].shape
    a = np.zeros((size + 1, words))
    for e in range(1, size + 1):
        a[e] = _log_sum([a[e - n - 1] + p[:, e - n - 1] for n, p in enumerate(log_p[:e])])
    return a


class Lattices:
    """All ways to write words of one length as tokens: ``a`` forwards, ``shares`` of the probability through each arc."""

    def __init__(self, vocabulary: Vocabulary, letters: np.ndarray):
        self.letters = letters
        self.tokens, self.log_p = vocabulary.arcs(letters)
        self.a = _forward(self.log_p)
        size = letters.shape[1]
        b = np.zeros_like(self.a)
        for s in range(size - 1, -1, -1):
            b[s] = _log_sum([p[:, s] + b[s + n + 1] for n, p in enumerate(self.log_p[: size - s])])
        self.total = self.a[size]
        self.shares = [np.exp(self.a[: size - n].T + p + b[n + 1 :].T - self.total[:, None]) for n, p in enumerate(self.log_p)]

    def without(self, rows: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """Log-probability of all segmentations of the words ``rows`` that do without the given token."""
        cut = [np.where(t[rows] == tokens[:, None], NONE, p[rows]) for t, p in zip(self.tokens, self.log_p, strict=True)]
        return _forward(cut)[-1]


def _summed(counts: DataFrame, log_p: dict[str, float], per_words, slab: int = 1 << 16) -> DataFrame:
    """``token``, ``value``: sums over the words of what ``per_words(lattices, n, sums)`` adds, summed up inside a task first.

    Words of one length are taken together, up to about ``slab`` characters at a time.
    """
    vocabulary = Vocabulary(log_p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, met = np.zeros(len(vocabulary.tokens)), np.zeros(len(vocabulary.tokens), bool)
        other: dict[str, float] = defaultdict(float)
        waiting: dict[int, list[tuple[str, float]]] = defaultdict(list)

        def take(size: int) -> None:
            words, n = zip(*waiting.pop(size), strict=True)
            letters = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64).reshape(len(words), size)
            tokens, values, rest = per_words(Lattices(vocabulary, letters), np.array(n))
            np.add(known, np.bincount(tokens, values, len(known)), out=known)
            met[tokens] = True
            for token, value in rest:
                other[token] += value

        held = 0
        for batch in batches:
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                group = waiting[len(word)]
                group.append((word, n))
                held += len(word)
                if len(group) * len(word) >= slab:
                    held -= len(group) * len(word)
                    take(len(word))
                elif held >= 16 * slab:  # many lengths
                    held = 0
                    for size in list(waiting):
                        take(size)
        for size in list(waiting):
            take(size)
        rows = {**other, **{vocabulary.tokens[i]: known[i] for i in np.flatnonzero(met)}}
        yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.string()), pa.array(list(rows.values()), pa.float64())], names=["token", "value"])

    rows = counts.where("word <> '' and n > 0").select("word", F.col("n").cast("double").alias("n"))
    return rows.mapInArrow(run, "token string, value double").groupBy("token").agg(F.sum("value").alias("value"))


def expected_counts(counts: DataFrame, log_p: dict[str, float]) -> DataFrame:
    """``token``, ``value``: how often each token is expected over all segmentations of ``word``, ``n``. The token '' holds the
    corpus's log-likelihood."""

    def expect(x: Lattices, n: np.ndarray):
        tokens = np.concatenate([t.ravel() for t in x.tokens])
        values = np.concatenate([(s * n[:, None]).ravel() for s in x.shares])
        points, of = np.unique(x.letters[x.tokens[0] < 0], return_inverse=True)
        alone = np.bincount(of, (x.shares[0] * n[:, None])[x.tokens[0] < 0], len(points))
        rest = [("", float(n @ x.total)), *((chr(p), v) for p, v in zip(points.tolist(), alone.tolist(), strict=True))]
        return tokens[tokens >= 0], values[tokens >= 0], rest

    return _summed(counts, log_p, expect)


def drop_losses(counts: DataFrame, log_p: dict[str, float]) -> DataFrame:
    """``token``, ``value``: by how much the log-likelihood of the corpus falls if a token of two characters or more goes.

    Only the words whose lattice has the token are asked: where it stands once, its posterior says the loss, else the
    lattice is run without it.
    """
    width = max(len(log_p), 1)

    def lose(x: Lattices, n: np.ndarray, slab: int = 1 << 16):
        arcs = [np.nonzero(t >= 0) for t in x.tokens[1:]]
        if not arcs:
            return np.zeros(0, int), np.zeros(0), []
        pair = np.concatenate([r * width + t[r, c] for (r, c), t in zip(arcs, x.tokens[1:], strict=True)])
        share = np.concatenate([s[at] for at, s in zip(arcs, x.shares[1:], strict=True)])
        pair, first, places = np.unique(pair, return_index=True, return_counts=True)
        row, token, share = pair // width, pair % width, share[first]
        once = (places == 1) & (share < 0.999)
        loss = np.zeros(len(pair))
        loss[once] = -np.log1p(-share[once])
        again = np.flatnonzero(~once)
        step = max(1, slab // x.letters.shape[1])
        for i in range(0, len(again), step):
            at = again[i : i + step]
            loss[at] = x.total[row[at]] - x.without(row[at], token[at])
        return token, n[row] * loss, []

    return _summed(counts, log_p, lose)


def maximised(counts: DataFrame, log_p: dict[str, float]) -> tuple[dict[str, float], float]:
    """Log-probabilities after one round, and the log-likelihood before it. A token never expected keeps a tiny share."""
    rows = {r["token"]: r["value"] for r in expected_counts(counts, log_p).collect()}
    likelihood = rows.pop("", 0.0)
    found = {t: max(rows.get(t, 0.0), 1e-12) for t in {*log_p, *rows}}
    total = sum(found.values())
    return {t: math.log(c / total) for t, c in sorted(found.items())}, likelihood


def train(counts: DataFrame, size: int, longest: int = 8, rounds: int = 2, shrink: float = 0.75, start: int = 4000) -> tuple[dict[str, float], list[float]]:
    """A vocabulary of ``size`` tokens (at least all single characters) with log-probabilities, and the log-likelihoods met.

    It starts from the ``start`` most frequent substrings. ``rounds`` of expectation-maximisation alternate with dropping
    the quarter of the longer tokens whose loss costs least; the last rounds follow the last cut. A cut may lower the
    likelihood, a round never does; NaN in the list marks the cuts. The words are written once for all rounds.
    """
    counts = persisted(counts.where("n > 0 and word <> ''"))
    first = substrings(counts, longest, start).collect()
    total = sum(r["n"] for r in first) or 1
    log_p = {r["token"]: math.log(r["n"] / total) for r in sorted(first, key=lambda r: r["token"])}
    history: list[float] = []
    while True:
        for _ in range(rounds):
            log_p, likelihood = maximised(counts, log_p)
            history.append(likelihood)
        longer = [t for t in log_p if len(t) > 1]
        target = max(size, int(len(log_p) * shrink))
        keep = max(target - (len(log_p) - len(longer)), 0)
        if len(log_p) <= size or not longer:
            return log_p, history
        loss = {r["token"]: r["value"] for r in drop_losses(counts, log_p).collect()}
        best = sorted(longer, key=lambda t: (-round(loss.get(t, 0.0), 9), t))[:keep]
        log_p = {t: log_p[t] for t in sorted([*best, *(t for t in log_p if len(t) == 1)])}
        history.append(float("nan"))
