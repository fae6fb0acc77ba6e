"""Operator 5: exact marginals, held-out accuracy, defined edge cases."""

import itertools
import math
import random

import numpy as np

from quern.llm import toxicity as X

WORDS = [a + b for a in ("lo", "mi", "ra", "tu", "se", "ko") for b in ("na", "vel", "dor", "shi", "pek", "lum")]


def test_marginals_are_exact():
    rng = np.random.default_rng(0)
    chain = (-0.7, 0.4, 1.1)
    lengths = np.array([4, 0, 1, 6])
    odds = np.exp(rng.normal(size=int(lengths.sum())))
    got, _, _ = X.marginals(odds, lengths, chain)
    at = 0
    for n in lengths:
        e, weight = odds[at : at + n], np.zeros(n)
        total = 0.0
        for states in itertools.product((0, 1), repeat=int(n)):
            w = math.prod(e[i] for i in range(n) if states[i])
            for a, b in zip(states, states[1:]):
                w *= math.exp({(0, 0): 0, (0, 1): chain[0], (1, 0): chain[1], (1, 1): chain[2]}[a, b])
            total += w
            weight += w * np.array(states)
        if n:
            assert np.allclose(got[at : at + n], weight / total)
        at += n


def corpus(n, seed):
    rng = random.Random(seed)
    for i in range(n):
        words = [rng.choice(WORDS) for _ in range(rng.randrange(20, 80))]
        toxic = int(rng.random() < 0.25)
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(["grob", "snark" + rng.choice(WORDS)]))
        yield i, " ".join(words), toxic


def test_held_out_accuracy(spark):
    rows = list(corpus(900, 1))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, None), (5000, ""), (5001, "12 !!")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = X.fit(*X.labelled_sample(docs, labels))
    got = {r["doc_id"]: r for r in X.score_toxicity(docs, model).collect()}
    assert len(got) == 903
    assert sum((got[i]["score"] >= 0.7) == (y == 1) for i, _, y in rows) / 900 > 0.98
    for i, text, y in rows[:50]:
        for span in filter(None, got[i]["spans"].split(",")):
            a, b = map(int, span.split(":"))
            assert text[a:b].startswith(("grob", "snark"))
    assert got[None]["score"] == got[5000]["score"] == got[5001]["score"] < 0.7
    kept = {r["doc_id"] for r in X.reject_toxic(docs, model).collect()}
    assert kept == {i for i, r in got.items() if r["score"] < 0.7}


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    model = X.fit(*X.labelled_sample(docs, labels))
    assert {r["score"] for r in X.score_toxicity(docs, model).collect()} == {0.0}
    assert X.score_toxicity(docs.where("doc_id = 9"), model).count() == 0


def test_edges(spark):
    rows = list(corpus(400, 2))
    long_text = " ".join([*WORDS] * 20_000) + " grob snarklona"
    docs = spark.createDataFrame([*((i, t, 0.5, "s") for i, t, _ in rows), (900, long_text, 0.5, "s"), (901, rows[0][1], 0.5, "s"), (901, rows[0][1], 0.5, "s")], "doc_id long, text string, score double, spans string")
    labels = spark.createDataFrame([*((i, y) for i, _, y in rows), (900, 1), (0, rows[0][2]), (0, rows[0][2])], "doc_id long, toxic int")
    texts, ys = X.labelled_sample(docs.unionAll(docs.where("doc_id < 5")), labels)
    assert len(texts) == len(ys) <= 400 and max(map(len, texts)) <= 200_000
    model = X.fit(texts, ys)
    got = {}
    for r in X.score_toxicity(docs, model).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert len(got[901]) == 2 and got[901][0]["score"] == got[901][1]["score"] == got[0][0]["score"]
    spans = [tuple(map(int, s.split(":"))) for s in got[900][0]["spans"].split(",")]
    assert [long_text[a:b] for a, b in spans] == ["grob", "snarklona"]
    assert X.reject_toxic(docs, model).columns == docs.columns


def test_pooling_against_a_plain_loop():
    rng = np.random.default_rng(1)
    lengths = np.array([3, 0, 5])
    p = rng.random(8)
    got, at = X.pooled(p, lengths), 0
    for row, n in zip(got, lengths):
        part = p[at : at + n]
        at += n
        want = [1.0, max(part, default=0.0), math.log1p(part.sum()), math.log1p(100 * part.sum() / max(n, 1))]
        assert np.allclose(row, want)


def test_tags_are_tied_features_of_toxic_documents():
    texts = [["aaa", "bad"]] * 6 + [["aaa", "bbb"]] * 30
    texts = [[*t, f"z{i}q"] for i, t in enumerate(texts)]
    strong = X.tie_strength(texts, np.array([1] * 6 + [0] * 30))
    assert {f for f in strong if f.startswith("w")} == {"wbad"}
