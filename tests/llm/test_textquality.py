"""Quality: features by hand, updates against the closed form, held-out accuracy, edge cases."""

import random

import numpy as np

from quern.llm import textquality as tq

WORDS = "stone river amber castle violet engine lumber rocket pepper meadow harbour copper lantern saddle thunder willow".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


def junk(rng, n):
    kind = rng.randrange(3)
    if kind == 0:
        return " ".join(rng.choice(WORDS).upper() + "!!" for _ in range(n))
    if kind == 1:
        return " | ".join(rng.choice(WORDS) for _ in range(n))
    return " ".join([rng.choice(WORDS) + "."] * n)


def sample(seed, n):
    rng = random.Random(seed)
    labels = [int(rng.random() < 0.7) for _ in range(n)]
    return [prose(rng, rng.randrange(5, 80)) if y else junk(rng, rng.randrange(5, 80)) for y in labels], labels


def test_features_by_hand():
    texts = ["Red  red dog!", "", " \n", "9 a"]
    at, slot, value = tq.features(texts, tq.Vocabulary())
    alone = [tq.features([t], tq.Vocabulary()) for t in texts]
    assert [list(slot[at == i]) for i in range(4)] == [list(a[1]) for a in alone]
    assert np.allclose(np.bincount(at, weights=value**2, minlength=4), [1, 0, 0, 1])
    # words red (twice), dog, !; classes Aa, repeat, a, !; pairs of words and of classes; runs of three classes
    assert len(alone[0][0]) == 3 + 4 + 3 + 3 + 2
    assert len(alone[3][0]) == 2 + 2 + 1 + 1


def test_documents_do_not_mix():
    rng = random.Random(1)
    texts = [prose(rng, rng.randrange(0, 30)) for _ in range(40)]
    model = tq.fit(*sample(2, 200))
    small = tq.Vocabulary(most=3)
    together = model.score(texts, tq.Vocabulary())
    assert np.allclose(together, [model.score([t], small)[0] for t in texts])


def test_updates_follow_the_leader():
    """After each step the weights minimise the sum of linearised losses, proximal terms and penalties."""
    rng = np.random.default_rng(4)
    state = tq.Leader(3, alpha=0.5, beta=1.0, l1=0.1, l2=0.2)
    linear, curve = np.zeros(4), np.zeros(4)  # sum of g - sigma w, and of sigma
    squares = np.zeros(4)
    for _ in range(30):
        at = np.array(sorted(rng.choice(3, 2, replace=False)) + [3])
        x = np.append(rng.random(2), 1.0)
        y = int(rng.random() < 0.5)
        w = state.weights(np.arange(4))
        p = 1 / (1 + np.exp(-(w[at] @ x)))
        assert abs(state.update(at, x, y) - p) < 1e-12
        g = np.zeros(4)
        g[at] = (p - y) * x
        sigma = (np.sqrt(squares + g * g) - np.sqrt(squares)) / 0.5
        squares += g * g
        linear += g - sigma * w
        curve += sigma
        new = state.weights(np.arange(4))
        l1 = np.array([0.1, 0.1, 0.1, 0.0])
        def cost(v):
            return linear * v + 0.5 * (curve + 0.2 + 1.0 / 0.5) * v * v + l1 * np.abs(v)
        for step in (-1e-4, 1e-4):
            assert (cost(new) <= cost(new + step) + 1e-12).all()


def test_held_out_accuracy_and_determinism():
    model = tq.fit(*sample(3, 400))
    texts, labels = sample(5, 300)
    score = model.score(texts, tq.Vocabulary())
    assert ((score >= 0.5) == np.array(labels)).mean() > 0.98
    again = tq.fit(*sample(3, 400))
    assert (again.slots == model.slots).all() and (again.weights == model.weights).all()
    assert len(model.slots) < 5000  # L1 keeps the model short


def test_one_class_and_none():
    assert abs(tq.fit(["a b"], [1]).score(["x"], tq.Vocabulary())[0] - 1) < 1e-5
    assert tq.fit([], []).score(["", "x"], tq.Vocabulary()).tolist() == [0.5, 0.5]


def test_spark_rows(spark):
    texts, labels = sample(7, 120)
    texts += [None, "", "   ", "stone " * 60_000, texts[0]]
    rows = [(i, t, 1.0, "x") for i, t in enumerate(texts)] + [(3, texts[4], 1.0, "y"), (None, texts[5], 0.0, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, slot string").repartition(3)
    marks = [(i, y, 0) for i, y in enumerate(labels)] + [(3, labels[3], 1), (None, 1, 0), (120, 1, None), (7, None, 0)]
    model = tq.fit(*tq.labelled_sample(docs, spark.createDataFrame(marks, "doc_id long, quality int, toxic int")))
    found = tq.score_quality(docs, model)
    assert found.columns == ["doc_id", "score"]
    got = sorted((str(r[0]), r[1]) for r in found.collect())
    want = sorted((str(i), float(model.score([t or ""], tq.Vocabulary())[0])) for i, t, *_ in rows)
    assert [g[0] for g in got] == [w[0] for w in want] and np.allclose([g[1] for g in got], [w[1] for w in want])
    assert tq.score_quality(docs.limit(0), model).count() == 0
    held_out = [i for i in range(120) if __import__("zlib").crc32(str(i).encode()) % 5 == 0]
    assert not set(texts[i] for i in held_out) & set(tq.labelled_sample(docs.where("doc_id < 120"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int"))[0]) - {texts[3], texts[4]}
    assert tq.labelled_sample(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")) == ([], [])
