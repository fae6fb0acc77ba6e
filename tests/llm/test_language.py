"""Operator 1: gradients against differences, held-out accuracy, defined edge cases."""

import random

import numpy as np

from quern.llm import language as L

SYLLABLES = {"aa": "ba be bi bo bu da de".split(), "bb": "kro gra tsk vli pro stu".split(), "cc": "ñó éá üö ßa çe".split()}


def test_gradients():
    rng = np.random.default_rng(0)
    net = L.ByteNetwork.fresh(["a", "b"], 3, rng)
    for n in ("gate_in", "cand_in", "gate_rec", "cand_rec", "out", "bias"):
        setattr(net, n, getattr(net, n).astype(np.float64))
    net.hold_padding()
    windows = rng.integers(0, 256, (3, L.WINDOW)).astype(np.int16)
    windows[0, 20:] = L.PAD
    target = np.array([0, 1, 1])
    _, grads = L.gradients(net, windows, target)
    for k, w in enumerate(net.weights()):
        at = (0, int(windows[1, 3]), 1) if k < 2 else tuple(0 for _ in w.shape)
        old, e = w[at], 1e-3
        w[at] = old + e
        up, _ = L.gradients(net, windows, target)
        w[at] = old - e
        down, _ = L.gradients(net, windows, target)
        w[at] = old
        assert abs((up - down) / (2 * e) - grads[k][at]) < 1e-4


def text(rng, lang):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(20, 80)))


def test_held_out_accuracy(spark):
    rng = random.Random(4)
    rows = [(i, text(rng, lang), lang) for i, lang in enumerate(rng.choices(list(SYLLABLES), k=300))]
    extra = [(1000, None, "aa"), (1001, "", "bb"), (1002, "123 !?", "cc"), (1003, "ba be bo", None), (None, "ba be bo", "aa")]
    docs = spark.createDataFrame([*rows, *extra], "doc_id long, text string, lang string")
    net = L.train(*L.labelled_sample(docs, per_lang=80))
    got = {r["doc_id"]: r for r in L.identify(docs, net).collect()}
    assert sum(got[i]["lang_pred"] == lang for i, _, lang in rows) > 290
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert [got[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "a b", None)], "doc_id long, text string, lang string")
    net = L.train(*L.labelled_sample(docs))
    assert [r["lang_pred"] for r in L.identify(docs, net).collect()] == ["und"]


def plain_probabilities(net, window):
    """The network one byte after the other, as the docstring writes it."""
    states = []
    for layer, codes in ((0, window), (1, window[::-1])):
        h, seen = np.zeros(net.gate_rec.shape[1]), []
        for c in codes:
            z = 1 / (1 + np.exp(-(net.gate_in[layer, c] + h @ net.gate_rec[layer])))
            n = np.tanh(net.cand_in[layer, c] + h @ net.cand_rec[layer])
            h = z * h + (1 - z) * n
            seen.append(h)
        states.append(seen if layer == 0 else seen[::-1])
    out = []
    for f, b in zip(*states):
        e = np.exp(f @ net.out[0] + b @ net.out[1] + net.bias)
        out.append(e / e.sum())
    return np.array(out)


def test_inference_against_a_plain_loop():
    rng = np.random.default_rng(3)
    net = L.ByteNetwork.fresh(["a", "b", "c"], 5, rng)
    net.hold_padding()
    windows = rng.integers(0, 256, (4, L.WINDOW)).astype(np.int16)
    windows[1, 30:] = L.PAD
    got = L.position_probabilities(net, windows)
    for i in range(4):
        assert np.allclose(got[:, i], plain_probabilities(net, windows[i]), atol=1e-4)
    texts = ["", "abc", "x" * 64, "é€" * 100, "long " * 3000]
    pooled = L.document_probabilities(net, texts)
    for text, p in zip(texts, pooled):
        data = text.encode()
        rows = [plain_probabilities(net, [*data[a : a + 64], *[L.PAD] * (64 - len(data[a : a + 64]))])[: len(data[a : a + 64])] for a in range(0, min(len(data), 640), 64)]
        if not data:
            assert not p.any()
        elif len(data) <= 640:
            assert np.allclose(p, np.concatenate(rows).mean(axis=0), atol=1e-4)


def test_edges(spark):
    rng = random.Random(5)
    rows = [(i, text(rng, lang), lang, 1, "x") for i, lang in enumerate(["aa", "bb"] * 30)]
    odd = [(100, "½ ² ³", "aa", 1, "x"), (101, "ba be " * 60_000, "aa", 1, "x"), (101, "ba be " * 60_000, "aa", 1, "x"), (None, None, None, None, None)]
    docs = spark.createDataFrame([*rows, *odd], "doc_id long, text string, lang string, score int, lang_pred string")
    sample = L.labelled_sample(docs, per_lang=20, max_chars=10_000)
    assert max(map(len, sample[0])) <= 10_000 and len(sample[0]) <= 40
    net = L.train(*sample)
    got = L.identify(docs, net).collect()
    assert len(got) == len(rows) + 4
    assert {r["lang_pred"] for r in got if r["doc_id"] in (100, None)} == {"und"}
    assert [r["lang_pred"] for r in got if r["doc_id"] == 101] == ["aa", "aa"]
    assert L.identify(docs.where("doc_id = -1"), net).count() == 0
