"""Expected counts, losses and training of the unigram model against enumeration."""

import math

import pytest

from quern.operators import tokenize, unigram

WORDS = {"banana": 5, "bandana": 2, "nan": 7, "an": 3, "b": 1, "anana": 4, "éa": 2}


def splits(word):
    if not word:
        yield ()
    for k in range(1, len(word) + 1):
        for rest in splits(word[k:]):
            yield (word[:k], *rest)


def brute(words, log_p, worst):
    counts, likelihood = {}, 0.0
    for w, n in words.items():
        paths = {s: math.exp(sum(log_p.get(t, worst if len(t) == 1 else -math.inf) for t in s)) for s in splits(w)}
        total = sum(paths.values())
        likelihood += n * math.log(total)
        for s, p in paths.items():
            for t in s:
                if p:
                    counts[t] = counts.get(t, 0) + n * p / total
    return counts, likelihood


@pytest.fixture(scope="module")
def model():
    tokens = ["a", "b", "n", "d", "an", "na", "ban", "ana", "nan", "anana"]
    return {t: math.log((i + 1) / 55) for i, t in enumerate(tokens)}


def frame(spark, words=WORDS):
    return spark.createDataFrame([*words.items(), ("", 4), ("gone", 0)], "word string, n long").repartition(3)


def test_expected_counts_by_enumeration(spark, model):
    worst = min(model.values()) - 10
    found = {r["token"]: r["value"] for r in unigram.expected_counts(frame(spark), model).collect()}
    counts, likelihood = brute(WORDS, model, worst)
    assert abs(found.pop("") - likelihood) < 1e-9
    assert found.keys() == counts.keys() and all(abs(found[t] - counts[t]) < 1e-9 for t in counts)


def test_losses_by_enumeration(spark, model):
    worst = min(model.values()) - 10
    found = {r["token"]: r["value"] for r in unigram.drop_losses(frame(spark), model).collect()}
    _, whole = brute(WORDS, model, worst)
    for t in model:
        if len(t) > 1:
            _, less = brute(WORDS, {k: v for k, v in model.items() if k != t}, worst)
            assert abs(found[t] - (whole - less)) < 1e-8, t
    assert all(len(t) > 1 for t in found)


def test_training(spark):
    log_p, history = unigram.train(frame(spark), 9, rounds=3)
    assert {"a", "b", "n", "d", "é"} <= log_p.keys() and len(log_p) == 9
    assert abs(sum(map(math.exp, log_p.values())) - 1) < 1e-9
    for a, b in zip(history, history[1:]):
        assert math.isnan(a) or math.isnan(b) or b >= a - 1e-9
    assert any(map(math.isnan, history))
    again, _ = unigram.train(frame(spark).repartition(2), 9, rounds=3)
    assert again.keys() == log_p.keys() and all(abs(again[t] - log_p[t]) < 1e-9 for t in log_p)
    # the pieces spell the words again, and the best path is made of tokens
    for r in tokenize.best_segmentation(frame(spark).where("word <> '' and n > 0"), log_p).collect():
        assert "".join(r["pieces"]) == r["word"] and set(r["pieces"]) <= log_p.keys()
    # no token that stays is worth less than one that went from the same round
    small, _ = unigram.train(frame(spark), 1)
    assert set(small) == {c for w in WORDS for c in w}


def test_long_word_and_empty(spark, model):
    found = {r["token"]: r["value"] for r in unigram.expected_counts(frame(spark, {"ban" * 2000: 1}), model).collect()}
    assert math.isfinite(found[""]) and abs(sum(v * len(t) for t, v in found.items()) - 6000) < 1e-3
    assert unigram.train(frame(spark, {}), 5) == ({}, [0.0, 0.0])


def test_words_travel_together(spark, model):
    """Many words of one length share array steps: 40,000 words took about 4 s and more a pass, one by one."""
    import itertools
    import time

    words = {"".join(w): 1 for w in itertools.islice(itertools.product("bandé", repeat=7), 40_000)}
    few = dict(list(words.items())[::4000])
    worst = min(model.values()) - 10
    want, likelihood = brute(few, model, worst)
    found = {r["token"]: r["value"] for r in unigram.expected_counts(frame(spark, few), model).collect()}
    assert abs(found.pop("") - likelihood) < 1e-9 and all(abs(found[t] - want[t]) < 1e-9 for t in want)
    began = time.process_time()
    run = unigram.Lattices(unigram.Vocabulary(model), unigram.np.array([[ord(c) for c in w] for w in words]))
    assert run.total.shape == (40_000,) and time.process_time() - began < 2
