"""Operator 3: ids against tokenizers, exact round trip, and packings that are valid and no worse than best fit."""

import math
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from quern.llm import packing

TEXTS = [None, "", "short text", "Le café était fermé. 12345 \U0001f600 " * 30, "word " * 5000, "a <|endoftext|> b", "\n\n\t  x" * 50, "漢字かな交じり文" * 20, "short text"]


def test_round_trip(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    rows = packing.pack(docs, keep_ids=True).collect()
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, t in enumerate(TEXTS):
        want = [*exact.encode(t or "", add_special_tokens=False).ids, 0]
        mine = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["piece"])
        assert [x for r in mine for x in r["ids"]] == want
        assert all(r["length"] == 2048 for r in mine[1:]) and [r["start"] for r in mine] == list(np.cumsum([0] + [r["length"] for r in mine[:-1]]))
        for r in mine:
            assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    built = packing.sequences(packing.pack(docs, keep_ids=True)).collect()
    assert sum(len(r["ids"]) for r in built) == sum(r["length"] for r in rows)


def test_evolution_is_no_worse_than_best_fit():
    rng = np.random.default_rng(0)
    for low, high in ((1, 2048), (600, 1000), (300, 1500)):
        lengths = rng.integers(low, high, 600)
        start = np.full(len(lengths), -1)
        packing.best_fit(np.argsort(-lengths, kind="stable"), lengths, 2048, start, [])
        bins = packing.evolve(lengths, 2048, 1, [])
        assert np.bincount(bins, weights=lengths).max() <= 2048
        assert math.ceil(lengths.sum() / 2048) <= len(np.unique(bins)) <= start.max() + 1


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(docs).count() == 0


def test_many_shards(spark):
    docs = spark.createDataFrame([(i, "word " * (i % 37 + 1)) for i in range(300)], "doc_id long, text string")
    rows = packing.pack(docs, shard_items=60).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(300))


def hard_lengths():
    c, eps = 2048, 16
    return np.array([c // 2 + eps] * 60 + [c // 4 + 2 * eps] * 60 + [c // 4 + eps] * 60 + [c // 4 - 2 * eps] * 120)


def test_crossover_beats_best_fit():
    for lengths in (hard_lengths(), np.random.default_rng(0).integers(600, 1000, 900)):
        start = np.full(len(lengths), -1)
        packing.best_fit(np.argsort(-lengths, kind="stable"), lengths, 2048, start, [])
        bred = packing.evolve(lengths, 2048, 0, [])
        unbred = packing.evolve(lengths, 2048, 0, [], generations=0)
        assert len(np.unique(bred)) < len(np.unique(unbred)) <= start.max() + 1
        assert np.bincount(bred, weights=lengths).max() <= 2048


def test_islands_beat_best_fit_through_spark(spark):
    lengths = hard_lengths()
    items = spark.createDataFrame([(i, 0, int(n)) for i, n in enumerate(lengths)], "row_key long, piece int, length long")
    start = np.full(len(lengths), -1)
    packing.best_fit(np.argsort(-lengths, kind="stable"), lengths, 2048, start, [])
    rows = packing.pack_lengths(items).collect()
    assert len(rows) == len(lengths) and len({r["sequence_id"] for r in rows}) < start.max() + 1


def test_every_island_breeds(monkeypatch):
    calls = []
    cross = packing._cross
    monkeypatch.setattr(packing, "_cross", lambda *a: calls.append(1) or cross(*a))
    packing.evolve(np.array([5, 6, 7]), 2048, 0, [])
    assert calls


def test_both_sides_of_the_encoder_switch():
    encode = packing.Encoder(packing.vocabulary())
    unit = "Le café était fermé, 12345 tokens\n\n\tand some don't words \U0001f600 漢字 "
    for n in (999_999, 1_000_000, 1_000_001):
        text = (unit * (n // len(unit) + 1))[:n]
        assert encode(text) == encode.exact.encode(text, add_special_tokens=False).ids == encode.fast.encode_ordinary(text)


def test_repeated_ids_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c", 1, 2, 3), (1, "a b c", 1, 2, 3), (1, "other", 1, 2, 3), (None, None, None, None, None)], "doc_id long, text string, row_key int, piece int, bin int")
    rows = packing.pack(docs).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == ["1", "1", "1", "None"]
    assert sorted((r["offset"], r["length"]) for r in rows)[0][0] == 0 and len({(r["sequence_id"], r["offset"]) for r in rows}) == 4
