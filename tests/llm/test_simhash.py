"""Operator 7: fingerprints and components against brute force."""

import random

import numpy as np
import pytest
import xxhash

from quern.llm import simhash


def brute_fp(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", words)
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    label = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            for j in range(len(fps)):
                if (fps[i] ^ fps[j]).bit_count() <= 3 and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


def test_fingerprints():
    for t in (None, "", " \t\n", "One", "one TWO", "A b c", "Ünï a b c d e", "a b c d e f g h " * 40, "x\x0by\x0cz w"):
        assert simhash.fingerprint(t) == brute_fp(t), t


def near_values(rng, n, centres):
    out = []
    for _ in range(n):
        v = rng.choice(centres)
        for _ in range(rng.randrange(5)):
            v ^= 1 << rng.randrange(64)
        out.append(v)
    return out


@pytest.mark.parametrize("shard", [512, 6])
def test_links_and_components(spark, shard):
    rng = random.Random(3)
    fps = sorted(set(near_values(rng, 120, [rng.getrandbits(64) for _ in range(12)])))
    rows = [(i, v - (1 << 64) if v >> 63 else v) for i, v in enumerate(fps)]
    reps = spark.createDataFrame(rows, "rep long, fp long")
    found = {r["v"]: r["label"] for r in simhash.components(simhash.links(reps, 3, shard)).collect()}
    assert [found.get(i, i) for i in range(len(fps))] == brute_components(fps)


def test_forest_finds_all_pairs():
    rng = random.Random(1)
    values = np.array(sorted(set(near_values(rng, 200, [rng.getrandbits(64) for _ in range(4)]))), np.uint64)
    group = np.sort(np.array([rng.randrange(3) for _ in values]))
    forest = simhash.BKForest(group, values)
    got = {(int(a), int(b)) for q, n in forest.search(group, values, 3) for a, b in zip(q, n)}
    want = {(a, b) for a in range(len(values)) for b in range(len(values)) if group[a] == group[b] and int(values[a] ^ values[b]).bit_count() <= 3}
    assert got == want


def test_rows(spark):
    text = "the quick brown fox jumps over the lazy dog while seven owls watch from a tall oak near the river at dawn " * 3
    rows = [(9, text), (4, text), (7, text + " x"), (3, None), (5, ""), (2, "other words entirely, nothing alike in here"), (None, text), (9, text)]
    docs = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, fp string")
    got = {(r["doc_id"], r["component_id"]) for r in simhash.simhash_components(docs).collect()}
    assert {(9, 4), (4, 4), (3, 3), (5, 3), (2, 2), (None, 4)} <= got
    kept = sorted(r["doc_id"] for r in simhash.keep_one_each(docs).collect() if r["doc_id"] is not None)
    assert kept in ([2, 3, 4], [2, 3, 4, 7])
    assert simhash.simhash_components(docs.where("doc_id = 99")).count() == 0


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def dense_values(rng, n):
    """Fingerprints that share most of their bits, so that the first dealings leave large shards."""
    base = rng.getrandbits(64)
    return sorted({base ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 9))) for _ in range(n)})


def test_large_shards_lose_no_link(spark):
    rng = random.Random(8)
    fps = dense_values(rng, 220)
    reps = spark.createDataFrame([(i, signed(v)) for i, v in enumerate(fps)], "rep long, fp long")
    for levels, shard in ((1, 5), (2, 5), (3, 20)):
        units = simhash.shards(reps, 3, shard, levels)
        edges = units.repartition("unit").sortWithinPartitions("unit").mapInArrow(simhash._unit_links(3, 50), "a long, b long")
        found = {r["v"]: r["label"] for r in simhash.components(edges).collect()}
        assert [found.get(i, i) for i in range(len(fps))] == brute_components(fps)


def test_copies_of_a_fingerprint_do_not_grow_with_the_table(spark):
    per_row = []
    for n in (2_000, 20_000):
        rng = random.Random(n)
        # 8 free bits in each of 4 blocks: a first shard holds n / 256, so at a shard of 4 pairs of sub-shards alone would
        # take 4 * n / 1024 copies (8 and 80); a second dealing takes 16 at most at either size
        values = {sum(rng.getrandbits(8) << (16 * k) for k in range(4)) for _ in range(n)}
        reps = spark.createDataFrame([(v, v) for v in map(signed, values)], "rep long, fp long")
        per_row.append(simhash.shards(reps, 3, 4).count() / len(values))
    assert max(per_row) <= 16


def test_null_ids_link_others(spark, monkeypatch):
    fps = {10: 0, None: 7, 20: 63, 30: 1 << 40 | 1 << 50 | 1 << 60 | 1 << 20}
    rows = [(i, signed(v), k) for k, (i, v) in enumerate(fps.items())]
    marked = spark.createDataFrame(rows, "doc_id long, fp long, row_key long")
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, shingle, seed: marked)
    got = {(r["doc_id"], r["component_id"]) for r in simhash.simhash_components(marked).collect()}
    assert got == {(10, 10), (None, 10), (20, 10), (30, 30)}


def test_one_row_of_each_component_stays(spark):
    text = "the quick brown fox jumps over the lazy dog while seven owls watch from a tall oak near the river at dawn"
    other = "completely unrelated sentence about engines, harbours, violets and the price of copper in a small town"
    rows = [(4, text), (4, text), (4, other), (9, text), (None, text), (None, other + " again and so on for a while longer than before"), (7, None), (8, "")]
    docs = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id long, text string, _key int, label int, row_key int")
    kept = sorted(((r["doc_id"], r["text"]) for r in simhash.keep_one_each(docs).collect()), key=str)
    assert kept == sorted([(4, text), (4, other), (7, None), (None, other + " again and so on for a while longer than before")], key=str)
    assert simhash.keep_one_each(docs).columns == docs.columns
    long_text = " ".join(f"w{i % 977}" for i in range(400_000))
    long_docs = spark.createDataFrame([(1, long_text), (2, long_text)], "doc_id long, text string")
    assert {r["component_id"] for r in simhash.simhash_components(long_docs).collect()} == {1}
    assert simhash.fingerprint(long_text) == brute_fp(long_text)
