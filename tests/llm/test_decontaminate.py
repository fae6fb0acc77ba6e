"""Operator 4 against the plain dynamic programme, and planted leaks."""

import random

from quern.llm import decontaminate as D

WORDS = "stone river amber castle violet engine lumber rocket pepper meadow".split()


def plain_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != c), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_myers_is_exact():
    rng = random.Random(2)
    for _ in range(200):
        p = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 30)))
        t = "".join(rng.choice("abcd") for _ in range(rng.randrange(0, 60)))
        assert D.myers(D.masks_of(p), len(p), t)[0] == plain_distance(p, t)


def edited(rng, text, n):
    out = list(text)
    for _ in range(n):
        i = rng.randrange(len(out))
        rng.choice((lambda: out.__setitem__(i, "z"), lambda: out.insert(i, "q"), lambda: out.pop(i)))()
    return "".join(out)


def test_every_occurrence_within_budget_is_found(spark):
    rng = random.Random(5)
    items = [" ".join(rng.choice(WORDS) for _ in range(12)) + f" item {i}" for i in range(6)]
    docs, want = [], {}
    for i in range(60):
        body = " ".join(rng.choice(WORDS) for _ in range(40))
        if i % 2:
            leak = edited(rng, items[i % 6], rng.randrange(0, 8))
            body = f"{body}\n {leak} {body}"
        docs.append((i, body))
        want[i] = {j for j, t in enumerate(items) if plain_distance(D.normal(t), D.normal(body)) <= int(len(D.normal(t)) * D.ERROR_RATE)}
    benchmark = spark.createDataFrame([*enumerate(items), (6, "tiny"), (7, None), (8, items[0])], "item_id long, text string")
    table = spark.createDataFrame([*docs, (99, None), (99, "")], "doc_id long, text string")
    got = {}
    for r in D.contaminated(table, benchmark).collect():
        got.setdefault(r["doc_id"], set()).add(r["item_id"])
    for i in want:
        found = got.get(i, set())
        assert found - {8} == want[i]
        assert (8 in found) == (0 in want[i])
    kept = {r["doc_id"] for r in D.drop_contaminated(table, benchmark, block_chars=200).collect()}
    assert kept == {99} | {i for i in want if not want[i]}
    assert D.contaminated(table, benchmark.where("item_id = 77")).count() == 0
    assert D.contaminated(table.where("doc_id = -1"), benchmark).count() == 0


def test_short_items_are_searched_exactly(spark):
    items = [(1, "Can"), (2, "blue whale"), (3, "漢字"), (4, "  "), (5, None), (6, "can"), (6, "can")]
    texts = ["a candle", "yes we CAN", "can", "the blue\n whale swims", "the blue whales", "かな漢字かな", "blue whal", None, ""]
    want = {1: {1, 6}, 2: {1, 6}, 3: {2}, 5: {3}}
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([(i, t, 0, 0) for i, t in enumerate(texts)], "doc_id long, text string, first_id int, item_id int")
    got = {}
    for r in D.contaminated(docs.unionAll(docs), benchmark).collect():
        got.setdefault(r["doc_id"], set()).add(r["item_id"])
    assert got == want
    assert sorted(r["doc_id"] for r in D.drop_contaminated(docs, benchmark).collect()) == [i for i in range(len(texts)) if i not in want]


def test_a_very_long_text(spark):
    rng = random.Random(6)
    item = " ".join(rng.choice(WORDS) for _ in range(15))
    body = " ".join(rng.choice(WORDS) for _ in range(200_000))
    docs = spark.createDataFrame([(1, body + " " + item), (2, body[: len(body) // 2] + " qqqq " + edited(rng, item, 3) + " zz")], "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert {r["doc_id"]: r["distance"] for r in D.contaminated(docs, benchmark).collect()}.keys() == {1, 2}


def test_an_id_over_texts_and_a_text_over_ids(spark):
    rng = random.Random(8)
    a, b, c = (" ".join(rng.choice(WORDS) for _ in range(14)) for _ in range(3))
    items = [(1, a), (1, b), (2, b), (3, c), (3, c), (4, a)]
    texts = {10: f"x {a} y", 11: f"{b} and {a}", 12: f"no {c}", 13: "none of them at all in here"}
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    found = D.contaminated(docs, benchmark).select("doc_id", "item_id", "start_pos", "end_pos").collect()
    want = sorted({(d, i, D.normal(t).find(D.normal(s))) for d, t in texts.items() for i, s in set(items) if D.normal(s) in D.normal(t)})
    assert sorted((r["doc_id"], r["item_id"], r["start_pos"]) for r in found) == want
