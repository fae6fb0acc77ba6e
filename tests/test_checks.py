"""Check digits against plain loops, and samples of features with ties and a hot feature."""

import random

from quern.operators import monitor, pii_rules


def plain_luhn(s):
    total = 0
    for i, c in enumerate(reversed(s)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return s != "" and total % 10 == 0


def plain_id(s):
    weights = (7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2)
    return "10X98765432"[sum(int(c) * w for c, w in zip(s, weights)) % 11] == s[17].upper()


def test_luhn(spark):
    rng = random.Random(1)
    values = ["".join(rng.choice("0123456789") for _ in range(rng.randrange(1, 20))) for _ in range(300)] + ["4111111111111111", "0", ""]
    rows = spark.createDataFrame([(v,) for v in [*values, None, "12a"]], "v string").select("v", pii_rules.luhn_ok(pii_rules.F.col("v")).alias("ok")).collect()
    for r in rows:
        assert r["ok"] == (bool(r["v"]) and r["v"].isdigit() and plain_luhn(r["v"])), r


def test_identity_numbers(spark):
    rng = random.Random(2)
    values = [f"{rng.randrange(10**6):06}{rng.randrange(1900, 2020)}{rng.randrange(1, 13):02}{rng.randrange(1, 29):02}{rng.randrange(1000):03}{rng.choice('0123456789Xx')}" for _ in range(400)]
    rows = spark.createDataFrame([(v,) for v in [*values, None, "11010519491331002X", "x"]], "v string").select("v", pii_rules.id18_ok(pii_rules.F.col("v")).alias("ok")).collect()
    assert sum(r["ok"] for r in rows) > 10
    for r in rows:
        assert r["ok"] == (r["v"] in values and plain_id(r["v"])), r
    docs = spark.createDataFrame([(1, "id 11010519491231002X and 4111111111111112"), (2, None)], "doc_id long, text string")
    assert sorted(map(tuple, pii_rules.identifiers(docs).collect())) == [(1, "bank_card", "4111111111111112", False), (1, "id_card_cn", "11010519491231002X", True)]


def test_feature_samples(spark):
    rng = random.Random(3)
    rows = [(0, i, float(rng.randrange(-3, 6))) for i in range(500)] + [(1, i, -1.0) for i in range(9)] + [(2, 4, 2.0), (2, 3, 2.0)]
    found = {r["feature"]: r for r in monitor.feature_samples(spark.createDataFrame(rows, "feature int, sample long, value double"), 4, lots=7).collect()}
    for f in (0, 1, 2):
        mine = [(-v, s) for g, s, v in rows if g == f]
        assert list(found[f]["top"]) == [s for _, s in sorted(mine)[:4]]
    assert found[1]["is_dead"] and not found[1]["is_high"] and found[2]["is_high"]
