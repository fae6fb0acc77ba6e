"""Operator 10 against Python's re with the plain patterns, and its bootstrapping."""

import re


from quern.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def holds(kind, hit):
    digits = re.sub("[^0-9]", "", hit)
    if kind == "ip":
        return all(int(p) <= 255 for p in hit.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind != "phone" or 9 <= len(digits) <= 15


def brute(text):
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p in PLAIN.items() for m in re.finditer(p, text or "") if holds(k, m.group()))


TEXTS = [
    None,
    "",
    "plain words only",
    "mail a.b@c.de, x@y, q@@z.com a@b.c.d%e@f.g and é@x.org \U0001f600 t@u.v",
    "ip 1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.004 1.2.3 9.9.9.9999999999999999999999999999999999999999999",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1112 7 8 9 5500000000000004 12345678901234567890123",
    "call +1 (555) 123-4567 or +49 30 1234 5678 9012 3456 or +7. or +12",
    "a@b.cd" * 300,
    "1 " * 20000,
    "1" * 50000 + " x" * 10 + "@" * 3000 + "y" * 20000,
    "call +1 (555) 123-4567 or +49 30 1234 5678 9012 3456 or +7. or +12",
]


def test_base_spans_match_brute_force(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.find_pii(docs).collect()}
    assert len(got) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        assert got[i]["base_spans"] == brute(text), i
        assert got[i]["n_email"] == sum(1 for _ in re.finditer(PLAIN["email"], text or ""))


def test_patterns_discover_unseen_identifiers(spark):
    rows = [(i, f"words here. Contact me: user{i}@mail.example.com then more") for i in range(6)]
    rows += [(10, "words again. Contact me: handle-99x77 then more"), (11, "version 2.0 released"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.find_pii(docs).collect()}
    assert got[10] == "context:25:37"
    assert got[11] == "" and got[None] == ""


def test_redaction_keeps_rows_and_columns(spark):
    rows = [(1, "see a@b.cd now", 14, "k"), (2, None, None, "k"), (3, "no data", 7, None), (3, "no data", 7, None), (4, "ip 1.2.3.4 card 4111111111111111 \U0001f600 a@b.cd", 40, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, row_key string")
    out = sorted(map(tuple, pii.redact(docs).collect()), key=str)
    assert (1, "see [EMAIL] now", 15, "k") in out
    assert (4, "ip [IP] card [CARD] \U0001f600 [EMAIL]", 29, "z") in out
    assert out.count((3, "no data", 7, None)) == 2 and (2, None, None, "k") in out and len(out) == 5


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert pii.find_pii(docs).count() == 0
    assert pii.redact(docs).count() == 0




def test_scores_against_brute_force(spark):
    rng = __import__("random").Random(3)
    edges = sorted({(f"p{min(rng.randrange(12), rng.randrange(12))}", rng.randrange(40)) for _ in range(150)})
    seeds = {i for i in range(40) if rng.random() < 0.4}
    table = spark.createDataFrame([(p, i, int(i in seeds)) for p, i in edges], "pattern string, instance long, seed int")
    score = {i: float(i in seeds) for _, i in edges}
    for _ in range(3):
        patterns = {}
        for p, _ in edges:
            mine = [i for q, i in edges if q == p]
            patterns[p] = (sum(score[i] for i in mine) / len(mine), sum(i in seeds for i in mine))
        new = {}
        for i in score:
            new[i] = max([float(i in seeds), *(patterns[p][0] for p, j in edges if j == i and patterns[p][1] >= 3)])
        got = {r["pattern"]: (r["score"], r["seeds"]) for r in pii.pattern_scores(table, spark.createDataFrame(list(score.items()), "instance long, score double")).collect()}
        assert got.keys() == patterns.keys() and all(abs(got[p][0] - patterns[p][0]) < 1e-9 and got[p][1] == patterns[p][1] for p in got)
        scored = spark.createDataFrame([(p, *v) for p, v in patterns.items()], "pattern string, score double, seeds long")
        found = {r["instance"]: r["score"] for r in pii.instance_scores(table, scored, 3).collect()}
        assert found.keys() == new.keys() and all(abs(found[i] - new[i]) < 1e-9 for i in new)
        score = new


def test_long_words_on_the_left(spark):
    name = "Identifier-of-the-registered-account-holder-in-the-central-records:" + "x" * 100
    rows = [(i, f"text. {name} user{i}@mail.example.com end") for i in range(6)] + [(10, f"text. {name} handle-99x77 end"), (11, f"text. {name[:-1]}y handle-99x77 end")]
    docs = spark.createDataFrame([(i, t, "a", "b", 1) for i, t in rows], "doc_id long, text string, kind string, pattern string, found_email int")
    got = {r["doc_id"]: r["spans"] for r in pii.find_pii(docs).collect()}
    assert got[10] == f"context:{rows[6][1].index('handle')}:{rows[6][1].index(' end')}" and got[11] == ""
    out = pii.redact(docs)
    assert out.columns == docs.columns and out.count() == 8
