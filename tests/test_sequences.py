"""First-wins over batches, affine scans, recursive chunks, answers with brackets and their cascades."""

import random
import re

import pytest

from quern.operators import answers, retrieval
from quern.streaming import first_wins as fw


def brute_first(bands):
    """One loop over ids in order: an id stays if none of its bands is held by one that stayed."""
    held, stay = set(), []
    for i in sorted({i for i, *_ in bands}):
        own = {(b, s) for j, b, s in bands if j == i}
        if not own & held:
            stay.append(i)
            held |= own
    return stay


def test_settle_first_against_a_loop(spark):
    rng = random.Random(5)
    bands = [(i, b, rng.randrange(9)) for i in range(60) for b in range(3)] + [(100 + i, 0, 70 + i // 2) for i in range(9)]
    bands += [(i, 5, 0) for i in range(200, 230)]  # one hot band
    found = fw.settle_first(spark.createDataFrame(bands, "id long, band int, slice long"))
    assert sorted(r["id"] for r in found.collect()) == brute_first(bands)


def test_same_survivors_for_any_cut(spark, tmp_path):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(12)]
    for i in range(12, 36):
        base = texts[rng.randrange(i)].split()
        base[rng.randrange(len(base))] = "edit"
        texts.append(" ".join(base))
    rows = [*enumerate(texts), (36, None), (37, ""), (38, texts[0])]
    schema = "doc_id long, text string"
    whole = {r["doc_id"] for r in fw.first_wins(spark.createDataFrame(rows, schema))[0].collect()}
    assert 0 in whole and 38 not in whole and len(whole) < 38
    for name, cuts in (("two", [0, 17, 39]), ("four", [0, 5, 6, 30, 39])):
        folder = tmp_path / name
        for a, b in zip(cuts, cuts[1:]):
            spark.createDataFrame(rows[a:b], schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
            stream = spark.readStream.schema(schema).parquet(f"{folder}/in")
            fw.keep_first_of_stream(stream, f"{folder}/out", f"{folder}/state", f"{folder}/checkpoint").awaitTermination(300)
        assert {r["doc_id"] for r in spark.read.parquet(f"{folder}/out").collect()} == whole


def test_gae_scan_against_the_fold(spark):
    rng = random.Random(7)
    rows = [(u, t * 3, rng.random(), rng.random(), float(rng.random() < 0.8)) for u, n in ((1, 1), (2, 400), (None, 37), (3, 90)) for t in range(n)]
    want = {}
    for u in {r[0] for r in rows}:
        steps = sorted((r for r in rows if r[0] == u), key=lambda r: r[1])
        last = 0.0
        for i in range(len(steps) - 1, -1, -1):
            nv, nk = (steps[i + 1][3], steps[i + 1][4]) if i + 1 < len(steps) else (0.0, 0.0)
            last = (steps[i][2] + 0.99 * nv - steps[i][3]) * steps[i][4] + 0.99 * 0.9 * last * nk
            want[u, i + 1] = (last, last + steps[i][3])
    df = spark.createDataFrame(rows, "user long, t long, reward double, value double, keep double").repartition(5)
    for span in (4, 1000):
        found = answers.gae_scan(df, "user", "t", mask="keep", gamma=0.99, lam=0.9, span=span).collect()
        assert len(found) == len(want)
        for r in found:
            assert abs(r["advantage"] - want[r["user"], r["step"]][0]) < 1e-9 and abs(r["returns"] - want[r["user"], r["step"]][1]) < 1e-9


def plain_chunks(text, size, separators):
    if len(text) <= size:
        return [text]
    for i, sep in enumerate(separators):
        if sep in text:
            out, held = [], None
            for part in text.split(sep):
                if held is not None and len(held + sep + part) <= size:
                    held = held + sep + part
                    continue
                out += [] if held is None else [held]
                held = part or None
            out += [] if held is None else [held]
            return [y for x in out for y in plain_chunks(x, size, separators[i + 1 :])]
    return [text[i : i + size] for i in range(0, len(text), size)]


def test_chunks_against_a_recursion(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice(["ab", "cde", " ", ". ", "\n", "\n\n", "x" * 15]) for _ in range(rng.randrange(60))) for _ in range(80)] + [None, "", " \n"]
    found = retrieval.recursive_chunks(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string"), 12)
    got = {}
    for r in found.orderBy("doc_id", "chunk").collect():
        got.setdefault(r["doc_id"], []).append(r["text"])
        assert len(r["text"]) <= 12
    seps = ("\n\n", "\n", ". ", " ")
    for i, t in enumerate(texts):
        assert got.get(i, []) == [c for c in plain_chunks(t or "", 12, seps) if c.strip()], repr(t)


def brute_boxed(t):
    best = None
    for m in re.finditer(r"\\boxed\{", t):
        depth, i = 1, m.end()
        while i < len(t) and depth:
            if t[i] == "\\" and i + 1 < len(t):
                i += 2
                continue
            depth += (t[i] == "{") - (t[i] == "}")
            i += 1
        if not depth:
            best = t[m.end() : i - 1].strip()
    return best


def test_balanced_boxes(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice(["\\boxed{", "{", "}", "}", "\\frac{1}{2}", "x", " ", "\\}", "\\{", "\n"]) for _ in range(rng.randrange(14))) for _ in range(200)]
    texts += ["\\boxed{\\frac{\\sqrt{a^{2}}}{b}} then", "no", "", "\\boxed{a \\boxed{b}}", "\\boxed{open", None]
    rows = spark.createDataFrame([*enumerate(texts)], "i int, t string").select("i", answers.boxed_balanced(answers.F.col("t")).alias("b")).collect()
    for r in rows:
        assert r["b"] == (None if texts[r["i"]] is None else brute_boxed(texts[r["i"]])), texts[r["i"]]


@pytest.mark.parametrize(
    ("order", "text", "want"),
    [
        ("verifier", "答案是 5。\\boxed{7}", "7"),
        ("verifier", "the answer is 42", "42"),
        ("verifier", "about 3 or 4 of them", "4"),
        ("verifier", "none", None),
        ("vote", "\\boxed{7} 答案是 5", "5"),
        ("vote", "  none ", "none"),
        ("prompt", "The answer is 12.\nDone", "12"),
        ("prompt", "one\ntwo ", "two"),
    ],
)
def test_orders(spark, order, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(answers.extract_by(answers.F.col("t"), order)).first()[0] == want


def test_a_pattern_before_the_others(spark):
    df = spark.createDataFrame([("Result: 9; \\boxed{1}",)], "t string")
    assert df.select(answers.extract_by(answers.F.col("t"), "prompt", r"Result: (\d+)")).first()[0] == "9"
