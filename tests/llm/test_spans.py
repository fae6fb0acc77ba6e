"""Operator 2 against a brute-force pass over all runs."""

import random

from quern.llm import spans

PASSAGE = "Seven wise owls watch the road. They never sleep at night, so they say. In winter the river freezes over! Who would cross it then?"


def brute(rows, run=3, min_words=10):
    seen, gone = {}, {}
    for doc, text in sorted(rows):
        cut = spans.sentences(text)
        size = min(run, len(cut))
        for i in range(len(cut) - size + 1 if cut else 0):
            if sum(w for _, _, w in cut[i : i + size]) < min_words:
                continue
            key = tuple(" ".join(text[a:b].lower().split()) for a, b, _ in cut[i : i + size])
            if key in seen:
                gone.setdefault(doc, set()).update(range(i, i + size))
            else:
                seen[key] = doc
    return {d: "".join(t[a:b] for j, (a, b, _) in enumerate(spans.sentences(t)) if j not in gone[d]) for d, t in rows if d in gone}


def test_sentences_cover_the_text():
    for t in (PASSAGE, "", "\n\n", "a", "...", "one two, " * 40 + "end", "x\n y\n\n z.", "word " * 100):
        cut = spans.sentences(t)
        assert "".join(t[a:b] for a, b, _ in cut) == t
        assert all(n <= spans.LONG for *_, n in cut)


def test_against_brute_force(spark):
    rows = [(i, f"Opening number {i} is here and says little. {PASSAGE} Closing number {i} ends it, {i} times.") for i in range(8)]
    rows += [(20, f"Glued start {PASSAGE}{PASSAGE}"), (21, "Short text."), (22, "Short text."), (23, ""), (24, "nothing shared in this one. at all. really, not a thing of any length.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in spans.remove_repeats(docs).collect()}
    want = brute(rows)
    assert {d: r["text"] for d, r in got.items()} == want
    assert set(want) == {1, 2, 3, 4, 5, 6, 7, 20}
    assert got[3]["first_ids"] == [0]


def test_nulls_copies_and_empty(spark):
    rows = [(1, PASSAGE), (1, PASSAGE), (None, PASSAGE), (2, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = spans.remove_repeats(docs).collect()
    assert [(r["doc_id"], r["text"]) for r in got] == [(None, "")] or all(r["text"] == "" for r in got)
    assert spans.remove_repeats(docs.where("doc_id = 9")).count() == 0


def test_short_lines_and_scripts_without_spaces(spark):
    menu = "\n".join(f"dish{i}" for i in range(60))
    tail = "A first sentence that alone has more than ten words in all of it.\nyes\nno\nso\nbe\nit"
    han = "春眠不觉晓，处处闻啼鸟。夜来风雨声！花落知多少？床前明月光，疑是地上霜。"
    thai = "กขคงจฉชซฌญฎฏฐฑฒณดตถทธนบปผฝพฟภมยรลว"
    rows = []
    for k, passage in enumerate((menu, tail, han, thai, "Low tide. Go.\nOne\ntwo\nthree four five six. Seven.")):
        rows += [(10 * k, f"{passage}\n"), (10 * k + 1, f"Own words {k} before it.\n{passage}\nOwn words {k} after it."), (10 * k + 2, f"{passage}\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in spans.remove_repeats(docs).collect()}
    for k in (0, 1, 2, 4):
        assert got[10 * k + 1] == f"Own words {k} before it.\nOwn words {k} after it." and got[10 * k + 2] == "", k
    assert got[32] == "" and not {0, 10, 20, 30, 40} & set(got)


def test_every_sentence_of_a_long_enough_passage_lies_in_a_run():
    rng = random.Random(3)
    for _ in range(300):
        passage = [(0, 0, rng.choice([1, 1, 2, 3, 12])) for _ in range(rng.randrange(3, 14))]
        if sum(w for *_, w in passage) < 10:
            continue
        inside = spans.extents(passage, 3, 10)
        before, after = ([(0, 0, rng.choice([1, 2, 9])) for _ in range(4)] for _ in range(2))
        outside = {(a - 4, b - 4) for a, b in spans.extents(before + passage + after, 3, 10)}
        assert {k for a, b in inside for k in range(a, b)} == set(range(len(passage)))
        assert set(inside) <= outside


def test_repeated_rows_long_texts_and_clashing_columns(spark):
    rng = random.Random(12)
    long_text = " ".join(f"Sentence {rng.random()} has its own number and ends here." for _ in range(20_000))
    rows = [(1, long_text + " " + PASSAGE), (2, PASSAGE + " " + long_text), (2, "Nothing here is said twice in these rows, of course."), (2, "Nothing here is said twice in these rows, of course.")]
    docs = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id long, text string, row_key int, hash int, place int")
    got = spans.remove_repeats(docs).collect()
    assert [(r["doc_id"], r["text"].strip()) for r in got] == [(2, "")]
