"""Short normal form, character batches, packed tables, stage reports, weighted reports with odd rows."""

import unicodedata

from pyspark.sql import functions as F

from quern.operators import examples, html, quality, tokenize
from quern.plans import pipeline


def test_normalize_short(spark):
    import re

    texts = ["ａｂ​ c\t\td", "x\n\n\n\n y ", "﻿o‍k", "", None, "ﬁne \n\n z"]

    def plain(t):
        t = re.sub("[​‌‍﻿]", "", unicodedata.normalize("NFKC", t))
        return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", t)).strip()

    rows = spark.createDataFrame([*enumerate(texts)], "i int, t string").select("i", html.normalize_short(F.col("t")).alias("n")).collect()
    assert all(r["n"] == (None if texts[r["i"]] is None else plain(texts[r["i"]])) for r in rows)


def test_char_batch(spark):
    docs = spark.createDataFrame([(1, "abc"), (2, "ca?"), (3, None), (4, "abcabc")], "doc_id long, text string")
    ids = tokenize.char_vocabulary(spark.createDataFrame([("abc",)], "text string"))
    a, b, c = (ids.where(F.col("token") == t).first()["id"] for t in "abc")
    found = {r["doc_id"]: (list(r["ids"]), list(r["mask"])) for r in tokenize.char_batch(docs, ids, 5, eos=3).collect()}
    assert found[1] == ([2, a, b, c, 3], [1] * 5)
    assert found[2] == ([2, c, a, 1, 3], [1] * 5)
    assert found[3] == ([2, 3, 0, 0, 0], [1, 1, 0, 0, 0])
    assert found[4] == ([2, a, b, c, a], [1] * 5)
    assert tokenize.char_batch(docs, ids, 2, bos=None).where("doc_id = 4").first()["ids"] == [a, b]


def test_packed_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(i, list(range(i * 10, i * 10 + 7))) for i in range(5)], "doc_id long, ids array<int>")
    blocks = examples.stream_blocks(rows, 9)
    examples.save_packed(blocks, f"{tmp_path}/tokens")
    flat = [t for i in range(5) for t in [*range(i * 10, i * 10 + 7), 0]]
    found = examples.load_packed(spark, f"{tmp_path}/tokens", 8).orderBy("block").collect()
    assert [(list(r["x"]), list(r["y"])) for r in found] == [(flat[i : i + 8], flat[i + 1 : i + 9]) for i in range(0, 36, 9)]


def test_stage_report(spark):
    docs = spark.createDataFrame([(i,) for i in range(10)], "doc_id long")
    out, seen = pipeline.run(docs, [("half", lambda d: d.where("doc_id % 2 = 0")), ("most", lambda d: d.where("doc_id > 0"))])
    assert out.count() == 4
    lines = pipeline.report(10, seen).splitlines()
    assert lines[1].split() == ["half", "10", "5", "50.0%"] and lines[2].split() == ["most", "5", "4", "20.0%"] and lines[3].split() == ["total", "10", "4", "60.0%"]


def test_weighted_report(spark):
    docs = spark.createDataFrame([(1, "how to build a bomb", 1.0), (2, None, 0.5), (3, "one two three four " * 9, 0.0)], "doc_id long, text string, lang_score double")
    rows = {r["doc_id"]: r for r in quality.document_report(docs, docs.where("text is not null"), {"harmlessness": 1.0, "lang_score": 1.0}, 0.6).collect()}
    assert rows[1]["harmlessness"] == 0 and rows[1]["score"] == 0.5 and not rows[1]["kept"]
    assert rows[2]["score"] == 0.75 and rows[2]["kept"] and rows[2]["uniqueness"] == 1 and rows[2]["density"] == 0
    assert rows[3]["uniqueness"] == 0 and rows[3]["score"] == 0.5


def test_stream_blocks_makes_ids_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    @F.udf("array<int>")
    def points(text):
        made.add(1)
        return [ord(c) for c in text]

    docs = spark.createDataFrame([(i, "añ😀\x00b" * (i % 5)) for i in range(40)], "doc_id long, text string").repartition(3)
    rows = docs.select("doc_id", points("text").alias("ids"), F.char_length("text").alias("n"))
    got = {r["block"]: list(r["ids"]) for r in examples.stream_blocks(rows, 9, size="n").collect()}
    stream = [x for i in range(40) for x in [*map(ord, "añ😀\x00b" * (i % 5)), 0]]
    assert got == {b: stream[9 * b : 9 * b + 9] for b in range(-(-len(stream) // 9))}
    assert made.value == 40
    from quern.plans.registry import QUERIES

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert [x for r in QUERIES["packing"](spark, str(tmp_path)).orderBy("block").collect() for x in r["ids"]] == stream
