"""Functions that no query reaches, ranks and windows in ranges, tokeniser files, and the recall of the semantic join."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import ranks
from quern.functions import text as T
from quern.operators import answers, chat, dedup, examples, html, monitor, quality, retrieval, tokenize
from quern.sources import tables


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=str)


def test_numbers_in_ranges(spark):
    rng = random.Random(1)
    data = [(i, rng.choice("aab"), rng.random()) for i in range(300)]
    docs = spark.createDataFrame(data, "doc_id long, g string, x double")
    want = {}
    for g in "ab":
        for n, (i, _, _) in enumerate(sorted((d for d in data if d[1] == g), key=lambda d: (d[2], d[0])), 1):
            want[i] = n
    got = ranks.numbered(docs, "g", F.col("x"), "doc_id", "n", lots=7)
    assert {r["doc_id"]: r["n"] for r in got.collect()} == want
    assert ranks.numbered(docs.where("g = 'z'"), "g", F.col("x"), "doc_id").count() == 0


def test_blocks_of_queries_meet_every_row(spark):
    a, q = spark.range(7).withColumnRenamed("id", "v"), spark.range(10).withColumnRenamed("id", "query_id")
    assert rows(ranks.in_blocks(a, q, most=3), "v", "query_id") == sorted(((v, k) for v in range(7) for k in range(10)), key=str)


def test_metric_windows_across_blocks(spark):
    rng = random.Random(2)
    values = [rng.choice([1.0, 1.0, 1.0, 9.0]) for _ in range(230)]
    metrics = spark.createDataFrame([("m", i, v) for i, v in enumerate(values)] + [("m", 999, None), ("n", 5, 2.0)], "name string, step long, value double")
    mean = lambda a: sum(a) / len(a)
    got = {r["step"]: r["smoothed"] for r in monitor.moving_average(metrics.where("name = 'm'"), 10, block=25).collect()}
    assert len(got) == 230 and all(math.isclose(got[i], mean(values[max(0, i - 9) : i + 1])) for i in range(230))
    want = [i for i in range(10, 230) if values[i] > 2 * mean(values[i - 10 : i])]
    assert [s for _, s in rows(monitor.loss_spikes(metrics, block=25), "name", "step")] == sorted(want, key=str)
    flat = spark.createDataFrame([("f", i, 1.0) for i in range(120)], "name string, step long, value double")
    assert monitor.plateaus(flat, 20, block=30).count() == 80


def test_semantic_recall_on_planted_pairs(spark):
    rng = random.Random(3)
    data, want = [], set()
    for i in range(150):
        v = [rng.gauss(0, 1) for _ in range(64)]
        w = [rng.gauss(0, 1) for _ in range(64)]
        k = sum(a * b for a, b in zip(v, w)) / sum(a * a for a in v)
        w = [b - k * a for a, b in zip(v, w)]
        scale = math.sqrt(sum(a * a for a in v) / sum(b * b for b in w)) * math.sqrt(1 / 0.87**2 - 1)
        data += [(2 * i, v), (2 * i + 1, [a + scale * b for a, b in zip(v, w)])]
        want.add((2 * i, 2 * i + 1))
    vectors = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    found = {(r["a"], r["b"]) for r in dedup.semantic_pairs(vectors, 0.85).collect()}
    assert len(found & want) / len(want) >= 0.99 and found == want
    assert {r["vec_id"] for r in dedup.semantic_removals(vectors.unionAll(vectors.where("vec_id = 0").withColumn("vec_id", F.lit(900))), 0.85).collect()} == {b for _, b in want} | {900}
    assert dedup.semantic_clusters(vectors, 0.85).groupBy("cluster").count().where("count = 2").count() == 150


def test_semantic_pairs_of_crowded_codes(spark):
    """Codes of many vectors are cut into blocks; a group of near copies and pairs across blocks are all found."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=64)
    crowd = base + 0.3 * rng.normal(size=(150, 64))
    other = rng.normal(size=(250, 64))
    all_ = np.vstack([crowd, other, other[:40] + 0.4 * rng.normal(size=(40, 64))])
    unit = all_ / np.linalg.norm(all_, axis=1)[:, None]
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(unit @ unit.T, 1) > 0.85), strict=True)}
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(all_)], "vec_id long, embedding array<double>")
    assert dedup.sign_tables(440, 0.85, 0.9999, 32)[0] == 4
    found = dedup.semantic_pairs(vectors, 0.85, bucket=32).collect()
    assert len(found) == len(want) > 150 * 149 / 2 and {(r["a"], r["b"]) for r in found} == want
    assert all(abs(r["cosine"] - unit[r["a"]] @ unit[r["b"]]) < 1e-12 for r in found)
    assert dedup.semantic_pairs(vectors.limit(0), 0.85).count() == 0


def test_layers_down_to_meaning(spark):
    long = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, long), (2, long), (3, long + " end"), (4, "quite different"), (5, "unlike the others")], "doc_id long, text string")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [1.0, 1.0]), (5, [1.0, 1.01])], "vec_id long, embedding array<double>")
    assert {r["doc_id"] for r in dedup.layered(docs).collect()} == {3, 4, 5}
    assert {r["doc_id"] for r in dedup.layered_semantic(docs, vectors, cosine=0.99, dim=2).collect()} == {3, 4}


def test_wordpiece_training(spark):
    counts = spark.createDataFrame([("hug", 10), ("pug", 5), ("pun", 12), ("bun", 4), ("hugs", 5)], "word string, n long")
    words = {"hug": 10, "pug": 5, "pun": 12, "bun": 4, "hugs": 5}
    split = {w: [c if i == 0 else "##" + c for i, c in enumerate(w)] for w in words}
    vocabulary = {x for s in split.values() for x in s}
    for _ in range(4):
        singles, pairs = Counter(), Counter()
        for w, n in words.items():
            for x in split[w]:
                singles[x] += n
            for p in zip(split[w], split[w][1:]):
                pairs[p] += n
        best = min((p for p in pairs if pairs[p] >= 2), key=lambda p: (-pairs[p] / (singles[p[0]] * singles[p[1]]), p))
        vocabulary.add(best[0] + best[1].removeprefix("##"))
        for w, s in split.items():
            out = []
            for x in s:
                if out and (out[-1], x) == best:
                    out[-1] += x.removeprefix("##")
                else:
                    out.append(x)
            split[w] = out
    assert set(tokenize.learn_wordpiece(counts, 4)) == vocabulary


def test_tokenizer_files_and_decoding(spark, tmp_path):
    docs = spark.createDataFrame([(1, "low lower lowest"), (2, None), (3, "new low")], "doc_id long, text string")
    counts = tokenize.word_frequencies(docs)
    merges = tokenize.learn_merges(counts, 5)
    pieces = tokenize.apply_merges(counts, merges)
    ids = tokenize.vocabulary_ids(pieces.select(F.explode("pieces").alias("token")))
    tokenize.save_tokenizer(f"file://{tmp_path}", ids, merges)
    again, read = tokenize.load_tokenizer(spark, f"file://{tmp_path}")
    assert read == merges and rows(again, "token", "id") == rows(ids, "token", "id")
    coded = tokenize.encoded(docs, tokenize.apply_merges(counts, read), again).withColumn("ids", tokenize.with_ends(F.col("ids")))
    assert rows(tokenize.decoded(coded, again)) == [(1, "low lower lowest"), (2, ""), (3, "new low")]
    table = spark.createDataFrame([("<unk>", 1), ("ab", 4), ("c", 5)], "token string, id int")
    odd = spark.createDataFrame([(1, [4, 5, 77])], "doc_id long, ids array<int>")
    assert rows(tokenize.decoded(odd, table, "unigram")) == [(1, "abc<unk>")]


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "l.txt").write_text("　 a b  \n\n \t \nc\n")
    assert rows(tables.read_lines(spark, f"file://{tmp_path}/l.txt")) == [("a b",), ("c",)]
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "x.py").write_bytes(b"ok \xff\xfe \xef\xbf\xbd end")
    assert tables.read_files(spark, f"file://{tmp_path}/src").first()["text"] == "ok  � end"
    tables.write_json(spark.range(3), f"file://{tmp_path}/out")
    assert spark.read.json(f"file://{tmp_path}/out").count() == 3


def test_spread_leaves_other_sizes_alone(spark):
    small = spark.range(10)
    assert tables.spread(small) is small
    assert tables.spread(spark.range(1_000_000)).rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism


def test_once_replaces_and_adds(spark):
    out = T.once(spark.createDataFrame([(1, "a"), (2, None)], "k int, text string"), {"text": F.upper("text"), "n": F.length("text")})
    assert out.columns == ["k", "text", "n"] and rows(out) == [(1, "A", 1), (2, None, None)]


def test_small_functions(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first()["x"]
    passed, score = quality.composite([(F.lit(True), F.lit(0.5), 1.0), (F.lit(True), F.lit(1.0), 3.0)])
    assert value(passed) and value(score) == 0.875
    assert value(quality.composite([(F.lit(False), F.lit(0.5), 1.0)])[1]) == 0.0
    assert [value(answers.math_equal(F.lit(a), F.lit(b))) for a, b in (("3", "3.0"), ("x", "y"))] == [True, False]
    assert value(html.numeric_entities(F.lit("&#65;&#x42;&#x1F600;&#xD800;"))) == "AB"
    assert value(tokenize.pretokens(F.lit("漢字ab12,"), tokenize.CJK)) == ["漢", "字", "ab", "12", ","]
    assert value(dedup.signature_likeness(F.array(F.lit(1), F.lit(2)), F.array(F.lit(1), F.lit(3)))) == 0.5
    losses = spark.createDataFrame([(1.0, 2, 5), (2.0, 1, 6), (9.0, 1, -100)], "nll double, n_bytes int, label int")
    r = examples.bits_per_byte(losses).first()
    assert r["n_tokens"] == 2 and math.isclose(r["loss"], 1.5) and math.isclose(r["bits_per_byte"], 1 / math.log(2))
    steps = spark.createDataFrame([(1, 8.0, 2), (2, 2.0, 2), (3, 6.0, 2)], "step int, nll double, n_tokens int")
    assert rows(examples.tracked(steps, 1), "step", "loss") == [(2, 1.0), (3, 2.0)]
    active = spark.createDataFrame([("f", 0.0), ("f", 2.0), ("f", 4.0), ("g", -1.0)], "feature string, value double")
    got = {r["feature"]: r for r in monitor.activation_stats(active).collect()}
    assert math.isclose(got["f"]["frequency"], 2 / 3) and got["f"]["mean"] == 3.0 and got["g"]["max"] == 0.0
    chars = tokenize.char_vocabulary(spark.createDataFrame([("ba",), ("c",)], "text string"))
    assert rows(chars.where("id > 3"), "token", "id") == [("a", 4), ("b", 5), ("c", 6)]
    counts = spark.createDataFrame([("abcd", 2), ("ef", 1)], "word string, n long")
    pieces = spark.createDataFrame([("abcd", ["ab", "cd"]), ("ef", ["ef"])], "word string, pieces array<string>")
    r = tokenize.fertility(counts, pieces).first()
    assert math.isclose(r["fertility"], 5 / 3) and math.isclose(r["compression"], 2.0)


def test_stores_prompts_and_grids(spark):
    docs = spark.createDataFrame([(1, "the red fox runs far"), (2, "a blue whale swims deep"), (3, "the red fox runs far")], "doc_id long, text string")
    signatures = dedup.minhash(docs)
    assert {r["doc_id"] for r in dedup.against_store(signatures.where("doc_id > 1"), signatures.where("doc_id = 1")).collect()} == {2}
    questions = spark.createDataFrame([(7, "red fox")], "item_id long, text string")
    hits = retrieval.search(retrieval.bm25_terms(docs, questions))
    shown = retrieval.prompt(hits, questions, docs).first()["prompt"]
    assert shown.startswith("Context:\n[1] the red fox runs far\n\n[2] ") and shown.endswith("Question: red fox\nAnswer:")
    relevant = spark.createDataFrame([(7, 1), (7, 3)], "query_id long, doc_id long")
    grid = retrieval.experiment_grid(docs, questions, relevant, (10, 30))
    assert len(rows(grid, "size", "retriever")) == 4 and {r["recall"] for r in grid.where("size = 30").collect()} == {1.0}


def test_verifier(spark):
    texts = ["1 + 1 = 2\n2 * 3 = 7\nanswer: 7", "one line", "6 / 0 = 5\n3 ÷ 2 = 1.5", "步骤一。步骤二 4 - 1 = 3"]
    got = [r["consistency_score"] for r in answers.verify(spark.createDataFrame(list(enumerate(texts)), "k int, text string")).orderBy("k").collect()]
    assert got == [pytest.approx(0.4 * 2 / 3), 0.2, 0.4, 0.4]
    row = spark.createDataFrame([("so it is 4", "4"), ("it is red", "red"), ("it is red", "blue"), ("x 3", None)], "text string, want string")
    assert [round(r["answer_score"], 6) for r in answers.verify(row, expected="want").collect()] == [0.3, 0.1, 0.0, 0.2]
    moments = spark.createDataFrame([("g", 1.0, 1), ("g", 3.0, 1), ("g", 50.0, 0)], "g string, v double, m int")
    assert [round(r["whitened"], 3) for r in answers.whiten(moments, "v", "g", mask="m", shift_mean=False).orderBy("v").collect()] == [1.0, 3.0, 50.0]
