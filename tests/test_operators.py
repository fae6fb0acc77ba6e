"""Dedup, statistics, mixing, retrieval, chat, answers, examples, tokenisers: known values and invariants."""

import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import answers, chat, dedup, examples, graph, mixing, monitor, retrieval, stats, tokenize
from quern.plans import pipeline
from quern.plans.registry import QUERIES
from quern.sources import tables

SENTENCES = ["the quick brown fox jumps over the lazy dog near the river bank on a sunny day in june", "a completely different text about cooking pasta with tomato sauce and fresh basil leaves", "short one"]


def one(spark, column):
    return spark.range(1).select(column.alias("r")).first()["r"]


def test_keep_first_and_nulls(spark):
    docs = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b"), (4, None), (5, None)], "doc_id long, text string")
    kept = dedup.keep_first(docs, dedup.sha256_key(F.col("text")))
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 4, 5]
    assert kept.columns == ["doc_id", "text"]
    assert dedup.keep_first(kept, dedup.sha256_key(F.col("text"))).count() == 4


def test_minhash_numbers(spark):
    docs = spark.createDataFrame([(1, SENTENCES[0]), (2, "")], "doc_id long, text string")
    got = {r["doc_id"]: r["signature"] for r in dedup.minhash(docs, k=16).collect()}
    words = SENTENCES[0].split()
    shingles = {" ".join(words[i : i + 5]) for i in range(len(words) - 4)}
    xs = [int(hashlib.md5(s.encode()).hexdigest()[:8], 16) for s in shingles]
    assert got[1] == [min((a * x + b) % dedup.PRIME & dedup.TOP for x in xs) for a, b in dedup.hash_parameters(16)]


def test_similar_pairs_lose_nothing(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(12):
        base = [rng.choice(words) for _ in range(60)]
        for j in range(4):
            copy = list(base)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(60)] = rng.choice(words)
            rows.append((4 * i + j, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {}
    for d, t in rows:
        w = t.split()
        if t not in {x for _, x in sets.values()}:
            sets[d] = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)}, t)
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a][0] & sets[b][0]) / len(sets[a][0] | sets[b][0]) >= 0.8}
    assert {(r["a"], r["b"]) for r in dedup.similar_pairs(docs).collect()} == want
    gone = {r["doc_id"] for r in dedup.greedy_removals(docs).collect()}
    assert all(a in gone or b in gone for a, b in want)
    label = {i: i for i, _ in rows}
    for _ in rows:
        for a, b in want:
            label[a] = label[b] = min(label[a], label[b])
    for stars in (0, 1, 3):
        linked = {r["v"]: r["label"] for r in dedup.components(dedup.similar_links(docs, stars=stars)).collect()}
        assert {i: linked.get(i, i) for i in label} == label


def test_clusters_of_many_near_copies_take_few_links(spark):
    """2,000 near copies of one text beside two small groups that share its passages, a chain and a null."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(2000):
        copy = list(base)
        copy[rng.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(copy)))
    other = [f"v{i}" for i in range(150)]
    rows += [(3000 + i, " ".join([*other, *base[: 30 + i]])) for i in range(4)]
    chain = [f"c{i}" for i in range(140)]
    rows += [(4000 + i, " ".join(chain[5 * i : 5 * i + 60])) for i in range(8)]
    docs = spark.createDataFrame([*rows, (5000, None), (5001, ""), (5002, "")], "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["cluster"] for r in dedup.near_dup_clusters(docs).collect()}
    assert {got[i] for i in range(2000)} == {0} and {got[3000 + i] for i in range(4)} == {3000} and {got[4000 + i] for i in range(8)} == {4000}
    assert got[5001] == got[5002] == 5001 and 5000 not in got
    assert dedup.similar_links(docs).count() < 20 * 2000


def test_median_and_histogram(spark):
    rows = spark.createDataFrame([(i, " ".join(["w"] * n)) for i, n in enumerate((1, 2, 4, 9))], "doc_id long, text string")
    assert stats.corpus(rows).first()["median_words"] == 4
    assert sum(r["n_docs"] for r in stats.length_histogram(rows).collect()) == 4


def test_mixture_numbers(spark):
    sources = spark.createDataFrame([("a", 6.0), ("b", 2.0), ("c", 1.0), ("d", 1.0)], "source string, weight double")
    p = lambda t: [round(r["p"], 6) for r in mixing.temperature_weights(sources, t).orderBy("source").collect()]
    assert p(1.0) == [0.6, 0.2, 0.1, 0.1]
    assert p(0.5) == [0.857143, 0.095238, 0.02381, 0.02381]
    assert p(2.0) == [0.417738, 0.241181, 0.170541, 0.170541]
    assert p(0) == [1.0, 0.0, 0.0, 0.0]
    docs = spark.createDataFrame([(i, "abcd"[i % 4]) for i in range(40)], "doc_id long, source string")
    drawn = mixing.round_robin(docs, mixing.temperature_weights(sources), 100)
    assert {r["source"]: r["count"] for r in drawn.groupBy("source").count().collect()} == {"a": 60, "b": 20, "c": 10, "d": 10}
    assert mixing.sample_proportional(docs, mixing.temperature_weights(sources), 200).count() == 200
    assert mixing.replay(docs, docs.withColumn("doc_id", F.col("doc_id") + 100), 0.5).count() >= 40


@pytest.mark.parametrize(("strategy", "step", "want"), [("linear", 2000, 6.666667), ("step", 10_000, 4.0), ("cosine", 0, 7.0)])
def test_curriculum(spark, strategy, step, want):
    alpha = mixing.curriculum_alpha(F.lit(step), 10_000, strategy, 1000)
    assert round(one(spark, 7 + alpha * (4 - 7)), 6) == want


def test_chunks(spark):
    docs = spark.createDataFrame([(1, "line one\nline two\n" + "x" * 120), (2, ""), (3, None)], "doc_id long, text string")
    fixed = retrieval.fixed_chunks(docs, 50, 10).where("doc_id = 1").orderBy("chunk").collect()
    assert all(a["text"][-10:] == b["text"][:10] for a, b in zip(fixed, fixed[1:]) if len(a["text"]) == 50)
    packed = [r["text"] for r in retrieval.line_chunks(docs, 50, 10).where("doc_id = 1").orderBy("chunk").collect()]
    assert packed == ["line one\nline two", "x" * 50, "x" * 50, "x" * 40]
    assert all(len(r["text"]) <= 30 for r in retrieval.recursive_chunks(docs, 30).collect())
    with pytest.raises(ValueError):
        retrieval.line_chunks(docs, 10, 10)


def test_index_recall(spark):
    rng = random.Random(0)
    centres = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(12)]
    rows = [(i, [c + rng.gauss(0, 0.3) for c in centres[i % 12]]) for i in range(480)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    found = retrieval.recall(retrieval.approximate_top_k(vectors, asked), retrieval.vector_top_k(vectors, asked), 10)
    assert found.agg(F.avg("recall")).first()[0] >= 0.9


def test_vector_search_by_matrices(spark):
    """Blocks of queries, copies, and vectors that are no ordinary ones: as scored one by one; crowded codes of the index in groups."""
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(64)]) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(60)] + [(2000, None), (2001, [0.0] * 64), (2002, [1.0] * 3), (2003, [math.nan] * 64)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    asked = vectors.where("vec_id in (7, 8, 20, 31, 2000, 2001, 2002) or vec_id between 40 and 60").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    for measure, score in (("cosine", retrieval.cosine), ("inner", retrieval.inner), ("l2", retrieval.squared_distance)):
        pairs = vectors.crossJoin(F.broadcast(asked)).select("query_id", F.col("vec_id").alias("doc_id"), F.round(score(F.col("q"), F.col("embedding")), 9).alias("score"))
        want = retrieval.top_k(pairs, 10, ascending=measure == "l2")
        assert sorted(map(str, retrieval.vector_top_k(vectors, asked, 10, measure, most=9).collect())) == sorted(map(str, want.collect()))
    plain, few = vectors.where("vec_id < 2000"), asked.where("query_id < 2000")
    whole = sorted(map(str, retrieval.approximate_top_k(plain, few, bucket=10**6).collect()))
    assert whole == sorted(map(str, retrieval.approximate_top_k(plain, few, bucket=3).collect())) and len(whole) == 250


def test_index_recall_on_the_test_tables(spark):
    for sf in ("/root/testdata/sf0.01", "/root/testdata/sf0.1"):
        assert QUERIES["approximate_topk_recall"](spark, sf).agg(F.avg("recall")).first()[0] >= 0.9, sf


def test_rerank_input(spark):
    r = one(spark, retrieval.rerank_input(F.lit([7, 8]), F.lit([9] * 10), 8))
    assert r["ids"] == [1, 7, 8, 2, 9, 9, 9, 2] and r["segments"] == [0, 0, 0, 0, 1, 1, 1, 1] and sum(r["mask"]) == 8


def test_graph(spark):
    docs = spark.createDataFrame([(1, "Ann met Bob in Rome"), (2, "Bob and Ann again"), (3, None)], "doc_id long, text string")
    links = graph.edges(graph.relations(graph.entities(docs, ["Ann", "Bob", "Rome"])))
    assert {(r["a"], r["b"]): r["n_docs"] for r in links.collect()} == {("Ann", "Bob"): 2, ("Ann", "Rome"): 1, ("Bob", "Rome"): 1}
    assert graph.summaries(links, graph.communities(links)).count() >= 1
    assert graph.neighbours(links, ["Rome"]).count() == 2
    assert graph.graph_stats(links).first()["n_nodes"] == 3


TURNS = [(1, 0, "system", "Be brief."), (1, 1, "user", "Hi"), (1, 2, "assistant", "Hello!"), (1, 3, "user", "Bye"), (1, 4, "assistant", "Goodbye."), (2, 0, "assistant", "alone")]


def test_chat(spark):
    turns = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")
    texts = {r["conv_id"]: r["text"] for r in chat.chatml(turns).collect()}
    for r in chat.assistant_spans(turns).collect():
        want = next(t for c, n, _, t in TURNS if (c, n) == (r["conv_id"], r["turn"]))
        assert texts[r["conv_id"]][r["start"] : r["end"]] == want
    llama = {r["conv_id"]: r["text"] for r in chat.llama(turns).collect()}
    assert llama[1] == "<s>[INST] <<SYS>>\nBe brief.\n<</SYS>>\n\nHi [/INST] Hello! </s>\n<s>[INST] Bye [/INST] Goodbye. </s>\n" and llama[2] == ""
    spans = chat.llama_spans(chat.llama(turns)).orderBy("n").collect()
    assert [llama[1][r["start"] : r["end"]] for r in spans] == ["Hello!", "Goodbye."]
    a = chat.alpaca(turns).where("conv_id = 1").first()
    assert a["text"][a["start"] : a["end"]] == "Goodbye."
    assert chat.chatml(turns, generation=True).where("conv_id = 1").first()["text"].endswith("<|im_start|>assistant\n")


def test_pair_encoding(spark):
    r = one(spark, chat.encode_pair(F.lit([1, 2, 3]), F.lit([4, 5]), 8, 2))
    assert r["input_ids"] == [1, 2, 4, 5, 0, 0, 0, 0] and r["labels"] == [-100, -100, 4, 5, -100, -100, -100, -100] and r["attention_mask"] == [1, 1, 1, 1, 0, 0, 0, 0]
    assert one(spark, chat.char_ids(F.lit("aé\U0001f600"))) == [97, 233, 0x1F600 % 256]
    ranked = spark.createDataFrame([("p", i, f"t{i}") for i in range(4)], "prompt_id string, rank int, text string")
    assert chat.ranking_pairs(ranked).count() == 6 and chat.ranking_pairs(ranked, most=3).count() == 3


@pytest.mark.parametrize(
    ("text", "hint", "want"),
    [
        ("so \\boxed{\\frac{1}{2}} holds", "math", "\\frac{1}{2}"),
        ("steps\n#### 1,234", "gsm8k", "1234"),
        ("所以答案是 42。", "auto", "42"),
        ("The answer is 7.\n", "auto", "7"),
        ("I choose (B).", "mcq", "B"),
        ("first 3 then -4.5", "number", "-4.5"),
        ("nothing\n last line ", "math", "last line"),
    ],
)
def test_extraction(spark, text, hint, want):
    assert one(spark, answers.extract(F.lit(text), hint)) == want


@pytest.mark.parametrize(("a", "b", "want"), [("1,000", "1000", True), ("50%", "0.5", True), ("1/2", "0.5", True), ("Paris.", "paris", True), ("3.14", "3.15", False), ("x", "y", False), ("1/0", "1/0", True)])
def test_comparison(spark, a, b, want):
    assert one(spark, answers.same_answer(F.lit(a), F.lit(b))) is want


def test_evaluation_numbers(spark):
    p = [one(spark, answers.pass_at_k(F.lit(10), F.lit(3), F.lit(k))) for k in (1, 3, 5, 10)]
    assert [round(x, 6) for x in (p[0], p[2], p[3])] == [0.3, 0.916667, 1.0] and p == sorted(p)
    paths = spark.createDataFrame([("q", "b", 0, 0.5), ("q", "a", 1, 0.9), ("q", "a", 2, 0.1), ("q", "b", 3, 0.2)], "question string, answer string, path int, score double")
    v = answers.vote(paths).first()
    assert (v["best"], v["confidence"], v["n"], v["n_unique"]) == ("b", 0.5, 4, 2)
    assert answers.best_of_n(paths).first()["best"] == "a"
    assert [round(x, 6) for x in one(spark, answers.gae(F.lit([1.0, 0.0, 2.0]), F.lit([0.5, 0.5, 0.5])))] == [round(x, 6) for x in (1 + 0.95 * (0 + 0.95 * 1.5), 0 + 0.95 * 1.5, 1.5)]
    assert one(spark, answers.samples_needed(F.lit(0.5))) == 5
    assert one(spark, answers.verify_arithmetic(F.lit("2 + 3 = 5 and 4 * 2 = 9"))) == 0.5
    assert one(spark, answers.safety(F.lit("How to HACK a bank"))) == "illegal_activity" and one(spark, answers.is_refusal(F.lit("I cannot help"))) is True


def test_calls(spark):
    c = one(spark, answers.parse_call(F.lit('use {"name": "add", "arguments": {"a": 1, "b": "x"}} now')))
    assert c["name"] == "add" and c["arguments"] == {"a": "1", "b": "x"}
    c = one(spark, answers.parse_call(F.lit('get(city="Rome", days=3)')))
    assert c["name"] == "get" and c["arguments"] == {"city": "Rome", "days": "3"}
    errors = answers.validate_call(F.create_map(F.lit("days"), F.lit("x"), F.lit("z"), F.lit("1")), {"city": {"required": True}, "days": {"type": "integer"}})
    assert one(spark, errors) == ["missing:city", "type:days", "unknown:z"]


def test_infilling_reassembles(spark):
    rows = spark.createDataFrame([(i, list(range(10, 10 + i))) for i in range(30)], "doc_id long, ids array<int>")
    for r in examples.infill(rows, rate=0.9).collect():
        x = r["fim_ids"]
        assert len(x) == len(r["loss_mask"])
        if r["fim_form"] == "none":
            assert x == r["ids"]
            continue
        p, s, m, e = (x.index(v) for v in (-1, -2, -3, -4))
        part = lambda a: x[a + 1 : min([b for b in (p, s, m, e) if b > a])]
        assert part(p) + part(m) + part(s) == r["ids"]
        assert sum(r["loss_mask"]) == len(part(m)) + 1


def test_blocks_and_windows(spark):
    rows = spark.createDataFrame([(i, list(range(1, i % 7 + 1))) for i in range(40)], "doc_id long, ids array<int>")
    got = [x for r in examples.stream_blocks(rows, 16).orderBy("block").collect() for x in r["ids"]]
    assert got == [x for i in range(40) for x in [*range(1, i % 7 + 1), 0]]
    w = examples.next_token_windows(rows, 3).collect()
    assert all(r["y"][:2] == r["x"][1:] for r in w)
    masked = examples.mask_tokens(rows, 50, 99, (1,)).collect()
    assert all((a == b) or l == b for r in masked for a, b, l in zip(r["masked"], r["ids"], r["labels"])) and all(l == -100 for r in masked for b, l in zip(r["ids"], r["labels"]) if b == 1)


def test_bpe(spark):
    counts = spark.createDataFrame([("low", 5), ("lower", 2), ("newest", 6), ("widest", 3)], "word string, n long")
    merges = tokenize.learn_merges(counts, 10)
    assert merges[:3] == [("e", "s"), ("es", "t"), ("est", "</w>")]
    pieces = {r["word"]: r["pieces"] for r in tokenize.apply_merges(counts, merges).collect()}
    assert all("".join(p) == w + "</w>" for w, p in pieces.items())
    joined = counts.select(tokenize.merge(tokenize.symbols(F.col("word")), "l", "o").alias("m"), "word").where("word = 'low'").first()["m"]
    assert joined == ["lo", "w", "</w>"]
    docs = spark.createDataFrame([(1, "low lower"), (2, "zzz"), (3, "")], "doc_id long, text string")
    ids = tokenize.vocabulary_ids(tokenize.apply_merges(counts, merges).select(F.explode("pieces").alias("token")))
    got = {r["doc_id"]: r["ids"] for r in tokenize.encoded(docs, tokenize.apply_merges(counts, merges), ids).collect()}
    assert got[2] == [1] and got[3] == [] and 1 not in got[1]


def test_other_tokenisers(spark):
    counts = spark.createDataFrame([("unaffable", 1), ("xyz", 1)], "word string, n long")
    got = {r["word"]: r["pieces"] for r in tokenize.longest_match(counts, ["un", "##aff", "##able"]).collect()}
    assert got == {"unaffable": ["un", "##aff", "##able"], "xyz": ["[UNK]"]}
    words = spark.createDataFrame([("hello", 9), ("hell", 5), ("yellow", 3)], "word string, n long")
    log_p = tokenize.learn_unigram(words, 12, rounds=1)
    assert len(log_p) <= 12 and set("helowy") <= set(log_p)
    assert all("".join(r["pieces"]) == r["word"] for r in tokenize.best_segmentation(words, log_p).collect())
    back = spark.createDataFrame([("hé\U0001f600",)], "t string").select(tokenize.utf8(F.col("t")).alias("b"), tokenize.from_utf8(tokenize.utf8(F.col("t"))).alias("t")).first()
    assert bytes(back["b"]).decode() == back["t"] == "hé\U0001f600"
    assert one(spark, tokenize.pretokens(F.lit("It's 42, ok"), tokenize.BYTE_LEVEL)) == ["It", "'s", " 42", ",", " ok"]


def test_metric_windows_skip_what_is_not_finite(spark):
    rows = [("loss", i, 1.0) for i in range(20)] + [("loss", 20, float("nan")), ("loss", 21, 5.0)]
    m = spark.createDataFrame(rows, "name string, step long, value double")
    assert [r["step"] for r in monitor.loss_spikes(m).collect()] == [21]
    assert monitor.summary(m).first()["count"] == 21


def test_pipeline_counts(spark):
    docs = spark.createDataFrame([(i, f"{SENTENCES[i % 2]}. {SENTENCES[(i + 1) % 2]}, " + f"and some words in the end that make text number {i // 4} unlike the others", "s") for i in range(12)], "doc_id long, text string, source string")
    out, seen = pipeline.run(docs)
    n = out.count()
    assert 0 < n <= 12 and seen["score"].get["rows"] == n


def test_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"q": "x", "a": null}, {"q": "y"}]')
    assert sorted((r["q"], r["a"]) for r in tables.read_json_array(spark, str(tmp_path / "a.json"), "q string, a string").collect()) == [("x", ""), ("y", "")]
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "m.py").write_bytes(b"x = '\xff1'")
    assert tables.read_files(spark, str(tmp_path / "src"), "*.py").first()["text"] == "x = '1'"
    df = spark.createDataFrame([("t" * 600,)], "text string")
    for _ in range(2):
        tables.append_json_lines(df, str(tmp_path / "out"), "text")
    rows = spark.read.json(str(tmp_path / "out")).collect()
    assert len(rows) == 2 and len(rows[0]["text"]) == 500
    split = spark.range(1000).select(tables.hash_split(F.col("id")).alias("v")).where("v").count()
    assert 50 < split < 150


def test_text_helpers_agree(spark):
    assert one(spark, T.jaccard(F.lit([1, 2, 3]), F.lit([2, 3, 4]))) == 0.5


def test_whole_tables_of_bytes_and_term_contributions(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in tables.read(spark, sf, "documents").collect()}
    got = {r["doc_id"]: r["bytes"] for r in QUERIES["utf8_bytes"](spark, sf).collect()}
    assert {d: list(t.encode()) for d, t in texts.items() if t is not None} == {d: b for d, b in got.items() if texts[d] is not None} and got.keys() == texts.keys()
    every = QUERIES["term_contributions"](spark, sf).collect()
    asked = {r["item_id"]: set(re.findall(r"[a-z]+", r["text"].lower())) for r in tables.read(spark, sf, "benchmark").collect()}
    held = {w for t in texts.values() for w in re.findall(r"[a-z]+", (t or "").lower())}
    assert {r["query_id"] for r in every} >= {i for i, words in asked.items() if any(len(w) > 3 and w in held for w in words)}


def test_greedy_removals_follow_the_sequential_rule(spark):
    rng = random.Random(11)
    for trial in range(3):
        sizes = {i: rng.randrange(1, 6) for i in range(40)}
        pairs = sorted({tuple(sorted(rng.sample(range(40), 2))) for _ in range((25, 60, 150)[trial])})
        gone = set()
        for a, b in pairs:
            if a not in gone and b not in gone:
                gone.add(a if sizes[a] < sizes[b] else b)
        table = spark.createDataFrame([(a, b, sizes[a], sizes[b]) for a, b in pairs], "a long, b long, size_a int, size_b int")
        assert sorted(r["doc_id"] for r in dedup.settle(dedup.persisted(table)).collect()) == sorted(gone)
