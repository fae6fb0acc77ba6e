"""Steps that were rewritten for larger tables, against brute force on small ones."""

import hashlib
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.functions.ranks import draw, indexed
from quern.operators import charlm, dedup, examples, html, retrieval, stats, suffixes


def test_index_has_no_gaps_and_keeps_order(spark):
    words = [f"w{i * 7919 % 1000:03d}" for i in range(1000)]
    rows = indexed(spark.createDataFrame([(w,) for w in words], "word string"), "word").collect()
    assert [r["_id"] for r in sorted(rows, key=lambda r: r["word"])] == list(range(1000))


def test_near_pairs_in_small_lots():
    rng = random.Random(3)
    ids = [[rng.randrange(6) for _ in range(rng.randrange(9))] for _ in range(40)]
    reach = [[rng.randrange(1, 4) for _ in x] for x in ids]
    batch = pa.RecordBatch.from_arrays([pa.array(ids, pa.list_(pa.int32())), pa.array(reach, pa.list_(pa.int8()))], names=["ids", "reach"])
    got = Counter()
    for out in examples._near_pairs(3, 10)(iter([batch])):
        for pair, n in zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True):
            got[pair >> 32, pair & 0xFFFFFFFF] += n
    want = Counter((x[i], x[j]) for x, r in zip(ids, reach, strict=True) for i in range(len(x)) for j in range(len(x)) if i != j and abs(i - j) <= r[i])
    assert got == want


@pytest.mark.parametrize("small", [0, 1000])
def test_sampled_skip_grams_against_brute_force(spark, small):
    rng = random.Random(5)
    rows = [(i, [rng.choice("abcdefghij") + rng.choice(["", "", str(rng.randrange(30))]) for _ in range(rng.randrange(30))]) for i in range(30)] + [(30, []), (31, None)]
    counts = Counter(w for _, x in rows for w in x or [])
    draws = {(r["k"], r["i"]): r["d"] for r in spark.range(32).selectExpr("id as k", "explode(sequence(0, 40)) as i").withColumn("d", draw(42, F.col("k"), F.col("i"))).collect()}
    want = Counter()
    for k, x in rows:
        w = [t for t in x or [] if counts[t] >= 5]
        for i in range(len(w)):
            r = int(draws[k, i] * 5) + 1
            want.update((w[i], w[j]) for j in range(max(0, i - r), min(len(w), i + r + 1)) if j != i)
    got = examples.sampled_skip_grams(spark.createDataFrame(rows, "doc_id long, words array<string>"), small=small)
    assert {(r["center"], r["context"]): r["n"] for r in got.collect()} == want


def test_lsh_candidates_makes_signatures_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("array<bigint>")
    def signature(i):
        made.add(1)
        return [i // 2] * 16

    rows = spark.range(40).select(F.col("id").alias("doc_id"), signature("id").alias("signature"))
    assert sorted(map(tuple, dedup.lsh_candidates(rows).collect())) == [(i, i + 1) for i in range(0, 40, 2)]
    assert made.value == 40


def test_minhash_against_whole_numbers(spark):
    text = " ".join(f"w{i}" for i in range(700))
    got = dedup.minhash(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"), k=16).orderBy("doc_id").collect()
    w = text.split()
    x = [int.from_bytes(hashlib.md5(" ".join(w[i : i + 5]).encode()).digest()[:4], "big") for i in range(len(w) - 4)]
    assert got[0]["signature"] == [min((a * v + b) % dedup.PRIME & dedup.TOP for v in x) for a, b in dedup.hash_parameters(16)]
    assert got[1]["signature"] == [dedup.TOP] * 16


def test_grams_are_counted_in_the_row(spark):
    docs = spark.createDataFrame([(1, "AbabXab"), (2, "ab"), (3, None), (4, "\U0001f600é\U0001f600é\U0001f600")], "doc_id long, text string")
    got = {(r["doc_id"], r["gram"]): (r["m"], r["context"]) for r in charlm.grams(docs).collect()}
    assert got == {(1, "aba"): (1, "ab"), (1, "bab"): (1, "ba"), (1, "abx"): (1, "ab"), (1, "bxa"): (1, "bx"), (1, "xab"): (1, "xa"), (4, "\U0001f600é\U0001f600"): (2, "\U0001f600é"), (4, "é\U0001f600é"): (1, "é\U0001f600")}


def test_ngram_repetition_by_hashes(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randrange(40))) for _ in range(30)] + [None, "", "a b c d"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    counts = Counter(" ".join(w[i : i + 5]) for w in ((t or "").split() for t in texts) for i in range(len(w) - 4))
    assert sorted(r["n"] for r in stats._hashed_counts(docs, 5).collect()) == sorted(counts.values())
    row = stats.ngram_repetition(docs).first()
    assert (row["total_ngrams"], row["unique_ngrams"]) == (counts.total(), len(counts))
    assert row["top_ratio"] == pytest.approx(sum(n for _, n in counts.most_common(10)) / counts.total())


def test_references_are_decoded_without_python(spark):
    texts = ["a&#65;b&#x1f;&#x110000;&#;&#x;&#0065", "&#&#233;;&#xD800;&#xffff;", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", html.numeric_entities(F.col("t")).alias("t"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    assert [r["t"] for r in df.orderBy("i").collect()] == ["aAb\x1f&#;&#x;&#0065", "&#é;￿", None, ""]


def test_minhash_reckons_near_whole_quotients(spark, monkeypatch):
    sent = []
    plain = type(spark.range(1)).mapInArrow
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", lambda self, *a, **b: sent.append(self.dtypes) or plain(self, *a, **b))
    words = [f"w{i}" for i in range(20_000)]
    rows = spark.createDataFrame([*enumerate(words)], "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["signature"] for r in dedup.minhash(rows, k=64).collect()}
    parameters = dedup.hash_parameters(64)
    x = [int.from_bytes(hashlib.md5(w.encode()).digest()[:4], "big") for w in words]
    assert any((a * v + b) % dedup.PRIME >= dedup.PRIME - (1 << 41) for v in x for a, b in parameters)  # floating point can't tell these
    assert all(got[i] == [(a * v + b) % dedup.PRIME & dedup.TOP for a, b in parameters] for i, v in enumerate(x))
    assert sent == [[("doc_id", "bigint"), ("hexed", "string")]]


def test_first_wins_rounds_see_shared_bands_only(spark, monkeypatch):
    from quern.streaming import first_wins as fw

    sizes = []
    monkeypatch.setattr(fw, "persisted", lambda df: (out := dedup.persisted(df), sizes.append(out.count()))[0])
    rows = [(i, b, 1000 * b + i) for i in range(300) for b in range(5)] + [(400, 0, 7), (400, 1, 1), (401, 1, 1)]
    stay = fw.settle_first(spark.createDataFrame(rows, "id long, band int, slice long"))
    assert {r["id"] for r in stay.collect()} == {*range(300), 401}
    assert max(sizes) <= 4


def test_perplexity_is_added_up_in_the_row(spark, monkeypatch):
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcdé\U0001f600X") for _ in range(n))
    reference = spark.createDataFrame([(text(90),) for _ in range(5)] + [(None,)], "text string")
    docs = spark.createDataFrame([(i, text(5 * i) + "z" * (i % 3)) for i in range(12)] + [(20, None), (21, "ab"), (22, "zzzz"), (None, "abcd"), (3, "abc")], "doc_id long, text string")
    for n in (2, 3):
        joined = {r["doc_id"]: r["perplexity"] for r in charlm.perplexity(docs, reference, n, small=0).collect()}
        with monkeypatch.context() as m:
            m.setattr(charlm, "_sent", None)  # no join
            got = {r["doc_id"]: r["perplexity"] for r in charlm.perplexity(docs, reference, n).collect()}
        assert got.keys() == joined.keys() and all(got[i] == pytest.approx(joined[i], rel=1e-12) for i in got)
    counts, _, vocabulary = charlm.fit(reference)
    short, whole = ({r["doc_id"]: (pytest.approx(r["log_p"]), r["m"]) for r in charlm._log_sums(docs.where("doc_id <> 3"), counts, vocabulary, 3, **k).collect()} for k in ({"span": 7}, {}))
    assert short.keys() == whole.keys() and all(short[i][1] == whole[i][1] for i in short)


def test_word_measures_equal_the_two_ratios(spark):
    from quern.functions import text as T

    rng = random.Random(4)
    texts = [" ".join(rng.choice("abC") for _ in range(n)) for n in (1, 2, 3, 4, 9, 30, 80)] + ["", None, " a  A b ", "x " * 50]
    docs = spark.createDataFrame([*enumerate(texts)], "i int, text string")
    t = F.col("text")
    for n in (2, 3):
        rows = docs.select("i", T.word_measures(t, n).alias("m"), T.duplicate_ngram_ratio(t, n).alias("r"), T.type_token_ratio(t).alias("d")).collect()
        assert all((r["m"]["repeated"], r["m"]["distinct"]) == ((r["r"], r["d"]) if texts[r["i"]] is not None else (None, None)) for r in rows)


def test_safety_signs_lose_no_match(spark):
    from quern.operators import answers

    texts = ["How To MAKE a Bomb", "how to build weapon", "instructions for ATTACK", "Instructions for tea", "my Credit Card number", "the home address of", "Phone Number of x", "how to TRICK", "create Forged", "how to break into", "Drug synthesis", "illegal substance recipe", "how to steal and make a bomb", "Kow", None, ""]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    plain = F.coalesce(*[F.when(F.col("text").rlike("(?i)" + "|".join(p)), name) for name, p in answers.RISKS], F.lit("safe"))
    rows = docs.select("text", answers.safety(F.col("text")).alias("got"), plain.alias("want")).collect()
    assert all(r["got"] == r["want"] for r in rows) and len({r["got"] for r in rows}) == 5


def test_near_pairs_write_only_a_fifth_of_the_shingles(spark, monkeypatch):
    """Of 60 texts two are alike: the sets of the others stay in their texts, and exact copies go without moving a text."""
    rng = random.Random(6)
    texts = [" ".join(str(rng.randrange(10**6)) for _ in range(200)) for _ in range(60)]
    texts[59] = texts[58] + " more"
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts + texts[:5])], "doc_id long, text string").repartition(3)
    written, real = [], dedup.persisted
    monkeypatch.setattr(dedup, "persisted", lambda df: written.append(real(df)) or written[-1])
    found = dedup.similar_pairs(docs).collect()
    assert [(r["a"], r["b"]) for r in found] == [(58, 59)] and found[0]["jaccard"] == 196 / 197
    arrays = [(df, c) for df in written for c, kind in df.dtypes if kind.startswith("array")]
    assert 60 * 40 <= sum(df.agg(F.sum(F.size(c))).first()[0] for df, c in arrays) < 60 * 50
    assert not any("text" in df.columns for df in written)
    plan = dedup.keep_first(docs, dedup.sha256_key(F.col("text")))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "BroadcastExchange" in plan


def test_first_of_copies_beyond_what_is_broadcast(spark):
    """Ids repeat, are null, and one id stands for a copy and a text of its own; the same rows stay either way."""
    rows = [(1, "a"), (2, "a"), (2, "b"), (2, "b"), (None, "a"), (None, "c"), (None, "c"), (3, None), (3, None), (4, "b"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for small in (0, 100):
        kept = [tuple(r) for r in dedup.keep_first(docs, F.col("text"), small=small).collect()]
        assert Counter(kept) == Counter([(1, "a"), (2, "b"), (2, "b"), (None, "c"), (None, "c"), (3, None), (3, None), (None, None)])


@pytest.mark.parametrize("name", ["context_precision", "rerank_topk"])
def test_queries_on_hits_make_no_row_for_each_document_and_term(spark, monkeypatch, name):
    """The hits come from sums inside the tasks, and equal those of the joined terms."""
    from quern.plans import more_queries

    folder, search, terms = "/root/testdata/sf0.001", retrieval.search, retrieval.bm25_terms
    want = search(terms(more_queries.read(spark, folder, "documents"), more_queries.read(spark, folder, "benchmark"))).select("query_id", "doc_id", "score", "rank").collect()
    monkeypatch.setattr(retrieval, "bm25_terms", None)
    got = more_queries.QUERIES[name](spark, folder).collect()
    assert {r["query_id"] for r in got} == {r["query_id"] for r in want}
    found = retrieval.keyword_top_k(more_queries.read(spark, folder, "documents"), more_queries.read(spark, folder, "benchmark"))
    assert Counter(map(tuple, found.select("query_id", "doc_id", "score", "rank").collect())) == Counter(map(tuple, want))


def test_passages_of_whole_copies_leave_no_rows(spark, monkeypatch):
    """30 of 60 texts are copies: they are repeated as a whole, and only the passage that two other texts share makes rows."""
    rng = random.Random(9)
    texts = ["".join(rng.choice("abcdefgh") for _ in range(400)) for _ in range(30)]
    shared, own = texts[0][100:180], (texts[1][:49] + "X", "Y" + texts[1][131:])
    texts[1] = shared.join(own)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts + texts)], "doc_id long, text string").repartition(3)
    written, real = [], suffixes.persisted
    monkeypatch.setattr(suffixes, "persisted", lambda df: written.append(real(df)) or written[-1])
    cut = {r["key"]: (r["text"], r["n_cut"]) for r in suffixes.cut_repeats(docs).collect()}
    assert cut == {1: ("".join(own), 80)} | {i: ("", 400) for i in range(30, 60)}
    assert 0 < sum(df.count() for df in written if "context" in df.columns) < 60


def test_skip_grams_number_texts_where_they_are(spark):
    """With a list of words that is broadcast, nothing but words and pairs is shuffled: no text is put together again."""
    rows = [(i, [f"w{(i * j) % 50}" for j in range(40)]) for i in range(40)]
    got = examples.sampled_skip_grams(spark.createDataFrame(rows, "doc_id long, words array<string>"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert got.count() > 0 and "collect_list" not in plan and plan.count("Exchange hashpartitioning") == 1
