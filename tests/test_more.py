"""ROUGE pairs, byte-level words, normal forms, semantic chunks, global queries, clusters, flattening."""

import random

from pyspark.sql import functions as F

from quern.operators import dedup, graph, monitor, retrieval, tokenize
from quern.sources import tables


def test_rouge_pairs_lose_nothing(spark):
    rng = random.Random(2)
    make = lambda: [rng.choice("abcdefghij") for _ in range(rng.randrange(3, 14))]
    rows = []
    for i in range(40):
        w = make()
        rows.append((2 * i, " ".join(w)))
        w[rng.randrange(len(w))] = "z"
        rows.append((2 * i + 1, " ".join(w)))
    docs = spark.createDataFrame([*rows, (999, None), (998, "")], "doc_id long, text string")
    got = {(r["a"], r["b"]) for r in dedup.rouge_pairs(docs, docs).collect()}
    assert got == {(a, b) for a, s in rows for b, t in rows if dedup.lcs_f1(s.split(), t.split()) > 0.7}


def test_byte_level(spark):
    counts = spark.createDataFrame([("né", 5), ("née", 4), ("\U0001f600", 3)], "word string, n long")
    spelled = tokenize.byte_words(counts)
    merges = tokenize.learn_merges(spelled, 6)
    pieces = tokenize.apply_merges(spelled, merges).select(tokenize.from_byte_pieces(F.col("pieces")).alias("t"))
    assert {r["t"] for r in pieces.collect()} == {"né", "née", "\U0001f600"}


def test_forms(spark):
    df = spark.createDataFrame([("é NASA Went a​b",), (None,)], "t string")
    rows = df.select(tokenize.unicode_form(F.col("t"), "NFC", True).alias("n"), tokenize.lower_but_acronyms(F.col("t")).alias("l")).collect()
    assert rows[0]["n"] == "é NASA Went ab" and "NASA went" in rows[0]["l"] and rows[1]["n"] is None


def test_semantic_chunks(spark):
    rows = [(1, i, f"s{i}", v) for i, v in enumerate([[1.0, 0.0], [1.0, 0.1], [0.0, 1.0], [0.1, 1.0], [1.0, 0.0]])]
    out = retrieval.semantic_chunks(spark.createDataFrame(rows, "doc_id long, n int, text string, vector array<double>")).orderBy("chunk").collect()
    assert [r["text"] for r in out] == ["s0 s1", "s2 s3", "s4"]


def test_global_query(spark):
    s = spark.createDataFrame([("a", "Ann, Bob: Ann - Bob"), ("b", "Rome, Oslo: Oslo - Rome")], "community string, summary string")
    assert [r["community"] for r in graph.global_query(s, "where is Rome").collect()] == ["b"]
    assert graph.global_query(s, "nothing here").count() == 2


def test_clusters_and_flatten(spark):
    v = spark.createDataFrame([(i, [float(i % 2) * 10, 0.1 * i]) for i in range(20)], "vec_id long, embedding array<double>")
    found = {r["vec_id"]: r["cluster"] for r in monitor.clusters(v, 2).collect()}
    assert len({found[i] for i in range(0, 20, 2)}) == 1 and found[0] != found[1]
    nested = spark.range(1).select(F.struct(F.lit(1).alias("b"), F.struct(F.lit(2).alias("d")).alias("c")).alias("a"), F.lit(3).alias("e"))
    assert tables.flatten(nested).columns == ["a/b", "a/c/d", "e"]


def test_merges_of_a_large_vocabulary_are_those_of_the_driver(spark):
    rng = random.Random(5)
    words = {"".join(rng.choice(letters) for _ in range(rng.randrange(1, 9))) for letters in ("ab", "abc", "é\U0001f600xyz</w>") for _ in range(60)}
    counts = spark.createDataFrame([(w, rng.choice((1, 2, 2, 3, 50))) for w in sorted(words)], "word string, n long")
    few = tokenize.learn_merges(counts, 25)
    assert few == tokenize.learn_merges(counts, 25, max_words=10) and len(few) == 25
    tiny = spark.createDataFrame([("aaaa", 3), ("abab", 2), ("", 5)], "word string, n long")
    assert tokenize.learn_merges(tiny, 50) == tokenize.learn_merges(tiny, 50, max_words=0)
    assert tokenize.learn_merges(counts.where("n < 0"), 5) == []
    assert tokenize.learn_wordpiece(counts, 6) == tokenize.learn_wordpiece(counts, 6, max_words=10)


def test_settled_head_of_the_ranking():
    ranked = [(("a", "b"), 9), (("c", "d"), 8), (("e", "f"), 7), (("b", "c"), 7), (("g", "h"), 6)]
    assert tokenize._settled(ranked, set(), True) == [("a", "b"), ("c", "d")]
    assert tokenize._settled(ranked[:3], set(), False) == [("a", "b"), ("c", "d")]
    assert tokenize._settled(ranked[:3], set(), True) == [("a", "b"), ("c", "d"), ("e", "f")]
    assert tokenize._settled(ranked, {"ab"}, True) == [("a", "b")] and tokenize._settled([], set(), True) == []
    assert tokenize._settled([(("a", "a"), 5), (("c", "d"), 4)], set(), True) == [("a", "a")]


def test_words_coded_in_their_documents(spark):
    """Encoding by the function of a word equals encoding by the table of pieces; odd characters, nulls and unknown ids too."""
    rows = [(1, "low lower lowest"), (2, "newer, \x01 wider < / w > </w>"), (3, None), (4, ""), (5, "\U00040000 ééé aaaa aaa"), (6, "zebra qqq")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    counts = tokenize.word_frequencies(docs.where("doc_id <> 6"))
    merges = tokenize.learn_merges(counts, 30, 1)
    assert merges == tokenize.learn_merges(counts, 30, 1, max_words=0)
    assert tokenize.learn_wordpiece(counts, 12, min_frequency=1) == tokenize.learn_wordpiece(counts, 12, min_frequency=1, max_words=0)
    pieces = tokenize.apply_merges(counts, merges)
    ids = tokenize.vocabulary_ids(pieces.select(F.explode("pieces").alias("token")))
    one = tokenize.encoded_by(docs, tokenize.by_merges(merges), ids, most=2)
    table = tokenize.encoded(docs, tokenize.apply_merges(tokenize.word_frequencies(docs), merges), ids)
    assert sorted(map(str, one.collect())) == sorted(map(str, table.collect()))
    texts = {r["doc_id"]: r["text"] for r in tokenize.decoded(one, ids).collect()}
    assert texts[1] == "low lower lowest" and texts[3] == texts[4] == "" and texts[6].startswith("<unk>") and len(texts) == 6
    strange = spark.createDataFrame([(1, [10**6, None, 2]), (1, []), (2, None)], "doc_id long, ids array<int>")
    assert sorted(r["text"] for r in tokenize.decoded(strange, ids).collect()) == ["", "", "<unk><unk>"]


def test_searches_inside_tasks_equal_the_plain_ones(spark):
    """Keyword and character searches and containment in batches against their row by row forms, with ties and odd rows."""
    texts = ["the red fox", "the the fox ran", "", None, "Red  FOX\tran far", "ññ 😀 fox", "a b c d", "the red fox", "xthe red fox ran", "ab"] * 60
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    items = spark.createDataFrame([(1, "the red fox"), (2, "fox fox far"), (3, ""), (4, "zzz"), (5, "a b"), (6, "red fox"), (7, "the red  fox ran")], "item_id long, text string")
    flat = lambda df, *c: sorted(tuple(r[x] for x in c) for r in df.collect())
    for kind, terms in (("bm25", retrieval.bm25_terms), ("tfidf", retrieval.tfidf_terms)):
        for k in (3, 20, 700):
            found, plain = retrieval.keyword_top_k(docs, items, k, kind), retrieval.search(terms(docs, items), k)
            assert flat(found, "query_id", "rank", "doc_id", "score") == flat(plain, "query_id", "rank", "doc_id", "score")
    for k in (4, 700):
        plain = retrieval.top_k(retrieval.char_overlap(docs, items), k)
        assert flat(retrieval.char_top_k(docs, items, k), "query_id", "rank", "doc_id", "score") == flat(plain, "query_id", "rank", "doc_id", "score")
    assert flat(retrieval.keyword_top_k(docs, items, 3, most=2), "query_id", "rank", "doc_id") == flat(retrieval.keyword_top_k(docs, items, 3), "query_id", "rank", "doc_id")
    want = sorted((r["item_id"], i) for r in items.collect() for i, t in enumerate(texts) if t is not None and r["text"] in t)
    assert flat(retrieval.containing(docs, items), "query_id", "doc_id") == want
    assert retrieval.keyword_top_k(docs.limit(0), items).count() == 0 and retrieval.keyword_top_k(docs, items.limit(0)).count() == 0


def test_prefixes_send_only_rare_shingles(spark):
    """A fifth of each set is joined, the frequent ones last, and no similar pair is lost."""
    rng = random.Random(8)
    base = [[rng.randrange(10**6) for _ in range(rng.choice((3, 10, 40)))] for _ in range(60)]
    texts = [b + [7, 7, 7, 7, 7, 7, 8, 8] for b in base] + [[rng.randrange(10**6), *b[1:]] + [7, 7, 7, 7, 7, 7, 8, 8] for b in base * 3]
    docs = spark.createDataFrame([(i, " ".join(map(str, t))) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    sets = docs.select("doc_id", dedup.T.hashed_shingles(F.col("text"), 5).alias("grams")).select("doc_id", F.size("grams").alias("size"), "grams")
    found = dedup._rarest(sets, 0.8, "doc_id").groupBy("doc_id", "size").agg(F.collect_set("gram").alias("g")).collect()
    assert len(found) == len(texts) and all(len(r["g"]) == r["size"] - -(-4 * r["size"] // 5) + 1 for r in found)
    own = {r["doc_id"]: set(r["grams"]) for r in sets.collect()}
    common = {g for g in set().union(*own.values()) if sum(g in s for s in own.values()) > 100}
    assert common and all(not common & set(r["g"]) for r in found if r["size"] > 30)
    first = {}
    for i, t in enumerate(texts):
        first.setdefault(tuple(t), i)
    ids = sorted(first.values())
    want = {(a, b) for a in ids for b in ids if a < b and len(own[a] & own[b]) >= 0.8 * len(own[a] | own[b])}
    got = [(r["a"], r["b"]) for r in dedup.similar_pairs(docs).collect()]
    assert len(want) > 20 and sorted(got) == sorted(want)
