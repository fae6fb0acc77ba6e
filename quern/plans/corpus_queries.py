"""Queries on mixing, retrieval, graphs, chat, answers, training examples, tokenisers and metric windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import answers, chat, examples, graph, mixing, monitor, retrieval, tokenize
from quern.operators.dedup import persisted
from quern.operators.stats import rounded
from quern.plans import pipeline
from quern.plans.text_queries import RAW_WORDS, WORDS
from quern.sources.tables import hash_split, metric_json, read

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


@query()
def default_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    return pipeline.run(read(spark, sf, "documents"))[0].select("doc_id", "text", F.round("rule_score", 6).alias("rule_score"), F.round("quality_score", 6).alias("quality_score"))


def _weights(docs: DataFrame, temperature: float = 2.0) -> DataFrame:
    return mixing.temperature_weights(docs.groupBy("source").agg(F.count("*").alias("weight")), temperature)


@query("with s as (select source, count(*) as weight from documents group by source) select source, round(sqrt(weight) / sum(sqrt(weight)) over (), 6)::double as p from s")
def mix_weights(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_weights(read(spark, sf, "documents")).select("source", "p"))


@query("""with s as (select source, sqrt(count(*)) as w from documents group by source), q as (select source, round_even(w / sum(w) over () * 1000, 0)::bigint as q from s)
select source, case when source = max(source) over () then greatest(0, 1000 - coalesce(sum(q) over (order by source rows between unbounded preceding and 1 preceding), 0))::bigint else q end as quota from q""")
def mix_quotas(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.allocate(_weights(read(spark, sf, "documents")), 1000).select("source", "quota")


def _draw_sql(seed: str, *columns: str) -> str:
    """SQL of ``ranks.draw``."""
    return f"(('0x' || substr(md5({' || chr(58) || '.join([repr(seed), *columns])}), 1, 13))::bigint / 4503599627370496.0)"


SOURCES = "c as (select source, count(*) as size, sqrt(count(*)) as w from documents group by source), p as (select source, size, w / sum(w) over () as p from c)"


@query(f"""with {SOURCES}, h as (select source, size, p, sum(p) over (order by source) as hi from p), d as (select unnest(range(1000)) as draw),
u as (select draw, {_draw_sql('42', 'draw')} as u, {_draw_sql('43', 'draw')} as v from d),
t as (select draw, source, (floor(v * size) + 1)::bigint as rank from u join h on u >= hi - p and u < hi),
n as (select doc_id, source, row_number() over (partition by source order by doc_id) as rank from documents)
select draw, t.source, doc_id from t join n on t.source = n.source and t.rank = n.rank""")
def mix_sample(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents")
    return mixing.sample_proportional(docs, _weights(docs), 1000)


@query(f"""with {SOURCES}, q as (select source, size, round_even(p * 1000, 0)::bigint as q from p),
a as (select source, size, case when source = max(source) over () then greatest(0, 1000 - coalesce(sum(q) over (order by source rows between unbounded preceding and 1 preceding), 0))::bigint else q end as quota from q),
t as (select source, size, unnest(range(quota)) as turn from a),
n as (select doc_id, source, row_number() over (partition by source order by {_draw_sql('42', 'doc_id')}, doc_id) as rank from documents)
select t.source, turn, doc_id from t join n on t.source = n.source and n.rank = turn % size + 1""")
def mix_round_robin(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents")
    return mixing.round_robin(docs, _weights(docs), 1000)


@query("select source, count(*) as n, round(count(*) / sum(count(*)) over (), 6)::double as share from documents group by source")
def mix_statistics(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents")
    return rounded(mixing.mix_statistics(docs, _weights(docs)).select("source", "n", "share"))


@query("""with s as (select lang, count(*)::double as initial, 1000.0 / count(*) as final from documents group by lang), t as (select unnest(range(0, 11)) * 1000 as step),
a as (select step, case when step <= 1000 then 0.0 else 0.5 * (1 - cos(pi() * least(1.0, (step - 1000) / 9000.0))) end as alpha from t)
select step::bigint as step, lang, round(initial + alpha * (final - initial), 6)::double as weight from a cross join s""")
def curriculum_schedule(spark: SparkSession, sf: str) -> DataFrame:
    n = F.count("*")
    sources = read(spark, sf, "documents").groupBy("lang").agg(n.cast("double").alias("initial"), (1000.0 / n).alias("final"))
    return rounded(mixing.curriculum(sources, 10_000, 10, "cosine", 1000).select("step", "lang", "weight"))


@query("with s as (select lang, count(*) as size from documents group by lang) select lang, size, round(sqrt(size) / sum(sqrt(size)) over (), 6)::double as p, round(sqrt(size) / sum(sqrt(size)) over () * 5000 / size, 6)::double as epochs from s")
def domain_epochs(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(mixing.domain_epochs(read(spark, sf, "documents"), 2.0, 5000, "lang"))


@query("select doc_id, ('0x' || substr(md5(doc_id::varchar), 1, 8))::bigint % 100 < 10 as validation from documents")
def train_validation_split(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select("doc_id", hash_split(F.col("doc_id")).alias("validation"))


BM25_CTE = rf"""
d as (select doc_id, {WORDS} as w from documents), c as (select count(*) as n_docs, avg(len(w)) as avg_len from d),
p as (select doc_id, len, term, count(*) as tf from (select doc_id, len(w) as len, unnest(w) as term from d) group by all),
df as (select term, count(*) as df from p group by term),
q as (select item_id as query_id, term, count(*) as qf from (select item_id, unnest({WORDS}) as term from benchmark) group by all),
s as (select query_id, doc_id, p.term, qf * ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg_len)) as score, qf * tf * ln(n_docs / df) as tfidf
 from p join q on p.term = q.term join df on p.term = df.term cross join c)"""
TOP10 = "select query_id, doc_id, round({s}, 4)::double as score, rank::int as rank from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from (select query_id, doc_id, round(sum({c}), 9) as score from s group by all having round(sum({c}), 9) > 0)) where rank <= 10"


@query(f"with {BM25_CTE} " + TOP10.format(s="score", c="score"))
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.keyword_top_k(read(spark, sf, "documents"), read(spark, sf, "benchmark")).withColumn("score", F.round("score", 4))


@query(f"with {BM25_CTE} " + TOP10.format(s="score", c="tfidf"))
def tfidf_topk(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.keyword_top_k(read(spark, sf, "documents"), read(spark, sf, "benchmark"), kind="tfidf").withColumn("score", F.round("score", 4))


@query(f"with {BM25_CTE} select query_id, doc_id, term, round(score, 5)::double as score from s")
def term_contributions(spark: SparkSession, sf: str) -> DataFrame:
    """Every benchmark item is a query."""
    return rounded(retrieval.bm25_terms(read(spark, sf, "documents"), read(spark, sf, "benchmark")), 5)


CHARS = "list_distinct(string_split(lower(text), ''))"


@query(f"""with {BM25_CTE}, a as (select query_id, doc_id, row_number() over (partition by query_id order by score desc, doc_id) as rank from (select query_id, doc_id, round(sum(score), 9) as score from s group by all having round(sum(score), 9) > 0)),
x as (select doc_id, {CHARS} as c from documents), y as (select item_id as query_id, {CHARS} as k from benchmark),
j as (select query_id, doc_id, len(list_intersect(k, c)) as m, len(k) + len(c) as t from x cross join y),
b as (select query_id, doc_id, row_number() over (partition by query_id order by m / (t - m) desc, doc_id) as rank from j),
f as (select query_id, doc_id, sum(1 / (60 + rank)) as score from (select * from a where rank <= 20 union all select * from b where rank <= 20) group by all)
select query_id, doc_id, round(score, 8)::double as score, rank::int as rank from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from f) where rank <= 10""")
def hybrid_topk(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(retrieval.hybrid(read(spark, sf, "documents"), read(spark, sf, "benchmark")), 8)


@query(f"""with {BM25_CTE}, a as (select query_id, doc_id, row_number() over (partition by query_id order by score desc, doc_id) as rank from (select query_id, doc_id, round(sum(score), 9) as score from s group by all having round(sum(score), 9) > 0)),
b as (select query_id, doc_id, row_number() over (partition by query_id order by score desc, doc_id) as rank from (select query_id, doc_id, round(sum(tfidf), 9) as score from s group by all having round(sum(tfidf), 9) > 0)),
u as (select * from a where rank <= 20 union all select * from b where rank <= 20)
select query_id, doc_id, round(sum(1 / (60 + rank)), 8)::double as score from u group by all""")
def rrf_fusion(spark: SparkSession, sf: str) -> DataFrame:
    docs, items = read(spark, sf, "documents"), read(spark, sf, "benchmark")
    lists = [retrieval.keyword_top_k(docs, items, 20, kind) for kind in ("bm25", "tfidf")]
    return rounded(retrieval.rrf(lists), 8)


@query("with s as (select doc_id, text, unnest(range(0, length(text), 450)) as pos from documents) select doc_id, doc_id || '_chunk_' || (pos // 450) as chunk_id, text[pos + 1:pos + 500] as text from s")
def fixed_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.fixed_chunks(read(spark, sf, "documents")).select("doc_id", "chunk_id", "text")


@query()
def line_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.line_chunks(read(spark, sf, "documents"))


@query()
def recursive_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.recursive_chunks(read(spark, sf, "documents"))


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


VECTORS = """select query_id, doc_id, round(score, 6)::double as score, rank::int as rank from (select *, row_number() over (partition by query_id order by score {o}, doc_id) as rank from
(select q.vec_id as query_id, v.vec_id as doc_id, round({f}, 9) as score from embeddings q cross join embeddings v where q.vec_id % 100 = 0)) where rank <= 10"""


@query(VECTORS.format(o="desc", f="list_cosine_similarity(q.embedding::double[], v.embedding::double[])"))
def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The stated queries are the vectors whose id is divisible by 100."""
    return rounded(retrieval.vector_top_k(read(spark, sf, "embeddings"), _asked(spark, sf)))


@query(VECTORS.format(o="asc", f="list_distance(q.embedding::double[], v.embedding::double[]) ** 2"))
def vector_topk_l2(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(retrieval.vector_top_k(read(spark, sf, "embeddings"), _asked(spark, sf), measure="l2"))


@query()
def approximate_topk_recall(spark: SparkSession, sf: str) -> DataFrame:
    vectors, asked = read(spark, sf, "embeddings"), _asked(spark, sf)
    return retrieval.recall(retrieval.approximate_top_k(vectors, asked), retrieval.vector_top_k(vectors, asked), 10)


@query(f"""with {BM25_CTE}, r as (select query_id, doc_id, rank from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from (select query_id, doc_id, round(sum(score), 9) as score from s group by all having round(sum(score), 9) > 0)) where rank <= 10),
rel as (select item_id as query_id, doc_id from documents join benchmark on contains(documents.text, benchmark.text)),
n as (select query_id, count(*) as n_rel from rel group by query_id), h as (select r.*, row_number() over (partition by r.query_id order by rank) as seen from r join rel using (query_id, doc_id)),
a as (select query_id, count(*) as found, min(rank) as first, sum(1 / log2(rank + 1.0)) as dcg, sum(seen / rank) as pr from h group by query_id)
select n.query_id, round(coalesce(found / n_rel, 0), 6)::double as recall, round(coalesce(1 / first, 0), 6)::double as mrr, round(coalesce(dcg / list_sum(list_transform(range(1, least(n_rel, 10) + 1), lambda i: 1 / log2(i + 1.0))), 0), 6)::double as ndcg,
round(coalesce(pr / least(n_rel, 10), 0), 6)::double as map from n left join a using (query_id)""")
def ranking_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Relevant to an item are the documents that contain it word for word."""
    docs, items = read(spark, sf, "documents"), read(spark, sf, "benchmark")
    ranked = retrieval.keyword_top_k(docs, items)
    return rounded(retrieval.ranking_metrics(ranked, retrieval.containing(docs, items)))


NAMES = ["the", "thing", "tion", "ouer", "licensed"]
GRAPH_CTE = "f as (select doc_id, length(text) as size, e, instr(lower(text), e) - 1 as at from documents, (select unnest(['the', 'thing', 'tion', 'ouer', 'licensed']) as e) where contains(lower(text), e)), m as (select x.doc_id, x.e as a, y.e as b, greatest(0.1, 1 - abs(x.at - y.at) / x.size) as weight from f x join f y on x.doc_id = y.doc_id and x.e < y.e)"


@query(f"with {GRAPH_CTE} select a, b, round(sum(weight), 6)::double as weight, count(*) as n_docs from m group by a, b")
def cooccurrence_edges(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(graph.edges(graph.relations(graph.entities(read(spark, sf, "documents"), NAMES))))


@query()
def graph_communities(spark: SparkSession, sf: str) -> DataFrame:
    links = graph.edges(graph.relations(graph.entities(read(spark, sf, "documents"), NAMES)))
    return graph.summaries(links, graph.communities(links))


@query("""with t as (select a.embedding as va, b.embedding as vb, c.embedding as vc from embeddings a, embeddings b, embeddings c where a.vec_id = 1 and b.vec_id = 2 and c.vec_id = 3),
q as (select list_transform(range(1, 65), lambda i: va[i] - vb[i] + vc[i]) as q from t)
select doc_id, round(score, 6)::double as score, rank::int as rank from (select vec_id as doc_id, score, row_number() over (order by score desc, vec_id) as rank from (select vec_id, round(list_cosine_similarity(q::double[], embedding::double[]), 9) as score from embeddings cross join q where vec_id not in (1, 2, 3))) where rank <= 5""")
def vector_analogy(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(graph.analogy(read(spark, sf, "embeddings"), 1, 2, 3).select("doc_id", "score", "rank"))


MSG = "'<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10)"


@query(f"select conv_id, string_agg({MSG}, '' order by turn) as text from conversations group by conv_id")
def chatml(spark: SparkSession, sf: str) -> DataFrame:
    return chat.chatml(read(spark, sf, "conversations"))


@query(f"""with p as (select conv_id, turn, role, text, coalesce(sum(length({MSG})) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0) + 12 + length(role) + 1 as start from conversations)
select conv_id, turn, start::bigint as start, (start + length(text))::bigint as "end" from p where role = 'assistant'""")
def assistant_spans(spark: SparkSession, sf: str) -> DataFrame:
    return chat.assistant_spans(read(spark, sf, "conversations"))


LLAMA = """with o as (select *, row_number() over w as n, lead(role) over w as nr, lead(text) over w as nt from conversations window w as (partition by conv_id order by turn)),
s as (select conv_id, text as sys from o where n = 1 and role = 'system'), u as (select o.*, sys, row_number() over (partition by o.conv_id order by turn) as u from o left join s using (conv_id) where role = 'user'),
t as (select conv_id, string_agg('<s>[INST] ' || case when u = 1 and coalesce(sys, '') <> '' then '<<SYS>>' || chr(10) || sys || chr(10) || '<</SYS>>' || chr(10) || chr(10) || text else text end || ' [/INST]' || case when nr = 'assistant' then ' ' || nt || ' </s>' || chr(10) else ' ' end, '' order by turn) as text from u group by conv_id)
select c.conv_id, coalesce(t.text, '') as text from (select distinct conv_id from conversations) c left join t using (conv_id)"""


@query(LLAMA)
def llama_chat(spark: SparkSession, sf: str) -> DataFrame:
    return chat.llama(read(spark, sf, "conversations"))


@query(f"""with x as ({LLAMA}), p as (select conv_id, string_split(text, '[/INST] ') as p from x), q as (select conv_id, unnest(p) as part, unnest(range(len(p))) as n from p),
s as (select *, sum(length(part) + 8) over (partition by conv_id order by n rows between unbounded preceding and 1 preceding)::bigint as start from q)
select conv_id, n::int as n, start, (start + strpos(part, ' </s>') - 1)::bigint as end from s where n > 0 and contains(part, ' </s>')""")
def llama_spans(spark: SparkSession, sf: str) -> DataFrame:
    return chat.llama_spans(chat.llama(read(spark, sf, "conversations")))


@query("""with r as (select conv_id, coalesce(max_by(text, turn) filter (role = 'user'), '') as i, coalesce(max_by(text, turn) filter (role = 'assistant'), '') as r from conversations group by conv_id)
select conv_id, 'Below is an instruction that describes a task. Write a response that appropriately completes the request.' || chr(10) || chr(10) || '### Instruction:' || chr(10) || i || chr(10) || chr(10) || '### Response:' || chr(10) || r as text from r""")
def alpaca_chat(spark: SparkSession, sf: str) -> DataFrame:
    return chat.alpaca(read(spark, sf, "conversations")).select("conv_id", "text")


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    turns = read(spark, sf, "conversations")
    over = Window.partitionBy("conv_id").orderBy("turn")
    rows = turns.withColumns({"answer": F.lead("text").over(over), "next_role": F.lead("role").over(over)})
    return rows.where("role = 'user' and next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("prompt"), "answer")


@query("""with o as (select *, lead(role) over w as nr, lead(text) over w as answer from conversations window w as (partition by conv_id order by turn)),
e as (select conv_id, turn, list_transform(list_filter(string_split(text[1:32], ''), lambda c: c <> ''), lambda c: (unicode(c) % 256)::int) as p, list_transform(list_filter(string_split(answer[1:64], ''), lambda c: c <> ''), lambda c: (unicode(c) % 256)::int) as r from o where role = 'user' and nr = 'assistant')
select conv_id, turn, (p || r)[1:64] as input_ids, (list_transform(p, lambda x: -100) || r)[1:64] as labels from e""")
def preference_encode(spark: SparkSession, sf: str) -> DataFrame:
    e = chat.encode_pair(chat.char_ids(F.col("prompt")), chat.char_ids(F.col("answer")), 64, 32, pad=False)
    return _pairs(spark, sf).select("conv_id", "turn", e.alias("e")).select("conv_id", "turn", "e.input_ids", "e.labels")


@query("select x.source, x.doc_id as chosen, y.doc_id as rejected from (select *, row_number() over (partition by source order by n_chars desc, doc_id) as r from documents) x join (select *, row_number() over (partition by source order by n_chars desc, doc_id) as r from documents) y on x.source = y.source and x.r < y.r and x.r <= 4 and y.r <= 4")
def preference_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of the four longest documents of each source, the longer one chosen."""
    order = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    best = read(spark, sf, "documents").withColumn("rank", F.row_number().over(order)).where("rank <= 4")
    return chat.ranking_pairs(best, "source", "rank", "doc_id").select("source", "chosen", "rejected")


@query(r"""select conv_id, turn, nullif(list_extract(regexp_extract_all(text, '-?\d+\.?\d*'), -1), '') as answer from conversations where role = 'assistant'""")
def answer_extract(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "conversations").where("role = 'assistant'").select("conv_id", "turn", answers.last_number(F.col("text")).alias("answer"))


def _votes(docs: DataFrame) -> DataFrame:
    """Sources as questions, languages as answers, documents as paths."""
    return docs.select(F.col("source").alias("question"), F.col("lang").alias("answer"), F.col("doc_id").alias("path"), (F.col("n_chars") / 1000).alias("score"))


@query("""with c as (select source, lang, count(*) as n, min(doc_id) as f from documents group by all)
select source as question, arg_max(lang, n * 1000000000 - f) as best, round(max(n) / sum(n), 6)::double as confidence, sum(n)::bigint as n, count(*) as n_unique from c group by source""")
def majority_vote(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(answers.vote(_votes(read(spark, sf, "documents"))))


@query("select source as question, arg_max(lang, n_chars::bigint * 1000000000 - doc_id) as best, max(n_chars) / 1000 as max, min(n_chars) / 1000 as min, round(avg(n_chars / 1000), 6)::double as mean, round(stddev_pop(n_chars / 1000), 6)::double as std, count(*) as n from documents group by source")
def best_of_n(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(answers.best_of_n(_votes(read(spark, sf, "documents"))))


@query("with b as (select lang, doc_id % 3 = 0 as correct, case when n_chars < 1000 then 'short' else 'long' end as difficulty from documents) select 'overall' as \"group\", '' as value, count(*) as n, sum(correct::int)::bigint as n_correct, round(avg(correct::int), 6)::double as accuracy from b union all select 'difficulty', difficulty, count(*), sum(correct::int)::bigint, round(avg(correct::int), 6) from b group by difficulty union all select 'category', lang, count(*), sum(correct::int)::bigint, round(avg(correct::int), 6) from b group by lang")
def accuracy_groups(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "documents").select((F.col("doc_id") % 3 == 0).alias("correct"), F.when(F.col("n_chars") < 1000, "short").otherwise("long").alias("difficulty"), F.col("lang").alias("category"))
    return rounded(answers.accuracy(rows))


@query("""with s as (select source, count(*) as n, count(*) filter (lang = 'en') as c from documents group by source)
select source, n, c, round(case when n - c < 5 then 1.0 else 1 - exp(list_sum(list_transform(range(0, 5), lambda i: ln(n - c - i) - ln(n - i)))) end, 6)::double as pass_5 from s""")
def pass_at_k(spark: SparkSession, sf: str) -> DataFrame:
    s = read(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"), F.count(F.when(F.col("lang") == "en", 1)).alias("c"))
    return rounded(s.withColumn("pass_5", answers.pass_at_k(F.col("n"), F.col("c"), F.lit(5))))


@query("""with m as (select avg(value) as mu, stddev_samp(value) as sd from events)
select count(value) as n, round(avg(value), 5)::double as mean, round(stddev_samp(value), 5)::double as std, round(min(value), 5)::double as min, round(max(value), 5)::double as max, round(quantile_cont(value, 0.25), 5)::double as q25, round(quantile_cont(value, 0.75), 5)::double as q75,
round(avg(((value - mu) / sd) ** 3), 5)::double as skewness, round(avg(((value - mu) / sd) ** 4) - 3, 5)::double as kurtosis from events cross join m""")
def reward_stats(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(answers.distribution(read(spark, sf, "events"), "value").select("n", "mean", "std", "min", "max", "q25", "q75", "skewness", "kurtosis"), 5)


@query("with e as (select min(value) as lo, max(value) as hi from events) select least(19, floor((value - lo) / ((hi - lo) / 20)))::int as bin, count(*) as n from events cross join e where value is not null group by 1")
def reward_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return answers.histogram(read(spark, sf, "events"), "value")


@query("""with s as (select avg(n_chars) filter (toxic = 1) as ma, avg(n_chars) filter (toxic = 0) as mb, var_samp(n_chars) filter (toxic = 1) as va, var_samp(n_chars) filter (toxic = 0) as vb from documents join labels using (doc_id)) select round((ma - mb) / sqrt((va + vb) / 2), 6)::double as d from s""")
def length_effect(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id").withColumn("is_toxic", F.col("toxic") == 1)
    return rounded(answers.cohens_d(rows, "n_chars", "is_toxic").select("d"))


@query(r"""with r as (select regexp_matches(text, '(?i)I (?:cannot|can''t|won''t|am unable to)|I''m (?:sorry|afraid),? (?:but )?I (?:cannot|can''t)|(?:not|never) (?:able|willing|going) to (?:help|assist|provide)|(?:against|violates) (?:my|the) (?:guidelines|policies|rules)|(?:harmful|dangerous|illegal|unethical)') as refused,
regexp_matches(text, '(?i)how to (?:make|create|build) (?:a )?(?:bomb|weapon|explosive)|instructions for (?:harm|attack|destroy)|(?:social security|credit card|bank account) number|(?:home address|phone number) of|how to (?:scam|deceive|trick|manipulate)|create (?:fake|forged|fraudulent)|how to (?:hack|break into|steal)|(?:drug|illegal substance) (?:recipe|synthesis)') as risky from conversations where role = 'assistant')
select count(*) as n, avg((refused or not risky)::int)::double as safety_rate, avg(refused::int)::double as refusal_rate, avg((risky and not refused)::int)::double as attack_rate from r""")
def safety_rates(spark: SparkSession, sf: str) -> DataFrame:
    return answers.safety_rates(read(spark, sf, "conversations").where("role = 'assistant'"))


def _metrics(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "events").select(F.col("event_type").alias("name"), F.col("event_id").alias("step"), "value")


M = "m as (select event_type as name, event_id as step, value from events where value is not null and isfinite(value))"


@query(f"with {M} select name, step, round(avg(value) over (partition by name order by step rows between 99 preceding and current row) + 1e-10, 6)::double as smoothed from m")
def metric_moving_avg(spark: SparkSession, sf: str) -> DataFrame:
    """The small addend keeps means that end in half a millionth from rounding both ways."""
    return rounded(monitor.moving_average(_metrics(spark, sf)).select("name", "step", (F.col("smoothed") + 1e-10).alias("smoothed")))


@query(f"with {M}, a as (select *, avg(value) over (partition by name order by step rows between 99 preceding and current row) as s from m) select name, step from a where s > 0 and value > 3 * s")
def metric_spikes(spark: SparkSession, sf: str) -> DataFrame:
    return monitor.spikes(_metrics(spark, sf)).select("name", "step")


@query(f"with {M}, a as (select *, row_number() over (partition by name order by step) as n, avg(value) over (partition by name order by step rows between 10 preceding and 1 preceding) as r from m) select name, step from a where n > 10 and value > 2 * r")
def loss_spikes(spark: SparkSession, sf: str) -> DataFrame:
    return monitor.loss_spikes(_metrics(spark, sf)).select("name", "step")


@query(f"with {M}, a as (select *, row_number() over w as n, avg(value) over (w rows between 49 preceding and current row) as l, avg(value) over (w rows between 99 preceding and 50 preceding) as e from m window w as (partition by name order by step)) select name, step from a where n > 100 and abs(l - e) / greatest(abs(e), 1e-8) < 0.001")
def plateaus(spark: SparkSession, sf: str) -> DataFrame:
    return monitor.plateaus(_metrics(spark, sf)).select("name", "step")


@query(f"with {M} select name, arg_max(value, step) as latest, min(value) as min, max(value) as max, count(*) as count from m group by name")
def metric_summary(spark: SparkSession, sf: str) -> DataFrame:
    return monitor.summary(_metrics(spark, sf))


@query(f"with {M} select name, (step // 10000)::bigint as span, to_json(list({{'step': step, 'value': value}} order by step))::varchar as history from m group by all")
def metric_history(spark: SparkSession, sf: str) -> DataFrame:
    return metric_json(monitor.finite(_metrics(spark, sf)))


@query("with c as (select event_type, count(*) as n from events group by 1), p as (select n, n / sum(n) over () as p from c) select count(*) as n_used, round(stddev_samp(n) / avg(n), 6)::double as cv, round(-sum(p * ln(p)), 6)::double as entropy, round(max(p), 6)::double as top_share from p")
def routing_stats(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(monitor.routing_stats(read(spark, sf, "events"), "event_type"))


@query(rf"""with w as (select word, count(*) as n from (select unnest(regexp_extract_all(text, '[\p{{L}}\p{{M}}\p{{N}}_]+|[^\p{{L}}\p{{M}}\p{{N}}_\s]')) as word from documents) group by word),
s as (select n, list_filter(string_split(word, ''), lambda c: c <> '') || ['</w>'] as s from w), p as (select n, unnest(list_transform(range(1, len(s)), lambda i: {{'l': s[i], 'r': s[i + 1]}})) as p from s)
select p.l as "left", p.r as "right", sum(n)::bigint as n from p group by all""")
def bpe_pair_counts(spark: SparkSession, sf: str) -> DataFrame:
    words = tokenize.word_frequencies(read(spark, sf, "documents"))
    return tokenize.pair_counts(words.select("n", tokenize.symbols(F.col("word")).alias("symbols")))


@query(rf"""with w as (select word, count(*) as n from (select unnest(regexp_extract_all(text, '[\p{{L}}\p{{M}}\p{{N}}_]+|[^\p{{L}}\p{{M}}\p{{N}}_\s]')) as word from documents) group by word),
s as (select n, list_filter(string_split(word, ''), lambda c: c <> '') || ['</w>'] as s from w), p as (select n, unnest(list_transform(range(1, len(s)), lambda i: {{'l': s[i], 'r': s[i + 1]}})) as p from s),
pc as (select p.l as l, p.r as r, sum(n) as n from p group by all), sc as (select s, sum(n) as m from (select n, unnest(s) as s from s) group by s)
select l as "left", r as "right", round(pc.n / (a.m * b.m), 9)::double as score from pc join sc a on l = a.s join sc b on r = b.s""")
def wordpiece_pair_scores(spark: SparkSession, sf: str) -> DataFrame:
    words = tokenize.word_frequencies(read(spark, sf, "documents"))
    return rounded(tokenize.pair_scores(words.select("n", tokenize.symbols(F.col("word")).alias("symbols"))), 9)


@query()
def bpe_encode(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents")
    counts = persisted(tokenize.word_frequencies(docs))
    merges = tokenize.learn_merges(counts, 200)
    ids = tokenize.vocabulary_ids(tokenize.apply_merges(counts, merges).select(F.explode("pieces").alias("token")))
    return tokenize.encoded_by(docs, tokenize.by_merges(merges), ids)


@query(rf"""with d as (select w as word, count(*) as n from (select unnest({WORDS}) as w from documents) group by w), k as (select distinct unnest({WORDS}) as word from benchmark)
select round(sum(case when k.word is not null then n else 0 end) / sum(n), 6)::double as token_coverage, round(avg((k.word is not null)::int), 6)::double as type_coverage, round(1 - sum(case when k.word is not null then n else 0 end) / sum(n), 6)::double as oov_rate from d left join k using (word)""")
def vocab_coverage(spark: SparkSession, sf: str) -> DataFrame:
    count = lambda name: read(spark, sf, name).select(F.explode(T.words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return rounded(tokenize.coverage(count("documents"), count("benchmark")))


@query(rf"""with v as (select lang, unnest({WORDS}) as token from documents), n as (select distinct lang as l from documents where lang is not null)
select x.l as a, y.l as b, (select count(*) from (select token from v where lang = x.l intersect select token from v where lang = y.l)) as shared from n x join n y on x.l < y.l""")
def vocab_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Between all languages, whose number is small."""
    docs = read(spark, sf, "documents")
    languages = [r["lang"] for r in docs.where("lang is not null").select("lang").distinct().orderBy("lang").collect()]
    words = docs.select("lang", F.explode(T.words(F.col("text"))).alias("token"))
    return tokenize.overlap({name: words.where(F.col("lang") == name) for name in languages})


@query("with c as (select doc_id, list_transform(list_filter(string_split(text, ''), lambda c: c <> ''), lambda c: unicode(c)) || [0] as t from documents), s as (select doc_id, unnest(t) as id, unnest(range(0, len(t))) as i from c), g as (select id, row_number() over (order by doc_id, i) - 1 as pos from s) select (pos // 512)::bigint as block, list(id order by pos) as ids from g group by 1")
def packing(spark: SparkSession, sf: str) -> DataFrame:
    """Code points as token ids; documents end to end in blocks of 512."""
    points = F.transform(F.filter(F.split("text", ""), lambda c: c != ""), F.ascii)
    docs = read(spark, sf, "documents").select("doc_id", points.alias("ids"), F.char_length("text").alias("n"))
    return examples.stream_blocks(docs, 512, size="n")


@query(rf"""with d as (select doc_id, list_transform({RAW_WORDS}, lambda w: length(w)::int) as t from documents) select doc_id, (pos - 1)::int as "at", t[pos:pos + 7] as x, t[pos + 1:pos + 8] as y from (select doc_id, t, unnest(range(1, len(t) - 7, 8)) as pos from d)""")
def token_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Word lengths as token ids; windows of 8 every 8 tokens."""
    ids = F.transform(T.words(F.col("text"), lower=False), lambda w: F.char_length(w))
    return examples.next_token_windows(read(spark, sf, "documents").select("doc_id", ids.alias("ids")), 8, 8)


@query(rf"""with w as (select item_id, {WORDS} as w from benchmark), e as (select item_id, unnest(w) as word, unnest(range(0, len(w))) as i from w)
select a.word as center, b.word as context, count(*) as n from e a join e b on a.item_id = b.item_id and a.i <> b.i and abs(a.i - b.i) <= 2 group by all""")
def skip_grams(spark: SparkSession, sf: str) -> DataFrame:
    return examples.skip_grams(read(spark, sf, "benchmark").select(T.words(F.col("text")).alias("words")))


@query(rf"with c as (select w as word, count(*) as n from (select unnest({WORDS}) as w from documents) group by w having count(*) >= 5) select word, round(n ** 0.75 / sum(n ** 0.75) over (), 9)::double as p from c")
def noise_table(spark: SparkSession, sf: str) -> DataFrame:
    counts = read(spark, sf, "documents").select(F.explode(T.words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return rounded(examples.noise_table(counts), 9)


LENGTHS = f"list_transform({RAW_WORDS}, lambda w: length(w)::int)"


@query(f"""with x as (select doc_id, {LENGTHS} as x from documents), n as (select *, len(x) as n, floor({_draw_sql('43', 'doc_id')} * (len(x) + 1))::int as a from x),
b as (select *, a + floor({_draw_sql('44', 'doc_id')} * (n + 1 - a))::int as b, {_draw_sql('42', 'doc_id')} as u, {_draw_sql('45', 'doc_id')} as v from n),
f as (select *, case when u >= 0.5 or n < 3 then 'none' when v < 0.5 then 'psm' else 'spm' end as fim_form, x[1:a] as pre, x[a + 1:b] as mid, x[b + 1:n] as suf from b)
select doc_id, fim_form, case when fim_form = 'psm' then [-1] || pre || [-2] || suf || [-3] || mid || [-4] when fim_form = 'spm' then [-2] || suf || [-1] || pre || [-3] || mid || [-4] else x end as fim_ids,
case when fim_form = 'none' then list_transform(x, lambda t: true) else list_transform(range(n - len(mid) + 3), lambda t: false) || list_transform(range(len(mid) + 1), lambda t: true) end as loss_mask from f""")
def fim_examples(spark: SparkSession, sf: str) -> DataFrame:
    ids = F.transform(T.words(F.col("text"), lower=False), lambda w: F.char_length(w))
    return examples.infill(read(spark, sf, "documents").select("doc_id", ids.alias("ids"))).select("doc_id", "fim_form", "fim_ids", "loss_mask")


_AT = "doc_id", "(i - 1)"


@query(f"""with x as (select doc_id, {LENGTHS} as x from documents)
select doc_id, list_transform(x, lambda t, i: case when {_draw_sql('42', *_AT)} >= 0.15 then t when {_draw_sql('43', *_AT)} < 0.8 then 31 when {_draw_sql('43', *_AT)} < 0.9 then floor({_draw_sql('44', *_AT)} * 30)::int else t end) as masked,
list_transform(x, lambda t, i: case when {_draw_sql('42', *_AT)} < 0.15 then t else -100 end) as labels from x""")
def mlm_examples(spark: SparkSession, sf: str) -> DataFrame:
    ids = F.transform(T.words(F.col("text"), lower=False), lambda w: F.char_length(w))
    return examples.mask_tokens(read(spark, sf, "documents").select("doc_id", ids.alias("ids")), 30, 31).select("doc_id", "masked", "labels")


@query(r"select doc_id, list_transform(list_filter(string_split(regexp_replace(hex(encode(text)), '(..)', '\1 ', 'g'), ' '), lambda x: x <> ''), lambda x: ('0x' || x)::int) as bytes from documents")
def utf8_bytes(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select("doc_id", tokenize.utf8(F.col("text")).alias("bytes"))
