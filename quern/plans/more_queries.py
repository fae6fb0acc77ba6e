"""Queries on verification, safety, reranking, reports, encodings, skip-grams and tokeniser round trips, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import answers, chat, examples, html, quality, retrieval, tokenize
from quern.operators.dedup import persisted
from quern.operators.stats import rounded
from quern.plans.corpus_queries import BM25_CTE, M, _draw_sql, _metrics
from quern.plans.text_queries import METRICS_CTE, RAW_WORDS, WORDS
from quern.sources.tables import read

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


STEPS = r"(case when len({a}) > 1 then {a} else list_filter(list_transform(string_split(text, '。'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') end)".replace("{a}", r"list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')")


@query(rf"""with t as (select conv_id, turn, text, {STEPS} as s, regexp_extract_all(text, '-?\d+\.?\d*') as n from conversations where role = 'assistant'),
f as (select conv_id, turn, (case when len(s) >= 2 then 0.1 else 0 end + case when regexp_matches(lower(text), '答案|结果|所以|因此|answer|result') then 0.1 else 0 end
 + case when length(text) > 10 and not regexp_matches(text[1:200], '[^\x{{4e00}}-\x{{9fa5}}a-zA-Z0-9\s\+\-\*\/\=\.\,\;\:\!\?\(\)\[\]\{{\}}]') then 0.1 else 0 end)::double as format_score,
 (case when len(n) > 0 then 0.1 else 0 end + case when abs(n[-1]::double) < 1e6 then 0.1 else 0 end)::double as answer_score from t)
select conv_id, turn, round(format_score, 6)::double as format_score, round(answer_score, 6)::double as answer_score from f""")
def verifier_scores(spark: SparkSession, sf: str) -> DataFrame:
    rows = answers.verify(read(spark, sf, "conversations").where("role = 'assistant'"))
    return rounded(rows.select("conv_id", "turn", "format_score", "answer_score"))


SUMS = "conv_id::varchar || ' + ' || turn::varchar || ' = ' || (conv_id + turn + (conv_id % 3 = 0)::int)::varchar || chr(10) || turn::varchar || ' * 2 = ' || (turn * 2)::varchar"


@query(f"select conv_id, turn, case when conv_id % 3 = 0 then 0.2 else 0.4 end::double as consistency_score, 0.3::double as answer_score from (select conv_id, turn, {SUMS} as text from conversations)")
def verifier_consistency(spark: SparkSession, sf: str) -> DataFrame:
    """Two equations for each turn, the first of them wrong in every third conversation; the answer is known."""
    c, t = F.col("conv_id"), F.col("turn")
    s = lambda x: x.cast("string")
    text = F.concat(s(c), F.lit(" + "), s(t), F.lit(" = "), s(c + t + (c % 3 == 0).cast("int")), F.lit("\n"), s(t), F.lit(" * 2 = "), s(t * 2))
    rows = read(spark, sf, "conversations").select("conv_id", "turn", text.alias("text"), s(t * 2).alias("want"))
    return rounded(answers.verify(rows, expected="want").select("conv_id", "turn", "consistency_score", "answer_score"))


@query(f"""with {BM25_CTE}, r as (select query_id, doc_id, round(sum(score), 9) as score from s group by all having round(sum(score), 9) > 0),
h as (select * from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from r) where rank <= 10)
select query_id, doc_id, score::double as score, rank::int as rank from (select query_id, doc_id, -(doc_id % 97)::double as score, row_number() over (partition by query_id order by -(doc_id % 97) desc, doc_id) as rank from h) where rank <= 5""")
def rerank_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The ten best by BM25 in the order of another score, here one made of the id."""
    hits = retrieval.keyword_top_k(read(spark, sf, "documents"), read(spark, sf, "benchmark"))
    scores = hits.select("query_id", "doc_id", (-(F.col("doc_id") % 97)).cast("double").alias("score"))
    return retrieval.rerank(hits, scores, 5)


@query(f"""with {BM25_CTE}, r as (select query_id, doc_id, round(sum(score), 9) as score from s group by all having round(sum(score), 9) > 0),
h as (select * from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from r) where rank <= 10),
m as (select query_id, rank, (contains(d.text, b.text))::int as rel from h join documents d using (doc_id) join benchmark b on b.item_id = query_id),
u as (select query_id, rel, sum(rel) over (partition by query_id order by rank) / rank as prec from m)
select query_id, round(coalesce(avg(prec) filter (rel = 1), 0), 6)::double as precision from u group by query_id""")
def context_precision(spark: SparkSession, sf: str) -> DataFrame:
    docs, items = read(spark, sf, "documents"), read(spark, sf, "benchmark")
    hits = persisted(retrieval.keyword_top_k(docs, items).select("query_id", "doc_id", "score", "rank"))
    # ten documents a query: the texts of the others stay where they are
    own = docs.join(F.broadcast(hits.select("doc_id").distinct()), "doc_id", "left_semi")
    texts = hits.join(own.select("doc_id", "text"), "doc_id").join(items.select(F.col("item_id").alias("query_id"), F.col("text").alias("q")), "query_id")
    return rounded(retrieval.context_precision(hits, texts.where(F.expr("contains(text, q)"))))


@query(f"""with c as (select text[pos + 1:pos + 500] as text from (select text, unnest(range(0, length(text), 450)) as pos from documents))
select count(*) as total_chunks, round(avg(length(text)), 4)::double as avg_chunk_length, (select count(distinct w) from (select unnest({WORDS}) as w from c)) as vocabulary from c""")
def index_stats(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(retrieval.index_stats(retrieval.fixed_chunks(read(spark, sf, "documents"))), 4)


@query("select doc_id, lang from documents where lang in ('en', 'de')")
def language_filter(spark: SparkSession, sf: str) -> DataFrame:
    return quality.language_filter(read(spark, sf, "documents"), ["en", "de"]).select("doc_id", "lang")


RISK = "(?i)how to (?:make|create|build) (?:a )?(?:bomb|weapon|explosive)|instructions for (?:harm|attack|destroy)|(?:social security|credit card|bank account) number|(?:home address|phone number) of|how to (?:scam|deceive|trick|manipulate)|create (?:fake|forged|fraudulent)|how to (?:hack|break into|steal)|(?:drug|illegal substance) (?:recipe|synthesis)"


@query(f"""with {METRICS_CTE} select lang, count(*) as n, round(avg(length), 4)::double as avg_length, round(avg(duplicate_ngram_ratio), 4)::double as avg_repetition, round(avg((special_char_ratio > 0.3)::int), 4)::double as noisy,
round(avg(regexp_matches(text, '{RISK}')::int), 4)::double as at_risk from metrics group by lang""")
def quality_report(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(quality.quality_report(read(spark, sf, "documents")), 4)


@query(r"""with u as (select conv_id, turn, text, lead(text) over (partition by conv_id order by turn) as answer, role from conversations),
c as (select case when regexp_matches(text, '(?i)how to (?:make|create|build) (?:a )?(?:bomb|weapon|explosive)|instructions for (?:harm|attack|destroy)') then 'harmful_content'
 when regexp_matches(text, '(?i)(?:social security|credit card|bank account) number|(?:home address|phone number) of') then 'personal_info'
 when regexp_matches(text, '(?i)how to (?:scam|deceive|trick|manipulate)|create (?:fake|forged|fraudulent)') then 'deception'
 when regexp_matches(text, '(?i)how to (?:hack|break into|steal)|(?:drug|illegal substance) (?:recipe|synthesis)') then 'illegal_activity' else 'safe' end as category,
 coalesce(regexp_matches(answer, '(?i)I (?:cannot|can''t|won''t|am unable to)|I''m (?:sorry|afraid),? (?:but )?I (?:cannot|can''t)|(?:not|never) (?:able|willing|going) to (?:help|assist|provide)|(?:against|violates) (?:my|the) (?:guidelines|policies|rules)|(?:harmful|dangerous|illegal|unethical)'), false)::int as refused from u where role = 'user')
select category, count(*) as n, case when category = 'safe' then 0.9 else 0.8 end::double as confidence, round(avg(refused), 6)::double as refusal_rate from c group by category""")
def safety_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    turns = read(spark, sf, "conversations").withColumn("response", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    return rounded(answers.safety_breakdown(turns.where("role = 'user'")))


CODES = "list_transform(string_split({t}, ''), lambda c: (ord(c) % 256)::int)"


@query(f"""with r as (select doc_id, {CODES.format(t='source')} as p, {CODES.format(t='text')}[1:512 - length(source)] as r, n_chars > 1000 as is_desirable from documents)
select doc_id, is_desirable, p || r || list_transform(range(512 - len(p) - len(r)), lambda i: 0) as input_ids, list_transform(p, lambda i: -100) || r || list_transform(range(512 - len(p) - len(r)), lambda i: -100) as labels,
list_transform(p || r, lambda i: 1) || list_transform(range(512 - len(p) - len(r)), lambda i: 0) as attention_mask from r""")
def feedback_encode(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "documents").select("doc_id", F.col("source").alias("prompt"), F.col("text").alias("response"), (F.col("n_chars") > 1000).alias("is_desirable"))
    return chat.feedback_examples(rows)


@query(f"""with r as (select item_id, {CODES.format(t="('Q: ' || text)")}[1:512] as ids from benchmark), f as (select item_id, ids || list_transform(range(512 - len(ids)), lambda i: 0) as input_ids from r)
select item_id, input_ids, list_transform(input_ids, lambda x: (x <> 0)::int) as attention_mask from f""")
def joined_encode(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "benchmark").select("item_id", chat.joined_ids(F.lit("Q: "), F.col("text")).alias("e")).select("item_id", "e.*")


@query(f"""with e as (select doc_id, unnest(range(len(w))) as pos, unnest(w) as word from (select doc_id, {WORDS} as w from documents)),
c as (select word from e group by word having count(*) >= 5),
k as (select doc_id, word, row_number() over (partition by doc_id order by pos) - 1 as i, count(*) over (partition by doc_id) as n from e join c using (word)),
w as (select *, (floor({_draw_sql('42', 'doc_id', 'i')} * 5) + 1)::int as r from k)
select a.word as center, b.word as context, count(*) as n from w a join k b on a.doc_id = b.doc_id and a.i <> b.i and b.i between a.i - a.r and a.i + a.r group by all""")
def skip_gram_samples(spark: SparkSession, sf: str) -> DataFrame:
    return examples.sampled_skip_grams(read(spark, sf, "documents").select("doc_id", T.words(F.col("text")).alias("words")))


@query(f"""with {M}, s as (select *, (step % 3 <> 0)::int as mask from m), a as (select name, avg(value) filter (mask = 1) as mean, var_pop(value) filter (mask = 1) as v from s group by name)
select name, step, round(greatest(-2.0, least(2.0, (value - mean) / sqrt(v + 1e-8))), 4)::double as whitened from s join a using (name)""")
def masked_whitening(spark: SparkSession, sf: str) -> DataFrame:
    from quern.operators import monitor

    rows = monitor.finite(_metrics(spark, sf)).withColumn("mask", (F.col("step") % 3 != 0).cast("int"))
    out = answers.whiten(rows, "value", "name", mask="mask")
    return rounded(out.select("name", "step", answers.clipped(F.col("whitened"), -2.0, 2.0).alias("whitened")), 4)


@query(r"select doc_id, array_to_string(regexp_extract_all(text, '[a-zA-Z]+'), ' ') as text from documents")
def bpe_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Words of letters encoded with learned merges and decoded again: the words themselves, space-joined."""
    docs = read(spark, sf, "documents")
    counts = persisted(tokenize.word_frequencies(docs, "[a-zA-Z]+"))
    merges = tokenize.learn_merges(counts, 100)
    ids = tokenize.vocabulary_ids(tokenize.apply_merges(counts, merges).select(F.explode("pieces").alias("token")))
    coded = tokenize.encoded_by(docs, tokenize.by_merges(merges), ids, "[a-zA-Z]+").withColumn("ids", tokenize.with_ends(F.col("ids")))
    return tokenize.decoded(coded, ids)


@query(r"select doc_id, array_to_string(regexp_extract_all(text, '[a-zA-Z]+'), ' ') as text from documents")
def wordpiece_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """The same with a learned WordPiece vocabulary; all its characters are known, so no word is lost."""
    docs = read(spark, sf, "documents")
    counts = tokenize.word_frequencies(docs, "[a-zA-Z]+")
    letters = [chr(c) for c in (*range(65, 91), *range(97, 123))]
    vocabulary = sorted({*tokenize.learn_wordpiece(counts, 50), *letters, *(f"##{c}" for c in letters)})
    ids = tokenize.vocabulary_ids(spark.createDataFrame([(t,) for t in vocabulary], "token string"))
    return tokenize.decoded(tokenize.encoded_by(docs, tokenize.by_longest(vocabulary), ids, "[a-zA-Z]+"), ids, "wordpiece")


@query(f"""with w as (select source, unnest({WORDS}) as token from documents), t as (select token from w group by token having count(distinct source) = (select count(distinct source) from documents)) select count(*) as shared from t""")
def vocab_common(spark: SparkSession, sf: str) -> DataFrame:
    """Words that every source has in common."""
    docs = read(spark, sf, "documents")
    sources = [r["source"] for r in docs.select("source").distinct().orderBy("source").collect()]
    words = docs.select("source", F.explode(T.words(F.col("text"))).alias("token")).distinct()
    return tokenize.common_to_all({s: words.where(F.col("source") == s) for s in sources})


@query()
def html_process_counts(spark: SparkSession, sf: str) -> DataFrame:
    return html.process_counts(read(spark, sf, "pages"))


@query(rf"""with r as (select doc_id, text, length(text) as n, {RAW_WORDS} as w from documents),
g as (select *, case when len(w) >= 10 then list_transform(range(1, len(w) - 8), lambda i: array_to_string(w[i:i + 9], ' ')) else [] end as g from r),
p as (select doc_id, n % 7 / 1.0 as judge, (n % 900)::double as ppl, n between 50 and 10000 and (len(g) = 0 or round(1 - len(list_distinct(g)) / len(g), 4) <= 0.3)
 and round(length(regexp_replace(text, '[^\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g')) / n, 6) <= 0.01 as ok, text from g)
select doc_id, case when judge < 3.5 then 'judge' when ppl < 5 or ppl > 500 then 'perplexity' end as failed_at from p where ok""")
def pair_layers(spark: SparkSession, sf: str) -> DataFrame:
    """The pairs that pass the rules (no meta expression occurs in them), and what later layers say; scores are made of lengths."""
    n = F.col("n")
    rows = read(spark, sf, "documents").select("doc_id", F.col("text").alias("response"), F.char_length("text").alias("n"))
    rows = rows.select("doc_id", "response", F.concat(F.lit('{"overall": '), (n % 7).cast("string"), F.lit(".0}")).alias("reply"), (n % 900).cast("double").alias("ppl"))
    out = quality.pair_pipeline(rows, "reply", "ppl")
    return out.where("failed_at is null or failed_at <> 'rules'").select("doc_id", "failed_at")
