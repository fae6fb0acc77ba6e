"""Queries on voting, rewards, prompts, graphs and event windows, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.operators import answers, chat, dedup, graph, quality, retrieval
from quern.operators.stats import rounded
from quern.plans.corpus_queries import GRAPH_CTE, NAMES, _votes
from quern.sources.tables import read
from quern.streaming import streams

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return register


MAJORITY = "m as (select source, arg_max(lang, n * 1000000000 - f) as best from (select source, lang, count(*) as n, min(doc_id) as f from documents group by all) group by source)"
WEIGHTED = "h as (select source, arg_max(lang, w::decimal(38, 0) * 1000000000 - f) as best, max(w) / sum(w) as share, sum(n)::bigint as n, count(*) as n_unique from (select source, lang, sum(n_chars) as w, count(*) as n, min(doc_id) as f from documents group by all) group by source)"


@query(f"with {WEIGHTED} select source as question, best, round(share, 6)::double as confidence, n, n_unique from h")
def weighted_vote(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(answers.vote(_votes(read(spark, sf, "documents")), F.col("score")))


@query("""with p as (select source, lang, doc_id, row_number() over (partition by source order by doc_id) as i from documents),
c as (select size, source, lang, count(*) as n, min(doc_id) as f from p, unnest([1, 4, 16]) as s(size) where i <= size group by all),
b as (select size, source, arg_max(lang, n * 1000000000 - f) as best from c group by all)
select size, round(avg((best = 'en')::int), 6)::double as accuracy from b group by size""")
def vote_scaling(spark: SparkSession, sf: str) -> DataFrame:
    paths = _votes(read(spark, sf, "documents")).withColumn("gold", F.lit("en"))
    return rounded(answers.scaling(paths, [1, 4, 16]))


@query(f"""with {MAJORITY}, {WEIGHTED}, b as (select source, arg_max(lang, n_chars::bigint * 1000000000 - doc_id) as best from documents group by source)
select round(avg((b.best = 'en')::int), 6)::double as best_of_n, round(avg((m.best = 'en')::int), 6)::double as majority, round(avg((h.best = 'en')::int), 6)::double as weighted
from b join m using (source) join h using (source)""")
def strategy_comparison(spark: SparkSession, sf: str) -> DataFrame:
    rows = _votes(read(spark, sf, "documents"))
    gold = rows.select("question").distinct().withColumn("answer", F.lit("en"))
    return rounded(answers.strategies(rows, gold))


@query("""with s as (select source, count(*) as n, count(*) filter (lang = 'en') as c from documents group by source)
select count(*) as n_questions, sum(n)::bigint as n_attempts, round(avg(c / n), 6)::double as pass_1,
round(avg(case when n - c < least(n, 4) then 1.0 else 1 - list_product(list_transform(range(0, least(n, 4)), lambda i: (n - c - i) / (n - i))) end), 6)::double as pass_k from s""")
def self_play_rounds(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "documents").select(F.col("source").alias("question"), (F.col("lang") == "en").alias("correct"))
    return rounded(answers.round_stats(rows))


@query("""with s as (select source, avg((lang = 'en')::int) as p from documents group by source)
select source, round(p, 6)::double as p, round(1 - (1 - p) ** 4, 6)::double as within_4,
case when p >= 1 then 1 when p > 0 then ceil(ln(0.05) / ln(1 - p))::bigint end as needed from s""")
def success_odds(spark: SparkSession, sf: str) -> DataFrame:
    s = read(spark, sf, "documents").groupBy("source").agg(F.avg((F.col("lang") == "en").cast("double")).alias("p"))
    return rounded(s.select("source", "p", answers.success_probability(F.col("p"), F.lit(4)).alias("within_4"), answers.samples_needed(F.col("p")).alias("needed")))


@query("""with r as (select source as question, doc_id % 5 as quality, length(text) as size, row_number() over (partition by source order by doc_id % 5 desc, length(text), text) as "rank" from documents where lang = 'en')
select question, quality, size, "rank" from r where "rank" <= 3""")
def solution_selection(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "documents").select(F.col("source").alias("question"), (F.col("doc_id") % 5).alias("quality"), F.col("text").alias("solution"), (F.col("lang") == "en").alias("correct"))
    return answers.best_solutions(rows, 3).select("question", "quality", F.char_length("solution").cast("long").alias("size"), F.col("rank").cast("long").alias("rank"))


@query("""with r as (select 0.1::double * (value - user_id % 7) as c, 0.1::double * (event_id % 11 - user_id % 5)::double as r from events)
select round(avg((c > r)::int), 6)::double as win_rate, round(avg(c), 6)::double as mean_chosen, round(avg(r), 6)::double as mean_rejected, round(avg(c - r), 6)::double as mean_margin, round(stddev_samp(c - r), 6)::double as std_margin from r""")
def reward_margins(spark: SparkSession, sf: str) -> DataFrame:
    part = lambda c, n: (F.col(c) % n).cast("double")
    rows = read(spark, sf, "events").select(F.col("value").alias("policy_chosen"), part("user_id", 7).alias("ref_chosen"), part("event_id", 11).alias("policy_rejected"), part("user_id", 5).alias("ref_rejected"))
    return rounded(answers.reward_margins(rows))


@query("""with d as (select value - user_id % 7 as d from events)
select round(avg(d), 5)::double as kl, round(-avg(d), 5)::double as reverse_kl, round(0.25 * var_samp(d), 5)::double as js, round(stddev_samp(d), 5)::double as std, round(max(d), 5)::double as max, round(min(d), 5)::double as min from d""")
def policy_divergence(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "events").select(F.col("value").alias("policy"), (F.col("user_id") % 7).cast("double").alias("ref"))
    return rounded(answers.divergence(rows), 5)


@query("""select event_id, event_type, round((value - avg(value) over w) / sqrt(var_samp(value) over w + 1e-8), 5)::double as whitened from events window w as (partition by event_type)""")
def whitened_rewards(spark: SparkSession, sf: str) -> DataFrame:
    rows = answers.whiten(read(spark, sf, "events").select("event_id", "event_type", "value"), "value", "event_type")
    return rounded(rows.select("event_id", "event_type", "whitened"), 5)


@query("""with s as (select user_id, row_number() over w as i, sqrt(abs(value)) + coalesce(lead(event_id % 5) over w, 0) - event_id % 5 as delta from events window w as (partition by user_id order by event_id))
select a.user_id, a.i as step, round(sum(0.95 ** (b.i - a.i) * b.delta), 5)::double as advantage from s a join s b on a.user_id = b.user_id and b.i >= a.i group by all""")
def advantages(spark: SparkSession, sf: str) -> DataFrame:
    steps = read(spark, sf, "events").select("user_id", "event_id", F.sqrt(F.abs("value")).alias("reward"), (F.col("event_id") % 5).cast("double").alias("value"))
    return rounded(answers.gae_scan(steps, "user_id", "event_id").select("user_id", "step", "advantage"), 5)


@query("""with f as (select conv_id, turn, text, role, max(case when role = 'system' then text end) over (partition by conv_id) as extra from conversations)
select conv_id, turn, '### Instruction:' || chr(10) || text || chr(10) || chr(10) || case when coalesce(extra, '') <> '' then '### Input:' || chr(10) || extra || chr(10) || chr(10) else '' end || '### Response:' || chr(10) as prompt from f where role = 'user'""")
def instruct_prompts(spark: SparkSession, sf: str) -> DataFrame:
    extra = F.max(F.when(F.col("role") == "system", F.col("text"))).over(Window.partitionBy("conv_id"))
    rows = read(spark, sf, "conversations").withColumn("extra", extra).where("role = 'user'")
    return rows.select("conv_id", "turn", chat.instruct_prompt(F.col("text"), F.col("extra")).alias("prompt"))


@query("""select item_id, 'Q: What is 2 + 3?' || chr(10) || 'A: 2 + 3 = 5. The answer is 5.' || chr(10) || chr(10) || 'Q: ' || text || chr(10) || 'A: Let''s think step by step.' as prompt from benchmark""")
def cot_prompts(spark: SparkSession, sf: str) -> DataFrame:
    example = [("What is 2 + 3?", "2 + 3 = 5. The answer is 5.")]
    return read(spark, sf, "benchmark").select("item_id", chat.cot_prompt(F.col("text"), example).alias("prompt"))


@query("""with b as (select item_id, list_transform(string_split(text, ''), lambda c: ord(c) % 256) as ids from benchmark),
m as (select item_id, ids, max(len(ids)) over (partition by item_id % 8) - len(ids) as fill from b)
select item_id, array_to_string(list_concat(ids, list_transform(range(0, fill), lambda i: 0)), ' ') as input_ids, (len(ids) + fill)::bigint as width, len(ids)::bigint as n_real from m""")
def collated_batches(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "benchmark").select("item_id", (F.col("item_id") % 8).alias("batch"), chat.char_ids(F.col("text")).alias("input_ids"))
    out = chat.collate(rows)
    real = F.aggregate("attention_mask", F.lit(0), lambda s, x: s + x).cast("long")
    return out.select("item_id", F.array_join(F.transform("input_ids", lambda x: x.cast("string")), " ").alias("input_ids"), F.size("input_ids").cast("long").alias("width"), real.alias("n_real"))


@query("select i / 20 as s, round(1 - (1 - (i / 20) ** 8) ** 16, 9)::double as probability from range(0, 21) as r(i)")
def band_curve(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(spark.range(21).select((F.col("id") / 20).alias("s")).select("s", dedup.candidate_probability(F.col("s")).alias("probability")), 9)


@query(r"""select role, case
when regexp_matches(text, '(?i)how to (?:make|create|build) (?:a )?(?:bomb|weapon|explosive)|instructions for (?:harm|attack|destroy)') then 'harmful_content'
when regexp_matches(text, '(?i)(?:social security|credit card|bank account) number|(?:home address|phone number) of') then 'personal_info'
when regexp_matches(text, '(?i)how to (?:scam|deceive|trick|manipulate)|create (?:fake|forged|fraudulent)') then 'deception'
when regexp_matches(text, '(?i)how to (?:hack|break into|steal)|(?:drug|illegal substance) (?:recipe|synthesis)') then 'illegal_activity'
else 'safe' end as category, count(*) as n from conversations group by all""")
def safety_categories(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "conversations").groupBy("role", answers.safety(F.col("text")).alias("category")).agg(F.count("*").alias("n"))


@query("""select epoch(time_bucket(interval '10 minutes', ts))::bigint as start, event_type, count(*) as n, round(avg(value), 5)::double as mean_value from events group by all""")
def event_windows(spark: SparkSession, sf: str) -> DataFrame:
    out = streams.tumbling(read(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return rounded(out.select(F.unix_timestamp("start").alias("start"), "event_type", "n", "mean_value"), 5)


@query("""with o as (select user_id, ts, (ts - lag(ts) over (partition by user_id order by ts) > interval '30 minutes')::int as opens from events),
g as (select user_id, ts, sum(coalesce(opens, 1)) over (partition by user_id order by ts rows unbounded preceding) as k from o)
select user_id, floor(epoch(min(ts)))::bigint as start, count(*) as n from g group by user_id, k""")
def event_sessions(spark: SparkSession, sf: str) -> DataFrame:
    out = streams.sessions(read(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return out.select("user_id", F.unix_timestamp("start").alias("start"), "n")


@query(f"with {GRAPH_CTE}, e as (select a, b, sum(weight) as weight from m group by all) select count(*) as n_edges, round(sum(weight), 4)::double as total_weight, (select count(distinct x) from (select a as x from e union all select b from e)) as n_nodes from e")
def graph_totals(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(graph.graph_stats(graph.edges(graph.relations(graph.entities(read(spark, sf, "documents"), NAMES)))), 4)


@query(f"with {GRAPH_CTE}, e as (select a, b, sum(weight) as weight from m group by all) select a as name, b as neighbour, round(weight, 4)::double as weight from e where a = 'tion' union all select b, a, round(weight, 4)::double from e where b = 'tion'")
def graph_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(graph.neighbours(graph.edges(graph.relations(graph.entities(read(spark, sf, "documents"), NAMES))), ["tion"]), 4)


@query("""with s as (select item_id, list_transform(string_split(text, ''), lambda c: ord(c) % 256) as raw from benchmark),
c as (select item_id, 2 + len(raw[1:16]) as n_query, list_concat([1], raw[1:16], [2], raw[17:17 + 44], [2]) as ids from s)
select item_id, array_to_string(list_concat(ids, list_transform(range(0, 64 - len(ids)), lambda i: 0)), ' ') as ids, (len(ids) - n_query)::bigint as n_document, len(ids)::bigint as n_real from c""")
def rerank_inputs(spark: SparkSession, sf: str) -> DataFrame:
    ids = chat.char_ids(F.col("text"))
    rows = read(spark, sf, "benchmark").select("item_id", retrieval.rerank_input(F.slice(ids, 1, 16), F.slice(ids, F.lit(17), F.greatest(F.size(ids) - 16, F.lit(0)))).alias("r"))
    total = lambda c: F.aggregate(c, F.lit(0), lambda s, x: s + x).cast("long")
    return rows.select("item_id", F.array_join(F.transform("r.ids", lambda x: x.cast("string")), " ").alias("ids"), total(F.col("r.segments")).alias("n_document"), total(F.col("r.mask")).alias("n_real"))


@query(r"""with l as (select doc_id, text, string_split(text, chr(10)) as raw from documents),
t as (select doc_id, text, len(raw) as n, list_transform(raw, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')) as lines from l),
s as (select *, list_filter(lines, lambda x: x <> '') as solid from t)
select doc_id, round(length(regexp_replace(text, '[^\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g')) / length(text), 6)::double as control_rate,
case when len(solid) = 0 then 0.0 else round(len(list_filter(solid, lambda x: regexp_matches(x, '^(#|//|/\*|\*)'))) / len(solid), 6)::double end as comment_ratio,
len(list_filter(lines, lambda x: regexp_matches(x, '^(def |class |import |from |return )'))) / n > 0.2 as code from s""")
def source_checks(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return rounded(read(spark, sf, "documents").select("doc_id", quality.control_rate(t).alias("control_rate"), quality.comment_ratio(t).alias("comment_ratio"), quality.looks_like_code(t).alias("code")))
