"""Queries on repeated substrings, graph indexes, communities, subword models, joins in time and answer formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import answers, expressions, graph, html, monitor, pii_rules, quality, retrieval, stats, suffixes, temporal, tokenize, unigram, vector_graph
from quern.operators.stats import rounded
from quern.plans.corpus_queries import NAMES, _draw_sql
from quern.plans.more_queries import RISK
from quern.plans.text_queries import LM_CTE, RAW_WORDS, WORDS, _pii_sql, grams
from quern.sources.tables import read
from quern.streaming import first_wins

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


WINDOWS = "w as materialized (select doc_id, pos, substr(text, pos + 1, 50) as s from (select doc_id, text, unnest(range(0, length(text) - 49)) as pos from documents))"
ISLANDS = "g as (select doc_id, pos, sum(new) over (partition by doc_id order by pos) as island from (select doc_id, pos, (coalesce(lag(pos) over (partition by doc_id order by pos) + 50 < pos, true))::int as new from m)), i as (select doc_id, min(pos) as start, max(pos) + 50 as \"end\" from g group by doc_id, island)"


@query(f"""with {WINDOWS}, r as (select s from w group by s having count(*) > 1), m as (select doc_id, pos from w semi join r on w.s = r.s), {ISLANDS}
select doc_id, start::bigint as start, "end"::bigint as "end" from i""")
def repeated_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Parts of the documents in a passage of 50 characters or more that occurs more than once, by suffix array."""
    return suffixes.repeated_spans(read(spark, sf, "documents")).withColumnRenamed("key", "doc_id")


@query(f"""with {WINDOWS}, r as (select s, min(row(doc_id, pos)) as first from w group by s having count(*) > 1), m as (select doc_id, pos from w join r on w.s = r.s where row(doc_id, pos) <> first), {ISLANDS},
p as (select doc_id, start, "end", coalesce(lag("end") over (partition by doc_id order by start), 0) as before from i),
k as (select p.doc_id, string_agg(substr(text, (before + 1)::int, (start - before)::int), '' order by start) as head, max("end") as last, sum("end" - start) as n_cut from p join documents d on p.doc_id = d.doc_id group by p.doc_id)
select k.doc_id, head || substr(d.text, (last + 1)::int) as text, n_cut::bigint as n_cut from k join documents d on k.doc_id = d.doc_id""")
def repeats_cut(spark: SparkSession, sf: str) -> DataFrame:
    """Documents without the passages of 50 characters or more that stand in an earlier place."""
    return suffixes.cut_repeats(read(spark, sf, "documents")).withColumnRenamed("key", "doc_id")


def _draw(column: str) -> str:
    return _draw_sql("5", column)


@query(f"""with recursive n as materialized (select vec_id, embedding::double[] as v, {_draw('vec_id')} as u from embeddings),
l as (select unnest(range(0, 12)) as layer), sized as (select layer, count(*) as size from l join n on u < 8.0 ** -layer group by layer),
t as (select min(layer) as top from (select layer from sized where size <= 32 union all select max(layer) from sized)),
m as materialized (select layer, vec_id, v from l join n on u < 8.0 ** -layer join t on layer <= top),
s as materialized (select a.layer, a.vec_id as a, b.vec_id as b, round(list_cosine_similarity(a.v, b.v), 12) as s from m a join m b on a.layer = b.layer and a.vec_id <> b.vec_id),
o as (select layer, a, b, s from (select *, row_number() over (partition by layer, a order by s desc, b) as r from s) where r <= 8),
e as (select layer, a, b from (select *, row_number() over (partition by layer, a order by s desc, b) as r from (select * from o union select layer, b, a, s from o)) where r <= 16),
d as (select m.layer, m.vec_id, count(e.b) as degree from m left join e on e.layer = m.layer and e.a = m.vec_id group by all)
select layer::int as layer, count(*) as n_nodes, sum(degree)::bigint as n_edges, min(degree)::int as min_degree, max(degree)::int as max_degree from d group by layer""")
def vector_graph_layers(spark: SparkSession, sf: str) -> DataFrame:
    """Layers of the graph index: vectors, links and degrees."""
    index = vector_graph.build(read(spark, sf, "embeddings"), degree=8)
    return vector_graph.layer_stats(index).select("layer", "n_nodes", "n_edges", "min_degree", "max_degree")


@query()
def vector_graph_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Recall of the graph index among the ten nearest, and the share of all vectors that each query was compared with."""
    vectors = read(spark, sf, "embeddings")
    asked = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    hits, scored = vector_graph.search(vector_graph.build(vectors, degree=8), asked, 10, ef=12, width=3)
    found = retrieval.recall(hits, retrieval.vector_top_k(vectors, asked), 10).join(scored, "query_id")
    return found.crossJoin(F.broadcast(vectors.agg(F.count("*").alias("n")))).select("query_id", "recall", (F.col("scored") / F.col("n")).alias("share"))


@query()
def graph_modularity(spark: SparkSession, sf: str) -> DataFrame:
    """Communities of the names that meet in documents, by local moving on modularity."""
    links = graph.edges(graph.relations(graph.entities(read(spark, sf, "documents"), NAMES)))
    return graph.louvain(links)[0]


@query()
def unigram_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    """A unigram vocabulary of 500 tokens learned from all words of the documents, with log-probabilities."""
    counts = tokenize.word_frequencies(read(spark, sf, "documents"))
    log_p, _ = unigram.train(counts, 500, start=1000)
    return rounded(spark.createDataFrame(sorted(log_p.items()), "token string, log_p double"))


@query("""with v as (select user_id, ts, event_id, value from events where event_type = 'view'), p as (select event_id, user_id, ts, value from events where event_type = 'purchase')
select p.event_id, p.user_id, v.event_id as asof_event_id, round(v.value, 6)::double as asof_value from p asof left join v on p.user_id = v.user_id and p.ts >= v.ts""")
def last_view_before(spark: SparkSession, sf: str) -> DataFrame:
    """For each purchase, the last view of the same user at or before it."""
    rows = read(spark, sf, "events").select("event_id", "user_id", "ts", "event_type", "value")
    views, bought = (rows.where(F.col("event_type") == kind).drop("event_type") for kind in ("view", "purchase"))
    found = temporal.asof_join(bought, views, "user_id", values=["event_id", "value"], order="event_id")
    return rounded(found.select("event_id", "user_id", "asof_event_id", "asof_value"))


@query("""select a.event_id, b.event_id as right_event_id from events a join events b on a.user_id = b.user_id and b.ts between a.ts - interval 1 hour and a.ts + interval 2 hours
where a.event_type = 'error' and b.event_type = 'click'""")
def clicks_near_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Clicks of a user from one hour before to two hours after each error."""
    rows = read(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    errors, clicks = (rows.where(F.col("event_type") == kind).drop("event_type") for kind in ("error", "click"))
    return temporal.interval_join(errors, clicks, "user_id", 3600, 7200).select("event_id", "right_event_id")


# Every assistant turn closes in one of eight formats, by its conversation and turn; the number it gives is conv_id * 1000 + turn.
ENDINGS = (
    r"so \boxed{{n}} is it",
    r"#### {n},500.25",
    "答案是 {n}。 done",
    "The final answer is: {n}.\nbye",
    "选 (b) 是对的",
    "Therefore, {n} apples.\n",
    "所以，{n}\nend",
    r"\boxed{\frac{1}{{n}}} and \boxed{{n}}",
)


def _endings_sql() -> str:
    quoted = [e.replace("'", "''").replace("\n", "' || chr(10) || '") for e in ENDINGS]
    parts = ["'" + q.replace("{n}", "' || n || '") + "'" for q in quoted]
    return "case (conv_id + turn) % 8 " + " ".join(f"when {i} then {p}" for i, p in enumerate(parts)) + " end"


def _formats_sql() -> str:
    last = lambda p, o="": f"list_extract(regexp_extract_all(t, '{p}', 1{o}), -1)"
    trim = lambda x: rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
    some = lambda x: f"nullif({x}, '')"
    box = some(trim(last(r"\\boxed\{([^{}]*(?:\{[^{}]*\}[^{}]*)*)\}")))
    hashes = some(f"replace({last('####\\s*(-?\\d+[\\d,]*\\.?\\d*)')}, ',', '')")
    zh = "coalesce(" + ", ".join(some(trim(last(p))) for p in (r"答案[是为：:]\s*(.+?)(?:[\n。]|$)", r"所以[，,]?\s*(.+?)(?:[\n。]|$)", r"因此[，,]?\s*(.+?)(?:[\n。]|$)")) + ")"
    en = "coalesce(" + ", ".join(some(trim(last(p))) for p in (r"[Tt]he (?:final )?answer is[:\s]*(.+?)[\n.]", r"[Tt]herefore[,\s]+(?:the answer is[:\s]*)?(.+?)[\n.]")) + ")"
    number = some(last(r"(-?\d+\.?\d*)"))
    line = trim(f"list_extract(string_split({trim('t')}, chr(10)), -1)")
    return f"""with t as (select conv_id, turn, text || chr(10) || {_endings_sql()} as t from (select *, (conv_id * 1000 + turn)::varchar as n from conversations where role = 'assistant'))
select conv_id, turn, {box} as boxed, {hashes} as hashes, {zh} as chinese, {en} as english, {number} as last_number,
coalesce({hashes}, {zh}, {en}, {box}, {number}, {line}) as gsm8k, coalesce({box}, {zh}, {en}, {number}, {line}) as math from t"""


@query(_formats_sql())
def answer_formats(spark: SparkSession, sf: str) -> DataFrame:
    """What each extractor and two of the cascades find in assistant turns that close with an answer in one of eight formats."""
    n = (F.col("conv_id") * 1000 + F.col("turn")).cast("string")
    pick = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(8))
    ending = F.coalesce(*[F.when(pick == i, F.replace(F.lit(e), F.lit("{n}"), n)) for i, e in enumerate(ENDINGS)])
    t = F.concat("text", F.lit("\n"), ending)
    rows = read(spark, sf, "conversations").where("role = 'assistant'").select("conv_id", "turn", t.alias("t"))
    t = F.col("t")
    found = {"boxed": answers.boxed(t), "hashes": answers.after_hashes(t), "chinese": answers.chinese(t), "english": answers.english(t), "last_number": answers.last_number(t)}
    return rows.select("conv_id", "turn", *[c.alias(k) for k, c in found.items()], answers.extract(t, "gsm8k").alias("gsm8k"), answers.extract(t, "math").alias("math"))


@query()
def first_wins_survivors(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that stay when each is dropped that shares a band with an earlier one that stays."""
    return first_wins.first_wins(read(spark, sf, "documents").select("doc_id", "text"))[0].select("doc_id")


@query("""with r as (select vec_id, unnest(range(64)) as feature, unnest(embedding)::double as value from embeddings),
s as (select feature, count(*) filter (value > 0) / count(*) as f, avg(value) filter (value > 0) as m, max(value) as x, list(vec_id order by value desc, vec_id)[1:5] as top from r group by feature)
select feature::int as feature, round(f, 6)::double as frequency, round(m, 6)::double as mean, round(x, 6)::double as "max", f < 1e-6 as is_dead, f > 0.5 as is_high, array_to_string(top, ',') as top from s""")
def feature_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Activation of each dimension of the embeddings, and the five vectors in which it is largest."""
    rows = read(spark, sf, "embeddings").select(F.col("vec_id").alias("sample"), F.posexplode(F.col("embedding").cast("array<double>")).alias("feature", "value"))
    found = monitor.feature_samples(rows, 5)
    return rounded(found.select("feature", "frequency", "mean", "max", "is_dead", "is_high", F.array_join(F.col("top").cast("array<string>"), ",").alias("top")))


@query("""with e as (select vec_id, list_transform(embedding, lambda x: exp(x::double)) as p from embeddings), n as (select vec_id, list_transform(p, lambda x: x / list_sum(p)) as p from e),
f as (select vec_id, unnest(range(64)) as i, unnest(p) as x from n)
select a.i::int as a, b.i::int as b, round(corr(a.x, b.x), 6)::double as correlation from f a join f b on a.vec_id = b.vec_id and a.i < b.i group by all""")
def expert_correlation(spark: SparkSession, sf: str) -> DataFrame:
    """The embeddings as routing scores of 64 experts: how far each two go together."""
    return rounded(monitor.expert_correlation(read(spark, sf, "embeddings").withColumnRenamed("embedding", "logits")))


@query("""with d as (select doc_id, '4' || lpad(doc_id::varchar, 14, '0') as a, '110101' || (1950 + doc_id % 60)::varchar || '0' || (1 + doc_id % 9)::varchar || '15' || lpad((doc_id % 1000)::varchar, 3, '0') as b from documents),
s as (select *, list_sum(list_transform(range(1, 16), lambda i: case when i % 2 = 0 then a[i]::int else (a[i]::int * 2) % 10 + (a[i]::int * 2) // 10 end)) as la,
list_sum(list_transform(range(1, 18), lambda i: b[i]::int * ((1 << (18 - i)) % 11))) as lb from d),
t as (select doc_id, a || ((10 - la % 10 + (doc_id % 2)) % 10)::varchar as card, b || case (12 - lb % 11 + (doc_id % 3 = 0)::int) % 11 when 10 then 'X' else ((12 - lb % 11 + (doc_id % 3 = 0)::int) % 11)::varchar end as id from s)
select doc_id, 'bank_card' as kind, card as value, doc_id % 2 = 0 as valid from t union all select doc_id, 'id_card_cn', id, doc_id % 3 <> 0 from t
union all select doc_id, 'bank_card', id, list_sum(list_transform(range(1, 19), lambda i: case when i % 2 = 0 then id[i]::int else (id[i]::int * 2) % 10 + (id[i]::int * 2) // 10 end)) % 10 = 0 from t where not ends_with(id, 'X')""")
def checked_identifiers(spark: SparkSession, sf: str) -> DataFrame:
    """Card and identity numbers made from the ids, every second and third with a wrong check digit, found in a text and checked."""
    n = F.col("doc_id")
    card = F.concat(F.lit("4"), F.lpad(n.cast("string"), 14, "0"))
    number = F.concat(F.lit("110101"), (1950 + n % 60).cast("string"), F.lit("0"), (1 + n % 9).cast("string"), F.lit("15"), F.lpad((n % 1000).cast("string"), 3, "0"))
    digits = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    total = lambda c, f: F.aggregate(F.transform(digits(c), f), F.lit(0), lambda s, x: s + x)
    luhn = total(card, lambda c, i: F.when(i % 2 == 1, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") * 2 / 10).cast("int")))
    eleven = total(number, lambda c, i: c.cast("int") * (F.pow(F.lit(2.0), 17 - i).cast("int") % 11))
    last = (F.lit(12) - eleven % 11 + (n % 3 == 0).cast("int")) % 11
    text = F.concat(F.lit("card "), card, ((10 - luhn % 10 + n % 2) % 10).cast("string"), F.lit(" and id "), number, F.when(last == 10, "X").otherwise(last.cast("string")), F.lit("."))
    return pii_rules.identifiers(read(spark, sf, "documents").select("doc_id", text.alias("text")))


@query("select conv_id, turn, turn % 2 = 0 as same from conversations")
def equal_expressions(spark: SparkSession, sf: str) -> DataFrame:
    """Whether (x + n)^2, n from conversation and turn, is what another form says, wrong by one in odd turns."""
    n, rest = F.col("conv_id") + F.col("turn"), F.col("turn") % 2
    left = F.concat(F.lit("(x + "), n.cast("string"), F.lit(")^2"))
    right = F.concat(F.lit("x(x + "), (2 * n).cast("string"), F.lit(") + \\frac{"), (2 * n * n + 2 * rest).cast("string"), F.lit("}{2}"))
    return read(spark, sf, "conversations").select("conv_id", "turn", expressions.same_value(left, right).alias("same"))


@query(_pii_sql(pii_rules.SHORT))
def pii_short(spark: SparkSession, sf: str) -> DataFrame:
    """Personal data by the four patterns of the short list."""
    docs = pii_rules.rewrite(read(spark, sf, "documents"), kinds=pii_rules.SHORT)
    return docs.select("doc_id", *[f"n_{k}" for k in pii_rules.SHORT], "text")


@query(rf"""with d as (select doc_id, {RAW_WORDS} as w from documents), b as (select item_id, {RAW_WORDS} as w from benchmark),
dg as (select distinct doc_id, gram from (select doc_id, unnest({grams(10)}) as gram from d)), bg as (select item_id, unnest({grams(10)}) as gram from b),
n as (select item_id, count(*) as n from bg group by item_id)
select doc_id, bg.item_id, round(count(*) / any_value(n), 6)::double as overlap from bg join dg using (gram) join n on bg.item_id = n.item_id group by doc_id, bg.item_id""")
def contamination_cased(spark: SparkSession, sf: str) -> DataFrame:
    """Overlap of benchmark items with documents, letter case kept, whatever its size."""
    return rounded(stats.overlap(read(spark, sf, "documents"), read(spark, sf, "benchmark"), threshold=0.0, lower=False))


@query(r"select doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') as text from documents")
def normal_short(spark: SparkSession, sf: str) -> DataFrame:
    """The short normal form; the driver's documents are in NFKC already, unit tests hold the rest."""
    return read(spark, sf, "documents").select("doc_id", html.normalize_short(F.col("text")).alias("text"))


@query("""with v as (select list(c order by c) as v from (select distinct unnest(string_split(text, '')) as c from conversations where text <> '') where c <> ''),
t as (select conv_id * 100 + turn as turn_id, [2] || list_transform(list_filter(string_split(text, ''), lambda c: c <> '')[1:63], lambda c: list_position(v, c) + 3) as t from conversations, v)
select turn_id, array_to_string(t || list_transform(range(64 - len(t)), lambda i: 0), ' ') as ids, len(t)::int as n from t""")
def char_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as character ids with a mark in front, cut and padded to 64; n counts the mask."""
    turns = read(spark, sf, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("turn_id"), "text")
    rows = tokenize.char_batch(turns, tokenize.char_vocabulary(turns), 64, key="turn_id")
    return rows.select("turn_id", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"), F.aggregate("mask", F.lit(0), lambda s, x: s + x).alias("n"))


@query(rf"""with {LM_CTE}, d as (select doc_id, lower(text) as t from documents),
dg as (select doc_id, unnest(list_transform(range(1, length(t) - 1), lambda i: t[i:i + 2])) as gram from d where length(t) >= 3),
s as (select doc_id, ln((coalesce(n_gram, 0) + 1) / (coalesce(n_context, 0) + v)) as lp from dg left join c3 using (gram) left join c2 on dg.gram[1:2] = c2.context cross join voc),
p as (select doc_id, exp(-avg(lp)) as ppl from s group by doc_id), w as (select doc_id, text, {WORDS} as w from documents),
r as (select doc_id, sum(case when n > 1 then n else 0 end) / sum(n) as r from (select doc_id, gram, count(*) as n from (select doc_id, unnest({grams(10)}) as gram from w) group by all) group by doc_id),
x as (select w.doc_id, case when ppl between 10 and 1000 then greatest(0, 1 - abs(ln(ppl) - (ln(10) + ln(1000)) / 2) / ((ln(1000) - ln(10)) / 2)) else 0 end as f, 1 - coalesce(r, 0) as u,
case when regexp_matches(text, '{RISK}') then 0 else 1 end as h, case when len(w) > 0 then len(list_distinct(w)) / len(w) else 0 end as e from w left join p on p.doc_id = w.doc_id left join r on r.doc_id = w.doc_id)
select doc_id, round(f, 4)::double as fluency, round(u, 4)::double as uniqueness, round(e, 4)::double as density, round((0.3 * f + 0.3 * u + 0.2 * h + 0.2 * e), 4)::double as score from x""")
def document_report(spark: SparkSession, sf: str) -> DataFrame:
    """Fluency, uniqueness, density and weighted score of every document; the character model is fitted on the benchmark."""
    found = quality.document_report(read(spark, sf, "documents"), read(spark, sf, "benchmark"))
    return rounded(found.select("doc_id", "fluency", "uniqueness", "density", "score"), 4)
