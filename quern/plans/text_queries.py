"""Queries on quality, cleaning, personal data, duplicates and statistics, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import charlm, dedup, html, pii_rules, quality, stats
from quern.sources.tables import read

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register the function under its name, with the SQL that gives the same rows."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


WORDS = r"list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '')"
RAW_WORDS = r"list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')"
LINES = r"list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"
GRAMS = "case when len(w) >= {n} then list_transform(range(1, len(w) - {m} + 1), lambda i: array_to_string(w[i:i + {m}], ' ')) else [] end"


def grams(n: int) -> str:
    return GRAMS.format(n=n, m=n - 1)


METRICS_CTE = rf"""
base as (select doc_id, lang, source, text, {WORDS} as w, {LINES} as l,
  list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g') <> '') as raw_l from documents),
g as (select doc_id, unnest({grams(5)}) as gram from base),
gc as (select doc_id, gram, count(*) as n from g group by all),
gd as (select doc_id, sum(case when n > 1 then n else 0 end) / sum(n) as dup from gc group by doc_id),
metrics as (select base.doc_id, lang, source, text, w, l, length(text) as length,
  case when length(text) = 0 then 0.0 else length(regexp_replace(text, '[\p{{L}}\p{{N}}\s]', '', 'g')) / length(text) end as special_char_ratio,
  case when length(text) = 0 then 0.0 else length(regexp_replace(text, '[^\p{{Nd}}]', '', 'g')) / length(text) end as digit_ratio,
  case when len(raw_l) = 0 then 0.0 else list_sum(list_transform(raw_l, lambda x: length(x))) / len(raw_l) end as avg_line_length,
  case when len(l) = 0 then 0.0 else (len(l) - len(list_distinct(l))) / len(l) end as duplicate_line_ratio,
  coalesce(dup, 0.0) as duplicate_ngram_ratio,
  case when len(w) = 0 then 0.0 else len(list_filter(w, lambda x: list_contains({sql_list(quality.STOP_WORDS)}, x))) / len(w) end as stopword_ratio
  from base left join gd using (doc_id)),
ruled as (select *, case when length < 100 then 'too_short' when length > 100000 then 'too_long' when special_char_ratio > 0.3 then 'special_chars'
  when digit_ratio > 0.5 then 'digits' when avg_line_length < 10 then 'short_lines' when avg_line_length > 500 then 'long_lines'
  when duplicate_line_ratio > 0.5 then 'repeated_lines' when duplicate_ngram_ratio > 0.3 then 'repeated_ngrams' else 'pass' end as reason,
  greatest(0.0, least(1.0, 1 - 0.5 * special_char_ratio - 0.5 * greatest(0.0, digit_ratio - 0.1) - 0.3 * duplicate_line_ratio - 0.3 * duplicate_ngram_ratio
    + case when stopword_ratio > 0.05 then 0.1 else 0.0 end)) as rs from metrics)
"""
ROUNDED = ", ".join(f"round({m}, 6)::double as {m}" for m in quality.METRICS[1:])


@query(f"with {METRICS_CTE} select doc_id, length, {ROUNDED} from metrics")
def rule_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return stats.rounded(quality.rule_metrics(read(spark, sf, "documents")).select("doc_id", *quality.METRICS))


@query(f"with {METRICS_CTE} select doc_id, reason, reason = 'pass' as passed, round(case when reason = 'pass' then rs else 0.0 end, 6)::double as score from ruled")
def rule_filter(spark: SparkSession, sf: str) -> DataFrame:
    return stats.rounded(quality.rule_filter(read(spark, sf, "documents")).select("doc_id", "reason", "passed", "score"))


QUALITY_SQL = f"""with {METRICS_CTE},
q as (select *, 0.5 + case when length between 200 and 50000 then 0.15 when length between 100 and 100000 then 0.05 else 0 end
  + case when len(w) = 0 then 0 when len(list_distinct(w)) / len(w) between 0.3 and 0.8 then 0.15 when len(list_distinct(w)) / len(w) between 0.2 and 0.9 then 0.05 else 0 end
  + case when len(list_filter(string_split(text, chr(10) || chr(10)), lambda p: regexp_replace(p, '\\s', '', 'g') <> '')) >= 2 then 0.1 else 0 end as qs from ruled where reason = 'pass')
select doc_id, round(least(1.0, greatest(0.0, 0.5 * qs + 0.5 * rs)), 6)::double as quality from q"""


@query(QUALITY_SQL)
def quality_score(spark: SparkSession, sf: str) -> DataFrame:
    kept = quality.rule_filter(read(spark, sf, "documents")).where("passed")
    return stats.rounded(kept.select("doc_id", quality.quality_score(F.col("text"), F.col("score")).alias("quality")))


@query(f"with {METRICS_CTE} select lang, count(*) as n_docs, sum(case when reason = 'pass' then 1 else 0 end)::bigint as n_passed, round(avg(stopword_ratio), 6)::double as mean_stop from ruled group by lang")
def quality_by_lang(spark: SparkSession, sf: str) -> DataFrame:
    out = quality.rule_filter(read(spark, sf, "documents")).groupBy("lang")
    return stats.rounded(out.agg(F.count("*").alias("n_docs"), F.sum(F.col("passed").cast("long")).alias("n_passed"), F.avg("stopword_ratio").alias("mean_stop")))


@query(f"with {METRICS_CTE} select doc_id, length between 100 and 100000 and special_char_ratio <= 0.3 and len(list_distinct(string_split(text, chr(10)))) / len(string_split(text, chr(10))) >= 0.5 as kept from metrics")
def short_rule(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select("doc_id", quality.short_rule(F.col("text")).alias("kept"))


BAD_WORDS = ["idiot", "moron", "scum"]


@query(rf"""with b as (select doc_id, list_filter({LINES}, lambda x: len(list_filter(regexp_split_to_array(x, '\s+'), lambda w: w <> '')) >= 3 and right(x, 1) in ('.', '!', '?') and not contains(lower(x), 'javascript')) as k from documents)
select doc_id, len(k) >= 5 and not regexp_matches(lower(array_to_string(k, ' ')), 'idiot|moron|scum') as kept from b""")
def c4_filter(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select("doc_id", quality.c4_filter(F.col("text"), BAD_WORDS).alias("kept"))


@query(rf"""with t as (select conv_id, turn, text, {RAW_WORDS} as w from conversations where role = 'assistant'),
m as (select *, {grams(10)} as g from t),
r as (select conv_id, turn, length(text) as response_length, round(case when len(g) = 0 then 0.0 else (len(g) - len(list_distinct(g))) / len(g) end, 4)::double as repeat_rate,
 regexp_matches(text, '(?i)作为(一个)?AI(语言)?模型|As an AI( language model)?|I(''m| am) (just )?an? AI|我(是|只是)(一个)?语言模型|I (don''t|cannot|can''t) (actually )?have|我(没有|无法)(真正|实际)') as meta from m)
select conv_id, turn, response_length, repeat_rate, not (response_length < 50 or response_length > 10000 or repeat_rate > 0.3 or meta) as passed from r""")
def pair_rule_filter(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "conversations").where("role = 'assistant'")
    return quality.pair_filter(rows, "text").select("conv_id", "turn", "response_length", "repeat_rate", "passed")


@query(r"select conv_id, turn, length(text) between 10 and 2000 and not regexp_matches(text, '^\s*(作为一个AI|作为AI|我是一个|我无法|As an AI|I''m an AI|I cannot)') and lower(trim(text)) not in ('你好', '谢谢', '再见', 'hello', 'hi', 'thanks') as ok from conversations where role = 'user'")
def instruction_filter(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", quality.instruction_ok(F.col("text")).alias("ok"))


@query("""select doc_id, (length(text) - length(replace(text, '#', '')))::bigint as num_headers, ((length(text) - length(replace(text, chr(10) || '- ', ''))) // 3 + (length(text) - length(replace(text, chr(10) || '* ', ''))) // 3)::bigint as num_lists,
round(length(text) / greatest(n_chars, 1), 2)::double as length_ratio from documents""")
def rewrite_metrics(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents")
    return quality.rewrite_metrics(docs, "text", "text").select("doc_id", "num_headers", "num_lists", "length_ratio")


LM_CTE = """
ref as (select lower(text) as t from benchmark), rg as (select unnest(list_transform(range(1, length(t) - 1), lambda i: t[i:i + 2])) as gram from ref where length(t) >= 3),
c3 as (select gram, count(*) as n_gram from rg group by gram), c2 as (select gram[1:2] as context, count(*) as n_context from rg group by 1),
voc as (select count(distinct c) as v from (select unnest(string_split(t, '')) as c from ref) where c <> '')"""


@query(f"with {LM_CTE} select gram, n_gram from c3")
def char_lm_fit(spark: SparkSession, sf: str) -> DataFrame:
    return charlm.fit(read(spark, sf, "benchmark"))[0]


@query(f"""with {LM_CTE}, d as (select doc_id, lower(text) as t from documents),
dg as (select doc_id, unnest(list_transform(range(1, length(t) - 1), lambda i: t[i:i + 2])) as gram from d where length(t) >= 3),
s as (select doc_id, ln((coalesce(n_gram, 0) + 1) / (coalesce(n_context, 0) + v)) as lp from dg left join c3 using (gram) left join c2 on dg.gram[1:2] = c2.context cross join voc),
p as (select doc_id, exp(-avg(lp)) as ppl from s group by doc_id)
select documents.doc_id, round(coalesce(ppl, 'infinity'::double), 4) as perplexity, coalesce(ppl between 10 and 1000, false) as passed, case when ppl < 30 then 'high' when ppl < 200 then 'medium' when ppl < 500 then 'low' else 'noise' end as band from documents left join p using (doc_id)""")
def char_ppl(spark: SparkSession, sf: str) -> DataFrame:
    scored = charlm.perplexity(read(spark, sf, "documents"), read(spark, sf, "benchmark"))
    passed, _ = charlm.perplexity_filter(F.col("perplexity"))
    return scored.select("doc_id", F.round("perplexity", 4).alias("perplexity"), passed.alias("passed"), quality.perplexity_band(F.col("perplexity")).alias("band"))


@query("""with d as (select doc_id, lang, lower(text) as t from documents where length(text) >= 3), g as (select doc_id, lang, unnest(list_transform(range(1, length(t) - 1), lambda i: t[i:i + 2])) as gram from d),
tc as (select gram, count(*) as n from g where lang = 'en' group by gram), sc as (select gram, count(*) as n from g where lang <> 'en' group by gram),
v as (select count(distinct c) as v from (select unnest(string_split(lower(text), '')) as c from documents where lang = 'en') where c <> ''),
n as (select (select sum(n) from tc) as nt, (select sum(n) from sc) as ns)
select doc_id, round(avg(ln((coalesce(tc.n, 0) + 1) / (nt + v)) - ln((coalesce(sc.n, 0) + 1) / (ns + v))), 5)::double as log_importance from g left join tc on g.gram = tc.gram left join sc on g.gram = sc.gram cross join n cross join v group by doc_id""")
def importance_weights(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents")
    return stats.rounded(charlm.importance(docs, docs.where("lang = 'en'"), docs.where("lang <> 'en'")), 5)


@query(r"""select page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]+>', '', 'g')) as title from pages""")
def html_title(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "pages").select("page_id", html.title(F.col("html")).alias("title"))


def _html_sql() -> str:
    t = "regexp_replace(html, '(?s)<!--.*?-->', '', 'g')"
    for tag in html.DROPPED:
        t = f"regexp_replace({t}, '(?is)<{tag}[^>]*>.*?</{tag}>', '', 'g')"
    t = rf"regexp_replace(regexp_replace({t}, '(?i)</({html.BLOCKS})>', chr(10), 'g'), '(?i)<br\s*/?\s*>', chr(10), 'g')"
    for name, sign in html.ENTITIES:
        t = "replace({}, '{}', '{}')".format(t, name, sign.replace("'", "''"))
    t = rf"regexp_replace(regexp_replace(regexp_replace({t}, '<[^>]+>', '', 'g'), '[ \t]+', ' ', 'g'), '\n\s*\n', chr(10) || chr(10), 'g')"
    return rf"""with p as (select page_id, html, list_filter(list_transform(string_split({t}, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) >= 20) as p from pages)
select page_id, array_to_string(p, chr(10) || chr(10)) as text, len(p) as num_paragraphs, round(length(array_to_string(p, chr(10) || chr(10))) / length(html), 6)::double as extraction_ratio from p"""


@query(_html_sql())
def html_text(spark: SparkSession, sf: str) -> DataFrame:
    return stats.rounded(html.extract(read(spark, sf, "pages")).select("page_id", "text", "num_paragraphs", "extraction_ratio"))


@query()
def html_process(spark: SparkSession, sf: str) -> DataFrame:
    return html.process(read(spark, sf, "pages")).select("page_id", "title", "text", "num_paragraphs", "extraction_ratio")


@query(r"""select page_id, regexp_replace('see ' || url || ' now', '(?i)https?://[^\s<>"{}|\\^`\[\]]+', '<url>', 'g') as text from pages""")
def url_strip(spark: SparkSession, sf: str) -> DataFrame:
    seen = F.concat(F.lit("see "), "url", F.lit(" now"))
    return read(spark, sf, "pages").select("page_id", html.without_urls(seen, "<url>").alias("text"))


@query(r"""with k as (select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x = '' or (len(list_filter(regexp_split_to_array(x, '\s+'), lambda w: w <> '')) >= 3
 and not regexp_matches(x, '(?i)copyright\s*\d{4}|all rights reserved|terms (of|and) (use|service|conditions)|privacy policy|cookie (policy|settings|preferences)|subscribe to (our )?newsletter|follow us on|share (this|on)|click here to|powered by'))) as k from documents)
select doc_id, regexp_replace(regexp_replace(array_to_string(k, chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') as text from k""")
def clean_lines(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select("doc_id", html.clean_lines(F.col("text")).alias("text"))


@query("select doc_id, text from documents")
def unicode_normal(spark: SparkSession, sf: str) -> DataFrame:
    """The driver's documents are in normal form already, so the SQL is the text itself; unit tests hold the rest."""
    return read(spark, sf, "documents").select("doc_id", html.normalize(F.col("text")).alias("text"))


def _pii_sql(kinds: tuple[str, ...] = tuple(k for k, *_ in pii_rules.PATTERNS)) -> str:
    t, counts = "text", []
    for kind, pattern, placeholder in pii_rules.PATTERNS:
        if kind not in kinds:
            continue
        p = pattern.removeprefix("(?U)").replace(r"\w", r"\pL\pN_").replace(r"[\pL\pN_.+-]", r"[\pL\pN_.+-]")
        counts.append(f"len(regexp_extract_all({t}, '{p}'))::bigint as n_{kind}")
        t = f"regexp_replace({t}, '{p}', '{placeholder}', 'g')"
    return f"select doc_id, {', '.join(counts)}, {t} as text from documents"


@query(_pii_sql())
def pii_redacted(spark: SparkSession, sf: str) -> DataFrame:
    docs = pii_rules.rewrite(read(spark, sf, "documents"))
    return docs.select("doc_id", *[f"n_{k}" for k, *_ in pii_rules.PATTERNS], "text")


@query(r"select doc_id, regexp_matches(text, '(?i)\b(licensed under|released under the|all rights reserved|creative commons|apache license|mit license|gnu general public license)') as licensed from documents")
def license_lines(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select("doc_id", pii_rules.has_license(F.col("text")).alias("licensed"))


@query("select min(doc_id) as doc_id, sha256(text) as hash from documents group by sha256(text)")
def exact_dedup_sha256(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents")
    return dedup.keep_first(docs.select("doc_id", dedup.sha256_key(F.col("text")).alias("hash")), F.col("hash")).select("doc_id", "hash")


@query(r"""select min(doc_id) as doc_id, md5(array_to_string(list_transform(string_split(regexp_replace(text, '^\s+|\s+$', '', 'g'), chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), chr(10))) as hash from documents group by 2""")
def exact_dedup_md5_lines(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents").select("doc_id", dedup.line_key(F.col("text")).alias("hash"))
    return dedup.keep_first(docs, F.col("hash")).select("doc_id", "hash")


@query(r"""with r as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(0, len(string_split(text, chr(10))))) as pos from documents),
k as (select *, case when len(list_filter(regexp_split_to_array(line, '\s+'), lambda w: w <> '')) >= 3 then md5(regexp_replace(lower(line), '^\s+|\s+$', '', 'g')) end as key from r),
f as (select *, row_number() over (partition by key order by doc_id, pos) as n from k)
select d.doc_id, coalesce(t, '') as text from documents d left join (select doc_id, string_agg(line, chr(10) order by pos) as t from f where key is null or n = 1 group by doc_id) using (doc_id)""")
def paragraph_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.unique_paragraphs(read(spark, sf, "documents"))


def _minhash_sql(k: int = 4) -> str:
    params = dedup.hash_parameters(k)
    cols = ", ".join(f"min((({a}::hugeint * x + {b}::hugeint) % {dedup.PRIME}::hugeint) % 4294967296::hugeint)::bigint" for a, b in params)
    return rf"""with b as (select doc_id, text, {WORDS} as w from documents),
s as (select doc_id, unnest(case when len(w) >= 5 then list_distinct({grams(5)}) else [regexp_replace(lower(text), '^\s+|\s+$', '', 'g')] end) as s from b),
h as (select doc_id, ('0x' || md5(s)[1:8])::bigint::hugeint as x from s)
select doc_id, list_value({cols}) as signature from h group by doc_id"""


@query(_minhash_sql())
def minhash_signature_k4(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.minhash(read(spark, sf, "documents"), k=4)


@query(f"""with m as ({_minhash_sql(128)}), b as (select doc_id, i as band, signature[i * 8 + 1:i * 8 + 8] as slice from (select doc_id, signature, unnest(range(16)) as i from m)),
l as (select band, slice, min(doc_id) as a from b group by all having count(*) > 1) select distinct l.a, b.doc_id as b from b join l on b.band = l.band and b.slice = l.slice where b.doc_id > l.a""")
def lsh_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.lsh_candidates(dedup.minhash(read(spark, sf, "documents")))


SHINGLE_PAIRS = rf"""
one as (select min(doc_id) as doc_id, lower(any_value(text)) as text from documents group by sha256(lower(text))),
b as (select doc_id, text, {WORDS} as w from one),
sh as (select doc_id, unnest(case when len(w) >= 5 then list_distinct({grams(5)}) else [regexp_replace(lower(text), '^\s+|\s+$', '', 'g')] end) as s from b),
n as (select doc_id, count(*) as n from sh group by doc_id),
i as (select x.doc_id as a, y.doc_id as b, count(*) as m from sh x join sh y on x.s = y.s and x.doc_id < y.doc_id group by all),
pairs as (select a, b, m / (na.n + nb.n - m) as jaccard from i join n na on a = na.doc_id join n nb on b = nb.doc_id where m / (na.n + nb.n - m) >= 0.8)"""


@query(f"with {SHINGLE_PAIRS} select a, b, round(jaccard, 6)::double as jaccard from pairs")
def near_dup_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return stats.rounded(dedup.similar_pairs(read(spark, sf, "documents")))


@query(f"""with recursive {SHINGLE_PAIRS},
e as (select a, b from pairs union select b, a from pairs),
reach as (select a as v, a as r from e union select reach.v, e.b from reach join e on reach.r = e.a),
lab as (select v, min(r) as label from reach group by v),
reps as (select sha256(lower(text)) as h, min(doc_id) as rep from documents group by 1)
select doc_id, coalesce(label, rep) as cluster from documents join reps on sha256(lower(text)) = h left join lab on rep = v""")
def near_dup_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.near_dup_clusters(read(spark, sf, "documents"))


GREEDY = """o as (select a, b, sa, sb, row_number() over (order by a, b) as i from ordered),
r as (select 0::bigint as i, []::bigint[] as gone union all select o.i, case when list_contains(gone, a) or list_contains(gone, b) then gone else list_append(gone, case when sa < sb then a else b end) end from r join o on o.i = r.i + 1),
final as (select gone from r order by i desc limit 1)"""


@query(f"""with recursive {SHINGLE_PAIRS},
ordered as (select a, b, length(x.text) as sa, length(y.text) as sb from pairs join documents x on x.doc_id = a join documents y on y.doc_id = b), {GREEDY},
k as (select min(doc_id) as doc_id from documents group by sha256(text)) select doc_id from k cross join final where not list_contains(gone, doc_id)""")
def layered_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.layered(read(spark, sf, "documents").select("doc_id", "text")).select("doc_id")


VECTOR_PAIRS = """v as (select vec_id, embedding::double[] as e from embeddings union all
 select vec_id + 1000000, list_transform(embedding::double[], lambda x, i: x * (1 + (0.3 + 0.05 * (vec_id % 7)) * sin(vec_id + i))) from embeddings where vec_id % 10 = 0),
pairs as (select x.vec_id as a, y.vec_id as b, list_cosine_similarity(x.e, y.e) as cosine from v x join v y on x.vec_id < y.vec_id where list_cosine_similarity(x.e, y.e) > 0.85)"""


def _with_near_copies(spark: SparkSession, sf: str) -> DataFrame:
    """The embeddings and a bent copy of every tenth, since the table itself holds no two that are alike."""
    e = read(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    bend = 0.3 + 0.05 * (F.col("vec_id") % 7)
    bent = e.where("vec_id % 10 = 0").withColumn("embedding", F.transform("embedding", lambda x, i: x * (1 + bend * F.sin(F.col("vec_id") + i + 1))))
    return e.unionByName(bent.withColumn("vec_id", F.col("vec_id") + 1_000_000))


@query(f"with {VECTOR_PAIRS} select a, b, round(cosine, 6)::double as cosine from pairs")
def semantic_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return stats.rounded(dedup.semantic_pairs(_with_near_copies(spark, sf)))


@query(f"""with recursive {VECTOR_PAIRS}, e as (select a, b from pairs union select b, a from pairs),
reach as (select a as v, a as r from e union select reach.v, e.b from reach join e on reach.r = e.a) select v as vec_id, min(r) as cluster from reach group by v""")
def semantic_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.semantic_clusters(_with_near_copies(spark, sf))


@query(f"with recursive {VECTOR_PAIRS}, ordered as (select a, b, 0 as sa, 0 as sb from pairs), {GREEDY} select unnest(gone) as vec_id from final")
def semantic_removals(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.semantic_removals(_with_near_copies(spark, sf))


@query(rf"""with b as (select text, len({RAW_WORDS}) as w from documents), v as (select count(distinct x) as n from (select unnest({WORDS}) as x from documents)),
m as (select w from (select w, row_number() over (order by w) as i, count(*) over () as n from b) where i = n // 2 + 1)
select count(*) as num_docs, sum(length(text))::bigint as total_chars, sum(w)::bigint as total_words, round(avg(w), 6)::double as avg_words, min(w) as min_words, max(w) as max_words, (select n from v) as vocabulary_size,
(select w from m) as median_words, round((select n from v) / sum(w), 6)::double as type_token_ratio, floor(sum(w) * 1.3)::bigint as estimated_tokens from b""")
def corpus_stats(spark: SparkSession, sf: str) -> DataFrame:
    return stats.rounded(stats.corpus(read(spark, sf, "documents")))


@query("select source, count(*) as n_docs from documents group by source")
def source_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return stats.source_distribution(read(spark, sf, "documents"))


@query(rf"""with b as (select len({RAW_WORDS}) as w from documents), e as (select min(w) as lo, max(w) as hi, greatest(1, (max(w) - min(w)) // 10) as size from b)
select ((w - lo) // size) * size + lo as bin_start, ((w - lo) // size) * size + lo + size - 1 as bin_end, count(*) as n_docs from b cross join e group by 1, 2""")
def length_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return stats.length_histogram(read(spark, sf, "documents"))


@query(rf"""with b as (select {WORDS} as w from documents), g as (select unnest({grams(5)}) as gram from b), c as (select gram, count(*) as n from g group by gram),
t as (select sum(n) as top from (select n from c order by n desc, gram limit 10))
select sum(n)::bigint as total_ngrams, count(*) as unique_ngrams, round(1 - count(*) / sum(n), 6)::double as repetition_rate, round((select top from t) / sum(n), 6)::double as top_ratio from c""")
def ngram_repetition(spark: SparkSession, sf: str) -> DataFrame:
    return stats.rounded(stats.ngram_repetition(read(spark, sf, "documents")))


@query(rf"""with c as (select w as word, count(*) as n from (select unnest({WORDS}) as w from documents) group by w), t as (select sum(n) as top from (select n from c order by n desc, word limit 100))
select count(*) as vocabulary_size, sum(n)::bigint as total_words, sum(case when n = 1 then 1 else 0 end)::bigint as hapax_count, round(sum(case when n = 1 then 1 else 0 end) / count(*), 6)::double as hapax_ratio, round((select top from t) / sum(n), 6)::double as top_coverage from c""")
def vocab_hapax(spark: SparkSession, sf: str) -> DataFrame:
    return stats.rounded(stats.vocabulary(read(spark, sf, "documents")))


@query(rf"select w as word, count(*) as n from (select unnest({WORDS}) as w from documents) group by w order by n desc, word limit 50")
def top_words(spark: SparkSession, sf: str) -> DataFrame:
    return stats.most_common(stats.word_counts(read(spark, sf, "documents")), "word", 50)


@query(rf"""with d as (select doc_id, {WORDS} as w from documents), b as (select item_id, {WORDS} as w from benchmark),
dg as (select distinct doc_id, gram from (select doc_id, unnest({grams(10)}) as gram from d)), bg as (select item_id, unnest({grams(10)}) as gram from b),
n as (select item_id, count(*) as n from bg group by item_id)
select doc_id, bg.item_id, round(count(*) / any_value(n), 6)::double as overlap from bg join dg using (gram) join n on bg.item_id = n.item_id group by doc_id, bg.item_id having count(*) / any_value(n) >= 0.7""")
def contamination_10gram(spark: SparkSession, sf: str) -> DataFrame:
    return stats.rounded(stats.overlap(read(spark, sf, "documents"), read(spark, sf, "benchmark")))


@query(rf"""with {METRICS_CTE} select round(avg(len(w)), 5)::double as length_mean, round(stddev_samp(len(w)), 5)::double as length_std, round(avg(case when len(w) < 50 then 1.0 else 0.0 end), 5)::double as short_ratio, round(avg(case when len(w) > 5000 then 1.0 else 0.0 end), 5)::double as long_ratio,
round(avg(case when len(w) > 0 then len(list_distinct(w)) / len(w) end), 5)::double as avg_ttr, round(avg(case when len(l) > 0 then duplicate_line_ratio end), 5)::double as avg_line_dup_ratio, round(avg(case when len(l) > 0 then (duplicate_line_ratio > 0.3)::int end), 5)::double as high_dup_docs,
round(avg(special_char_ratio), 5)::double as avg_special_ratio, round(avg((special_char_ratio > 0.3)::int), 5)::double as noisy_docs, round((select count(distinct x) / count(*) from (select unnest(w) as x from metrics)), 5)::double as global_ttr from metrics""")
def quality_profile(spark: SparkSession, sf: str) -> DataFrame:
    return stats.rounded(stats.profile(read(spark, sf, "documents")), 5)


@query()
def compression_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return stats.compression(read(spark, sf, "documents"))


@query(rf"select doc_id, len({WORDS}) as n_words, (len(list_distinct({WORDS})))::bigint as n_distinct from documents")
def word_stats(spark: SparkSession, sf: str) -> DataFrame:
    w = T.words(F.col("text"))
    return read(spark, sf, "documents").select("doc_id", F.size(w).cast("long").alias("n_words"), F.size(F.array_distinct(w)).cast("long").alias("n_distinct"))
