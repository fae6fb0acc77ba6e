"""The registered queries of the thirteen operators: production parameters, whole tables, digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import crc_mod, table


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; learned from rows whose id's crc32 mod 5 is not 0."""
    from quern.llm import language

    docs = table(spark, sf_dir, "documents")
    net = language.train(*language.labelled_sample(docs))
    return language.identify(docs, net).select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


def op2_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a repeated passage first found elsewhere, with what stays of their texts."""
    from quern.llm import spans

    return spans.remove_repeats(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut and packed into sequences of 2048 tokens."""
    from quern.llm import packing

    return packing.pack(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item within its edit budget, with the best place of each item."""
    from quern.llm import decontaminate

    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document; labels are learned from rows whose id's crc32 mod 3 is not 1."""
    from quern.llm import toxicity

    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(*toxicity.labelled_sample(docs, table(spark, sf_dir, "labels")))
    scored = toxicity.score_toxicity(docs, model)
    return scored.select(
        "doc_id",
        (crc_mod("doc_id", 3) == 1).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
        "n_words",
        "spans",
    )


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: counts and digest of the base spans, and all spans."""
    from quern.llm import secrets

    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_guess")


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; links at 3 bits or fewer."""
    from quern.llm import simhash

    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL; the list is the URLs of the pages whose id is divisible by 100."""
    from quern.llm import urls

    pages = table(spark, sf_dir, "pages")
    return urls.judge(pages, pages.where("page_id % 100 = 0").select("url"))


OP8_SQL = r"""
with parts as (
  select page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') as path
  from pages),
keyed as (
  select *, case when host <> '' then regexp_replace(regexp_replace(host, ':(80|443)$', ''), '^www\.', '') || rtrim(path, '/') end as url_key
  from parts),
listed as (select distinct url_key from keyed where page_id % 100 = 0 and url_key is not null),
ruled as (
  select keyed.*, listed.url_key is not null as is_listed,
         case when (host = 'example.org' or ends_with(host, '.example.org')) and starts_with(path, '/en/1') then 'example.org/en/1'
              when (host = 'example.org' or ends_with(host, '.example.org')) and starts_with(path, '/es/') then 'example.org/es/'
              when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/fr/') then 'com/fr/'
              when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/de/') then 'com/de/'
              when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/') then 'org/' end as rule
  from keyed left join listed on keyed.url_key = listed.url_key)
select page_id, host, path, rule,
       case when rule in ('org/', 'com/fr/') then 'allow'
            when rule is not null then 'block'
            when is_listed then 'block' else 'allow' end as verdict,
       is_listed
from ruled
"""


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, with likenesses."""
    from quern.llm import minhash

    return minhash.compare_with_edits(table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: counts and digest of the base spans, and all spans."""
    from quern.llm import pii

    found = pii.find_pii(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_context")


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; labels are learned from rows whose id's crc32 mod 5 is not 0."""
    from quern.llm import textquality

    docs = table(spark, sf_dir, "documents")
    model = textquality.fit(*textquality.labelled_sample(docs, table(spark, sf_dir, "labels")))
    scored = textquality.score_quality(docs, model)
    return scored.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frequent words of all documents with the form and root of each."""
    from quern.llm import spelling

    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
with recursive tab as (
  select list(c order by i) as t from (
    select i, list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c
    from (select unnest(range(256)) as i))),
runs as (
  select coalesce(doc_id::varchar, 'null') as id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as low, count(*) as k
  from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) as r from documents)
  where length(r) >= 6 group by all),
bytes as (
  select low, k, flatten(list_transform(string_split(id || ':' || low, ''), lambda ch: case when unicode(ch) < 128 then [unicode(ch)] else [192 + (unicode(ch) >> 6), 128 + (unicode(ch) & 63)] end)) as b
  from runs),
hashed as (
  select low, k, xor(list_reduce(list_prepend(4294967295, list_transform(b, lambda x: x::bigint)), lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295) as h
  from bytes, tab),
made as (
  select case when h % 199 = 0 then left(low, (h % length(low))::int) || substr(low, (h % length(low))::int + 2) else low end as word, k from hashed),
words as materialized (select word, sum(k)::bigint as n from made where length(word) >= 6 group by word having sum(k) >= 5),
cut as materialized (
  select distinct word, n, i, left(word, i - 1) as a, substr(word, i + 1) as z from (select word, n, unnest(range(1, length(word) + 1)) as i from words)),
pairs as (
  select x.word, y.word as near, y.n as near_n from cut x join cut y on x.i = y.i and x.a = y.a and x.z = y.z and x.word <> y.word
  union
  select c.word, w.word, w.n from cut c join words w on w.word = c.a || c.z
  union
  select w.word, c.word, c.n from cut c join words w on w.word = c.a || c.z),
best as (select word, count(*) as n_near, arg_min(near, row(-near_n, near)) as form, max(near_n) as form_n from pairs group by word),
known as materialized (
  select w.word, w.n, coalesce(b.n_near, 0) as n_near, case when b.form_n >= 5 * w.n then b.form end as form, case when b.form_n >= 5 * w.n then b.form_n end as form_n
  from words w left join best b on w.word = b.word),
walk as (
  select word, word as cur, 0 as step from known
  union all
  select walk.word, known.form, step + 1 from walk join known on known.word = walk.cur where known.form is not null)
select k.word, k.form, r.root, k.n, k.n_near, k.form_n
from known k join (select word, arg_max(cur, step) as root from walk group by word) r on r.word = k.word
"""


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations, rebuilt on shared beginnings."""
    from quern.llm import prefixes

    return prefixes.conversation_trie(table(spark, sf_dir, "conversations"))


OP13_SQL = r"""
with tab as (
  select list(c order by i) as t from (
    select i, list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c
    from (select unnest(range(256)) as i))),
heads as (
  select conv_id, conv_id - conv_id % 5 as donor,
         xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::varchar, ''), lambda x: unicode(x)::bigint)), lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295) % 9 as h
  from (select distinct conv_id from conversations where conv_id is not null), tab),
turns as (
  select conv_id, turn, sha256(length(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, '')) as mark, octet_length(encode(coalesce(text, '')))::bigint as n_bytes
  from conversations where conv_id is not null),
placed as (select conv_id, mark, n_bytes, row_number() over (partition by conv_id order by turn nulls first, mark) as i from turns),
both_parts as (
  select g.conv_id, 0 as part, p.i, p.mark, p.n_bytes from heads g join placed p on p.conv_id = g.donor where p.i <= g.h
  union all
  select g.conv_id, 1, p.i, p.mark, p.n_bytes from heads g join placed p on p.conv_id = g.conv_id where p.i > g.h),
numbered as (select conv_id, mark, n_bytes, row_number() over (partition by conv_id order by part, i) as depth from both_parts),
steps as (
  select conv_id, depth, n_bytes, string_agg(mark, '') over (partition by conv_id order by depth rows unbounded preceding) as key from numbered
  union all
  select conv_id, 0, 0, '' from heads),
sizes as (select conv_id, max(depth) as size from steps group by conv_id),
nodes as (
  select depth, key, min(s.conv_id) as conv_id, count(*) as n_convs, max(n_bytes) as n_bytes,
         sha256(coalesce(string_agg(s.conv_id::varchar, ',' order by s.conv_id) filter (depth = size), '')) as ends_sha256
  from steps s join sizes z on s.conv_id = z.conv_id group by depth, key),
kids as (select depth - 1 as depth, left(key, (64 * (depth - 1))::int) as key, count(*) as n_children from nodes where depth > 0 group by all),
full_nodes as (select n.*, coalesce(k.n_children, 0) as n_children from nodes n left join kids k on n.depth = k.depth and n.key = k.key),
up as (
  select a as depth, left(key, (64 * a)::int) as key, sum((n_children = 0)::bigint) as n_leaves, sum((n_convs - 1) * n_bytes) as saved_tokens
  from (select *, unnest(range(depth + 1)) as a from full_nodes) group by all)
select n.conv_id, n.depth::bigint as depth, p.conv_id as parent_conv_id, n.n_convs::bigint as n_convs, n.n_children::bigint as n_children,
       u.n_leaves::bigint as n_leaves, u.saved_tokens::bigint as saved_tokens, n.ends_sha256
from full_nodes n join up u on n.depth = u.depth and n.key = u.key
left join nodes p on p.depth = n.depth - 1 and p.key = left(n.key, (64 * (n.depth - 1))::int)
"""


QUERIES = {
    "op1_language": op1_language,
    "op2_span_dedup": op2_span_dedup,
    "op3_packing": op3_packing,
    "op4_decontamination": op4_decontamination,
    "op5_toxicity": op5_toxicity,
    "op6_secrets": op6_secrets,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op8_url_filter": op8_url_filter,
    "op9_fingerprints": op9_fingerprints,
    "op10_pii": op10_pii,
    "op11_quality": op11_quality,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_prefix_trie": op13_prefix_trie,
}
ORACLE_SQL: dict[str, str] = {"op8_url_filter": OP8_SQL, "op12_spelling_variants": OP12_SQL, "op13_prefix_trie": OP13_SQL}
