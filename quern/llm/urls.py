"""URL filters: host and path rules, and a listed-URL check through a blocked Bloom filter, in DataFrame functions only.

The canonical form of a URL is its host without ``www.`` and default port, and its path without trailing slashes;
scheme, query and fragment don't count. The listed canonical URLs set 8 bits each in one 256-bit block (four words) of
a Bloom filter with 16 bits a URL. The filter is a table with a row for each block, so it grows with the list and is
joined by block number: by broadcast while its size, which is known, is within ``broadcast_bytes``, else by a shuffle.
Only URLs whose bits are all set go on to the exact hash join, which removes the false positives.

Edge cases: a null URL or one without ``://`` has empty host and path, fits no rule and is not listed. Repeated rows are
judged each on their own. An empty list blocks nothing. Other columns of the pages are not read, whatever their names.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
WORDS, BITS_PER_URL = 4, 16


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def canonical(host_: Column, path_: Column) -> Column:
    """Host and path in the form that the list is compared in; null for an empty host."""
    name = F.regexp_replace(F.regexp_replace(host_, r":(80|443)$", ""), r"^www\.", "")
    return F.when(host_ != "", F.concat(name, F.regexp_replace(path_, "/+$", "")))


def longest_rule(host_: Column, path_: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule, as text, and its verdict; null where none fits."""
    name = verdict = None
    for judged, rule in sorted(rules, key=lambda r: -len(r[1])):
        domain, slash, rest = rule.partition("/")
        fits = ((host_ == domain) | host_.endswith("." + domain)) & path_.startswith(slash + rest)
        name = F.when(fits, rule) if name is None else name.when(fits, rule)
        verdict = F.when(fits, judged) if verdict is None else verdict.when(fits, judged)
    return (name, verdict) if name is not None else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("long")


def _masks(key: Column) -> list[Column]:
    """Two bits in each of the four words of a block, from a second hash."""
    h = F.xxhash64(key, F.lit("bits"))
    bit = lambda n: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * n).bitwiseAND(63).cast("int"))
    return [bit(2 * w).bitwiseOR(bit(2 * w + 1)) for w in range(WORDS)]


def bloom(listed: DataFrame) -> tuple[DataFrame, int]:
    """The filter of the distinct ``url_key`` of ``listed``: ``block`` and its words; and the number of blocks."""
    blocks = max(1, -(-listed.count() * BITS_PER_URL // (64 * WORDS)))
    keyed = listed.select(_block(F.col("url_key"), blocks).alias("block"), *[m.alias(f"m{w}") for w, m in enumerate(_masks(F.col("url_key")))])
    return keyed.groupBy("block").agg(*[F.bit_or(f"m{w}").alias(f"w{w}") for w in range(WORDS)]), blocks


def flag_listed(pages: DataFrame, listed: DataFrame, broadcast_bytes: int = 16 << 20) -> DataFrame:
    """``pages`` (with ``url_key``) and ``is_listed``, true if the key is among the distinct keys of ``listed``."""
    table, blocks = bloom(listed)
    if blocks * 8 * (WORDS + 1) <= broadcast_bytes:
        table = F.broadcast(table)
    known = pages.where(F.col("url_key").isNotNull())
    probed = known.withColumn("block", _block(F.col("url_key"), blocks)).join(table, "block", "left")
    hit = F.lit(True)
    for w, m in enumerate(_masks(F.col("url_key"))):
        hit = hit & (F.col(f"w{w}").bitwiseAND(m) == m)
    probed = probed.withColumn("maybe", F.coalesce(hit, F.lit(False)))
    sure_not = probed.where(~F.col("maybe")).select(*pages.columns, F.lit(False).alias("is_listed"))
    exact = listed.select("url_key", F.lit(True).alias("is_listed"))
    maybe = probed.where("maybe").select(*pages.columns).join(exact, "url_key", "left").select(*pages.columns, F.coalesce("is_listed", F.lit(False)).alias("is_listed"))
    missing = pages.where(F.col("url_key").isNull()).select(*pages.columns, F.lit(False).alias("is_listed"))
    return sure_not.unionAll(maybe).unionAll(missing)


def judge(pages: DataFrame, listed: DataFrame, rules=RULES, **settings) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict``, ``is_listed`` of every page.

    ``listed`` has a column ``url``. A rule's verdict comes first; else listed URLs are blocked and others allowed.
    """
    parted = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path")).withColumn("url_key", canonical(F.col("host"), F.col("path")))
    keys = listed.select(canonical(host(F.col("url")), path(F.col("url"))).alias("url_key")).where("url_key is not null").distinct()
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    flagged = flag_listed(parted, keys, **settings)
    return flagged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("is_listed"), "block").otherwise("allow")).alias("verdict"), "is_listed")
