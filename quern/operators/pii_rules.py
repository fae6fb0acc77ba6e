"""Personal data by an ordered list of patterns: detection, counts and rewriting; narrow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns in the order in which they are applied, with their placeholders.
PATTERNS = (
    ("email", r"(?U)\b[\w.+-]+@[\w-]+\.[\w.-]+\b", "[EMAIL]"),
    ("phone_cn_mobile", r"(?U)\b1[3-9]\d{9}\b", "[PHONE]"),
    ("phone_cn_landline", r"(?U)\b0\d{2,3}-?\d{7,8}\b", "[PHONE]"),
    ("ip_address", r"(?U)\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "[IP]"),
    ("id_card_cn", r"(?U)\b\d{17}[\dXx]\b", "[ID_CARD]"),
    ("bank_card", r"(?U)\b\d{16,19}\b", "[BANK_CARD]"),
)
SHORT = ("email", "phone_cn_mobile", "ip_address", "id_card_cn")
LICENSE = r"(?i)\b(licensed under|released under the|all rights reserved|creative commons|apache license|mit license|gnu general public license)"


def detect(text: Column, kinds: tuple[str, ...] = tuple(k for k, *_ in PATTERNS)) -> Column:
    """Map from kind to its matches in the text as it is; kinds without a match are absent."""
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), F.regexp_extract_all(text, F.lit(p), F.lit(0)).alias("value")) for k, p, _ in PATTERNS if k in kinds])
    return F.map_from_entries(F.filter(pairs, lambda x: F.size(x["value"]) > 0))


def rewrite(docs: DataFrame, mode: str = "replace", kinds: tuple[str, ...] = tuple(k for k, *_ in PATTERNS)) -> DataFrame:
    """``docs`` with ``text`` rewritten pattern after pattern and ``n_<kind>``, each counted on the text it was applied to."""
    if mode not in ("replace", "remove"):
        raise ValueError("mode is 'replace' or 'remove'")
    t = F.col("text")
    counts = {}
    for kind, pattern, placeholder in PATTERNS:
        if kind in kinds:
            counts[f"n_{kind}"] = F.regexp_count(t, F.lit(pattern)).cast("long")
            t = F.regexp_replace(t, pattern, placeholder if mode == "replace" else "")
    return docs.withColumns(counts | {"text": t})


def has_license(text: Column) -> Column:
    """Whether the text speaks of its licence."""
    return text.rlike(LICENSE)


def luhn_ok(digits: Column) -> Column:
    """Whether a string of digits ends in its Luhn check digit: from the right, every second digit doubled, nines cast out."""
    from_right = F.reverse(F.filter(F.split(digits, ""), lambda c: c != ""))
    worth = F.transform(from_right, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")))
    total = F.aggregate(worth, F.lit(0), lambda s, x: s + x)
    return F.when(digits.rlike(r"^[0-9]+$"), total % 10 == 0).otherwise(F.lit(False))


def id18_ok(text: Column) -> Column:
    """Whether 17 digits and a digit or X are an identity number: the weights 2^17 .. 2^0, modulo 11, of all places sum to 1,
    X counting 10, and places 7 to 14 are a date that exists."""
    places = F.filter(F.split(F.upper(text), ""), lambda c: c != "")
    weights = F.array(*[F.lit(pow(2, 17 - i, 11)) for i in range(18)])
    value = lambda c: F.when(c == "X", 10).otherwise(c.try_cast("int"))
    total = F.aggregate(F.zip_with(places, weights, lambda c, w: value(c) * w), F.lit(0), lambda s, x: s + x)
    born = F.try_to_timestamp(F.substring(text, 7, 8), F.lit("yyyyMMdd")).isNotNull()
    return F.when(text.rlike(r"^[0-9]{17}[0-9Xx]$"), (total % 11 == 1) & born).otherwise(F.lit(False))


def identifiers(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key``, ``kind``, ``value``, ``valid``: the identity numbers and bank cards that ``detect`` finds, and whether their check
    digits hold, so that digit strings that only look alike can be told apart. Null texts hold none."""
    found = docs.select(key, F.explode(detect(F.col("text"), ("id_card_cn", "bank_card"))).alias("kind", "values")).select(key, "kind", F.explode("values").alias("value"))
    return found.withColumn("valid", F.when(F.col("kind") == "bank_card", luhn_ok(F.col("value"))).otherwise(id18_ok(F.col("value"))))
