r"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Seeds are the matches of four plain patterns (email, ip, card, phone). Every word that holds a digit or an ``@`` is an
instance, and the one or two words to its left, back to the instance before it and however long, are its lexical
patterns. Patterns and
instances form a bipartite graph: a pattern scores the mean of its distinct instances, an instance the best of its
patterns, seeds stay at 1, and the two steps alternate. Patterns of high score that at least ``min_seeds`` distinct
seeds support then mark the other instances they introduce as identifiers of kind ``context``.

Regular expressions give no offsets in Spark SQL, so the text is both split at and searched for each pattern; the
lengths of the parts, summed over a window, are the offsets (code points). The written patterns are unrolled and
possessive forms that match the same strings as the contract's in linear time and without recursion.

A pattern that very many instances share is a hot key only on the side of the edges; it is dealt over ``SALT`` tasks, and
the few patterns that can score are sent to each of them.

Edge cases: a null text counts as empty and has no span. Rows that repeat an id are scanned each on their own. All
texts are read whole. Other columns pass through ``redact`` untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import durable

SALT = 32
KINDS = ("email", "ip", "card", "phone", "context")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
INSTANCE = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"


def _left_words(before: Column) -> Column:
    """The last two words of ``before``, or one, with the white space behind them; linear, since it reads backwards."""
    return F.lower(F.reverse(F.regexp_extract(F.reverse(before), r"^\s*+\S++(?:\s++\S++)?+", 0)))


def _hits(text: Column, pattern: str, left: bool = False) -> Column:
    """Array of (skip, hit, left): characters before the hit since the last one, the hit, and the words to its left if
    they are wanted."""
    parts = F.zip_with(
        F.split(text, pattern, -1),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda p, h: F.struct(F.char_length(p).cast("long").alias("skip"), h.alias("hit"), (_left_words(p) if left else F.lit("")).alias("left")),
    )
    return F.filter(parts, lambda x: x["hit"].isNotNull())


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return (n > 0) & (F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0)


def _holds(kind: Column, hit: Column) -> Column:
    """The conditions that a match of the base patterns must meet."""
    digits = F.regexp_replace(hit, "[^0-9]", "")
    octets = F.transform(F.split(hit, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
    small = F.forall(octets, lambda p: (F.length(p) <= 3) & (F.try_to_number(p, F.lit("999")) <= 255))
    return (
        F.when(kind == "email", F.lit(True))
        .when(kind == "ip", small)
        .when(kind == "card", F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False))
        .when(kind == "phone", F.length(digits).between(9, 15))
        .otherwise(True)
    )


def scan(docs: DataFrame, keep: list[str]) -> DataFrame:
    """One pass over the texts: ``row`` (a key of the row), ``keep`` and ``found``, the raw hits of all kinds; written."""
    text = F.coalesce("text", F.lit(""))
    none = F.filter(_hits(F.lit(""), "x"), lambda _: F.lit(False))
    digits, at = F.col("text").rlike("[0-9]"), F.col("text").contains("@")
    wanted = {"email": at, "ip": digits, "card": digits, "phone": digits, "instance": digits | at}
    arrays = [F.when(wanted[k], _hits(text, PATTERNS.get(k, INSTANCE), k == "instance")).otherwise(none).alias(f"found_{k}") for k in wanted]
    return durable(docs.select(F.monotonically_increasing_id().alias("row_key"), *keep, *arrays))


def places(scanned: DataFrame) -> DataFrame:
    """``row_key``, ``kind``, ``hit``, ``left``, ``start``, ``end`` of every raw hit."""
    rows = None
    for kind in (*PATTERNS, "instance"):
        part = scanned.select("row_key", F.lit(kind).alias("kind"), F.posexplode(f"found_{kind}").alias("n", "h")).select("row_key", "kind", "n", "h.*")
        rows = part if rows is None else rows.unionAll(part)
    before = Window.partitionBy("row_key", "kind").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    size = F.char_length("hit")
    end = F.sum(F.col("skip") + size).over(before)
    return rows.withColumn("size", size).withColumn("end", end).select("row_key", "kind", "hit", "left", (F.col("end") - F.col("size")).alias("start"), "end")


def _salted(many: DataFrame, few: DataFrame, spread: str, how: str = "inner") -> DataFrame:
    """Join by ``pattern`` and a salt: rows of ``many`` take it from ``spread``, each row of ``few`` is there for all."""
    salted = many.withColumn("salt", F.pmod(F.xxhash64(spread), F.lit(SALT)))
    copies = few.withColumn("salt", F.explode(F.array(*[F.lit(i).cast("long") for i in range(SALT)])))
    return salted.join(copies, ["pattern", "salt"], how).drop("salt")


def pattern_scores(edges: DataFrame, instances: DataFrame) -> DataFrame:
    """``pattern``, ``score`` (mean of its distinct instances) and ``seeds``, how many of them are seeds."""
    return edges.join(instances, "instance").groupBy("pattern").agg(F.avg("score").alias("score"), F.sum("seed").alias("seeds"))


def instance_scores(edges: DataFrame, patterns: DataFrame, min_seeds: int) -> DataFrame:
    """``instance`` and ``score``: 1 for a seed, else the best of its patterns that enough seeds support, else 0."""
    good = patterns.where((F.col("seeds") >= min_seeds) & (F.col("score") > 0)).select("pattern", F.col("score").alias("p_score"))
    best = F.max(F.coalesce("p_score", F.lit(0.0)))
    return _salted(edges, good, "instance", "left").groupBy("instance").agg(F.greatest(F.max("seed").cast("double"), best).alias("score"))


def find_spans(scanned: DataFrame, rounds: int = 3, threshold: float = 0.8, min_seeds: int = 3) -> DataFrame:
    """``row_key``, ``kind``, ``start``, ``end``: base spans and those that high-confidence patterns discover."""
    found = durable(places(scanned).where(_holds(F.col("kind"), F.col("hit"))))
    base = found.where(F.col("kind") != "instance")
    # Trim quotes and punctuation off the instances.
    head = F.char_length(F.regexp_extract("hit", r"^[(\[<{\"']*", 0)).cast("long")
    tail = F.char_length(F.regexp_extract("hit", r"[.,;:!?)\]>}\"']*$", 0)).cast("long")
    words = found.where(F.col("kind") == "instance").withColumn("head", head).withColumn("tail", tail)
    words = words.where("head + tail < end - start").select("row_key", "kind", F.expr("substring(hit, cast(head + 1 as int), cast(end - start - head - tail as int))").alias("hit"), "left", (F.col("start") + F.col("head")).alias("start"), (F.col("end") - F.col("tail")).alias("end"))
    # A word that overlaps a base span is a seed; a running maximum and minimum find that without a join.
    along = Window.partitionBy("row_key").orderBy("start", "is_word")
    both = words.withColumn("is_word", F.lit(1)).unionByName(base.withColumn("is_word", F.lit(0)))
    reach = F.max(F.when(F.col("is_word") == 0, F.col("end"))).over(along.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.min(F.when(F.col("is_word") == 0, F.col("start"))).over(along.rowsBetween(1, Window.unboundedFollowing))
    seed = F.coalesce(F.col("reach") > F.col("start"), F.lit(False)) | F.coalesce(F.col("ahead") < F.col("end"), F.lit(False))
    left = F.trim(F.regexp_replace("left", r"\s+", " "))
    words = (
        both.withColumn("reach", reach).withColumn("ahead", ahead).where("is_word = 1")
        .select("row_key", "start", "end", seed.cast("int").alias("seed"), F.xxhash64("hit").alias("instance"), left.alias("left"), F.length(F.regexp_replace("hit", r"[^\p{L}\p{N}]", "")).alias("signs"))
        .withColumn("pattern", F.explode(F.array_distinct(F.array(F.concat(F.lit("2 "), "left"), F.concat(F.lit("1 "), F.regexp_extract("left", r"\S+$", 0))))))
        .where("left <> ''")
    )
    words = durable(words.drop("left"))
    edges = durable(words.groupBy("pattern", "instance").agg(F.max("seed").alias("seed")))
    instances = edges.groupBy("instance").agg(F.max("seed").cast("double").alias("score"))
    patterns = None
    for _ in range(rounds):
        patterns = pattern_scores(edges, instances)
        instances = instance_scores(edges, patterns, min_seeds)
    sure = patterns.where((F.col("seeds") >= min_seeds) & (F.col("score") >= threshold)).select("pattern")
    new = _salted(words.where("seed = 0 and signs >= 4"), sure, "start").select("row_key", F.lit("context").alias("kind"), "start", "end").distinct()
    return base.select("row_key", "kind", "start", "end").unionAll(new)


def _order() -> Column:
    return F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))


def per_document(scanned: DataFrame, spans: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, counts of the base kinds, ``base_spans`` and ``spans`` as kind:start:end, comma-joined."""
    listed = spans.groupBy("row_key").agg(F.sort_array(F.collect_list(F.struct(_order().alias("o"), "start", "end", "kind"))).alias("s"))
    show = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    empty = F.coalesce("s", F.filter(F.array(F.struct(F.lit(1).cast("long").alias("o"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end"), F.lit("").alias("kind"))), lambda _: F.lit(False)))
    out = scanned.select("row_key", *keep).join(listed, "row_key", "left").withColumn("s", empty)
    count = lambda k: F.size(F.filter("s", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [count(k) for k in KINDS]
    return out.select(*keep, *counts, show(F.filter("s", lambda x: x["kind"] != "context")).alias("base_spans"), show(F.col("s")).alias("spans"))


def find_pii(docs: DataFrame, **settings) -> DataFrame:
    """``doc_id``, ``n_email`` ... ``n_context``, ``base_spans``, ``spans`` of every row of ``docs``."""
    scanned = scan(docs, ["doc_id"])
    return per_document(scanned, find_spans(scanned, **settings), ["doc_id"])


def redact(docs: DataFrame, **settings) -> DataFrame:
    """``docs``, all columns, with each span replaced by its kind in brackets and ``n_chars``, if there, counted anew."""
    columns = docs.columns
    scanned = scan(docs.select(F.struct(*columns).alias("all"), "text"), ["all"])
    spans = find_spans(scanned, **settings)
    along = Window.partitionBy("row_key").orderBy("start", _order())
    covered = F.coalesce(F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = spans.withColumn("covered", covered).where("end > covered").withColumn("start", F.greatest("start", "covered"))
    listed = spans.groupBy("row_key").agg(F.sort_array(F.collect_list(F.struct("start", "end", "kind"))).alias("s"))
    any_hit = F.size("found_instance") > 0
    text = F.col("all.text")
    n = F.size("s")
    cut = F.transform(
        F.sequence(F.lit(0), n),
        lambda i: F.concat(
            F.substring(text, F.when(i == 0, 1).otherwise(F.get("s", i - 1)["end"] + 1).cast("int"), (F.when(i < n, F.get("s", i)["start"]).otherwise(F.char_length(text)) - F.when(i == 0, 0).otherwise(F.get("s", i - 1)["end"])).cast("int")),
            F.when(i < n, F.concat(F.lit("["), F.upper(F.get("s", i)["kind"]), F.lit("]"))).otherwise(""),
        ),
    )
    # The spans grow with the corpus, so they are never broadcast.
    changed = scanned.where(any_hit).join(listed.hint("merge"), "row_key", "left").withColumn("new", F.when(F.col("s").isNull(), text).otherwise(F.array_join(cut, "")))
    fixed = {"text": F.col("new")} | ({"n_chars": F.when(F.col("s").isNull(), F.col("all.n_chars")).otherwise(F.char_length("new").cast(dict(docs.dtypes)["n_chars"]))} if "n_chars" in columns else {})
    out = changed.select(*[fixed.get(c, F.col(f"all.`{c}`")).alias(c) for c in columns])
    same = scanned.where(~any_hit).select(*[F.col(f"all.`{c}`").alias(c) for c in columns])
    return same.unionAll(out)
