"""Document fingerprints by one-permutation MinHash, in DataFrame functions only.

Every 5-word shingle is hashed once; the top bits of the hash name one of ``n_bins`` bins and each bin keeps its
smallest hash. Empty bins are filled by optimal densification: an empty bin walks a fixed pseudo-random sequence of
bins, which depends on its own number only, to the first bin that is not empty; the rare walk that meets none within
``WALK`` steps takes the non-empty bin of smallest rank hash, which is the end of the same kind of walk. The
fingerprint packs the low 8 bits of the bins; the share of equal bins, corrected for chance agreement of 8 bits,
estimates the Jaccard similarity of the shingle sets.

All of it happens inside the row: sorting a document's hashes together with one marker per bin puts each bin's
smallest hash, or its marker, first. No shuffle is needed for a fingerprint.

Edge cases: null texts count as empty. A text of fewer than five words has one shingle, all its words; one without
words has the empty shingle, so all such texts are alike. Lower case and runs of white space do not matter.
"""

from __future__ import annotations

import math

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS = 8
WALK = 12
#: Text of a range of ids that one task compares; the number of ranges follows from it, so tasks don't grow with the table.
LOT_BYTES = 256 << 20


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def walks(n_bins: int, seed: int = 11) -> list[int]:
    """The first ``WALK`` bins that each empty bin asks, bin after bin."""
    rng = random.Random(seed)
    return [rng.randrange(n_bins) for _ in range(n_bins * WALK)]


def bins(text: Column, n_bins: int = 256, shingle: int = 5) -> Column:
    """The densified bins' low bits, an array of ``n_bins`` bytes (as signed tinyint)."""
    shift = 63 - (n_bins.bit_length() - 1)
    assert n_bins == 1 << (63 - shift), "n_bins must be a power of two"
    words = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " ")), " ")
    hashed = F.transform(words, lambda w: F.xxhash64(w))

    def shingles(w: Column) -> Column:
        whole = F.array(F.aggregate(w, F.lit(42).cast("long"), lambda h, x: F.xxhash64(h, x)))
        each = F.transform(F.sequence(F.lit(0), F.size(w) - shingle), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(shingle)]))
        return F.transform(F.when(F.size(w) >= shingle, each).otherwise(whole), lambda h: F.shiftrightunsigned(h, 1))

    markers = F.lit([((j + 1) << shift) - 1 for j in range(n_bins)])
    walk = F.lit(walks(n_bins))

    def first(sorted_: Column) -> Column:
        return F.filter(sorted_, lambda x, i: (i == 0) | (F.shiftright(x, shift) != F.shiftright(F.get(sorted_, i - 1), shift)))

    def dense(lows: Column) -> Column:
        def is_marker(x: Column) -> Column:
            return x.bitwiseAND((1 << shift) - 1) == (1 << shift) - 1

        def fill(x: Column, j: Column) -> Column:
            tries = []
            for a in range(WALK):
                y = F.get(lows, F.get(walk, j * WALK + a))
                tries.append(F.when(~is_marker(y), y))
            ranked = F.transform(lows, lambda y, t: F.when(~is_marker(y), F.struct(F.xxhash64(j, t).alias("r"), y.alias("y"))))
            return F.when(~is_marker(x), x).otherwise(F.coalesce(*tries, F.array_min(ranked)["y"]))

        return F.transform(lows, fill)

    low = _let(_let(_let(hashed, lambda w: F.sort_array(F.concat(shingles(w), markers))), first), dense)
    return F.transform(low, lambda x: (x.bitwiseAND((1 << BITS) - 1) - 128).cast("tinyint"))


def packed(low: Column) -> Column:
    """The bytes of ``bins`` as lowercase hex digits."""
    digits = F.lit([f"{v:02x}" for v in range(1 << BITS)])
    return F.array_join(F.transform(low, lambda x: F.get(digits, x.cast("int") + 128)), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard estimate from two arrays of bins, corrected for bins that agree by chance."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    chance = 1.0 / (1 << BITS)
    return F.greatest(F.lit(0.0), (same / F.size(a) - chance) / (1 - chance))


def fingerprint(docs: DataFrame, n_bins: int = 256) -> DataFrame:
    """``doc_id`` and ``fingerprint`` of every row; narrow."""
    return docs.select("doc_id", packed(bins(F.col("text"), n_bins)).alias("fingerprint"))


def longs(values: list[int]) -> Column:
    """A constant array, folded into one literal of the plan however long it is."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def bounds_up_to(cuts: list[int], value: Column) -> Column:
    """How many of the sorted ``cuts`` are at most ``value``: the block of bounds first, then the place in it.

    A row meets about twice the square root of the number of bounds.
    """
    width = max(1, math.isqrt(len(cuts)))
    heads = cuts[width::width]
    block = F.size(F.filter(longs(heads), lambda c: c <= value)) if heads else F.lit(0)
    inside = F.slice(longs(cuts), block * width + 1, width)
    return F.when(value.isNotNull(), block * width + F.size(F.filter(inside, lambda c: c <= value)))


def with_next(docs: DataFrame, columns: list[str], lots: int) -> DataFrame:
    """``doc_id``, ``columns`` and ``next_<column>``: those of the next row by ``doc_id``, the first row after the last.

    Rows are dealt into ranges of ids whose bounds are quantiles, and the first row of a range also goes to the range
    before it, so a window inside each range sees every successor: one shuffle, no sort of everything in one task.
    Null ids come first; rows of one id are ordered by a hash of their columns.
    """
    n = max(2, lots)
    cuts = docs.select(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 20 * n)).first()[0] or []
    cuts = sorted(set(cuts))
    lot = F.coalesce(bounds_up_to(cuts, F.col("doc_id")), F.lit(0)) if cuts else F.lit(0)
    dealt = docs.withColumn("lot", F.when(F.col("doc_id").isNull(), 0).otherwise(lot))
    lows = sorted(dealt.groupBy("lot").agg(F.min(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))).alias("low")).collect())
    low_of, before = [None] * n, [0] * n
    for (k, low), (p, _) in zip(lows, [lows[-1], *lows[:-1]] if lows else [], strict=True):
        low_of[k], before[k] = low, p
    first = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))) == F.get(longs([x if x is not None else 0 for x in low_of]), F.col("lot"))
    wraps = F.col("lot") == (lows[0][0] if lows else 0)
    own = F.struct(F.col("lot").alias("to"), F.lit(0).alias("guest"))
    guest = F.struct(F.get(longs(before), F.col("lot")).cast("int").alias("to"), F.when(wraps, 2).otherwise(1).alias("guest"))
    sent = dealt.withColumn("copy", F.explode(F.when(first, F.array(own, guest)).otherwise(F.array(own)))).select("doc_id", *columns, "copy.*")
    along = Window.partitionBy("to").orderBy("guest", F.col("doc_id").asc_nulls_first(), F.xxhash64(*columns))
    return sent.select("doc_id", *columns, "guest", *[F.lead(c).over(along).alias(f"next_{c}") for c in columns]).where("guest = 0").drop("guest")


def compare_with_edits(docs: DataFrame, n_bins: int = 256, lots: int | None = None) -> DataFrame:
    """Fingerprint of every text and of its edited text, and their likeness to each other and to the next document."""
    spark = docs.sparkSession
    if lots is None:
        size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
        lots = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // LOT_BYTES))
    marked = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), bins(F.col("text"), n_bins).alias("low"))
    near = with_next(marked, ["text", "low"], lots)
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    near = near.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)))
    near = near.select("doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "low", bins(F.col("edited"), n_bins).alias("edited_low"), "next_low")
    return near.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        packed(F.col("low")).alias("fingerprint"),
        packed(F.col("edited_low")).alias("edited_fingerprint"),
        likeness(F.col("low"), F.col("edited_low")).alias("near_edited"),
        likeness(F.col("low"), F.col("next_low")).alias("near_next"),
    )
