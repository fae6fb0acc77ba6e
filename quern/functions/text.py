"""Column helpers for text: one meaning of word, line, strip and n-gram for the whole library.

White space, letters and digits follow Unicode (``(?U)``). Every helper maps null to null unless it says otherwise.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with ``columns`` added or replaced, each computed exactly once a row.

    A filter or projection above does not see through the generator, so the optimiser neither pushes a copy of a costly
    expression below it nor repeats it for each use, as it does with plain projections.
    """
    made = [c.alias(f"_once_{i}") for i, c in enumerate(columns.values())]
    out = df.select("*", F.inline(F.array(F.struct(*made))))
    names = {n: F.col(f"_once_{i}").alias(n) for i, n in enumerate(columns)}
    old = [names.pop(c) if c in names else F.col(f"`{c}`") for c in df.columns]
    return out.select(*old, *names.values())


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column, lower: bool = True) -> Column:
    """Runs of non-white-space, lower-cased by default; no empty strings."""
    return F.filter(F.split(F.lower(text) if lower else text, r"(?U)\s+"), lambda w: w != "")


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def solid_lines(text: Column) -> Column:
    """Stripped lines that are not blank."""
    return F.filter(F.transform(lines(text), strip), lambda x: x != "")


def n_words(text: Column) -> Column:
    return F.size(words(text, lower=False)).cast("long")


def ngrams(tokens: Column, n: int) -> Column:
    """All runs of ``n`` tokens, space-joined, in order; empty if there are fewer tokens."""
    run = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.array_join(F.slice(w, i + 1, n), " "))
    return let(tokens, lambda w: F.when(F.size(w) >= n, run(w)).otherwise(F.array().cast("array<string>")))


def shingles(text: Column, n: int = 5) -> Column:
    """Set of ``n``-word shingles; a text of fewer words is one shingle, itself lower-cased and stripped."""
    return let(words(text), lambda w: F.when(F.size(w) >= n, F.array_distinct(ngrams(w, n))).otherwise(F.array(strip(F.lower(text)))))


def hashed_shingles(text: Column, n: int = 5) -> Column:
    """As ``shingles``, but 64-bit hashes of them, made from the words' hashes without building the strings."""
    whole = lambda w: F.array(F.xxhash64(strip(F.lower(text))))
    each = lambda w: F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(n)])))
    return let(F.transform(words(text), lambda w: F.xxhash64(w)), lambda w: F.when(F.size(w) >= n, each(w)).otherwise(whole(w)))


def share(part: Column, whole: Column) -> Column:
    """part / whole, 0 where whole is 0."""
    return F.when(whole == 0, 0.0).otherwise(part / F.when(whole != 0, whole))


def special_ratio(text: Column) -> Column:
    return share(F.char_length(F.regexp_replace(text, r"(?U)[\p{L}\p{N}\s]", "")), F.char_length(text))


def digit_ratio(text: Column) -> Column:
    return share(F.char_length(F.regexp_replace(text, r"\P{Nd}", "")), F.char_length(text))


def mean_line_length(text: Column) -> Column:
    """Mean length of the lines that are not blank, unstripped."""
    solid = F.filter(lines(text), lambda x: strip(x) != "")
    return let(solid, lambda a: share(F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + F.char_length(x)), F.size(a)))


def duplicate_line_ratio(text: Column) -> Column:
    return let(solid_lines(text), lambda a: share(F.size(a) - F.size(F.array_distinct(a)), F.size(a)))


def duplicate_ngram_ratio(text: Column, n: int = 5) -> Column:
    """Occurrences of n-grams that occur more than once, over all n-grams of the text.

    The n-grams are hashed and sorted inside the row: one with an equal neighbour occurs more than once.
    """
    hashes = let(F.transform(words(text), lambda w: F.xxhash64(w)), lambda w: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(n)]))).otherwise(F.array().cast("array<bigint>")))
    twice = lambda a: F.filter(a, lambda x, i: F.coalesce(x == F.get(a, i - 1), F.lit(False)) | F.coalesce(x == F.get(a, i + 1), F.lit(False)))
    return let(F.sort_array(hashes), lambda a: share(F.size(twice(a)), F.size(a)))


def share_of(tokens: Column, vocabulary: list[str]) -> Column:
    """Share of the tokens that are in ``vocabulary``."""
    return let(tokens, lambda w: share(F.size(F.filter(w, lambda x: x.isin(vocabulary))), F.size(w)))


def type_token_ratio(text: Column) -> Column:
    return let(words(text), lambda w: share(F.size(F.array_distinct(w)), F.size(w)))


def word_measures(text: Column, n: int = 5) -> Column:
    """Struct of ``repeated`` and ``distinct``: ``duplicate_ngram_ratio`` and ``type_token_ratio`` from one list of the words' hashes.

    Words and n-grams are told apart by 64 bits and sorted as arrays; a run of n words has the polynomial of their hashes.
    """

    @F.arrow_udf("repeated double, distinct double")
    def measure(hashes: pa.Array) -> pa.Array:
        repeated, distinct = [], []
        for row in hashes:
            w = row.values.to_numpy().view(np.uint64) if row.is_valid else None
            run = np.zeros(max(0, len(w) - n + 1) if row.is_valid else 0, np.uint64)
            for i in range(n if len(run) else 0):
                run *= np.uint64(0x9E3779B97F4A7C15)
                run += w[i : i + len(run)]
            run.sort()
            same = np.concatenate([[False], run[1:] == run[:-1], [False]])
            repeated.append(None if w is None else float((same[1:] | same[:-1]).sum() / max(1, len(run))))
            distinct.append(None if w is None else len(np.unique(w)) / max(1, len(w)))
        return pa.StructArray.from_arrays([pa.array(repeated, pa.float64()), pa.array(distinct, pa.float64())], names=["repeated", "distinct"])

    return measure(F.transform(words(text), lambda w: F.xxhash64(w)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets given as arrays; 1 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)
