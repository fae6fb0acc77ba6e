"""Corpus statistics, profiles and benchmark overlap."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as T


def upper_median(df: DataFrame, column: str) -> DataFrame:
    """One row ``median``: element n // 2 of the sorted values, found from counts of distinct values."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    # the running sum is over distinct values, ordered; document lengths have few
    running = counts.withColumn("upto", F.sum("n").over(Window.orderBy(column).rowsBetween(Window.unboundedPreceding, 0)))
    return running.crossJoin(F.broadcast(total)).where(F.col("upto") > F.floor(F.col("total") / 2)).agg(F.min(column).alias("median"))


def corpus(docs: DataFrame, tokens_per_word: float = 1.3) -> DataFrame:
    """One row of counts, lengths and vocabulary of all documents; a null text counts as empty."""
    t = docs.select(F.coalesce("text", F.lit("")).alias("text")).withColumn("words", T.n_words(F.col("text")))
    sizes = t.agg(
        F.count("*").alias("num_docs"),
        F.sum(F.char_length("text")).alias("total_chars"),
        F.sum("words").alias("total_words"),
        F.avg("words").alias("avg_words"),
        F.min("words").alias("min_words"),
        F.max("words").alias("max_words"),
    )
    vocabulary = word_counts(docs).agg(F.count("*").alias("vocabulary_size"))
    out = sizes.crossJoin(F.broadcast(vocabulary)).crossJoin(F.broadcast(upper_median(t, "words").withColumnRenamed("median", "median_words")))
    return out.withColumns({"type_token_ratio": T.share(F.col("vocabulary_size"), F.col("total_words")), "estimated_tokens": F.floor(F.col("total_words") * tokens_per_word).cast("long")})


def word_counts(docs: DataFrame, key: str | None = None) -> DataFrame:
    keys = [key] if key else []
    return docs.select(*keys, F.explode(T.words(F.col("text"))).alias("word")).groupBy(*keys, "word").agg(F.count("*").alias("n"))


def source_distribution(docs: DataFrame, source: str = "source") -> DataFrame:
    return docs.groupBy(source).agg(F.count("*").alias("n_docs"))


def length_histogram(docs: DataFrame, bins: int = 10) -> DataFrame:
    """``bin_start``, ``bin_end``, ``n_docs`` of word counts in bins of equal whole width."""
    w = docs.select(T.n_words(F.coalesce("text", F.lit(""))).alias("w"))
    ends = w.agg(F.min("w").alias("lo"), F.max("w").alias("hi"))
    size = F.greatest(F.lit(1), F.floor((F.col("hi") - F.col("lo")) / bins)).cast("long")
    start = (F.floor((F.col("w") - F.col("lo")) / F.col("size")) * F.col("size") + F.col("lo")).cast("long")
    out = w.crossJoin(F.broadcast(ends)).withColumn("size", size).withColumn("bin_start", start)
    end = F.when(F.col("hi") == F.col("lo"), F.col("hi")).otherwise(F.col("bin_start") + F.col("size") - 1)
    return out.groupBy("bin_start", end.alias("bin_end")).agg(F.count("*").alias("n_docs"))


def ngram_counts(docs: DataFrame, n: int = 5) -> DataFrame:
    return docs.select(F.explode(T.ngrams(T.words(F.col("text")), n)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


def _hashed_counts(docs: DataFrame, n: int) -> DataFrame:
    """``n`` of each distinct n-gram, told apart by 96 bits of its words' hashes, which are shorter than its text."""
    parts = F.transform(T.words(F.col("text")), lambda w: F.struct(F.xxhash64(w).alias("a"), F.hash(w).alias("b")))
    each = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.struct(F.xxhash64(*[F.get(w, i + k)["a"] for k in range(n)]).alias("a"), F.hash(*[F.get(w, i + k)["b"] for k in range(n)]).alias("b")))
    rows = docs.select(F.inline(T.let(parts, lambda w: F.when(F.size(w) >= n, each(w)))))
    return rows.groupBy("a", "b").agg(F.count("*").alias("n"))


def ngram_repetition(docs: DataFrame, n: int = 5, top: int = 10) -> DataFrame:
    """Total and distinct n-grams of the corpus, 1 - distinct / total, and the share of the ``top`` most frequent."""
    counts = _hashed_counts(docs, n)
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_ngrams"), F.count("*").alias("unique_ngrams"))
    most = counts.orderBy(F.desc("n")).limit(top).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("top"))
    out = total.crossJoin(F.broadcast(most))
    return out.select("total_ngrams", "unique_ngrams", F.when(F.col("total_ngrams") == 0, 0.0).otherwise(1 - T.share(F.col("unique_ngrams"), F.col("total_ngrams"))).alias("repetition_rate"), T.share(F.col("top"), F.col("total_ngrams")).alias("top_ratio"))


def most_common(counts: DataFrame, key: str, k: int = 10) -> DataFrame:
    return counts.orderBy(F.desc("n"), key).limit(k)


def vocabulary(docs: DataFrame, top: int = 100) -> DataFrame:
    """Distinct and total words, hapax count and ratio, and the share of the ``top`` most frequent words."""
    counts = word_counts(docs)
    size = counts.agg(F.count("*").alias("vocabulary_size"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_words"), F.count(F.when(F.col("n") == 1, 1)).alias("hapax_count"))
    most = most_common(counts, "word", top).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("top"))
    out = size.crossJoin(F.broadcast(most))
    return out.select("vocabulary_size", "total_words", "hapax_count", T.share(F.col("hapax_count"), F.col("vocabulary_size")).alias("hapax_ratio"), T.share(F.col("top"), F.col("total_words")).alias("top_coverage"))


def zlib_ratio(text: Column) -> Column:
    """Compressed over plain size in bytes; null for empty texts."""

    @F.pandas_udf("double")
    def ratio(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: len(zlib.compress(t.encode())) / len(t.encode()) if t else None).astype(float)

    return ratio(text)


def compression(docs: DataFrame) -> DataFrame:
    """Mean zlib ratio of all documents that are not empty."""
    return docs.select(zlib_ratio(F.col("text")).alias("r")).agg(F.avg("r").alias("compression_ratio"))


def overlap(docs: DataFrame, benchmark: DataFrame, n: int = 10, threshold: float = 0.7, lower: bool = True) -> DataFrame:
    """``doc_id``, ``item_id``, ``overlap``: share of an item's n-gram occurrences found in a document's set, if large.

    An equi-join on the n-grams: documents meet only the items they share one with. The grams of the documents are
    first reduced to those of the benchmark by a semi join.
    """
    grams = lambda df, key: df.select(key, F.explode(T.ngrams(T.words(F.col("text"), lower), n)).alias("gram"))
    items = grams(benchmark, "item_id").groupBy("item_id", "gram").agg(F.count("*").alias("m"))
    sizes = items.groupBy("item_id").agg(F.sum("m").alias("total"))
    mine = grams(docs, "doc_id").join(items.select("gram").distinct(), "gram", "left_semi").distinct()
    shared = mine.join(items, "gram").groupBy("doc_id", "item_id").agg(F.sum("m").alias("shared"))
    out = shared.join(sizes, "item_id").select("doc_id", "item_id", (F.col("shared") / F.col("total")).alias("overlap"))
    return out.where(F.col("overlap") >= threshold)


def profile(docs: DataFrame) -> DataFrame:
    """One row of length, vocabulary, repetition and format measures of the corpus."""
    t = F.coalesce("text", F.lit(""))
    each = docs.select(T.n_words(t).alias("w"), F.when(F.size(T.words(t)) > 0, T.type_token_ratio(t)).alias("ttr"), F.when(F.size(T.solid_lines(t)) > 0, T.duplicate_line_ratio(t)).alias("dup"), F.when(t != "", T.special_ratio(t)).alias("special"))
    part = lambda cond, base: F.coalesce(F.avg(F.when(base, cond.cast("double"))), F.lit(0.0))
    row = each.agg(
        F.coalesce(F.avg("w"), F.lit(0.0)).alias("length_mean"),
        F.coalesce(F.stddev_samp("w"), F.lit(0.0)).alias("length_std"),
        part(F.col("w") < 50, F.col("w").isNotNull()).alias("short_ratio"),
        part(F.col("w") > 5000, F.col("w").isNotNull()).alias("long_ratio"),
        F.coalesce(F.avg("ttr"), F.lit(0.0)).alias("avg_ttr"),
        F.coalesce(F.avg("dup"), F.lit(0.0)).alias("avg_line_dup_ratio"),
        part(F.col("dup") > 0.3, F.col("dup").isNotNull()).alias("high_dup_docs"),
        F.coalesce(F.avg("special"), F.lit(0.0)).alias("avg_special_ratio"),
        part(F.col("special") > 0.3, F.col("special").isNotNull()).alias("noisy_docs"),
    )
    words = word_counts(docs).agg(T.share(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).alias("global_ttr"))
    return row.crossJoin(F.broadcast(words))


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, for results that are compared."""
    return df.select(*[F.round(c, places).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def as_long(c: Column) -> Column:
    return c.cast("long")
