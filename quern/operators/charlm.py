"""Character n-gram language model: counts, perplexity, and importance weights between two corpora."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.dedup import persisted


def grams(docs: DataFrame, n: int = 3, key: str | None = "doc_id") -> DataFrame:
    """``key``, ``gram``, ``context``, ``m``: the distinct character n-grams of each lower-cased text, their first n - 1 characters,
    and how often the text has them, counted inside the row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                rows, found, times = [], [], []
                for i, text in enumerate(batch.column(0).slice(start, 256).to_pylist(), start):
                    counted = Counter(map("".join, zip(*[text[k:] for k in range(n)], strict=False))) if text else {}
                    rows += [i] * len(counted)
                    found += counted
                    times += counted.values()
                keys = [batch.column(1).take(pa.array(rows, pa.int64()))] if key else []
                yield pa.RecordBatch.from_arrays([*keys, pa.array(found, pa.string()), pa.array(times, pa.int64())], names=[*([key] if key else []), "gram", "m"])

    kept = f"{key} {dict(docs.dtypes)[key]}, " if key else ""
    rows = docs.select(F.lower("text").alias("_t"), *([key] if key else [])).mapInArrow(count, f"{kept}gram string, m long")
    return rows.withColumn("context", F.substring("gram", 1, n - 1))


def fit(docs: DataFrame, n: int = 3) -> tuple[DataFrame, DataFrame, int]:
    """Counts of n-grams and of contexts, and the number of distinct characters; the counts are written."""
    counts = persisted(grams(docs, n, None).groupBy("gram", "context").agg(F.sum("m").alias("n_gram")))
    contexts = counts.groupBy("context").agg(F.sum("n_gram").alias("n_context"))
    vocabulary = docs.select(F.explode(F.array_distinct(F.split(F.lower("text"), ""))).alias("c")).where("c <> ''").distinct().count()
    return counts.select("gram", "n_gram"), contexts, vocabulary


def _sent(table: DataFrame, small: int = 500_000) -> DataFrame:
    """A table of counts, broadcast while it has at most ``small`` rows."""
    return F.broadcast(table) if table.count() <= small else table


def _coded(text: str, n: int) -> np.ndarray:
    """The ``n``-grams of a text as numbers, 21 bits a character; ``n`` is 3 at most."""
    x = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
    size = max(0, len(x) - n + 1)
    return sum((x[k : k + size] << 21 * (n - 1 - k) for k in range(n)), np.zeros(size, np.int64))


def _log_sums(docs: DataFrame, counts: DataFrame, vocabulary: int, n: int, span: int = 1 << 20) -> DataFrame:
    """``doc_id``, ``log_p``, ``m``: the sum of the log-probabilities of each text's grams, and their number, made inside the row
    from a broadcast of the sorted model. Beside the place of a gram that it lacks stands one of the same context, if any does."""
    known = counts.toArrow()
    model = _coded("".join(known["gram"].to_pylist()), n)[::n]
    order = np.argsort(model)
    model, times = model[order], known["n_gram"].to_numpy()[order]
    of = np.unique(model >> 21, return_inverse=True)[1]
    rest = np.log(np.bincount(of, times)[of] + vocabulary)
    ends = [[-1 << 42], [(1 << 63) - 1]]  # no character has these contexts
    model, found, missed = (np.concatenate([first, x, last]) for first, x, last in ((ends[0], model, ends[1]), ([0.0], np.log(times + 1) - rest, [0.0]), ([0.0], -rest, [0.0])))
    sent, unseen = docs.sparkSession.sparkContext.broadcast((model, found, missed)), -math.log(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, found, missed = sent.value
        for batch in batches:
            sums, sizes = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for i, value in enumerate(batch.column(0)):
                text = value.as_py() or ""
                for start in range(0, len(text), span):
                    g = _coded(text[start : start + span + n - 1], n)
                    at = np.searchsorted(model, g)
                    hit, context = model[at] == g, g >> 21
                    at -= model[at] >> 21 != context
                    sums[i] += np.where(hit, found[at], np.where(model[at] >> 21 == context, missed[at], unseen)).sum()
                    sizes[i] += len(g)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(sums), pa.array(sizes)], names=["doc_id", "log_p", "m"])

    rows = docs.select(F.lower("text").alias("_t"), "doc_id")
    return rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, log_p double, m long").where("m > 0")


def perplexity(docs: DataFrame, reference: DataFrame, n: int = 3, small: int = 500_000) -> DataFrame:
    """``doc_id``, ``perplexity`` under the add-one model of ``reference``; infinite for texts under n characters.

    A document's grams are added up inside its row under a model of at most ``small`` grams, which the alphabet bounds; under
    a larger one they are counted inside the row and meet the model in joins.
    """
    counts, contexts, vocabulary = fit(reference, n)
    if n <= 3 and 0 < counts.count() <= small:
        sums = _log_sums(docs, counts, vocabulary, n)
    else:
        scored = grams(docs, n).join(_sent(counts, small), "gram", "left").join(_sent(contexts, small), "context", "left")
        p = (F.coalesce("n_gram", F.lit(0)) + 1) / (F.coalesce("n_context", F.lit(0)) + vocabulary)
        sums = scored.select("doc_id", (F.col("m") * F.log(p)).alias("log_p"), "m")
    per_doc = sums.groupBy("doc_id").agg(F.exp(-F.sum("log_p") / F.sum("m")).alias("perplexity"))
    return docs.select("doc_id").join(per_doc, "doc_id", "left").select("doc_id", F.coalesce("perplexity", F.lit(float("inf"))).alias("perplexity"))


def perplexity_filter(ppl: Column, low: float = 10.0, high: float = 1000.0) -> tuple[Column, Column]:
    """Passed if within the bounds; score 1 at their geometric mean, falling to 0 at either on the log scale."""
    middle, reach = (math.log(low) + math.log(high)) / 2, (math.log(high) - math.log(low)) / 2
    passed = ppl.between(low, high)
    return passed, F.when(passed, F.greatest(F.lit(0.0), 1 - F.abs(F.log(ppl) - middle) / reach)).otherwise(0.0)


def importance(docs: DataFrame, target: DataFrame, source: DataFrame, n: int = 3) -> DataFrame:
    """``doc_id`` and mean log ratio of the target's to the source's add-one gram probabilities."""
    t, _, v = fit(target, n)
    s = fit(source, n)[0]
    nt, ns = t.agg(F.sum("n_gram").alias("nt")), s.agg(F.sum("n_gram").alias("ns"))
    joined = grams(docs, n).join(_sent(t.withColumnRenamed("n_gram", "t")), "gram", "left").join(_sent(s.withColumnRenamed("n_gram", "s")), "gram", "left").crossJoin(F.broadcast(nt.crossJoin(ns)))
    ratio = F.log((F.coalesce("t", F.lit(0)) + 1) / (F.col("nt") + v)) - F.log((F.coalesce("s", F.lit(0)) + 1) / (F.col("ns") + v))
    return joined.groupBy("doc_id").agg((F.sum(F.col("m") * ratio) / F.sum("m")).alias("log_importance"))
