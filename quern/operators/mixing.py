"""Mixture weights, sampling and schedules."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.ranks import draw, numbered


def temperature_weights(sources: DataFrame, temperature: float = 1.0, weight: str = "weight") -> DataFrame:
    """``sources`` with ``p`` = weight^(1/T) / sum; T = 0 puts all on the largest. One row a source: a small table."""
    over = Window.partitionBy()
    raw = F.pow(F.col(weight), F.lit(1.0 / temperature)) if temperature else (F.col(weight) == F.max(weight).over(over)).cast("double")
    out = sources.withColumn("_raw", raw)
    return out.withColumn("p", F.when(F.sum("_raw").over(over) > 0, F.col("_raw") / F.sum("_raw").over(over)).otherwise(F.col("_raw"))).drop("_raw")


def sample_proportional(docs: DataFrame, weights: DataFrame, n: int, seed: int = 42, source: str = "source") -> DataFrame:
    """``n`` draws with replacement: a source by its weight ``p``, then a document of it; ``draw``, ``source``, ``doc_id``."""
    spark = docs.sparkSession
    upto = weights.select(source, "p", F.sum("p").over(Window.orderBy(source)).alias("hi")).withColumn("lo", F.col("hi") - F.col("p"))
    draws = spark.range(n).withColumnRenamed("id", "draw").withColumn("u", draw(seed, "draw"))
    picked = draws.join(F.broadcast(upto), (F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi"))).select("draw", source)
    sizes = docs.groupBy(source).agg(F.count("*").alias("_size"))
    ranked = numbered(docs.select("doc_id", source), source, F.col("doc_id"), "doc_id", "_rank")
    chosen = picked.join(sizes, source).withColumn("_rank", F.floor(draw(seed + 1, "draw") * F.col("_size")).cast("long") + 1)
    return chosen.join(ranked, [source, "_rank"]).select("draw", source, "doc_id")


def allocate(weights: DataFrame, n: int, source: str = "source") -> DataFrame:
    """``quota`` of each source: half-even rounding of p*n; the last by name takes the remainder."""
    by_name = Window.partitionBy().orderBy(source)
    rounded = weights.withColumn("_q", F.bround(F.col("p") * n).cast("long"))
    last = F.row_number().over(Window.partitionBy().orderBy(F.desc(source))) == 1
    before = F.coalesce(F.sum("_q").over(by_name.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rounded.withColumn("quota", F.when(last, F.greatest(F.lit(0), F.lit(n) - before)).otherwise(F.col("_q"))).drop("_q")


def round_robin(docs: DataFrame, weights: DataFrame, n: int, seed: int = 42, source: str = "source") -> DataFrame:
    """``quota`` documents of each source, going round its documents in a seeded order; ``source``, ``turn``, ``doc_id``."""
    quota = allocate(weights, n, source).select(source, F.explode(F.when(F.col("quota") > 0, F.sequence(F.lit(0).cast("long"), F.col("quota") - 1))).alias("turn"))
    shuffled = numbered(docs.select("doc_id", source), source, draw(seed, "doc_id"), "doc_id", "_rank")
    sizes = docs.groupBy(source).agg(F.count("*").alias("_size"))
    turns = quota.join(sizes, source).withColumn("_rank", F.pmod("turn", "_size") + 1)
    return turns.join(shuffled, [source, "_rank"]).select(source, "turn", "doc_id")


def mix_statistics(sample: DataFrame, weights: DataFrame, source: str = "source") -> DataFrame:
    """Documents drawn and their share for each source, beside the share wanted."""
    counts = sample.groupBy(source).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return weights.join(counts, source, "left").crossJoin(F.broadcast(total)).select(source, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.col("n") / F.col("total"), F.lit(0.0)).alias("share"), "p")


def curriculum_alpha(step: Column, total: int, strategy: str = "linear", warmup: int = 0) -> Column:
    """How far the schedule has gone from the first to the last weights at ``step``."""
    progress = F.least(F.lit(1.0), (step - warmup) / float(max(total - warmup, 1)))
    shapes = {"linear": progress, "cosine": 0.5 * (1 - F.cos(progress * math.pi)), "step": F.least(F.lit(1.0), F.floor(progress * 4) / 3)}
    return F.when(step <= warmup, 0.0).otherwise(shapes[strategy])


def curriculum(sources: DataFrame, total: int, points: int = 10, strategy: str = "linear", warmup: int = 0) -> DataFrame:
    """Weight of each source (``initial`` to ``final``) at ``points`` + 1 steps."""
    steps = sources.sparkSession.range(points + 1).select(F.floor(F.col("id") / points * total).cast("long").alias("step"))
    alpha = curriculum_alpha(F.col("step"), total, strategy, warmup)
    return steps.crossJoin(F.broadcast(sources)).withColumn("weight", F.col("initial") + alpha * (F.col("final") - F.col("initial")))


def domain_epochs(docs: DataFrame, temperature: float, n: int, domain: str = "source") -> DataFrame:
    """Size, sampling weight size^(1/T) and mean passes over each domain in ``n`` draws."""
    sizes = docs.groupBy(domain).agg(F.count("*").alias("size"))
    raw = sizes.withColumn("_raw", F.pow("size", F.lit(1.0 / temperature)) if temperature > 0 else F.lit(1.0))
    out = raw.crossJoin(F.broadcast(raw.agg(F.sum("_raw").alias("_all"))))
    return out.select(domain, "size", (F.col("_raw") / F.col("_all")).alias("p"), (F.col("_raw") / F.col("_all") * n / F.col("size")).alias("epochs"))


def replay(new: DataFrame, old: DataFrame, ratio: float, seed: int = 42, key: str = "doc_id") -> DataFrame:
    """``new`` and a hash sample of ``old`` that makes about ``ratio`` of the mix."""
    wanted = new.agg(F.count("*").alias("n")).crossJoin(F.broadcast(old.agg(F.count("*").alias("m"))))
    part = old.crossJoin(F.broadcast(wanted)).where(draw(seed, key) < F.col("n") * ratio / (1 - ratio) / F.greatest("m", F.lit(1)))
    return new.unionByName(part.select(new.columns))
