"""Windows over metric histories (``name``, ``step``, ``value``); points that are not finite are left out first."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from quern.functions.ranks import numbered
from quern.functions.text import let, once


def finite(metrics: DataFrame) -> DataFrame:
    return metrics.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf")))


def _runs(metrics: DataFrame, before: int, block: int = 100_000) -> tuple[DataFrame, WindowSpec]:
    """The finite points with their number ``n`` in their metric, dealt into ``block``s of points, and the window along a
    block. The last ``before`` points of a block go along to the next one as guests, which ``_own`` drops again, so that
    windows of that many points are whole and no task holds all of a metric."""
    block = max(block, before)
    rows = numbered(finite(metrics).select("name", "step", "value"), "name", F.col("step"), "step", "n")
    at = F.floor((F.col("n") - 1) / block).cast("long")
    ends = F.pmod(F.col("n") - 1, F.lit(block)) >= block - before
    places = F.when(ends, F.array(F.struct(at.alias("block"), F.lit(False).alias("guest")), F.struct((at + 1).alias("block"), F.lit(True).alias("guest")))).otherwise(F.array(F.struct(at.alias("block"), F.lit(False).alias("guest"))))
    dealt = rows.withColumn("p", F.explode(places)).select("name", "step", "value", "n", "p.block", "p.guest")
    return dealt, Window.partitionBy("name", "block").orderBy("n")


def _own(rows: DataFrame) -> DataFrame:
    return rows.where("not guest").drop("guest", "block")


def moving_average(metrics: DataFrame, window: int = 100, **settings) -> DataFrame:
    rows, along = _runs(metrics, window - 1, **settings)
    return _own(rows.withColumn("smoothed", F.avg("value").over(along.rowsBetween(1 - window, 0)))).drop("n")


def spikes(metrics: DataFrame, window: int = 100, threshold: float = 3.0, **settings) -> DataFrame:
    """Points over ``threshold`` times the moving average that includes them, where that is positive."""
    return moving_average(metrics, window, **settings).where((F.col("smoothed") > 0) & (F.col("value") > threshold * F.col("smoothed")))


def loss_spikes(metrics: DataFrame, before: int = 10, threshold: float = 2.0, **settings) -> DataFrame:
    """Points over ``threshold`` times the mean of the ``before`` points ahead of them."""
    rows, along = _runs(metrics, before, **settings)
    rows = _own(rows.withColumn("recent", F.avg("value").over(along.rowsBetween(-before, -1))))
    return rows.where((F.col("n") > before) & (F.col("value") > threshold * F.col("recent"))).drop("n")


def plateaus(metrics: DataFrame, span: int = 50, change: float = 0.001, **settings) -> DataFrame:
    """Points where the mean of the last ``span`` differs from that of the span before by a relative ``change`` at most."""
    rows, along = _runs(metrics, 2 * span - 1, **settings)
    rows = _own(rows.withColumns({"late": F.avg("value").over(along.rowsBetween(1 - span, 0)), "early": F.avg("value").over(along.rowsBetween(1 - 2 * span, -span))}))
    return rows.where((F.col("n") > 2 * span) & (F.abs(F.col("late") - F.col("early")) / F.greatest(F.abs("early"), F.lit(1e-8)) < change)).drop("n")


def summary(metrics: DataFrame) -> DataFrame:
    return finite(metrics).groupBy("name").agg(F.max_by("value", "step").alias("latest"), F.min("value").alias("min"), F.max("value").alias("max"), F.count("*").alias("count"))


def routing_stats(choices: DataFrame, expert: str = "expert") -> DataFrame:
    """Load of the experts: how many were used, coefficient of variation, entropy and the busiest one's share."""
    counts = choices.groupBy(expert).agg(F.count("*").alias("n"))
    p = counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("all")))).withColumn("p", F.col("n") / F.col("all"))
    return p.agg(F.count("*").alias("n_used"), (F.stddev_samp("n") / F.avg("n")).alias("cv"), (-F.sum(F.col("p") * F.log("p"))).alias("entropy"), F.max("p").alias("top_share"))


def activation_stats(rows: DataFrame, feature: str = "feature", value: str = "value") -> DataFrame:
    """Frequency, mean, maximum and deviation of each feature's active (positive) values."""
    active = F.when(F.col(value) > 0, F.col(value))
    return rows.groupBy(feature).agg((F.count(active) / F.count("*")).alias("frequency"), F.coalesce(F.avg(active), F.lit(0.0)).alias("mean"), F.coalesce(F.max(active), F.lit(0.0)).alias("max"), F.coalesce(F.stddev_samp(active), F.lit(0.0)).alias("std"))


def feature_samples(rows: DataFrame, k: int = 10, feature: str = "feature", value: str = "value", sample: str = "sample", dead: float = 1e-6, high: float = 0.5, lots: int = 64) -> DataFrame:
    """``activation_stats`` with ``is_dead`` (active less often than ``dead``), ``is_high`` (more often than ``high``) and ``top``: the
    ``k`` samples of the largest values, best first, ties to the smaller sample.

    A feature may hold most of the rows: its samples are dealt in ``lots``, each lot keeps its best, and only these meet.
    """
    order = [F.col(value).desc(), F.col(sample)]
    lot = rows.withColumn("_lot", F.pmod(F.xxhash64(sample), F.lit(lots)))
    best = lot.withColumn("_r", F.row_number().over(Window.partitionBy(feature, "_lot").orderBy(*order))).where(F.col("_r") <= k)
    best = best.withColumn("_r", F.row_number().over(Window.partitionBy(feature).orderBy(*order))).where(F.col("_r") <= k)
    top = best.groupBy(feature).agg(F.transform(F.sort_array(F.collect_list(F.struct("_r", F.col(sample).alias("s")))), lambda x: x["s"]).alias("top"))
    return activation_stats(rows, feature, value).withColumns({"is_dead": F.col("frequency") < dead, "is_high": F.col("frequency") > high}).join(top, feature, "left")


def expert_correlation(rows: DataFrame, logits: str = "logits") -> DataFrame:
    """``a`` < ``b``, ``correlation`` of the routing probabilities (softmax of the array ``logits``) of each two experts; near 1
    means that they don't specialise. Pairs are of experts, counted per task before the shuffle; null where one never varies."""
    scores = F.col(logits).cast("array<double>")
    powers = let(scores, lambda v: let(F.array_max(v), lambda top: F.transform(v, lambda x: F.exp(x - top))))
    probability = let(powers, lambda p: let(F.aggregate(p, F.lit(0.0), lambda s, x: s + x), lambda total: F.transform(p, lambda x: x / total)))
    known = once(rows.select(logits), {"p": probability}).select("p", F.posexplode("p").alias("a", "x"))
    pairs = known.select("a", "x", F.posexplode("p").alias("b", "y")).where("a < b")
    return pairs.groupBy("a", "b").agg(F.corr("x", "y").alias("correlation"))


def clusters(vectors: DataFrame, k: int, seed: int = 42, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``key`` and ``cluster`` by k-means, with parallel seeding of the centres."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = vectors.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    model = KMeans(k=k, seed=seed).fit(rows)
    return model.transform(rows).select(key, F.col("prediction").alias("cluster"))
