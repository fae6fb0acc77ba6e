"""Seeded draws and row numbers that need no task per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(seed: int, *columns) -> Column:
    """A number in [0, 1) from the seed and the columns' text: the first 13 hex digits of an MD5 over 16^13."""
    parts = [F.col(c) if isinstance(c, str) else c for c in columns]
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def numbered(df: DataFrame, group: str, order: Column, ties: str, name: str = "_n", lots: int | None = None) -> DataFrame:
    """``df`` with ``name``: rows numbered from 1 inside ``group`` by the number ``order``, then ``ties``.

    A group may hold a third of all rows, so it isn't sorted by one task: rows are dealt by (group, range of ``order``),
    whose bounds are quantiles, numbered inside that, and raised by the counts of the ranges before.
    """
    lots = lots or max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = sorted(set(df.select(F.percentile_approx(order, [i / lots for i in range(1, lots)], 20 * lots)).first()[0] or []))
    dealt = df.withColumn("_lot", F.size(F.filter(F.lit(cuts), lambda c: c <= order)) if cuts else F.lit(0))
    counts = dealt.groupBy(group, "_lot").agg(F.count("*").alias("_c"))
    upto = Window.partitionBy(group).orderBy("_lot")
    base = counts.select(F.col(group).alias("_group"), F.col("_lot").alias("_of"), (F.sum("_c").over(upto) - F.col("_c")).alias("_base"))
    inside = dealt.withColumn("_in", F.row_number().over(Window.partitionBy(group, "_lot").orderBy(order, ties)))
    joined = inside.join(base, inside[group].eqNullSafe(base["_group"]) & (inside["_lot"] == base["_of"]))
    return joined.select(*[inside[c] for c in df.columns], (F.col("_in") + F.col("_base")).alias(name))


def indexed(df: DataFrame, order: str, name: str = "_id") -> DataFrame:
    """``df`` with ``name``: its rows numbered from 0 without gaps in ``order`` (null first), by ranges, ties as they come.

    The rows are written in order; the sizes of the ranges are broadcast.
    """
    from quern.operators.dedup import persisted

    dealt = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(order, "_tie").sortWithinPartitions(order, "_tie")
    rows = persisted(dealt.drop("_tie").withColumn("_at", F.monotonically_increasing_id()))
    sizes = rows.groupBy(F.shiftright("_at", 33).alias("_part")).agg(F.count("*").alias("_rows"))
    before = F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    bases = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_base"))
    placed = rows.join(F.broadcast(bases), F.shiftright("_at", 33) == F.col("_part"))
    return placed.select(*df.columns, (F.col("_base") + F.col("_at").bitwiseAND((1 << 33) - 1)).alias(name))


def in_blocks(rows: DataFrame, queries: DataFrame, key: str = "query_id", most: int = 10_000) -> DataFrame:
    """Every row with every query of a stated set, which is sent to the tasks in blocks of about ``most`` queries, one
    pass over the rows for each block, so what is broadcast is bounded however many queries there are."""
    blocks = max(1, -(-queries.count() // most))
    out = None
    for b in range(blocks):
        part = rows.join(F.broadcast(queries.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == b)))
        out = part if out is None else out.unionAll(part)
    return out
