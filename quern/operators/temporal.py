"""Joins in time: the last row before each (as-of), and all rows within a distance (interval), dealt in buckets of time.

No task holds all rows of a key: rows are dealt by key and time bucket. What an as-of join must carry over from earlier
buckets is one row a bucket; an interval join copies the left rows to the one or two buckets that their interval meets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _micros(ts: Column | str) -> Column:
    """Microseconds of a time, with or without a zone."""
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def _bucket(ts: Column, seconds: float) -> Column:
    return F.floor(_micros(ts) / int(seconds * 1_000_000)).cast("long")


def asof_join(left: DataFrame, right: DataFrame, key: str, ts: str = "ts", values: list[str] | None = None, within: float | None = None, bucket: float = 86_400.0, order: str | None = None) -> DataFrame:
    """``left`` with the ``values`` of the last row of ``right`` of the same key at or before its time, prefixed ``asof_``, and that
    time; null where there is none, or none ``within`` so many seconds.

    Rows of ``right`` at one time go by ``order`` (the largest wins; by their values without it). A null key matches nothing;
    rows of ``left`` without a key or a time stay, with nulls.
    """
    values = values if values is not None else [c for c in right.columns if c not in (key, ts)]
    shown = F.struct(F.col(ts).alias("ts"), F.col(order or ts).alias("o"), *[F.col(c).alias(f"v{i}") for i, c in enumerate(values)])
    known = right.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(F.col(key).alias("_k"), F.col(ts).alias("_t"), shown.alias("_r"))
    known = known.select("_k", _bucket(F.col("_t"), bucket).alias("_b"), "_t", "_r")
    whole = F.struct(*[F.col(f"`{c}`") for c in left.columns])
    asked = left.select(F.col(key).alias("_k"), _bucket(F.col(ts), bucket).alias("_b"), F.col(ts).alias("_t"), whole.alias("_l"))
    usable = F.col("_k").isNotNull() & F.col("_t").isNotNull()

    # inside a bucket: the largest row of the right side so far, those of the same time included
    both = asked.where(usable).select("*", F.lit(None).cast(known.schema["_r"].dataType).alias("_r")).unionByName(known.select("*", F.lit(None).cast(asked.schema["_l"].dataType).alias("_l")))
    upto = Window.partitionBy("_k", "_b").orderBy(_micros("_t")).rangeBetween(Window.unboundedPreceding, 0)
    inside = both.withColumn("_in", F.max("_r").over(upto)).where("_l is not null")

    # from the buckets before: one row a bucket, the last of each carried on
    last = known.groupBy("_k", "_b").agg(F.max("_r").alias("_r")).unionByName(asked.where(usable).select("_k", "_b").distinct().withColumn("_r", F.lit(None).cast(known.schema["_r"].dataType)))
    ends = last.groupBy("_k", "_b").agg(F.max("_r").alias("_r"))
    before = ends.withColumn("_before", F.max("_r").over(Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))).select("_k", "_b", "_before")
    found = inside.join(before, ["_k", "_b"], "left").select("_l", "_t", F.coalesce("_in", "_before").alias("_f"))
    if within is not None:
        near = _micros("_t") - _micros("_f.ts") <= int(within * 1_000_000)
        found = found.withColumn("_f", F.when(near, F.col("_f")))
    rest = asked.where(~F.coalesce(usable, F.lit(False))).select("_l", "_t", F.lit(None).cast(known.schema["_r"].dataType).alias("_f"))
    out = found.unionByName(rest)
    return out.select("_l.*", F.col("_f.ts").alias(f"asof_{ts}"), *[F.col(f"_f.v{i}").alias(f"asof_{c}") for i, c in enumerate(values)])


def interval_join(left: DataFrame, right: DataFrame, key: str, before: float, after: float, ts: str = "ts") -> DataFrame:
    """Pairs of one key whose right time lies from ``before`` seconds before the left time to ``after`` after it, both included.

    Columns of the right side are prefixed ``right_``. Buckets are as wide as the interval, so a left row is copied to at most
    two of them and a right row stands in one; every pair comes once. Null keys and times match nothing.
    """
    if before < 0 or after < 0 or before + after <= 0:
        raise ValueError("the interval must have a length")
    width = before + after
    low, high = (_micros(ts) - int(before * 1_000_000)), (_micros(ts) + int(after * 1_000_000))
    span = int(width * 1_000_000)
    a = left.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select("*", low.alias("_low"), high.alias("_high"))
    a = a.select("*", F.explode(F.sequence(F.floor(F.col("_low") / span), F.floor(F.col("_high") / span))).alias("_b"))
    b = right.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(*[F.col(c).alias(f"right_{c}") for c in right.columns], _bucket(F.col(ts), width).alias("_rb"))
    t = _micros(f"right_{ts}")
    met = a.join(b, (F.col(key) == F.col(f"right_{key}")) & (F.col("_b") == F.col("_rb")) & (t >= F.col("_low")) & (t <= F.col("_high")))
    return met.drop("_low", "_high", "_b", "_rb")
