"""As-of and interval joins against plain loops; ties, nulls, a key with most of the rows."""

import datetime
import random

from quern.operators import temporal

START = datetime.datetime(2024, 1, 1)


def at(seconds):
    return START + datetime.timedelta(seconds=seconds)


def rows(rng, n):
    return [(rng.choice([1, 1, 1, 2, 3]), at(rng.randrange(3000)) if rng.random() < 0.97 else None, i) for i in range(n)] + [(None, at(5), n)]


def test_asof(spark):
    rng = random.Random(1)
    left, right = rows(rng, 300), rows(rng, 200)
    a = spark.createDataFrame(left, "k long, ts timestamp, i int").repartition(4)
    b = spark.createDataFrame(right, "k long, ts timestamp, i int").repartition(3)
    for within, bucket in ((None, 60.0), (None, 1e6), (40.0, 60.0)):
        found = {r["i"]: (r["asof_ts"], r["asof_i"]) for r in temporal.asof_join(a, b, "k", within=within, bucket=bucket, order="i").collect()}
        assert len(found) == len(left)
        for k, t, i in left:
            ok = [(u, j) for h, u, j in right if k is not None and t is not None and u is not None and h == k and u <= t]
            best = max(ok, default=(None, None))
            if within is not None and best[0] is not None and (t - best[0]).total_seconds() > within:
                best = (None, None)
            assert found[i] == best
    assert temporal.asof_join(a, b.limit(0), "k").where("asof_i is not null").count() == 0
    assert temporal.asof_join(a.limit(0), b, "k").count() == 0


def test_interval(spark):
    rng = random.Random(2)
    left, right = rows(rng, 200), rows(rng, 200)
    a = spark.createDataFrame(left, "k long, ts timestamp, i int")
    b = spark.createDataFrame(right, "k long, ts timestamp, i int")
    for before, after in ((30, 10), (0, 45), (7, 0)):
        found = sorted((r["i"], r["right_i"]) for r in temporal.interval_join(a, b, "k", before, after).collect())
        want = sorted((i, j) for k, t, i in left for h, u, j in right if k is not None and h == k and t and u and -before <= (u - t).total_seconds() <= after)
        assert found == want
