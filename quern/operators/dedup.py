"""Exact, near and semantic duplicates.

Exact copies collapse first, by a pre-aggregated minimum, so no later step sees a group of copies. Near duplicates are
found among the distinct texts: by MinHash bands, or without loss by a prefix-filtered set join.
"""

from __future__ import annotations

import hashlib
import math
import random
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text as T

PRIME = (1 << 61) - 1
TOP = (1 << 32) - 1


_OWN: list[str] = []


def persisted(df: DataFrame) -> DataFrame:
    """Written to the folder in spark.checkpoint.dir and read back, so that loops don't grow a lineage.

    A local session without that setting gets a temporary folder; on a cluster, whose executors would each write to their
    own disk, its absence is an error.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _OWN:
            _OWN.append("file://" + tempfile.mkdtemp(prefix="quern-"))
        folder = _OWN[0]
    path = f"{folder.rstrip('/')}/quern-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quern_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete the files of a ``persisted`` table that no later plan reads, as a loop does with its earlier rounds."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._quern_path)
    path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def sha256_key(text: Column) -> Column:
    return F.sha2(text, 256)


def line_key(text: Column) -> Column:
    """MD5 of the stripped text's stripped lines."""
    return F.md5(F.array_join(F.transform(T.lines(T.strip(text)), T.strip), "\n"))


def keep_first(docs: DataFrame, key: Column, order: str = "doc_id", small: int = 1_000_000) -> DataFrame:
    """One row for each distinct key, that of the smallest ``order``; rows with a null key all stay.

    Only orders and keys are shuffled to find the rows that go, which are written: a text never is, unless more than
    ``small`` rows go, which are not broadcast then.
    """
    keyed = docs.where(key.isNotNull()).select(F.col(order).alias("_order"), key.alias("_key"))
    first = keyed.groupBy("_key").agg(F.min("_order").alias("_first"))
    gone = persisted(keyed.join(first, "_key").where(~F.col("_order").eqNullSafe(F.col("_first"))).select("_order", F.xxhash64("_key").alias("_mark")).distinct())
    marked = docs.withColumn("_mark_of", F.xxhash64(key))
    same = F.col(order).eqNullSafe(F.col("_order")) & (F.col("_mark_of") == F.col("_mark"))
    return marked.join(_sent(gone, small), same, "left_anti").drop("_mark_of")


def _sent(rows: DataFrame, small: int) -> DataFrame:
    """A written table, to be broadcast if it has at most ``small`` rows."""
    return F.broadcast(rows) if rows.count() <= small else rows


def without(docs: DataFrame, gone: DataFrame, key: str = "doc_id", small: int = 1_000_000) -> DataFrame:
    """``docs`` whose ``key`` is not in ``gone``, a table of written rows, without a shuffle of ``docs`` unless there are many."""
    return docs.join(_sent(gone, small), key, "left_anti")


def unique_paragraphs(docs: DataFrame, order: str = "doc_id", least: int = 3) -> DataFrame:
    """Texts without the paragraphs (lines of ``least`` words or more) that occurred before, by ``order`` and position."""
    rows = docs.select(order, F.posexplode(T.lines(F.col("text"))).alias("at", "line"))
    rows = rows.withColumn("key", F.when(F.size(T.words(F.col("line"))) >= least, F.md5(T.strip(F.lower("line")))))
    first = rows.where("key is not null").groupBy("key").agg(F.min(F.struct(order, "at")).alias("f"))
    seen = rows.join(first, "key", "left").where(F.col("key").isNull() | (F.col("f") == F.struct(order, "at")))
    joined = seen.groupBy(order).agg(F.sort_array(F.collect_list(F.struct("at", "line"))).alias("l"))
    return docs.select(order).join(joined, order, "left").select(order, F.coalesce(F.array_join(F.col("l.line"), "\n"), F.lit("")).alias("text"))


def hash_parameters(k: int = 128, seed: int = 42) -> list[tuple[int, int]]:
    """Multipliers and offsets of ``k`` hash functions over the 61-bit prime."""
    rng = random.Random(seed)
    return [(rng.randint(1, PRIME - 1), rng.randint(0, PRIME - 1)) for _ in range(k)]


def minhash(docs: DataFrame, k: int = 128, n: int = 5, seed: int = 42, key: str = "doc_id") -> DataFrame:
    """``key`` and ``signature``: k minima of (a*x + b) mod 2^61-1, low 32 bits, over the hashed ``n``-word shingles.

    Spark hashes the shingles; a row sends Python one string of eight hex digits a shingle. A minimum is over the low halves
    of a*x + b and of its quotient by the prime together. The quotient comes from floating point, with an error of under
    2^-20; the few that near to a whole number are made from whole numbers.
    """
    a, b = zip(*hash_parameters(k, seed), strict=True)
    slope, start = np.array([x / PRIME for x in a]), np.array([x / PRIME - 0.5 for x in b])
    a_low, b_low = (np.array([x & TOP for x in c], np.uint32) for c in (a, b))
    rounding, sure, span = 1.5 * 2.0**52, 0.5 - 2.0**-19, max(1, (1 << 14) // k)

    def signature(hexed: str | None) -> list[int]:
        low = np.full(k, TOP, np.uint32)
        every = np.unique(np.frombuffer(bytes.fromhex(hexed or ""), ">u4")).astype(np.uint32)
        for i in range(0, len(every), span):
            x = every[i : i + span, None]
            rest = x * slope
            rest += start
            quotient = rest + rounding  # its low 32 bits are now those of the nearest whole number
            value = x * a_low
            value += b_low
            value += quotient.view("<u4")[:, ::2]
            quotient -= rounding
            rest -= quotient
            if max(rest.max(), -rest.min()) > sure:
                for r, c in np.argwhere(np.abs(rest) > sure):
                    value[r, c] = (a[c] * int(x[r, 0]) + b[c]) % PRIME & TOP
            np.minimum(low, value.min(axis=0), out=low)
        return low.tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [signature(s.as_py()) for s in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int64()))], names=[key, "signature"])

    mark = lambda s: F.substring(F.md5(s), 1, 8)
    each = lambda w: F.array_join(F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: mark(F.concat_ws(" ", *[F.get(w, i + j) for j in range(n)]))), "")
    hexed = T.let(T.words(F.col("text")), lambda w: F.when(F.size(w) >= n, each(w)).otherwise(mark(T.strip(F.lower("text")))))
    return docs.select(key, hexed.alias("hexed")).mapInArrow(run, f"{key} {dict(docs.dtypes)[key]}, signature array<bigint>")


def signature_likeness(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.size(a)


def bands(signatures: DataFrame, b: int = 16, key: str = "doc_id") -> DataFrame:
    """``key``, ``band``, ``slice``: the signature cut into ``b`` equal parts."""
    r = F.size("signature") / b
    cut = F.transform(F.sequence(F.lit(0), F.lit(b - 1)), lambda i: F.slice("signature", (i * r + 1).cast("int"), r.cast("int")))
    return signatures.select(key, F.posexplode(cut).alias("band", "slice"))


def candidate_probability(s: Column, b: int = 16, r: int = 8) -> Column:
    return 1 - F.pow(1 - F.pow(s, r), b)


def lsh_threshold(b: int = 16, r: int = 8) -> float:
    return (1 / b) ** (1 / r)


def lsh_candidates(signatures: DataFrame, b: int = 16, key: str = "doc_id") -> DataFrame:
    """Links between documents that share a band slice, each to the bucket's smallest id: a star, never all pairs.

    Every pair of a bucket is joined over its star, so components of candidates are those of all pairs.
    """
    rows = persisted(bands(signatures, b, key))  # else the signatures would be made for both sides of the join
    least = rows.groupBy("band", "slice").agg(F.min(key).alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    return rows.join(least, ["band", "slice"]).where(F.col(key) > F.col("a")).select("a", F.col(key).alias("b")).distinct()


def _rarest(sets: DataFrame, threshold: float, key: str, slots: int = 1 << 20) -> DataFrame:
    """``key``, ``size``, ``gram``: of each set of ``grams`` the |x| - ceil(t*|x|) + 1 rarest.

    Rarity is the number of grams of all sets in the same of ``slots`` classes of hashes, which no gram's own number exceeds;
    the table of classes is broadcast. Any order that all sets share would do for the prefix filter. The tasks' tables travel
    as compressed pieces, and what is kept is written in arrays.
    """
    piece = min(slots, 1 << 14)

    def flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        return pc.list_flatten(batch.column(2)).to_numpy(), pc.list_value_length(batch.column(2)).to_numpy()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(slots, np.int64)
        for batch in batches:
            total += np.bincount(flat(batch)[0] & (slots - 1), minlength=slots)
        used = [i for i in range(0, slots, piece) if total[i : i + piece].any()]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array([zlib.compress(total[i : i + piece], 1) for i in used], pa.binary())], names=["at", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[at] = total.get(at, 0) + np.frombuffer(zlib.decompress(n), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([n.tobytes() for n in total.values()], pa.binary())], names=["at", "n"])

    rows = sets.select(key, "size", "grams")
    found = rows.mapInArrow(count, "at long, n binary").repartition("at").mapInArrow(add, "at long, n binary").toArrow()
    table = np.zeros(slots, np.int64)
    for at, n in zip(found["at"].to_pylist(), found["n"].to_pylist(), strict=True):
        table[at : at + piece] = np.frombuffer(n, np.int64)
    sent = sets.sparkSession.sparkContext.broadcast(table)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                grams, size = flat(batch)
                of = np.repeat(np.arange(len(size)), size)
                order = np.lexsort((grams, sent.value[grams & (slots - 1)], of))
                place = np.arange(len(grams)) - np.repeat(np.cumsum(size) - size, size)
                # a little less than t*|x|, as it is rounded up
                most = (size - np.ceil(threshold * size - 1e-9) + 1).astype(np.int64)
                kept = place < most[of]
                ends = np.concatenate([[0], np.cumsum(np.minimum(most, size))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(ends), pa.array(grams[order][kept]))], names=[key, "size", "grams"])

    short = persisted(rows.mapInArrow(take, f"{key} {dict(sets.dtypes)[key]}, size int, grams array<long>"))
    return short.select(key, "size", F.explode("grams").alias("gram"))


def _marks(grams: DataFrame, slots: int) -> np.ndarray:
    """A bit for each of ``slots`` classes of hashes, set where one of ``grams`` falls; Spark makes it in pieces of 4 kB."""
    place = F.col("gram").bitwiseAND(slots - 1) + 1  # Spark counts places from 1
    pieces = grams.select(F.bitmap_bucket_number(place).alias("b"), F.bitmap_bit_position(place).alias("p")).groupBy("b").agg(F.bitmap_construct_agg("p").alias("bits")).toArrow()
    marks = np.zeros(slots // 8, np.uint8)
    for b, bits in zip(pieces["b"].to_pylist(), pieces["bits"].to_pylist(), strict=True):
        marks[4096 * (b - 1) : 4096 * b] = np.frombuffer(bits, np.uint8)
    return marks


def _prefixes(docs: DataFrame, threshold: float, n: int, key: str, slots: int = 1 << 27) -> tuple[DataFrame, DataFrame]:
    """``sets``: the hashed shingles of each distinct text (not written); ``prefix``: the prefix shingles that texts share.

    Exact copies are represented by their smallest id. Sets of similarity t share one of the |x| - ceil(t*|x|) + 1 rarest
    shingles of each (prefix filter). Those that occur more than once are marked in a table of ``slots`` bits, and only marked
    ones leave their text: a few that are alone come along, and meet nothing.
    """
    one = keep_first(docs.where("text is not null").select(key, "text"), sha256_key(F.lower("text")), key)
    sets = T.once(one, {"grams": T.hashed_shingles(F.col("text"), n)}).select(key, F.size("grams").alias("size"), "grams")
    each = _rarest(sets, threshold, key)
    sent = docs.sparkSession.sparkContext.broadcast(_marks(each.groupBy("gram").agg(F.count("*").alias("df")).where("df > 1"), slots))

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = batch.column(2).to_numpy() & (slots - 1)
            yield batch.filter(pa.array(sent.value[slot >> 3] >> (slot & 7).astype(np.uint8) & 1 == 1))

    return sets, persisted(each.mapInArrow(shared, f"{key} {dict(docs.dtypes)[key]}, size int, gram long"))


def _alike(pairs: DataFrame, sets: DataFrame, prefix: DataFrame, threshold: float, key: str, small: int = 1_000_000) -> DataFrame:
    """Of the candidate ``pairs`` (``a``, ``b``, sizes ``na``, ``nb``) those of a Jaccard of ``threshold`` or more.

    Prefixes follow one order, so what is common beyond the common shingles of both prefixes lies behind the prefix that ends
    first. Only pairs that can still be similar by that bound meet with their sets, which are made for their texts alone.
    """
    pairs = pairs.where((F.col("na") >= threshold * F.col("nb")) & (F.col("nb") >= threshold * F.col("na"))).distinct()
    held = prefix.groupBy(key).agg(F.collect_list("gram").alias("p"))
    met = pairs.join(held.select(F.col(key).alias("a"), F.col("p").alias("pa")), "a").join(held.select(F.col(key).alias("b"), F.col("p").alias("pb")), "b")
    rest = F.ceil(threshold * F.greatest("na", "nb") - 1e-9) - 1
    bound = F.size(F.array_intersect("pa", "pb")) + rest >= threshold / (1 + threshold) * (F.col("na") + F.col("nb")) - 1e-6
    few = persisted(met.where(bound).select("a", "b", "na", "nb"))
    ids = persisted(few.select(F.col("a").alias("_id")).unionAll(few.select("b")).distinct())
    own = sets.join(_sent(ids, small), F.col(key) == F.col("_id"), "left_semi")
    met = few.join(own.select(F.col(key).alias("a"), F.col("grams").alias("ga")), "a").join(own.select(F.col(key).alias("b"), F.col("grams").alias("gb")), "b")
    common = F.size(F.array_intersect("ga", "gb"))
    return met.select("a", "b", (common / (F.col("na") + F.col("nb") - common)).alias("jaccard")).where(F.col("jaccard") >= threshold)


def similar_pairs(docs: DataFrame, threshold: float = 0.8, n: int = 5, key: str = "doc_id") -> DataFrame:
    """All pairs ``a`` < ``b`` of distinct texts whose shingle sets have Jaccard of ``threshold`` or more, with ``jaccard``.

    Candidates share a shingle of their prefixes; no pair is lost.
    """
    sets, prefix = _prefixes(docs, threshold, n, key)
    left, right = prefix.select(F.col(key).alias("a"), F.col("size").alias("na"), "gram"), prefix.select(F.col(key).alias("b"), F.col("size").alias("nb"), "gram")
    return _alike(left.join(right, "gram").where("a < b").select("a", "b", "na", "nb"), sets, prefix, threshold, key)


def similar_links(docs: DataFrame, threshold: float = 0.8, n: int = 5, key: str = "doc_id", stars: int = 3) -> DataFrame:
    """Links ``a``, ``b`` between similar texts with the components of ``similar_pairs``, but not all pairs of a group.

    A round compares the holders of each prefix shingle with one of them, which a hash of the round draws, so a group of
    near copies becomes one component for a row each. Shingles whose holders are one component already take no further
    part. At last the holders of a shingle that are in different components are all compared, so no component is missed.
    """
    sets, prefix = _prefixes(docs, threshold, n, key)

    def holders(label: DataFrame) -> DataFrame:
        held = prefix.join(label, prefix[key] == label["v"], "left").select("gram", key, "size", F.coalesce("label", key).alias("label"))
        split = held.groupBy("gram").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("gram")
        return persisted(held.join(split, "gram"))

    links = prefix.select(F.col(key).alias("a"), F.col(key).alias("b")).limit(0)
    held = holders(links.toDF("v", "label"))
    for turn in range(stars):
        centre = held.groupBy("gram").agg(F.min_by(F.struct(F.col(key).alias("a"), F.col("size").alias("na"), F.col("label").alias("la")), F.xxhash64(F.col(key), F.lit(turn))).alias("c")).select("gram", "c.*")
        pairs = held.join(centre, "gram").where("la <> label").select("a", F.col(key).alias("b"), "na", F.col("size").alias("nb"))
        more = persisted(_alike(pairs, sets, prefix, threshold, key).select("a", "b"))
        if more.isEmpty():
            break
        links = links.unionAll(more)
        release(held)
        held = holders(components(links))
    if held.isEmpty():
        return links
    labels = held.select("gram", "label").distinct()
    apart = labels.select("gram", F.col("label").alias("la")).join(labels.select("gram", F.col("label").alias("lb")), "gram").where("la < lb")
    left = held.select("gram", F.col("label").alias("la"), F.col(key).alias("a"), F.col("size").alias("na"))
    right = held.select("gram", F.col("label").alias("lb"), F.col(key).alias("b"), F.col("size").alias("nb"))
    pairs = apart.join(left, ["gram", "la"]).join(right, ["gram", "lb"]).select("a", "b", "na", "nb")
    return links.unionAll(_alike(pairs, sets, prefix, threshold, key).select("a", "b"))


def components(edges: DataFrame) -> DataFrame:
    """``v``, ``label``: the smallest vertex reachable over the edges ``a`` - ``b``."""
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = persisted(both.unionAll(both.select("a", F.col("a").alias("b"))).distinct())
    labels, before = persisted(both.groupBy("a").agg(F.min("b").alias("label")).withColumnRenamed("a", "v")), None
    while True:
        now = labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        if now == before:
            release(both)
            return labels
        before, old = now, labels
        near = both.join(labels, both["b"] == labels["v"]).groupBy("a").agg(F.min("label").alias("label"))
        jump = labels.select(F.col("v").alias("label"), F.col("label").alias("further"))
        labels = persisted(near.join(jump, "label").select(F.col("a").alias("v"), F.least("label", "further").alias("label")))
        release(old)


def near_dup_clusters(docs: DataFrame, threshold: float = 0.8, n: int = 5) -> DataFrame:
    """``doc_id`` and ``cluster``, the smallest id of its component of similar pairs, for every document with a text."""
    rep = docs.where("text is not null").withColumn("_key", sha256_key(F.lower("text")))
    first = rep.groupBy("_key").agg(F.min("doc_id").alias("rep"))
    found = components(similar_links(docs, threshold, n))
    named = first.join(found, first["rep"] == found["v"], "left").select("_key", F.coalesce("label", "rep").alias("cluster"))
    return rep.join(named, "_key").select("doc_id", "cluster")


def greedy_removals(docs: DataFrame, threshold: float = 0.8, n: int = 5) -> DataFrame:
    """Ids of the near duplicates to drop: pairs in ascending order, each drops its shorter text (tie: the larger id)
    unless one of the two is gone already.

    The rule is sequential, but what it does with a text's pairs depends on earlier pairs of the same texts only. So each
    round settles, all at once, every text that is the second of no open pair and the least partner of all its partners;
    the least text that is left is always among them. Rounds follow chains of texts that depend on each other, not the
    number of texts, and no group of a component is ever in one task. Each round is written.
    """
    sizes = docs.select("doc_id", F.char_length("text").alias("size"))
    pairs = similar_pairs(docs, threshold, n).select("a", "b")
    pairs = pairs.join(sizes.select(F.col("doc_id").alias("a"), F.col("size").alias("size_a")), "a").join(sizes.select(F.col("doc_id").alias("b"), F.col("size").alias("size_b")), "b")
    return settle(persisted(pairs))


def settle(open_: DataFrame) -> DataFrame:
    """``doc_id`` of the texts that the greedy rule drops, from pairs ``a`` < ``b`` with ``size_a`` and ``size_b``."""
    gone = open_.select(F.col("a").alias("doc_id")).limit(0)
    while not open_.isEmpty():
        least = open_.groupBy("b").agg(F.min("a").alias("least"))
        waits = open_.join(least, "b").where("least < a").select("a").unionAll(least.select(F.col("b").alias("a"))).distinct()
        ready = open_.join(waits, "a", "left_anti")
        # a text drops its partners in order until one is longer, which drops it
        ends = ready.groupBy("a").agg(F.min(F.when(F.col("size_b") > F.col("size_a"), F.col("b"))).alias("end"))
        settled = persisted(ready.join(ends, "a").select("a", "b", "end"))
        lost = persisted(settled.where("end is null or b < end").select(F.col("b").alias("doc_id")).unionAll(settled.where("end is not null").select(F.col("a").alias("doc_id"))).distinct())
        gone = gone.unionAll(lost)
        done = lost.unionAll(settled.select(F.col("a").alias("doc_id"))).distinct()
        rest = open_.join(done, open_["a"] == done["doc_id"], "left_anti")
        before, open_ = open_, persisted(rest.join(lost, rest["b"] == lost["doc_id"], "left_anti"))
        release(before)
        release(settled)
    return gone


def layered(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Exact copies, then near duplicates removed; survivors are chosen by id."""
    one = keep_first(docs, sha256_key(F.col("text")))
    return without(one, greedy_removals(one, threshold))


def against_store(signatures: DataFrame, stored: DataFrame, b: int = 16, key: str = "doc_id") -> DataFrame:
    """New signatures without a band slice in the stored ones: dedup of a new snapshot against earlier ones."""
    old = bands(stored, b, key).select("band", "slice").distinct()
    hits = bands(signatures, b, key).join(old, ["band", "slice"], "left_semi").select(key).distinct()
    return signatures.join(hits, key, "left_anti")


def unit(vector: Column) -> Column:
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: F.when(norm == 0, 0.0).otherwise(x.cast("double") / F.when(norm != 0, norm)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def sign_tables(n: int, threshold: float, recall: float, bucket: int = 4096) -> tuple[int, int]:
    """Planes a table, so that ``n`` vectors leave at most about ``bucket`` to a code, and the tables that find a pair at the
    threshold with probability ``recall``; pairs of higher cosine are likelier still. One bucket needs no plane, and loses none."""
    planes = min(24, math.ceil(math.log2(n / bucket))) if n > bucket else 0
    if not planes:
        return 0, 1
    agree = (1 - math.acos(threshold) / math.pi) ** planes
    return planes, math.ceil(math.log(1 - recall) / math.log(1 - agree))


def _close(u: np.ndarray, v: np.ndarray | None, threshold: float, slab: int = 512) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of ``u`` and of ``v`` (of ``u`` and later ones of ``u`` without it) whose inner product is over ``threshold``, and that.

    Products in single precision, a slab of rows at a time, leave out what is under the threshold by more than their error;
    the others are summed in double precision from the first place to the last.
    """
    left, right, cosine = [], [], []
    w = u if v is None else v
    narrow = w.astype(np.float32).T
    for start in range(0, len(u), slab):
        first = start if v is None else 0
        i, j = np.nonzero(u[start : start + slab].astype(np.float32) @ narrow[:, first:] > threshold - 1e-4)
        i, j = i + start, j + first
        if v is None:
            i, j = i[i < j], j[i < j]
        for at in range(0, len(i), 100_000):
            k, m = i[at : at + 100_000], j[at : at + 100_000]
            total = np.zeros(len(k))
            for d in range(u.shape[1]):
                total += u[k, d] * w[m, d]
            over = total > threshold
            left.append(k[over])
            right.append(m[over])
            cosine.append(total[over])
    return (np.concatenate(left), np.concatenate(right), np.concatenate(cosine)) if left else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Arrays of one length as the rows of a matrix."""
    flat = pc.list_flatten(column).to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def semantic_pairs(vectors: DataFrame, threshold: float = 0.85, recall: float = 0.9999, seed: int = 5, key: str = "vec_id", vector: str = "embedding", dim: int = 64, bucket: int = 4096) -> DataFrame:
    """Pairs ``a`` < ``b`` with cosine over ``threshold``, verified exactly, among vectors that share a sign pattern of
    random planes in one of the tables.

    The number of planes follows from the number of vectors, so buckets don't grow with it, and the number of tables from
    the ``recall`` wanted for a pair just at the threshold: a link is missed with probability 1 - ``recall`` at most.
    The vectors of a code meet in one group, as a product of matrices, so that only similar pairs leave it; a code of over
    two ``bucket``s is cut into blocks, and each two of its blocks are a group. Equal vectors collapse to the smallest id.
    """
    unique = persisted(vectors.where(F.col(vector).isNotNull()).groupBy(vector).agg(F.min(key).alias(key)).select(key, unit(F.col(vector)).alias("u")))
    planes, tables = sign_tables(unique.count(), threshold, recall, bucket)
    normals = np.random.default_rng(seed).normal(size=(tables * planes, dim))
    powers = 1 << np.arange(planes, dtype=np.int64)
    kind = dict(vectors.dtypes)[key]

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            u = np.array(batch.column(1).to_pylist(), np.float64)
            code = ((u @ normals.T >= 0).reshape(len(u), tables, planes) * powers).sum(axis=2)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(code), pa.list_(pa.int64()))], names=[key, "u", "codes"])

    def meet(group: pa.Table) -> pa.Table:
        here, there = (group.filter(pc.equal(group["block"], group[side][0])) for side in ("lo", "hi"))
        same = group["lo"][0] == group["hi"][0]
        i, j, cosine = _close(_matrix(here["u"]), None if same else _matrix(there["u"]), threshold)
        return pa.table({"x": here[key].take(pa.array(i)), "y": there[key].take(pa.array(j)), "cosine": pa.array(cosine)})

    coded = unique.mapInArrow(codes, f"{key} {kind}, u array<double>, codes array<long>")
    counts = coded.select(F.posexplode("codes").alias("t", "code")).groupBy("t", "code").agg(F.count("*").alias("n"))
    large = counts.where(F.col("n") > 2 * bucket).select("t", "code", F.ceil(F.col("n") / bucket).cast("int").alias("blocks"))
    rows = coded.select(key, "u", F.posexplode("codes").alias("t", "code")).join(F.broadcast(large), ["t", "code"], "left")
    rows = rows.withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64(key), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = rows.select(key, "u", "t", "code", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    near = dealt.groupBy("t", "code", "lo", "hi").applyInArrow(meet, f"x {kind}, y {kind}, cosine double")
    return near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "cosine").distinct()


def _equal_vectors(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """``key`` and ``rep``, the smallest id that has the same vector."""
    known = vectors.where(F.exists(vector, lambda x: x != 0)).select(key, vector)
    least = known.groupBy(vector).agg(F.min(key).alias("rep"))
    return known.join(least, vector).select(key, "rep")


def semantic_clusters(vectors: DataFrame, threshold: float = 0.85, key: str = "vec_id", vector: str = "embedding", **settings) -> DataFrame:
    """``key`` and ``cluster``, the smallest id of its component of similar pairs, of the vectors that have a partner."""
    reps = persisted(_equal_vectors(vectors, key, vector))
    found = components(semantic_pairs(vectors, threshold, key=key, vector=vector, **settings))
    named = reps.join(found, reps["rep"] == found["v"], "left").select(key, F.coalesce("label", "rep").alias("cluster"))
    shared = named.groupBy("cluster").agg(F.count("*").alias("n")).where("n > 1").select("cluster")
    return named.join(shared, "cluster").select(key, "cluster")


def semantic_removals(vectors: DataFrame, threshold: float = 0.85, key: str = "vec_id", vector: str = "embedding", **settings) -> DataFrame:
    """Ids to drop when vectors are taken in order and one goes if its cosine to one kept before is over ``threshold``."""
    pairs = semantic_pairs(vectors, threshold, key=key, vector=vector, **settings).select("a", "b", F.lit(0).alias("size_a"), F.lit(0).alias("size_b"))
    copies = _equal_vectors(vectors, key, vector).where(F.col(key) != F.col("rep")).select(F.col(key).alias("doc_id"))
    return settle(persisted(pairs)).unionAll(copies).withColumnRenamed("doc_id", key)


def layered_semantic(docs: DataFrame, vectors: DataFrame, threshold: float = 0.8, cosine: float = 0.85, **settings) -> DataFrame:
    """Exact, near and then semantic duplicates removed; vectors are those of the survivors, by ``vec_id`` = ``doc_id``."""
    kept = persisted(layered(docs, threshold))
    left = vectors.join(kept.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    return kept.join(semantic_removals(left, cosine, **settings).withColumnRenamed("vec_id", "doc_id"), "doc_id", "left_anti")


def lcs_f1(a: list[str], b: list[str]) -> float:
    """ROUGE-L: harmonic mean of the longest common subsequence's share of either word list."""
    if not a or not b:
        return 0.0
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return 2 * row[-1] / (len(a) + len(b))


def rouge_pairs(new: DataFrame, known: DataFrame, threshold: float = 0.7, key: str = "doc_id") -> DataFrame:
    """``a`` of ``new``, ``b`` of ``known``, ``rouge_l`` over ``threshold``.

    A common subsequence is a common multiset of words, of at least t*m / (2 - t) of the m words. So one of the
    m - ceil(that) + 1 rarest numbered words of either text is shared, and only those are joined; no pair is lost.
    """
    words = lambda d: d.where("text is not null").select(key, T.words(F.col("text")).alias("w")).where(F.size("w") > 0)
    sides = {n: persisted(words(d)) for n, d in (("a", new), ("b", known))}

    def numbered(d: DataFrame) -> DataFrame:
        each = d.select(key, F.size("w").alias("m"), F.explode("w").alias("word")).groupBy(key, "m", "word").agg(F.count("*").alias("c"))
        return each.select(key, "m", F.explode(F.transform(F.sequence(F.lit(1).cast("long"), F.col("c")), lambda i: F.concat_ws("#", "word", i.cast("string")))).alias("token"))

    tokens = {n: numbered(d) for n, d in sides.items()}
    frequency = tokens["a"].select("token").unionAll(tokens["b"].select("token")).groupBy("token").agg(F.count("*").alias("df"))

    def prefix(d: DataFrame) -> DataFrame:
        ranked = d.join(frequency, "token").groupBy(key, "m").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("t"))
        size = (F.col("m") - F.ceil(threshold * F.col("m") / (2 - threshold)) + 1).cast("int")
        return ranked.select(key, F.explode(F.slice("t", 1, size)).alias("t")).select(key, "t.token")

    near = prefix(tokens["a"]).withColumnRenamed(key, "a").join(prefix(tokens["b"]).withColumnRenamed(key, "b"), "token").select("a", "b").distinct()
    near = near.join(sides["a"].select(F.col(key).alias("a"), F.col("w").alias("wa")), "a").join(sides["b"].select(F.col(key).alias("b"), F.col("w").alias("wb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = [lcs_f1(x, y) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score, pa.float64())], names=["a", "b", "rouge_l"])

    kind = dict(new.dtypes)[key]
    return near.select("a", "b", "wa", "wb").mapInArrow(run, f"a {kind}, b {kind}, rouge_l double").where(F.col("rouge_l") > threshold)
