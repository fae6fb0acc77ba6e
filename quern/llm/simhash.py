"""SimHash near-duplicates found with BK-trees.

Every text gets a 64-bit SimHash of its 3-word shingles. Fingerprints that differ in at most ``radius`` bits are
linked, and linked documents form components. Candidates are dealt by pigeonhole: of ``radius + 1`` bit blocks, two
linked fingerprints agree in one, so each block value is a shard. A value that more than ``shard`` distinct fingerprints
share is dealt again by the same rule over the bits that are left, so shards stay small when the table grows, at a
few copies of a fingerprint more. A shard's distinct fingerprints stand in BK-trees, whose children are keyed by their
Hamming distance to the parent; a search follows only the edges within the radius of its own distance. A shard that is
still too large after ``LEVELS`` dealings (fingerprints that really lie close together) is cut into sub-shards, and
every pair of sub-shards is one unit of work, so it spreads over tasks. Trees travel to the queries through the
shuffle, never through the driver, since their number grows with the corpus.

Edge cases: a text without words (null and empty ones too) has fingerprint zero and links like any other. Copies share
a fingerprint and are searched once. Rows with a null id take part with their text and link others; a component is named
by its smallest non-null id, and the name is null where there is none. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import blocks, durable, release

LEVELS = 3


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """SimHash of the lower-cased words' shingles; bytes.lower and bytes.split know ASCII only, as wanted."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - shingle + 1)
    stops = ends[len(words) - n :].tolist()
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, stops, strict=True)), np.uint64, n)
    total = np.zeros(64, np.int64)
    for i in range(0, n, 65536):
        total += np.unpackbits(hashes[i : i + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """``doc_id``, ``fp``, the fingerprint as a signed long, and ``row_key``, a hash of the text; one narrow Arrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in blocks(batch, "text"):
                fps = np.array([fingerprint(t, shingle, seed) for t in texts], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps), part.column(2)], names=["doc_id", "fp", "row_key"])

    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("row_key"))
    return keyed.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, fp long, row_key long")


class BKForest:
    """BK-trees over the groups of ``values``, built and searched level by level on arrays.

    ``group`` must be sorted; the first value of a group is the root of its tree.
    """

    def __init__(self, group: np.ndarray, values: np.ndarray):
        self.values = values
        n = len(values)
        first = np.ones(n, bool)
        first[1:] = group[1:] != group[:-1]
        self.groups, self.root = group[first], np.flatnonzero(first)
        at = np.repeat(self.root, np.diff(np.append(self.root, n)))
        items = np.flatnonzero(~first)
        at = at[items]
        edges, children = [], []
        while len(items):
            key = at * 65 + np.bitwise_count(values[items] ^ values[at]).astype(np.int64)
            order = np.argsort(key, kind="stable")
            items, key = items[order], key[order]
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            edges.append(key[new])
            children.append(items[new])
            at = np.repeat(items[new], np.diff(np.append(np.flatnonzero(new), len(key))))[~new]
            items = items[~new]
        edge = np.concatenate(edges) if edges else np.zeros(0, np.int64)
        child = np.concatenate(children) if children else np.zeros(0, np.int64)
        order = np.argsort(edge)
        self.edge, self.child = edge[order], child[order]

    def search(self, group: np.ndarray, queries: np.ndarray, radius: int, most: int = 2_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query position, value position) within ``radius``, in lots that keep the frontier bounded."""
        if not len(self.groups):
            return
        slot = np.searchsorted(self.groups, group)
        slot[slot == len(self.groups)] = 0
        known = np.flatnonzero(self.groups[slot] == group)
        sizes = np.diff(np.append(self.root, len(self.values)))[slot[known]]
        lot = (np.cumsum(sizes) // most) if len(known) else known
        for part in np.split(known, np.flatnonzero(np.diff(lot)) + 1):
            q, node = part, self.root[slot[part]]
            while len(q):
                d = np.bitwise_count(queries[q] ^ self.values[node]).astype(np.int64)
                near = d <= radius
                yield q[near], node[near]
                lo = np.searchsorted(self.edge, node * 65 + np.maximum(d - radius, 0))
                hi = np.searchsorted(self.edge, node * 65 + np.minimum(d + radius, 64), side="right")
                n = hi - lo
                total = int(n.sum())
                q = np.repeat(q, n)
                node = self.child[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(total)]


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest position reachable over the links a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _links_in(rows: pa.Table, radius: int) -> pa.RecordBatch:
    """Links from each fingerprint to the first one of its component inside its unit; ``rows`` hold whole units."""
    unit, rep, fp, role = (rows.column(c).to_numpy() for c in ("unit", "rep", "fp", "role"))
    order = np.lexsort((rep, unit))
    unit, rep, fp, role = unit[order], rep[order], fp[order].view(np.uint64), role[order]
    # role 0 stands in the tree and asks; in a pair of sub-shards role 1 is the tree, role 2 asks
    tree, ask = np.flatnonzero(role != 2), np.flatnonzero(role != 1)
    forest = BKForest(unit[tree], fp[tree])
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for q, node in forest.search(unit[ask], fp[ask], radius):
        q, node = ask[q], tree[node]
        keep = q != node
        a.append(q[keep])
        b.append(node[keep])
    label = _labels(len(unit), np.concatenate(a), np.concatenate(b))
    linked = np.flatnonzero(label != np.arange(len(unit)))
    return pa.RecordBatch.from_arrays([pa.array(rep[linked]), pa.array(rep[label[linked]])], names=["a", "b"])


def _unit_links(radius: int, lot: int = 100_000):
    """mapInArrow over rows sorted by unit: whole units go on in lots of about ``lot`` rows, the open one is held back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < lot:
                continue
            table = pa.Table.from_batches(held)
            unit = table.column("unit").to_numpy()
            whole = int(np.searchsorted(unit, unit[-1]))
            if whole:
                yield _links_in(table.slice(0, whole), radius)
            held = table.slice(whole).combine_chunks().to_batches()
            rows = table.num_rows - whole
        if held:
            yield _links_in(pa.Table.from_batches(held), radius)

    return run


def _spread(left: int, n: int) -> list[int]:
    """``n`` masks that share out the set bits of ``left``, in runs of nearly equal length."""
    bits = [i for i in range(64) if left >> i & 1]
    return [sum(1 << i for i in bits[len(bits) * k // n : len(bits) * (k + 1) // n]) for k in range(n)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _dealt(rows: DataFrame, places: dict[int, list[int]]) -> DataFrame:
    """``rep``, ``fp``, ``place`` (which bits agree) and ``key`` (a hash of them): each row once for every new place.

    ``places`` maps an old place (-1: none) to the masks of its new ones; a key covers the old bits too.
    """
    masks = [m for new in places.values() for m in new]
    of, at = {}, 0
    for old, new in places.items():
        of[old] = list(range(at, at + len(new)))
        at += len(new)
    known = F.lit([_signed(m) for m in masks])
    wanted = F.coalesce(*[F.when(F.col("place") == old, F.lit(new)) for old, new in of.items()])
    each = rows.select("rep", "fp", F.explode(wanted).alias("place"))
    return each.select("rep", "fp", "place", F.xxhash64("place", F.col("fp").bitwiseAND(F.get(known, F.col("place")))).alias("key"))


def shards(reps: DataFrame, radius: int = 3, shard: int = 512, levels: int = LEVELS) -> DataFrame:
    """``unit``, ``rep``, ``fp``, ``role``: the units of work that hold every linked pair of fingerprints in one of them."""
    n = radius + 1
    masks = {-1: _spread((1 << 64) - 1, n)}
    rows, units = reps.select("rep", "fp", F.lit(-1).alias("place")), None
    for level in range(levels):
        dealt = _dealt(rows, masks)
        sizes = dealt.groupBy("place", "key").agg(F.count("*").alias("n")).where("n > 1")
        sized = durable(dealt.join(sizes, ["place", "key"]))
        small = sized.where(F.col("n") <= shard).select(F.xxhash64("place", "key", F.lit(level), F.lit(0)).alias("unit"), "rep", "fp", F.lit(0).alias("role"))
        units = small if units is None else units.unionAll(small)
        rows = sized.where(F.col("n") > shard)
        if rows.isEmpty():
            return units
        # The bits that a place compares are settled: its rows can only differ in the others.
        flat = [m for new in masks.values() for m in new]
        masks = {i: [m | more for more in _spread(~m & ((1 << 64) - 1), n)] for i, m in enumerate(flat)}
    p = F.ceil(F.col("n") / shard).cast("int")
    large = rows.withColumn("p", p).withColumn("own", F.pmod(F.xxhash64("fp", F.lit("own")), F.col("p")).cast("int"))
    other = large.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("p") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    role = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    return units.unionAll(other.select(F.xxhash64("place", "key", low + 1, high + 1).alias("unit"), "rep", "fp", role.alias("role")))


def links(reps: DataFrame, radius: int = 3, shard: int = 512) -> DataFrame:
    """Links ``a`` - ``b`` between the representatives (``rep``, ``fp``) that span every component of fingerprints."""
    units = shards(reps, radius, shard).repartition("unit").sortWithinPartitions("unit")
    return units.mapInArrow(_unit_links(radius), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """``v`` and ``label``, the smallest vertex reachable: label propagation with pointer jumping until nothing changes.

    Joins and partial aggregates only, so a vertex with very many links is split like any skewed key. Each round is
    written to the shared folder.
    """
    pairs = edges.select(F.explode(F.array(*[F.struct(F.col(x).alias("u"), F.col(y).alias("v")) for x, y in (("a", "b"), ("b", "a"), ("a", "a"), ("b", "b"))])).alias("e")).select("e.*").distinct()
    pairs = durable(pairs)
    labels = durable(pairs.groupBy("u").agg(F.min("v").alias("label")).withColumnRenamed("u", "v"))
    total = None
    while True:
        now = labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        if now == total:
            release(pairs)
            return labels
        total, before = now, labels
        near = pairs.join(labels, "v").groupBy("u").agg(F.min("label").alias("label"))
        jump = labels.select(F.col("v").alias("label"), F.col("label").alias("further"))
        labels = durable(near.join(jump, "label").select(F.col("u").alias("v"), F.least("label", "further").alias("label")))
        release(before)


def _named(docs: DataFrame, radius: int, shingle: int, seed: int) -> DataFrame:
    """``doc_id``, ``row_key``, ``fp`` and ``label`` of every row; rows of one component share the label, a fingerprint."""
    marked = durable(fingerprints(docs, shingle, seed))
    labels = components(links(marked.select(F.col("fp").alias("rep"), "fp").distinct(), radius))
    joined = marked.join(labels, marked["fp"] == labels["v"], "left")
    return joined.select("doc_id", "row_key", "fp", F.coalesce("label", "fp").alias("label"))


def simhash_components(docs: DataFrame, radius: int = 3, shingle: int = 3, seed: int = 42) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id``, the smallest id reachable over links."""
    named = durable(_named(docs, radius, shingle, seed))
    # Written first: in a stage of its own the join by label, which a large component makes skewed, can be split.
    least = durable(named.groupBy("label").agg(F.min("doc_id").alias("component_id")))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return named.join(least, "label").select("doc_id", digits.alias("fingerprint"), "component_id")


def keep_one_each(docs: DataFrame, radius: int = 3, shingle: int = 3, seed: int = 42) -> DataFrame:
    """``docs``, all columns, with one row of each component: that of the smallest id.

    Rows without an id come after those with one; of rows with one id in one component, the text of the smallest hash
    stays, and one of identical rows. Rows that share an id and belong to different components all stay.
    """
    named = durable(_named(docs, radius, shingle, seed))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key"))
    kept = durable(named.groupBy("label").agg(first.alias("k")).select(F.col("k.doc_id").alias("_quern_id"), F.col("k.row_key").alias("_quern_kept")))
    # The ids grow with the corpus, so they are never broadcast: texts are dealt by id at every size.
    keyed = docs.withColumn("_quern_key", F.xxhash64("text"))
    out = keyed.join(kept.hint("merge"), keyed["doc_id"].eqNullSafe(kept["_quern_id"]) & (keyed["_quern_key"] == kept["_quern_kept"]), "left_semi")
    repeated = named.groupBy("doc_id", "row_key").agg(F.count("*").alias("n")).where("n > 1")
    again = repeated.join(kept, repeated["doc_id"].eqNullSafe(kept["_quern_id"]) & (repeated["row_key"] == kept["_quern_kept"]), "left_semi")
    if not again.isEmpty():
        out = out.dropDuplicates(["doc_id", "_quern_key"])
    return out.drop("_quern_key")
