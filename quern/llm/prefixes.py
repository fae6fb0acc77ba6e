"""Prefix trie of conversations: chained digests, nodes by (depth, digest), sums over subtrees.

Every turn has a SHA-256 digest of its role and text; a prefix's digest is the SHA-256 of the digest of the prefix
before it and that of its last turn, so equal prefixes have equal digests and texts are never shuffled. Every prefix of
every conversation is a row; grouped by (depth, digest) these are the nodes, each represented by its smallest member.
A node must reach all its ancestors. They are prefixes of its representative, and one conversation represents a whole
run of its prefixes down to its end; so a conversation first sums the values of the nodes it represents from its end
upwards, and hands each of its prefixes the sum at or below it: the explosion of nodes to ancestors, pre-aggregated by
path, with one row a turn instead of one for each pair of depths.

Hot nodes: counts are combined before they are shuffled; ids of members that end at a node are joined in ranges of ids,
and only these pieces are put through SHA-256 in order (which is sequential by definition), as a stream; names of
parents with many children are broadcast, of which there are fewer than 2000 at any size.

Edge cases: turns are ordered by ``turn``, null first, ties by the digest of role and text; a null role or text counts as
empty; repeated rows are turns of their own. Rows without a ``conv_id`` belong to no conversation and take no part.
``conv_id % 5`` is the remainder that SQL gives, of the sign of ``conv_id``. Without any conversation there is no node.
Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import durable, join_counted

START = hashlib.sha256(b"").digest()
NODE = ["depth", "digest"]


def turns_in_order(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``i`` (from 1), ``mark`` (digest of role and text), ``n_bytes`` of each turn's text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    mark = F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.where("conv_id is not null").select("conv_id", "turn", mark.alias("mark"), F.octet_length(text).cast("long").alias("n_bytes"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "mark")
    return rows.select("conv_id", F.row_number().over(order).alias("i"), "mark", "n_bytes")


def rebuilt(turns: DataFrame, group: int = 5, most: int = 9) -> DataFrame:
    """The turns of every conversation c rebuilt: the first h of conversation c - c % ``group``, then its own after its
    first h, where h = crc32(c) % ``most``. ``i`` orders them; a conversation without turns has one row, i null.

    A donor lends at most ``most`` - 1 turns to ``group`` conversations, so the join has no hot key.
    """
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    heads = turns.select("conv_id").distinct().select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("donor"))
    lent = turns.where(F.col("i") < most).select(F.col("conv_id").alias("donor"), "i", "mark", "n_bytes")
    head = heads.join(lent, "donor").where("i <= h").select("conv_id", "i", "mark", "n_bytes")
    own = turns.where(F.col("i") > h).select("conv_id", F.col("i") + most, "mark", "n_bytes")
    none = heads.select("conv_id", F.lit(None).cast("int").alias("i"), F.lit(None).cast("binary").alias("mark"), F.lit(0).cast("long").alias("n_bytes"))
    return none.unionAll(head).unionAll(own)


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A prefix for each row, in the order of the rows: depth, its digest, the digest before it; ``last`` marks the end
    of a conversation. One digest is held, however long the conversation."""
    names = ["conv_id", "depth", "digest", "before", "n_bytes", "last"]
    conv, depth, digest = None, 0, START
    waiting: tuple | None = None  # a row is sent when the next one tells whether it was the last
    for batch in batches:
        out = []
        for c, mark, size in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
            if waiting is not None:
                out.append((*waiting, c != conv))
            if c != conv:
                conv, depth, digest = c, 0, START
                waiting = (c, 0, START, None, 0)
            else:
                before, digest, depth = digest, hashlib.sha256(digest + mark).digest(), depth + 1
                waiting = (c, depth, digest, before, size)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.bool_()), strict=True)], names=names)
    if waiting is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*waiting, True), (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.bool_()), strict=True)], names=names)


def prefixes(sequences: DataFrame) -> DataFrame:
    """Every prefix of every sequence (``conv_id``, ``i``, ``mark``, ``n_bytes``; one row with null ``i`` each) from depth 0."""
    rows = sequences.repartition("conv_id").sortWithinPartitions("conv_id", F.col("i").asc_nulls_first())
    return rows.select("conv_id", "mark", "n_bytes").mapInArrow(_chain, "conv_id long, depth long, digest binary, before binary, n_bytes long, last boolean")


def _streamed_sha(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's pieces, comma-joined in their order; nodes come one after the other."""
    node, sha, out = None, None, []

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.string()), strict=True)], names=[*NODE, "ends_sha256"])

    for batch in batches:
        for depth, digest, piece in zip(*[batch.column(k) for k in range(3)], strict=True):
            here = (depth.as_py(), digest.as_py())
            if here != node:
                if node is not None:
                    out.append((*node, sha.hexdigest()))
                node, sha = here, hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(piece.as_py().encode())
        if len(out) > 10_000:
            yield table(out)
            out = []
    if node is not None:
        yield table([*out, (*node, sha.hexdigest())])


def ends(rows: DataFrame, piece: int = 50_000) -> DataFrame:
    """``depth``, ``digest``, ``ends_sha256``: of the ids (ascending, comma-joined) of the conversations that end at a node.

    Ids are dealt in ranges of about ``piece``; a range joins the ids of each node into one text of at most that many, so
    that the ordered pass over a hot node reads few rows.
    """
    spark = rows.sparkSession
    last = rows.where("last").select("conv_id", *NODE)
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-last.count() // piece))
    dealt = last.repartitionByRange(ranges, "conv_id").withColumn("_range", F.spark_partition_id())
    ids = F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",")
    pieces = durable(dealt.groupBy(*NODE, "_range").agg(ids.alias("ids")))
    count = pieces.groupBy(*NODE).agg(F.count("*").alias("_rows"))
    counted = join_counted(pieces, durable(count), NODE)
    alone = counted.where("_rows = 1").select(*NODE, F.sha2("ids", 256).alias("ends_sha256"))
    many = counted.where("_rows > 1").select(*NODE, "ids", "_range").repartition(*NODE).sortWithinPartitions(*NODE, "_range")
    return alone.unionAll(many.select(*NODE, "ids").mapInArrow(_streamed_sha, "depth long, digest binary, ends_sha256 string"))


def trie(rows: DataFrame) -> DataFrame:
    """The nodes of a written table of ``prefixes`` with their sums; see ``conversation_trie``."""
    nodes = rows.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("n_bytes").alias("n_bytes"), F.max("before").alias("before"))
    nodes = durable(nodes)
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("before").alias("digest")).agg(F.count("*").alias("n_children"))
    nodes = durable(nodes.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long")))

    # Values of the nodes a conversation represents, summed from its end; every prefix receives what lies at or below it.
    value = nodes.select("conv_id", "depth", ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved"), (F.col("n_children") == 0).cast("long").alias("leaf"))
    path = Window.partitionBy("conv_id").orderBy(F.col("depth").desc())
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    given = rows.select("conv_id", *NODE).join(value, ["conv_id", "depth"], "left").select(*NODE, F.sum(zero("saved")).over(path).alias("s"), F.sum(zero("leaf")).over(path).alias("l"))
    sums = given.where("s <> 0 or l <> 0").groupBy(*NODE).agg(F.sum("l").alias("n_leaves"), F.sum("s").alias("saved_tokens"))

    parents = nodes.where("n_children > 0").select(F.col("depth").alias("_up"), F.col("digest").alias("before"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("_rows"))
    below = nodes.where("depth > 0").select("*", (F.col("depth") - 1).alias("_up"))
    named = join_counted(below, parents, ["_up", "before"]).select(*NODE, "parent_conv_id", "conv_id", "n_convs", "n_children")
    root = nodes.where("depth = 0").select(*NODE, F.lit(None).cast("long").alias("parent_conv_id"), "conv_id", "n_convs", "n_children")
    every = named.unionByName(root).join(sums, NODE).join(ends(rows), NODE, "left")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return every.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """A row for each distinct prefix of the rebuilt conversations.

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``
    (bytes that members share beyond the first, over the subtree), ``ends_sha256`` (of the ids that end here).
    """
    turns = durable(turns_in_order(conversations))
    return trie(durable(prefixes(rebuilt(turns))))
