"""Best-fit packing of tokenised documents into sequences by a grouping genetic algorithm on islands.

Documents become token ids and an end id; only those longer than a sequence are cut, the first piece taking the
remainder and the others being full. Full pieces are sequences of their own. The rest is dealt by hash into shards of
about ``shard_items`` pieces, small enough for a task and large enough that the one open sequence a shard may leave
does not count. On each shard several islands evolve packings from different seeds: crossover injects whole
well-filled bins of one parent into the other, bins that hold a duplicate are dissolved, and the displaced pieces are
placed by best fit. After each epoch the elite of every island migrates to the next one through the shuffle, and
the best island of a shard gives its packing.

Edge cases: a null or empty text is the end id alone. Repeated rows and ids are packed each on their own. An empty
table gives no row. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import base64
import math
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import blocks, durable

SEQUENCE = 2048


def vocabulary() -> tuple[str, str, str]:
    """The default tokenizer: its JSON file, the same vocabulary as ranks, and the split pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


class Encoder:
    """The ids that the ``tokenizers`` file gives, from the faster rank encoder of the same vocabulary.

    Texts that spell a special token, and texts over a million characters, go through ``tokenizers`` itself.
    """

    def __init__(self, files: tuple[str, str, str]):
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.exact = Tokenizer.from_file(files[0])
        self.special = [t.content for t in self.exact.get_added_tokens_decoder().values()]
        with open(files[1], "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("ranks", pat_str=files[2], mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if len(text) > 1_000_000 or any(s in text for s in self.special):
            return self.exact.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def pieces(docs: DataFrame, capacity: int = SEQUENCE, end_id: int = 0, keep_ids: bool = False, files: tuple[str, str, str] | None = None) -> DataFrame:
    """``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32`` and, if asked for, ``ids`` of every piece."""
    files = files or vocabulary()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(files)
        for batch in batches:
            for part, texts in blocks(batch, "text"):
                out: list[list] = [[] for _ in range(6)]
                for i, text in enumerate(texts):
                    ids = np.array([*encode(text or ""), end_id], "<u4")
                    first = len(ids) % capacity or capacity
                    bounds = [0, *range(first, len(ids) + 1, capacity)]
                    for n, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                        for column, value in zip(out, (i, n, a, b - a, zlib.crc32(ids[a:b].tobytes()), ids[a:b] if keep_ids else None), strict=True):
                            column.append(value)
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64()) + (pa.list_(pa.int32()),) * keep_ids
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(out[0], pa.int64())), *(pa.array(c, k) for c, k in zip(out[1:], kinds, strict=False))], names=names)

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def best_fit(order: np.ndarray, lengths: np.ndarray, capacity: int, bins: np.ndarray, fill: list[int]) -> None:
    """Place ``order``'s items, one after the other, into the fullest bin with room; new bins are opened at need.

    Bins are kept by the room they have left; the bits of one integer tell which amounts of room exist.
    """
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for b, f in enumerate(fill):
        rooms[capacity - f].append(b)
        mask |= 1 << (capacity - f)
    for item in order.tolist():
        size = int(lengths[item])
        fits = mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                mask ^= 1 << room
        else:
            room, b = capacity, len(fill)
            fill.append(0)
        bins[item] = b
        fill[b] += size
        room -= size
        rooms[room].append(b)
        mask |= 1 << room


def _compact(bins: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bins numbered from 0 without gaps, and how full each is."""
    _, bins = np.unique(bins, return_inverse=True)
    return bins, np.bincount(bins, weights=lengths).astype(np.int64)


def _cross(giver: np.ndarray, taker: np.ndarray, lengths: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """A child: well-filled bins of ``giver`` injected whole into ``taker``, duplicates removed, the displaced best-fitted.

    The displaced pieces go in by falling size with some noise; in plain order they would meet again as before.
    """
    giver, given = _compact(giver, lengths)
    full = np.flatnonzero(given >= np.quantile(given, 0.85))
    chosen = np.zeros(len(given), bool)
    chosen[full[rng.random(len(full)) < rng.uniform(0.1, 0.9)]] = True
    injected = chosen[giver]
    taker, filled = _compact(taker, lengths)
    broken = np.zeros(len(filled), bool)
    broken[taker[injected]] = True
    broken[np.argsort(filled)[: 1 + int(0.3 * len(filled))]] = True  # mutation: the emptiest bins dissolve
    displaced = np.flatnonzero(broken[taker] & ~injected)
    child = np.where(injected, giver + len(filled), taker)
    child[displaced] = -1
    kept = child >= 0
    number, fill = _compact(child[kept], lengths[kept])
    child[kept] = number
    levels = fill.tolist()
    best_fit(displaced[np.argsort(-lengths[displaced] * rng.uniform(0.7, 1.3, len(displaced)), kind="stable")], lengths, capacity, child, levels)
    return child


def evolve(lengths: np.ndarray, capacity: int, seed: int, elites: list[np.ndarray], generations: int = 30, population: int = 6) -> np.ndarray:
    """The best packing an island finds; ``elites`` are packings it starts from."""
    rng = np.random.default_rng(seed)
    least = math.ceil(int(lengths.sum()) / capacity)

    def fitness(bins: np.ndarray) -> tuple[int, float]:
        fill = np.bincount(bins, weights=lengths)
        return -int((fill > 0).sum()), float(((fill / capacity) ** 2).sum())

    people = list(elites)
    while len(people) < population:
        noise = 1.0 if not people else rng.uniform(0.85, 1.15, len(lengths))
        bins = np.full(len(lengths), -1)
        best_fit(np.argsort(-lengths * noise, kind="stable"), lengths, capacity, bins, [])
        people.append(bins)
    people.sort(key=fitness, reverse=True)
    for generation in range(generations):
        # every island breeds at least once; packings at the bound can still differ in how loose their last sequence is
        if generation and -fitness(people[0])[0] == least:
            break
        children = [_cross(people[a], people[b], lengths, capacity, rng) for a, b in (rng.choice(len(people), 2, replace=False) for _ in range(population // 2))]
        people = sorted([*people, *children], key=fitness, reverse=True)[:population]
    return people[0]


def _island(capacity: int, seed: int):
    """applyInPandas of one island for one epoch: rows of the pieces, once for each packing that is handed in."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["origin", "row_key", "piece"], kind="stable")
        origins = rows["origin"].unique()
        packings = [rows.loc[rows["origin"] == o, "bin"].to_numpy(np.int64) for o in origins]
        one = rows[rows["origin"] == origins[0]].copy()
        lengths = one["length"].to_numpy(np.int64)
        shard, island = int(one["shard"].iloc[0]), int(one["island"].iloc[0])
        bins = evolve(lengths, capacity, seed * 1_000_003 + shard * 101 + island, [p for p in packings if (p >= 0).all()])
        bins, fill = _compact(bins, lengths)
        order = np.argsort(bins, kind="stable")
        before = np.cumsum(lengths[order]) - lengths[order]
        offset = np.empty(len(bins), np.int64)
        offset[order] = before - np.repeat(before[np.flatnonzero(np.diff(bins[order], prepend=-1))], np.bincount(bins))
        return one.assign(bin=bins, offset=offset, n_bins=len(fill), fill=fill[bins], origin=one["island"])

    return run


ISLAND_SCHEMA = "shard int, island int, origin int, row_key long, piece int, length long, bin long, offset long, n_bins long, fill long"


def _shards(items: DataFrame, first: int, capacity: int, shard_items: int, islands: int, epochs: int) -> tuple[DataFrame, int]:
    """The best island's packing of every shard, and the number of shards; shard numbers start at ``first``."""
    shards = max(1, math.ceil(items.count() / shard_items))
    number = (F.pmod(F.xxhash64("row_key", "piece", F.lit(first)), F.lit(shards)) + first).cast("int")
    zero = F.lit(0).cast("long")
    state = items.select(number.alias("shard"), F.explode(F.array(*map(F.lit, range(islands)))).alias("island"), F.lit(0).alias("origin"), "row_key", "piece", "length", F.lit(-1).cast("long").alias("bin"), zero.alias("offset"), zero.alias("n_bins"), zero.alias("fill"))
    for epoch in range(epochs):
        if epoch and islands > 1:
            state = state.unionAll(state.withColumn("island", F.pmod(F.col("island") + 1, F.lit(islands))))
        state = durable(state.groupBy("shard", "island").applyInPandas(_island(capacity, epoch), ISLAND_SCHEMA))
    best = state.groupBy("shard").agg(F.min_by("island", F.struct("n_bins", "island")).alias("island"))
    return state.join(best, ["shard", "island"]), shards


def pack_lengths(items: DataFrame, capacity: int = SEQUENCE, shard_items: int = 4096, islands: int = 2, epochs: int = 2, loose: float = 0.9) -> DataFrame:
    """Pack ``row_key``, ``piece``, ``length`` (all under ``capacity``): adds ``sequence_id`` and ``offset``.

    Sequences filled under ``loose``, as the last one of a shard is, are dissolved after the first round and their
    pieces packed once more, together; the second packing is taken if it needs fewer sequences.
    """
    packed, shards = _shards(items, 0, capacity, shard_items, islands, epochs)
    packed = durable(packed)
    open_ = packed.where(F.col("fill") < loose * capacity)
    if shards > 1:
        again = durable(_shards(open_.select("row_key", "piece", "length"), shards, capacity, shard_items, islands, epochs)[0])
        before, after = (d.agg(F.countDistinct("shard", "bin")).first()[0] for d in (open_, again))
        if after < before:
            packed = packed.where(F.col("fill") >= loose * capacity).unionByName(again)
    return packed.select("row_key", "piece", (F.col("shard").cast("long") * (1 << 32) + F.col("bin")).alias("sequence_id"), "offset")


def pack(docs: DataFrame, capacity: int = SEQUENCE, end_id: int = 0, keep_ids: bool = False, files: tuple[str, str, str] | None = None, **settings) -> DataFrame:
    """Every piece of every document with its place: ``sequence_id`` and ``offset`` beside the columns of ``pieces``."""
    cut = durable(pieces(docs, capacity, end_id, keep_ids, files).withColumn("row_key", F.monotonically_increasing_id()))
    placed = pack_lengths(cut.where(F.col("length") < capacity).select("row_key", "piece", "length"), capacity, **settings)
    columns = [c for c in cut.columns if c != "row_key"]
    whole = cut.where(F.col("length") == capacity).select(*columns, (-1 - F.col("row_key")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return whole.unionAll(cut.where(F.col("length") < capacity).join(placed, ["row_key", "piece"]).select(*columns, "sequence_id", "offset"))


def sequences(packed: DataFrame, capacity: int = SEQUENCE) -> DataFrame:
    """The training sequences of a packing made with ``keep_ids``: ``sequence_id``, ``ids``, ``doc_ids`` in order.

    A group is one sequence, so it holds ``capacity`` ids at most.
    """
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "ids"))).alias("p"))
    return parts.select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"))
