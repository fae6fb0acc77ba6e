"""Spelling variants: words one edit apart, found in sorted blocks that share a half, and the form each belongs to.

One edit leaves a half of a word intact. So every word stands in two dictionaries, sorted forward by its first half and
in reverse by its last; words one edit apart meet in a run (block) of one of them. A block is known by the length ``m``
of its shorter words, the bounds ``lo`` <= p < ``hi`` of the place p where the edit can be, and the letters outside
(``head`` before lo, ``tail`` from hi). A block of more than ``LIMIT`` words is cut in two the same way, by the half of
its open part that the edit leaves intact, until one letter is open; such a block holds no more words than the alphabet
allows. Blocks are scanned in key order, each against itself, and pairs verified letter by letter in arrays; the place p
of a pair, the length of its common prefix, lies in one block only, so no pair comes twice.

Edge cases: null and empty texts hold no word; a null id counts as the text ``null`` in the draw of deleted letters;
repeated rows count each; without a word that is frequent enough the result is empty. Ties between forms of equal counts
go to the smaller word in code-point order. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import let
from quern.llm.common import durable, join_counted

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["m", "lo", "hi", "head", "tail"]
LIMIT = 128


def frequent_words(docs: DataFrame, min_length: int = 6, min_count: int = 5, drop_mod: int = 199) -> DataFrame:
    """``word``, ``n``: runs of Latin letters, A-Z lower-cased, of at least ``min_length`` letters and ``min_count``
    occurrences. A run whose crc32 with its document's id is divisible by ``drop_mod`` loses one letter first."""
    found = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("_id"), F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z\\u00C0-\\u00FF]+"), F.lit(0))).alias("_run"))
    found = found.where(F.char_length("_run") >= min_length).select("_id", F.translate("_run", UPPER, LOWER).alias("_low"))
    crc = F.crc32(F.concat("_id", F.lit(":"), "_low").cast("binary"))
    at = (F.col("_h") % F.char_length("_low")).cast("int")
    less = F.concat(F.substring(F.col("_low"), F.lit(1), at), F.substring(F.col("_low"), at + 2, F.char_length("_low")))
    word = F.when(F.col("_h") % drop_mod == 0, less).otherwise(F.col("_low"))
    kept = found.withColumn("_h", crc).select(word.alias("word")).where(F.char_length("word") >= min_length)
    return kept.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def _halves(m: Column, lo: Column, hi: Column) -> Column:
    """The two blocks of ``word`` whose open part is a half of lo..hi, as an array of keys."""
    mid = ((lo + hi) / 2).cast("int")
    word = F.col("word")
    end = lambda h: F.right(word, F.greatest(m - h, F.lit(0)))
    fore = F.struct(m.alias("m"), mid.alias("lo"), hi.alias("hi"), F.left(word, mid).alias("head"), end(hi).alias("tail"))
    back = F.struct(m.alias("m"), lo.alias("lo"), mid.alias("hi"), F.left(word, lo).alias("head"), end(mid).alias("tail"))
    return F.array(fore, back)


def _first_blocks(words: DataFrame, min_length: int) -> DataFrame:
    """Every word in the forward and the reversed dictionary, as the shorter word of a pair and as the longer one."""
    size = F.char_length("word")
    lengths = F.when(size > min_length, F.array(size, size - 1)).otherwise(F.array(size))
    rows = words.select("word", "n", F.explode(lengths).alias("_m"))
    return rows.select("word", "n", F.explode(_halves(F.col("_m"), F.lit(0), F.col("_m") + 1)).alias("_b")).select("word", "n", "_b.*")


def blocks_to_scan(words: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Rows of blocks small enough to scan; larger ones are cut in halves, a level at a time, each level written.

    Only blocks of two words or more, one of them short, go on. A level joins the rows to the counts of their blocks.
    """
    least = words.agg(F.min(F.char_length("word"))).first()[0] or 1
    rows, out = _first_blocks(words, least), None
    while True:
        short = F.sum((F.char_length("word") == F.col("m")).cast("int"))
        counts = rows.groupBy(*KEY).agg(F.count("*").alias("_rows"), short.alias("_short")).where("_rows > 1 and _short > 0").drop("_short")
        level = durable(join_counted(rows, durable(counts), KEY))
        large = (F.col("_rows") > limit) & (F.col("hi") - F.col("lo") > 1)
        part = level.where(~large).drop("_rows")
        out = part if out is None else out.unionByName(part)
        if not level.where(large).limit(1).count():
            return out
        rows = level.where(large).select("word", "n", F.explode(_halves(F.col("m"), F.col("lo"), F.col("hi"))).alias("_b")).select("word", "n", "_b.*")


def _pairs_in(keys: np.ndarray, words: list[str], short: np.ndarray, lo: np.ndarray, hi: np.ndarray, width: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the pairs one edit apart inside the blocks; rows come block by block, short words first."""
    n = len(words)
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    sizes = np.diff(np.append(first, n))
    place, room = np.arange(n) - np.repeat(first, sizes), np.repeat(sizes, sizes)
    lengths = np.fromiter(map(len, words), np.int64, n)
    # Rows of words too long for the matrix are compared in Python, so its width does not follow the longest word.
    wide = lengths > width
    letters = np.array([w if len(w) <= width else "" for w in words], dtype=f"U{width + 1}").view(np.uint32).reshape(n, width + 1)
    left, right = [], []
    for step in range(1, int(sizes.max()) if n else 0):
        a = np.flatnonzero((place + step < room) & short)
        b = a + step
        long = wide[a] | wide[b]
        for i, j in zip(a[long], b[long], strict=True):
            if one_edit(words[i], words[j], lo[i], hi[i]):
                left.append(np.array([i]))
                right.append(np.array([j]))
        a, b = a[~long], b[~long]
        same = lengths[a] == lengths[b]
        i, j = a[same], b[same]
        ok = (letters[i] != letters[j]).sum(axis=1) == 1
        left.append(i[ok])
        right.append(j[ok])
        i, j = a[~same], b[~same]
        p = (letters[i] != letters[j]).argmax(axis=1)  # the common prefix
        off = letters[i][:, :-1] != letters[j][:, 1:]
        last = np.where(off.any(axis=1), off.shape[1] - 1 - off[:, ::-1].argmax(axis=1), -1)
        ok = (last < p) & (lo[i] <= p) & (p < hi[i])
        left.append(i[ok])
        right.append(j[ok])
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def one_edit(a: str, b: str, lo: int = 0, hi: int | None = None) -> bool:
    """Whether exactly one letter is replaced, or inserted into the shorter ``a``, at a place of lo..hi - 1."""
    p = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    rest = a[p + 1 :] == b[p + 1 :] if len(a) == len(b) else a[p:] == b[p + 1 :]
    return a != b and rest and abs(len(b) - len(a)) <= 1 and lo <= p and (hi is None or p < hi)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of each block, both ways; the last block of a batch waits for the next batch."""
    names = ["word", "near", "near_n"]

    def scanned(t: pa.Table) -> pa.RecordBatch:
        words = t["word"].to_pylist()
        m, lo, hi = (t[c].to_numpy() for c in ("m", "lo", "hi"))
        short = np.fromiter(map(len, words), np.int64, len(words)) == m
        a, b = _pairs_in(t["_block"].to_numpy(), words, short, lo, hi)
        at, other = pa.array(np.concatenate([a, b])), pa.array(np.concatenate([b, a]))
        return pa.RecordBatch.from_arrays([pa.concat_arrays(x.chunks) if isinstance(x, pa.ChunkedArray) else x for x in (t["word"].take(at), t["word"].take(other), t["n"].take(other))], names=names)

    held: pa.Table | None = None
    count, last = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = list(zip(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in KEY], strict=True))
        numbers = np.empty(len(keys), np.int64)
        for i, k in enumerate(keys):
            count += k != last
            last = k
            numbers[i] = count
        table = pa.Table.from_batches([batch]).append_column("_block", pa.array(numbers))
        table = table if held is None else pa.concat_tables([held, table])
        done = int(np.searchsorted(table["_block"].to_numpy(), count))
        if done:
            yield scanned(table.slice(0, done))
        held = table.slice(done)
    if held is not None and held.num_rows:
        yield scanned(held)


def near_words(words: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``word``, ``near``, ``near_n``: both ways for all words (``word``, ``n``, distinct) that are one edit apart."""
    rows = blocks_to_scan(words, limit)
    ordered = rows.repartition(*KEY).sortWithinPartitions(*KEY, F.char_length("word"), "word")
    return ordered.mapInArrow(_scan, "word string, near string, near_n long")


def forms(words: DataFrame, ratio: int = 5, limit: int = LIMIT) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n``: the most frequent near word, if it occurs ``ratio`` times
    as often or more, and the last word reached from form to form.

    Counts grow by that ratio at each step, so chains are short; they are followed by doubling, a written round each.
    """
    best = near_words(words, limit).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("b"))
    known = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("b.form").alias("form"), (-F.col("b.less")).alias("form_n"))
    fits = F.coalesce(F.col("form_n") >= ratio * F.col("n"), F.lit(False))
    known = durable(known.withColumn("form", F.when(fits, F.col("form"))).withColumn("form_n", F.when(fits, F.col("form_n"))))
    roots = known.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        jump = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = durable(roots.join(jump, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        roots = moved.select("word", "root")
        if not moved.where("moved").limit(1).count():
            break
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """``forms`` of the frequent words of the whole texts of ``docs``."""
    return forms(durable(frequent_words(docs)))
