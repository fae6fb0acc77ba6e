"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may occur in a document with up to k = floor(m * error_rate) edits. Cut the item into
k + 1 pieces: each edit spoils one piece at most, so one piece survives exactly. All pieces of all items stand in one
Aho-Corasick automaton, each document is read once, and every piece hit names a window that the item could fill.
Windows of one item that overlap are merged, and each is verified with Myers' bit-parallel edit distance.

Texts are compared in lower case with runs of white space as one space; offsets count characters of that form.
Items of under ``min_chars`` characters have no budget: they are searched exactly, and as whole words where their script
puts spaces between words, since ``can`` is no leak in ``candle``.

Edge cases: a null or empty document has no hit; null items, and those without a character but white space, are not
searched; repeated items share one search and each is reported; repeated documents are each reported. Other columns are
not read, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import blocks
from quern.llm.spans import LETTER as UNSPACED

ERROR_RATE = 0.08
MIN_CHARS = 20


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def myers(masks: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """Least edit distance of the pattern to any substring of ``text`` and the first end at which it is reached."""
    full, high = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = m, 0
    get = masks.get
    for i, c in enumerate(text, 1):
        eq = get(c, 0)
        x = eq | minus
        d = (((eq & plus) + plus) ^ plus) | eq
        d |= minus
        hp = minus | ~(d | plus) & full
        hm = plus & d
        if hp & high:
            score += 1
        elif hm & high:
            score -= 1
        hp = (hp << 1) & full
        hm = (hm << 1) & full
        plus = hm | (~(x | d | hp) & full)
        minus = hp & d
        if score < best:
            best, end = score, i
    return best, end


def is_whole(text: str, start: int, end: int) -> bool:
    """Whether text[start:end] neither starts nor ends inside a word of a script that puts spaces between words."""

    def joined(a: str, b: str) -> bool:
        return a.isalnum() and b.isalnum() and not UNSPACED.search(a + b)

    return not (start > 0 and joined(text[start - 1], text[start]) or end < len(text) and joined(text[end - 1], text[end]))


def masks_of(pattern: str) -> dict[str, int]:
    out: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        out[c] |= 1 << i
    return dict(out)


class ItemMatcher:
    """Automaton of the pieces of ``items`` and the patterns that verify a hit."""

    def __init__(self, items: list[str], error_rate: float = ERROR_RATE, min_chars: int = MIN_CHARS):
        self.items = items
        self.short = [len(t) < min_chars for t in items]
        self.budget = [0 if short else int(len(t) * error_rate) for t, short in zip(items, self.short, strict=True)]
        self.forward: dict[int, dict[str, int]] = {}
        self.backward: dict[int, dict[str, int]] = {}
        pieces: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for n, (t, k) in enumerate(zip(items, self.budget, strict=True)):
            cuts = [len(t) * i // (k + 1) for i in range(k + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                pieces[t[a:b]].append((n, a))
        self.automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()

    def windows(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(item, start, end) of the merged windows that a piece hit names."""
        found: dict[int, list[int]] = defaultdict(list)
        for end, (size, places) in self.automaton.iter(text):
            for n, offset in places:
                if not self.short[n] or is_whole(text, end - size + 1, end + 1):
                    found[n].append(end - size + 1 - offset)
        for n, diagonals in found.items():
            m, k = len(self.items[n]), self.budget[n]
            diagonals.sort()
            lo = hi = diagonals[0]
            for d in diagonals[1:]:
                if d - hi > m + 2 * k:
                    yield n, max(0, lo - k), hi + m + k
                    lo = d
                hi = d
            yield n, max(0, lo - k), hi + m + k

    def matches(self, text: str) -> Iterator[tuple[int, int, int, int]]:
        """(item, distance, start, end) of the best occurrence of each item within its budget."""
        best: dict[int, tuple[int, int, int]] = {}
        for n, lo, hi in self.windows(text):
            item, k = self.items[n], self.budget[n]
            window = text[lo:hi]
            at = window.find(item)
            if at >= 0:
                got = (0, lo + at, lo + at + len(item))
            else:
                if n not in self.forward:
                    self.forward[n], self.backward[n] = masks_of(item), masks_of(item[::-1])
                distance, end = myers(self.forward[n], len(item), window)
                if distance > k:
                    continue
                head = window[max(0, end - len(item) - k) : end]
                _, back = myers(self.backward[n], len(item), head[::-1])
                got = (distance, lo + end - back, lo + end)
            best[n] = min(best.get(n, got), got)
        for n in sorted(best):
            yield (n, *best[n])


def _known(benchmark: DataFrame) -> DataFrame:
    return benchmark.where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")


def _distinct_items(benchmark: DataFrame, block_chars: int) -> Iterator[list[tuple[str, int]]]:
    """The distinct item texts in blocks of about ``block_chars`` characters: normalised text and the hash of the text."""
    distinct = _known(benchmark).select("text").distinct().withColumn("text_key", F.xxhash64("text"))
    total = distinct.agg(F.sum(F.char_length("text"))).first()[0] or 0
    n = int(total // block_chars) + 1
    for b in range(n):
        rows = distinct.where(F.pmod(F.xxhash64("text"), F.lit(n)) == b).collect()
        yield sorted((t, row["text_key"]) for row in rows if (t := normal(row["text"])))


def contaminated(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, min_chars: int = MIN_CHARS, block_chars: int = 4_000_000) -> DataFrame:
    """``doc_id``, ``item_id``, ``distance``, ``start_pos``, ``end_pos``: the best occurrence of each item in each document.

    The test items are the stated query set: their distinct texts are taken in blocks of at most ``block_chars``
    characters, one pass over the documents for each block, so neither driver nor task holds more than a block. The ids
    that share a text meet its hits in a join at the end.
    """
    id_type = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {id_type}, text_key long, distance int, start_pos long, end_pos long"
    out = None
    for searched in _distinct_items(benchmark, block_chars):

        def run(batches: Iterator[pa.RecordBatch], searched: list = searched) -> Iterator[pa.RecordBatch]:
            matcher = ItemMatcher([t for t, _ in searched], error_rate, min_chars) if searched else None
            for batch in batches:
                for part, texts in blocks(batch, "text"):
                    rows, found = [], []
                    for i, text in enumerate(texts):
                        for n, *place in matcher.matches(normal(text)) if matcher else ():
                            rows.append(i)
                            found.append((searched[n][1], *place))
                    columns = list(zip(*found, strict=True)) or [[]] * 4
                    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                        names=["doc_id", "text_key", "distance", "start_pos", "end_pos"],
                    )

        found = docs.select("doc_id", "text").mapInArrow(run, schema)
        out = found if out is None else out.unionAll(found)
    # an id may stand for several texts and a text for several ids, so hits meet ids by the text
    members = _known(benchmark).select("item_id", F.xxhash64("text").alias("text_key")).distinct()
    return out.join(members, "text_key").select("doc_id", "item_id", "distance", "start_pos", "end_pos")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, min_chars: int = MIN_CHARS, block_chars: int = 4_000_000) -> DataFrame:
    """``docs``, all columns, without the rows that hold a test item within its edit budget; no join, no shuffle."""
    for block in _distinct_items(benchmark, block_chars):
        searched = [t for t, _ in block]

        def run(batches: Iterator[pa.RecordBatch], searched: list = searched) -> Iterator[pa.RecordBatch]:
            matcher = ItemMatcher(searched, error_rate, min_chars) if searched else None
            for batch in batches:
                for part, texts in blocks(batch, "text"):
                    clean = [matcher is None or next(matcher.matches(normal(t)), None) is None for t in texts]
                    yield part.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
