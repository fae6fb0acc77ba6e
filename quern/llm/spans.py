"""Substring dedup by sliding sentence spans.

Texts are cut into sentences (at ``.``, ``!``, ``?``, their like in other scripts, and line ends; a sentence of over
``LONG`` words is cut further, after commas or else every ``LONG`` words). In scripts without spaces every letter counts
as a word. From each sentence on, the shortest run of at least ``run`` sentences and ``min_words`` words is hashed, and
so is the shortest one that ends with it: short lines make longer runs, and every sentence of a repeated passage that
has ``run`` sentences and ``min_words`` words lies in a run within the passage. A run that occurs more than once,
anywhere in the corpus, is a repeat. Its first occurrence, by document id and place, stays, and sentences that any other
occurrence covers are removed.

Only hashes travel (96 bits of a 128-bit hash, so that chance finds no repeat at any size): (hash, document, place) is shuffled once to find the first occurrence of each hash, by a minimum
that is pre-aggregated, and once to tell the other occurrences, by a join in which a frequent hash is a skewed key
that adaptive execution splits. Texts are read again only where something is removed.

Sentences are compared with case and white space folded. Edge cases: null and empty texts have no runs; a text of fewer
than ``run`` sentences is one run if it has ``min_words`` words, so short copies count; a text of fewer words has none. Rows that repeat an id with
another text are separate occurrences in the order of their texts' hashes; identical rows count as one document and are
treated alike. Rows with a null id come last. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import blocks, durable

ENDS = ".!?。！？｡．؟۔।॥።།။។"
SENTENCE = re.compile(rf"[^{ENDS}\n]*(?:[{ENDS}]+|\n|$)")
#: Thai, Lao, Tibetan, Myanmar, Khmer, kana and Han: scripts without spaces between words.
UNSPACED = "\u0e00-\u0e4f\u0e80-\u0ecf\u0f40-\u0fbc\u1000-\u103f\u1780-\u17d3\u3005-\u3007\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U000323af"
LETTER = re.compile(f"[{UNSPACED}]")
WORD = re.compile(rf"[{UNSPACED}][^\w\s]*|[^\s{UNSPACED}]+")
COMMAS = ",;:，；：、،؛"
LONG = 20


def sentences(text: str) -> list[tuple[int, int, int]]:
    """(start, end, words) of the sentences; together they cover the text, and a piece without words joins the one before."""
    out: list[list[int]] = []
    spaced = text.isascii() or not LETTER.search(text)
    for m in SENTENCE.finditer(text):
        a, b = m.span()
        if a == b:
            continue
        n = len(m[0].split()) if spaced else len(WORD.findall(m[0]))
        if n == 0 or not any(c.isalnum() for c in m[0]):
            if out:
                out[-1][1] = b
                continue
            n = 0
        if n <= LONG:
            out.append([a, b, n])
            continue
        words = [w.span() for w in WORD.finditer(text, a, b)]
        start, held = a, 0
        for i, (_, e) in enumerate(words):
            held += 1
            if i + 1 < len(words) and (held >= LONG or text[e - 1] in COMMAS and held >= 5):
                out.append([start, e, held])
                start, held = e, 0
        out.append([start, b, held])
    return [tuple(x) for x in out]


def extents(cut: list[tuple[int, int, int]], run: int, min_words: int) -> list[tuple[int, int]]:
    """(first sentence, one past the last) of each run, in order."""
    n = len(cut)
    if not n:
        return []
    size = min(run, n)
    words = np.cumsum([0, *(w for _, _, w in cut)])
    starts = np.arange(n - size + 1)
    ends = np.maximum(starts + size, np.searchsorted(words, words[starts] + min_words))
    if np.array_equal(ends, starts + size):
        return list(zip(starts.tolist(), ends.tolist(), strict=True))
    found = {(a, b) for a, b in zip(starts.tolist(), ends.tolist(), strict=True) if b <= n}
    ends = starts + size
    starts = np.minimum(starts, np.searchsorted(words, words[ends] - min_words, "right") - 1)
    found |= {(a, b) for a, b in zip(starts.tolist(), ends.tolist(), strict=True) if a >= 0}
    return sorted(found)


def runs(text: str, run: int, min_words: int) -> list[tuple[int, bytes]]:
    """(number of the run among the text's ``extents``, 16-byte hash) of each run."""
    cut = sentences(text)
    packed = b"".join(xxhash.xxh3_128_digest(" ".join(text[a:b].lower().split())) for a, b, _ in cut)
    return [(i, xxhash.xxh3_128_digest(packed[16 * a : 16 * b])) for i, (a, b) in enumerate(extents(cut, run, min_words))]


def run_table(docs: DataFrame, run: int = 3, min_words: int = 10) -> DataFrame:
    """``row_key``, ``doc_id``, ``place``, ``hash`` and ``check`` (its next 32 bits) of every run; one Arrow pass, written
    to the shared folder."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in blocks(batch, "text"):
                rows, places, hashes = [], [], []
                for i, text in enumerate(texts):
                    for place, h in runs(text or "", run, min_words):
                        rows.append(i)
                        places.append(place)
                        hashes.append(h)
                at = pa.array(rows, pa.int64())
                words = np.frombuffer(b"".join(hashes), "<i4").reshape(-1, 4)
                columns = [part.column(0).take(at), part.column(1).take(at), pa.array(places, pa.int32()), pa.array(np.ascontiguousarray(words[:, :2]).view("<i8")[:, 0]), pa.array(words[:, 2])]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row_key", "place", "hash", "check"])

    keyed = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("row_key"), "text")
    return durable(keyed.mapInArrow(scan, f"doc_id {dict(docs.dtypes)['doc_id']}, row_key long, place int, hash long, check int"))


def repeats(table: DataFrame) -> DataFrame:
    """Every non-first occurrence of a repeated run: ``doc_id``, ``row_key``, ``place``, ``first_id``."""
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "row_key", "place")
    first = table.groupBy("hash", "check").agg(F.min(order).alias("f"), F.count("*").alias("n")).where("n > 1").select("hash", "check", "f")
    # Written first: in a stage of its own the join, which a frequent run makes skewed, can be split.
    first = durable(first)
    other = ~(F.col("f.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("f.row_key") == F.col("row_key")) & (F.col("f.place") == F.col("place")))
    return table.join(first, ["hash", "check"]).where(other).select("doc_id", "row_key", "place", F.col("f.doc_id").alias("first_id"))


def remove_repeats(docs: DataFrame, run: int = 3, min_words: int = 10) -> DataFrame:
    """The documents that lose sentences: ``doc_id``, ``text`` (what stays), ``n_removed`` sentences, ``removed`` spans
    (start:end, comma-joined) and ``first_ids``, the documents that hold the first occurrences."""
    found = repeats(run_table(docs, run, min_words))
    # distinct first: a document of copies would else list the same first document once for every run
    places = found.groupBy("doc_id", "row_key").agg(F.collect_set("place").alias("places"), F.array_sort(F.collect_set("first_id")).alias("first_ids"))
    keyed = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("row_key"), "text")
    same = keyed["doc_id"].eqNullSafe(places["doc_id"]) & (keyed["row_key"] == places["row_key"])
    hit = keyed.join(places, same).select(keyed["doc_id"], keyed["text"], "places", "first_ids")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in blocks(batch, "text"):
                kept, counts, removed = [], [], []
                for text, places in zip(texts, part.column(2).to_pylist(), strict=True):
                    spans = sentences(text)
                    found = extents(spans, run, min_words)
                    gone = sorted({k for p in places for k in range(*found[p])})
                    out, at, shown = [], 0, []
                    for g in gone:
                        a, b, _ = spans[g]
                        out.append(text[at:a])
                        at = b
                        if shown and shown[-1][1] == a:
                            shown[-1][1] = b
                        else:
                            shown.append([a, b])
                    out.append(text[at:])
                    kept.append("".join(out))
                    counts.append(len(gone))
                    removed.append(",".join(f"{a}:{b}" for a, b in shown))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(kept, pa.string()), pa.array(counts, pa.int64()), pa.array(removed, pa.string()), part.column(3)], names=["doc_id", "text", "n_removed", "removed", "first_ids"])

    kind = dict(docs.dtypes)["doc_id"]
    return hit.mapInArrow(cut, f"doc_id {kind}, text string, n_removed long, removed string, first_ids array<{kind}>")
