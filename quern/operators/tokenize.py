"""Pre-tokenisers and subword vocabularies.

The corpus is reduced to word counts by Spark. Merge loops run on every distinct word: on the driver while these are few,
else in rounds on Spark with the same result. Encoding runs once for each distinct word and is joined back.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.dedup import persisted, release

END = "</w>"
SPECIALS = ("<pad>", "<unk>", "<bos>", "<eos>")
# The byte-level pre-tokeniser's pattern.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SIMPLE = r"(?U)\w+|[^\w\s]"
CJK = r"\p{IsHan}|[\p{P}\p{S}]|\p{N}+|[\p{L}&&[^\p{IsHan}]]+"


def pretokens(text: Column, pattern: str = SIMPLE) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def word_frequencies(docs: DataFrame, pattern: str = SIMPLE) -> DataFrame:
    return docs.select(F.explode(pretokens(F.col("text"), pattern)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def symbols(word: Column) -> Column:
    """Characters of a word and the end mark."""
    return F.concat(F.filter(F.split(word, ""), lambda c: c != ""), F.array(F.lit(END)))


def pair_counts(words: DataFrame) -> DataFrame:
    """``left``, ``right``, ``n`` of neighbouring symbols (array column ``symbols``), weighted by the words' counts."""
    at = F.when(F.size("symbols") > 1, F.sequence(F.lit(0), F.size("symbols") - 2))
    pairs = words.select("n", F.explode(F.transform(at, lambda i: F.struct(F.get("symbols", i).alias("left"), F.get("symbols", i + 1).alias("right")))).alias("p"))
    return pairs.groupBy("p.left", "p.right").agg(F.sum("n").alias("n"))


def pair_scores(words: DataFrame, min_frequency: int = 0) -> DataFrame:
    """``left``, ``right``, ``score`` = count of the pair over the product of its symbols' counts."""
    singles = words.select("n", F.explode("symbols").alias("s")).groupBy("s").agg(F.sum("n").alias("m"))
    joined = pair_counts(words).where(F.col("n") >= min_frequency).join(singles.select(F.col("s").alias("left"), F.col("m").alias("ml")), "left").join(singles.select(F.col("s").alias("right"), F.col("m").alias("mr")), "right")
    return joined.select("left", "right", (F.col("n") / (F.col("ml") * F.col("mr"))).alias("score"))


def merge(symbols_: Column, left: str | Column, right: str | Column, joined: str | Column | None = None) -> Column:
    """The array with each neighbouring ``left``, ``right`` made one symbol, from the left."""
    a, b = F.lit(left), F.lit(right)
    ab = F.concat(a, b) if joined is None else F.lit(joined)
    step = lambda done, s: F.when((F.size(done) > 0) & (F.element_at(done, -1) == a) & (s == b), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(ab))).otherwise(F.array_append(done, s))
    return F.aggregate(symbols_, F.array().cast("array<string>"), step)


def learn_merges(counts: DataFrame, merges: int, min_frequency: int = 2, max_words: int = 200_000) -> list[tuple[str, str]]:
    """Byte-pair merges learned from every word; ties go to the smaller pair.

    Up to ``max_words`` distinct words the driver holds them and a merge touches only the words of its pair. More words stay
    a Spark table that is counted in rounds; the merges are the same.
    """
    table = persisted(counts.select("word", "n"))
    rows = table.limit(max_words + 1).collect()
    if len(rows) > max_words:
        return _merge_rounds(table, merges, min_frequency)
    release(table)
    words = [([*r["word"], END], r["n"]) for r in rows]
    pairs: Counter = Counter()
    where: dict[tuple[str, str], set[int]] = {}
    for i, (s, n) in enumerate(words):
        for p in zip(s, s[1:], strict=False):
            pairs[p] += n
            where.setdefault(p, set()).add(i)
    out = []
    while len(out) < merges and pairs:
        best, n = min(pairs.items(), key=lambda x: (-x[1], x[0]))
        if n < min_frequency:
            break
        out.append(best)
        for i in sorted(where.pop(best)):
            s, n = words[i]
            for p in zip(s, s[1:], strict=False):
                pairs[p] -= n
                if pairs[p] <= 0:
                    del pairs[p]
            new = _merged(s, best)
            words[i] = (new, n)
            for p in zip(new, new[1:], strict=False):
                pairs[p] += n
                where.setdefault(p, set()).add(i)
        pairs.pop(best, None)
    return out


class _Points:
    """Symbols as single code points, so that a word is a string and a merge replaces two of its characters by one. A character
    stands for itself; ``point`` gives other symbols code points that ``used`` texts lack."""

    def __init__(self, used: set[str]):
        self.names: dict[str, str] = {}
        self.points: dict[str, str] = {}
        self.free = (c for c in map(chr, range(0x40000, 0x110000)) if c not in used)

    def point(self, name: str) -> str:
        if name not in self.points:
            self.points[name] = next(self.free)
            self.names[self.points[name]] = name
        return self.points[name]

    def of(self, symbol: str) -> str:
        return self.points.get(symbol, symbol)

    def name(self, point: Column) -> Column:
        known = F.create_map(*[F.lit(x) for pair in self.names.items() for x in pair]) if self.names else F.lit(None)
        return F.coalesce(F.try_element_at(known, point), point) if self.names else point


def _replaced(word: Column, merges: list[tuple[str, str]]) -> Column:
    """``word`` with each (pair, joined) of code points replaced in order, from the left."""
    for pair, joined in merges:
        word = F.replace(word, F.lit(pair), F.lit(joined))
    return word


def _pieces_of(word: Column, size: int) -> Column:
    """Its substrings of ``size`` code points."""
    return F.when(F.char_length(word) >= size, F.transform(F.sequence(F.lit(1), F.char_length(word) - size + 1), lambda i: F.substring(word, i, F.lit(size))))


def _characters(words: DataFrame) -> set[str]:
    return {r["c"] for r in words.select(F.explode(F.split("word", "")).alias("c")).distinct().collect()}


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their ``n``."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
    return keys[first], np.add.reduceat(n[order], first) if len(first) else n


def _point_pairs(words: DataFrame) -> DataFrame:
    """``p``, ``n``: neighbouring code points of the words ``s``, counted by ``n``; a task adds its own up before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            x = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
            of = np.repeat(np.arange(len(texts)), np.fromiter(map(len, texts), np.int64, len(texts)))
            at = np.flatnonzero(of[:-1] == of[1:])
            new, n = _summed(x[at] << 21 | x[at + 1], batch.column(0).to_numpy()[of[at]])
            keys, sums = _summed(np.concatenate([keys, new]), np.concatenate([sums, n]))
        yield pa.RecordBatch.from_arrays([pa.array([chr(p >> 21) + chr(p & 0x1FFFFF) for p in keys.tolist()], pa.string()), pa.array(sums)], names=["p", "n"])

    return words.select("n", "s").mapInArrow(count, "p string, n long").groupBy("p").agg(F.sum("n").alias("n"))


def _merge_rounds(words: DataFrame, merges: int, min_frequency: int, candidates: int = 256, pending: int = 24) -> list[tuple[str, str]]:
    """The merges of ``learn_merges`` with the words in a table: a round counts all pairs, brings the ``candidates`` most
    frequent to the driver, and takes those that no earlier merge of the round can overtake (``_settled``). Merges are applied as
    the words are read; the words are written anew once more than ``pending`` of them wait."""
    points = _Points(_characters(words))
    state = persisted(words.select("n", F.concat("word", F.lit(points.point(END))).alias("s")))
    release(words)
    out: list[tuple[str, str]] = []
    waiting: list[tuple[str, str]] = []
    made = {END}
    while len(out) < merges:
        now = state.select("n", _replaced(F.col("s"), waiting).alias("s")).where(F.char_length("s") > 1)
        if len(waiting) > pending:
            last, state, waiting = state, persisted(now), []
            now = state
            release(last)
        pairs = _point_pairs(now).where(F.col("n") >= min_frequency)
        named = pairs.select("n", points.name(F.substring("p", 1, 1)).alias("left"), points.name(F.substring("p", 2, 1)).alias("right"))
        ranked = named.orderBy(F.desc("n"), "left", "right").limit(candidates).collect()
        batch = _settled([((r["left"], r["right"]), r["n"]) for r in ranked], made, len(ranked) < candidates)[: merges - len(out)]
        if not batch:
            break
        out += batch
        made |= {a + b for a, b in batch}
        waiting += [(points.of(a) + points.of(b), points.point(a + b)) for a, b in batch]
    release(state)
    return out


def _settled(ranked: list[tuple[tuple[str, str], int]], made: set[str], complete: bool) -> list[tuple[str, str]]:
    """The head of the ranking that stays the head, in this order, while it is merged one by one.

    Merging (a, b) changes the counts of pairs that end in a or start with b only, and a pair that it makes is at most as
    frequent as one of these. So pairs more frequent than the first such pair are safe. A merge whose symbol exists already,
    or of a symbol with itself, ends the round, and so does the end of an incomplete ranking.
    """
    taken: list[tuple[str, str]] = []
    floor = 0 if complete or not ranked else ranked[-1][1]
    new: set[str] = set()
    for i, ((a, b), n) in enumerate(ranked):
        if i and n <= floor:
            break
        if any(b == x or a == y for x, y in taken):
            while taken[1:] and ranked[len(taken) - 1][1] == n:
                taken.pop()
            break
        taken.append((a, b))
        if a == b or a + b in made or a + b in new:
            break
        new.add(a + b)
    return taken


def _merged(s: list[str], pair: tuple[str, str]) -> list[str]:
    out: list[str] = []
    for x in s:
        if out and (out[-1], x) == pair:
            out[-1] += x
        else:
            out.append(x)
    return out


def learn_wordpiece(counts: DataFrame, merges: int, prefix: str = "##", min_frequency: int = 2, max_words: int = 200_000) -> list[str]:
    """A WordPiece vocabulary: single characters (those inside a word marked by ``prefix``) and the pieces of ``merges``
    merges of the pair with the best count / (count of left * count of right); ties go to the smaller pair.

    As in ``learn_merges``, the driver holds up to ``max_words`` distinct words, and more are counted by Spark, here with
    one merge a round, because a merge changes the score of every pair that shares a symbol with it.
    """
    table = persisted(counts.where("word <> ''").select("word", "n"))
    rows = table.limit(max_words + 1).collect()
    if len(rows) > max_words:
        return _wordpiece_rounds(table, merges, prefix, min_frequency)
    release(table)
    words = [([c if i == 0 else prefix + c for i, c in enumerate(r["word"])], r["n"]) for r in rows]
    singles: Counter = Counter()
    pairs: Counter = Counter()
    where: dict[tuple[str, str], set[int]] = {}

    def count(i: int, sign: int) -> None:
        s, n = words[i]
        for x in s:
            singles[x] += sign * n
        for p in zip(s, s[1:], strict=False):
            pairs[p] += sign * n
            if sign > 0:
                where.setdefault(p, set()).add(i)

    for i in range(len(words)):
        count(i, 1)
    vocabulary = set(singles)
    for _ in range(merges):
        open_ = [(-n / (singles[p[0]] * singles[p[1]]), p) for p, n in pairs.items() if n >= min_frequency]
        if not open_:
            break
        best = min(open_)[1]
        joined = best[0] + best[1].removeprefix(prefix)
        vocabulary.add(joined)
        for i in sorted(where.pop(best)):
            count(i, -1)
            s, n = words[i]
            out: list[str] = []
            for x in s:
                if out and (out[-1], x) == best:
                    out[-1] = joined
                else:
                    out.append(x)
            words[i] = (out, n)
            count(i, 1)
        pairs.pop(best, None)
    return sorted(vocabulary)


def _wordpiece_rounds(words: DataFrame, merges: int, prefix: str, min_frequency: int) -> list[str]:
    """``learn_wordpiece`` with the words in a table; the best pair of each round and the characters reach the driver."""
    letters = sorted(_characters(words) - {""})
    points = _Points(set(letters))
    inside = "".join(points.point(prefix + c) for c in letters)
    state = persisted(words.select("n", F.concat(F.substring("word", 1, 1), F.translate(F.substring(F.col("word"), F.lit(2), F.char_length("word")), "".join(letters), inside)).alias("s")))
    release(words)
    vocabulary: set[str] = set()
    for turn in range(max(merges, 1)):
        counts = persisted(state.select("n", F.explode(F.concat(_pieces_of(F.col("s"), 1), F.coalesce(_pieces_of(F.col("s"), 2), F.array().cast("array<string>")))).alias("p")).groupBy("p").agg(F.sum("n").alias("n")))
        single = counts.where(F.char_length("p") == 1)
        if not turn:
            vocabulary = {r["s"] for r in single.select(points.name(F.col("p")).alias("s")).collect()}
        if not merges:
            break
        pairs = counts.where((F.char_length("p") == 2) & (F.col("n") >= min_frequency)).select(F.substring("p", 1, 1).alias("l"), F.substring("p", 2, 1).alias("r"), "n")
        scored = pairs.join(single.select(F.col("p").alias("l"), F.col("n").alias("ml")), "l").join(single.select(F.col("p").alias("r"), F.col("n").alias("mr")), "r")
        scored = scored.select("l", "r", points.name(F.col("l")).alias("left"), points.name(F.col("r")).alias("right"), (F.col("n") / (F.col("ml") * F.col("mr"))).alias("score"))
        best = scored.orderBy(F.desc("score"), "left", "right").first()
        release(counts)
        if best is None:
            break
        joined = best["left"] + best["right"].removeprefix(prefix)
        vocabulary.add(joined)
        last, state = state, persisted(state.select("n", _replaced(F.col("s"), [(best["l"] + best["r"], points.point(joined))]).alias("s")))
        release(last)
    release(state)
    return sorted(vocabulary)


def vocabulary_ids(tokens: DataFrame, specials: tuple[str, ...] = SPECIALS) -> DataFrame:
    """``token``, ``id``: the special tokens first, then by length, longest first, then by spelling."""
    from pyspark.sql import Window

    ordered = tokens.select("token").distinct().where(~F.col("token").isin(*specials))
    ids = ordered.withColumn("id", F.row_number().over(Window.orderBy(F.desc(F.char_length("token")), "token")) + len(specials) - 1)
    fixed = tokens.sparkSession.createDataFrame([(t, i) for i, t in enumerate(specials)], "token string, id int")
    return fixed.unionByName(ids)


def by_merges(merges: list[tuple[str, str]]) -> Callable[[str], list[str]]:
    """The function that gives the pieces of a word under the merges."""
    rank = {p: i for i, p in enumerate(merges)}

    def one(word: str) -> list[str]:
        s = [*word, END]
        while len(s) > 1:
            best = min(zip(s, s[1:], strict=False), key=lambda p: rank.get(p, len(rank)))
            if best not in rank:
                break
            s = _merged(s, best)
        return s

    return one


def _each_word(counts: DataFrame, one: Callable[[str], list[str]]) -> DataFrame:
    @F.pandas_udf("array<string>")
    def pieces(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for words in batches:
            yield words.map(one)

    return counts.select("word", pieces("word").alias("pieces"))


def apply_merges(counts: DataFrame, merges: list[tuple[str, str]]) -> DataFrame:
    """``word``, ``pieces`` of each distinct word under the merges."""
    return _each_word(counts, by_merges(merges))


def by_longest(vocabulary: list[str], prefix: str = "##", unknown: str = "[UNK]") -> Callable[[str], list[str]]:
    """The function that gives the pieces of a word by greedy longest match."""
    known = frozenset(vocabulary)
    longest = max(map(len, known), default=0)

    def one(word: str) -> list[str]:
        out, at = [], 0
        while at < len(word):
            found = next((word[at:e] for e in range(min(len(word), at + longest), at, -1) if (prefix if at else "") + word[at:e] in known), None)
            if found is None:
                return [unknown]
            out.append((prefix if at else "") + found)
            at += len(found)
        return out

    return one


def longest_match(counts: DataFrame, vocabulary: list[str], prefix: str = "##", unknown: str = "[UNK]") -> DataFrame:
    """``word``, ``pieces``: greedy longest vocabulary match from the left; a word that fails anywhere is unknown."""
    return _each_word(counts, by_longest(vocabulary, prefix, unknown))


def substrings(counts: DataFrame, longest: int = 20, top: int = 10_000) -> DataFrame:
    """The most frequent substrings of the words, and every single character: the first unigram vocabulary."""
    w = F.col("word")
    starts = F.sequence(F.lit(1), F.char_length(w))
    all_ = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.char_length(w) - i + 1)), lambda n: F.substring(w, i, n))))
    rows = counts.where("word <> ''").select("n", F.explode(all_).alias("token")).groupBy("token").agg(F.sum("n").alias("n"))
    single = F.char_length("token") == 1
    return rows.where(single).unionAll(rows.where(~single).orderBy(F.desc("n"), "token").limit(top))


def best_segmentation(counts: DataFrame, log_p: dict[str, float]) -> DataFrame:
    """``word``, ``pieces`` of highest total log-probability (Viterbi); unknown characters cost more than any token."""
    worst = min(log_p.values(), default=0.0) - 10
    longest = max(map(len, log_p), default=1)

    def one(word: str) -> list[str]:
        best: list[tuple[float, int]] = [(0.0, 0)]
        for e in range(1, len(word) + 1):
            options = [(best[s][0] + log_p.get(word[s:e], worst if e - s == 1 else float("-inf")), s) for s in range(max(0, e - longest), e)]
            best.append(max(options, key=lambda x: (x[0], -x[1])))
        out, e = [], len(word)
        while e:
            out.append(word[best[e][1] : e])
            e = best[e][1]
        return out[::-1]

    @F.pandas_udf("array<string>")
    def pieces(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for words in batches:
            yield words.map(one)

    return counts.select("word", pieces("word").alias("pieces"))


def learn_unigram(counts: DataFrame, size: int, longest: int = 8, rounds: int = 4, shrink: float = 0.75, start: int = 4000) -> dict[str, float]:
    """Unigram vocabulary by hard expectation-maximisation: segment, count, drop the rarest quarter (never single
    characters) until ``size`` tokens are left. Spark segments and counts; the driver holds the vocabulary only."""
    import math

    first = substrings(counts, longest, start).collect()
    total = sum(r["n"] for r in first) or 1
    log_p = {r["token"]: math.log(r["n"] / total) for r in first}
    while True:
        for _ in range(rounds if len(log_p) <= size else 1):
            used = best_segmentation(counts, log_p).join(counts, "word").select("n", F.explode("pieces").alias("t")).groupBy("t").agg(F.sum("n").alias("n")).collect()
            total = sum(r["n"] for r in used) or 1
            seen = {r["t"]: math.log(r["n"] / total) for r in used}
            floor = min(seen.values(), default=0.0) - 1
            log_p = {t: seen.get(t, floor) for t in {*log_p, *(t for t in seen if len(t) == 1)}}
        if len(log_p) <= size:
            return log_p
        singles = {t for t in log_p if len(t) == 1}
        rest = sorted((t for t in log_p if len(t) > 1), key=lambda t: (-log_p[t], t))
        keep = max(size - len(singles), 0) if len(log_p) * shrink <= size else int(len(rest) * shrink)
        if keep >= len(rest):
            return log_p
        log_p = {t: log_p[t] for t in [*singles, *rest[:keep]]}


def encoded(docs: DataFrame, pieces: DataFrame, ids: DataFrame, pattern: str = SIMPLE, unknown: int = 1, key: str = "doc_id") -> DataFrame:
    """``key``, ``ids``: each document's words replaced by their pieces' ids. Words are encoded once and joined back."""
    flat = pieces.select("word", F.posexplode("pieces").alias("at", "token")).join(ids, "token", "left")
    per_word = flat.groupBy("word").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", F.coalesce("id", F.lit(unknown)).alias("id")))), lambda x: x["id"]).alias("ids"))
    words = docs.select(key, F.posexplode(pretokens(F.col("text"), pattern)).alias("at", "word"))
    joined = words.join(per_word, "word", "left").withColumn("ids", F.coalesce("ids", F.array(F.lit(unknown))))
    out = joined.groupBy(key).agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("at", "ids"))), lambda x: x["ids"])).alias("ids"))
    return docs.select(key).join(out, key, "left").select(key, F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))


def encoded_by(docs: DataFrame, one: Callable[[str], list[str]], ids: DataFrame, pattern: str = SIMPLE, unknown: int = 1, key: str = "doc_id", most: int = 500_000) -> DataFrame:
    """As ``encoded``, with the function that gives a word's pieces instead of their table: no word leaves its document.

    A task encodes each word of a lot of documents once and keeps the ids of up to ``most`` words; the vocabulary ``ids`` is
    sent to the tasks.
    """
    sent = docs.sparkSession.sparkContext.broadcast({r["token"]: r["id"] for r in ids.select("token", "id").collect()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, seen = sent.value, {}
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                words = batch.column(1)
                coded = pc.list_flatten(words).dictionary_encode()
                if len(seen) > most:
                    seen.clear()
                lists = []
                for w in coded.dictionary.to_pylist():
                    if w not in seen:
                        seen[w] = [vocabulary.get(p, unknown) for p in one(w)]
                    lists.append(seen[w])
                per_word = pa.array(lists, pa.list_(pa.int32())).take(coded.indices)
                ends = np.concatenate([[0], np.cumsum(pc.list_value_length(per_word).to_numpy(zero_copy_only=False))]).astype(np.int32)
                bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False))]).astype(np.int64)
                out = pa.ListArray.from_arrays(pa.array(ends[bounds]), pc.list_flatten(per_word))
                yield pa.RecordBatch.from_arrays([batch.column(0), out], names=[key, "ids"])

    return docs.select(key, F.coalesce(pretokens(F.col("text"), pattern), F.array().cast("array<string>")).alias("w")).mapInArrow(run, f"{key} {dict(docs.dtypes)[key]}, ids array<int>")


def with_ends(ids: Column, bos: int | None = 2, eos: int | None = 3) -> Column:
    """The ids between the marks of beginning and end; a mark that is None is left out."""
    return F.concat(*([F.array(F.lit(bos))] if bos is not None else []), ids, *([F.array(F.lit(eos))] if eos is not None else []))


def decoded(rows: DataFrame, ids: DataFrame, form: str = "bpe", key: str = "doc_id", column: str = "ids", specials: tuple[str, ...] = SPECIALS, prefix: str = "##", unknown: str = "<unk>") -> DataFrame:
    """``key``, ``text`` of id arrays, row by row: pieces by id from the vocabulary (``token``, ``id``), which is sent to the tasks,
    specials left out.

    ``form`` says how pieces spell words: ``bpe`` (an end mark closes a word), ``wordpiece`` (``prefix`` continues one) or
    ``unigram`` (pieces follow each other as they are). Ids that the vocabulary lacks give ``unknown``.
    """
    texts = {r["id"]: r["token"] for r in ids.select("id", "token").where("id is not null").collect()}
    spell = lambda t: t if form != "wordpiece" else t[len(prefix) :] if t.startswith(prefix) else " " + t
    places = sorted(texts)
    dropped = [texts[i] in specials and texts[i] != unknown for i in places]
    sent = rows.sparkSession.sparkContext.broadcast((np.array(places, np.int64), np.array([*dropped, False]), [*(spell(texts[i]) for i in places), spell(unknown)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, gone, names = sent.value
        names = pa.array(names, pa.string())
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                lists = batch.column(1)
                flat = pc.list_flatten(lists)
                x = pc.fill_null(flat, 0).to_numpy(zero_copy_only=False).astype(np.int64)
                place = np.minimum(np.searchsorted(known, x), max(len(known) - 1, 0))
                hit = (known[place] == x if len(known) else np.zeros(len(x), bool)) & pc.is_valid(flat).to_numpy(zero_copy_only=False)
                place = np.where(hit, place, len(known))
                kept = ~gone[place]
                bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
                ends = np.concatenate([[0], np.cumsum(kept)]).astype(np.int32)
                pieces = pa.ListArray.from_arrays(pa.array(ends[bounds]), names.take(pa.array(place[kept])))
                yield pa.RecordBatch.from_arrays([batch.column(0), pc.binary_join(pieces, "")], names=[key, "p"])

    joined = rows.select(key, F.coalesce(F.col(column).cast("array<long>"), F.array().cast("array<long>"))).mapInArrow(run, f"{key} {dict(rows.dtypes)[key]}, p string")
    text = F.rtrim(F.replace("p", F.lit(END), F.lit(" "))) if form == "bpe" else F.ltrim("p") if form == "wordpiece" else F.col("p")
    return joined.select(key, text.alias("text"))


def save_tokenizer(path: str, ids: DataFrame, merges: list[tuple[str, str]] | None = None) -> None:
    """Write vocabulary (``token``, ``id``) and merges (``rank``, ``left``, ``right``) as JSON lines under ``path``."""
    ids.select("token", "id").write.mode("overwrite").json(f"{path}/vocabulary")
    rows = [(i, a, b) for i, (a, b) in enumerate(merges or [])]
    ids.sparkSession.createDataFrame(rows, "rank int, left string, right string").write.mode("overwrite").json(f"{path}/merges")


def load_tokenizer(spark, path: str) -> tuple[DataFrame, list[tuple[str, str]]]:
    """The vocabulary table and the merges, in order, that ``save_tokenizer`` wrote."""
    ids = spark.read.schema("token string, id int").json(f"{path}/vocabulary")
    merges = spark.read.schema("rank int, left string, right string").json(f"{path}/merges").orderBy("rank").collect()
    return ids, [(r["left"], r["right"]) for r in merges]


def char_vocabulary(docs: DataFrame, specials: tuple[str, ...] = SPECIALS) -> DataFrame:
    chars = docs.select(F.explode(F.split("text", "")).alias("token")).where("token <> ''")
    from pyspark.sql import Window

    ids = chars.distinct().withColumn("id", F.row_number().over(Window.orderBy("token")) + len(specials) - 1)
    return docs.sparkSession.createDataFrame([(t, i) for i, t in enumerate(specials)], "token string, id int").unionByName(ids)


def char_batch(docs: DataFrame, ids: DataFrame, max_length: int, bos: int | None = 2, eos: int | None = None, pad: int = 0, unknown: int = 1, key: str = "doc_id") -> DataFrame:
    """``key``, ``ids``, ``mask``: each text as character ids between the marks, cut to ``max_length`` and padded to it; the mask is
    1 where a token is.

    ``ids`` (``token``, ``id``) is a vocabulary of characters, so no larger than Unicode, and is sent whole as one map.
    """
    known = ids.where(F.char_length("token") == 1).agg(F.map_from_entries(F.collect_list(F.struct("token", "id"))).alias("_ids"))
    chars = F.filter(F.split(F.coalesce("text", F.lit("")), ""), lambda c: c != "")
    room = max_length - int(bos is not None)
    rows = docs.crossJoin(F.broadcast(known)).select(key, with_ends(F.transform(F.slice(chars, 1, max(room, 0)), lambda c: F.coalesce(F.element_at("_ids", c), F.lit(unknown))), bos, None).alias("t"), (F.size(chars) + int(bos is not None)).alias("n"))
    full = F.slice(F.when(F.col("n") < max_length, with_ends(F.col("t"), None, eos)).otherwise(F.col("t")), 1, max_length)
    rows = rows.select(key, full.alias("t"))
    rest = F.lit(max_length) - F.size("t")
    return rows.select(key, F.concat("t", F.array_repeat(F.lit(pad), rest)).alias("ids"), F.concat(F.transform("t", lambda _: F.lit(1)), F.array_repeat(F.lit(0), rest)).alias("mask"))


def utf8(text: Column) -> Column:
    """The bytes of the text as an array of 0 to 255; null for null."""
    pairs = F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit(".."), F.lit(0))
    return F.transform(pairs, lambda h: F.conv(h, 16, 10).cast("int"))


def from_utf8(codes: Column) -> Column:
    return F.decode(F.unhex(F.array_join(F.transform(codes, lambda b: F.lpad(F.hex(b), 2, "0")), "")), "UTF-8")


def fertility(counts: DataFrame, pieces: DataFrame) -> DataFrame:
    """Pieces a word and characters a piece over the corpus the counts come from."""
    rows = counts.join(pieces, "word")
    s = rows.agg(F.sum(F.col("n") * F.size("pieces")).alias("p"), F.sum("n").alias("w"), F.sum(F.col("n") * F.char_length("word")).alias("c"))
    return s.select((F.col("p") / F.col("w")).alias("fertility"), (F.col("c") / F.col("p")).alias("compression"))


def coverage(counts: DataFrame, known: DataFrame) -> DataFrame:
    """Share of running words and of distinct words that ``known`` (``word``) holds, and the out-of-vocabulary rate."""
    rows = counts.join(known.select("word").distinct().withColumn("k", F.lit(1)), "word", "left")
    s = rows.agg(F.sum(F.when(F.col("k") == 1, F.col("n")).otherwise(0)).alias("in"), F.sum("n").alias("all"), F.avg(F.coalesce("k", F.lit(0)).cast("double")).alias("type_coverage"))
    return s.select((F.col("in") / F.col("all")).alias("token_coverage"), "type_coverage", (1 - F.col("in") / F.col("all")).alias("oov_rate"))


def overlap(vocabularies: dict[str, DataFrame]) -> DataFrame:
    """``a``, ``b``, ``shared``: tokens that each two of the named vocabularies (``token``) have in common."""
    out = None
    names = sorted(vocabularies)
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            n = vocabularies[a].select("token").intersect(vocabularies[b].select("token")).agg(F.count("*").alias("shared")).select(F.lit(a).alias("a"), F.lit(b).alias("b"), "shared")
            out = n if out is None else out.unionAll(n)
    return out


def common_to_all(vocabularies: dict[str, DataFrame]) -> DataFrame:
    """One row: ``shared``, the tokens that all of the named vocabularies hold."""
    tables = [vocabularies[n].select("token").distinct() for n in sorted(vocabularies)]
    out = tables[0]
    for t in tables[1:]:
        out = out.intersect(t)
    return out.agg(F.count("*").alias("shared"))


def byte_words(counts: DataFrame) -> DataFrame:
    """Words spelled with one character for each of their UTF-8 bytes, for merges on the byte alphabet."""
    return counts.select(F.decode(F.encode("word", "UTF-8"), "ISO-8859-1").alias("word"), "n")


def from_byte_pieces(pieces: Column) -> Column:
    """Text of byte-spelled pieces; the end mark is dropped."""
    return F.decode(F.encode(F.replace(F.array_join(pieces, ""), F.lit(END), F.lit("")), "ISO-8859-1"), "UTF-8")


def lower_but_acronyms(text: Column) -> Column:
    """Lower case, but for words of two letters or more that are capitals throughout; single spaces between words."""
    words = F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")
    keep = lambda w: (F.char_length(w) > 1) & (F.upper(w) == w) & (F.lower(w) != w)
    return F.array_join(F.transform(words, lambda w: F.when(keep(w), w).otherwise(F.lower(w))), " ")


def unicode_form(text: Column, form: str = "NFC", strip_controls: bool = False) -> Column:
    """One of the four Unicode normal forms, by an Arrow function; controls and format characters dropped if asked."""
    import unicodedata

    if form not in ("NFC", "NFD", "NFKC", "NFKD"):
        raise ValueError("form is NFC, NFD, NFKC or NFKD")

    @F.pandas_udf("string")
    def normal(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: unicodedata.normalize(form, t) if isinstance(t, str) else t)

    out = normal(text)
    return F.regexp_replace(out, r"[\p{Cc}\p{Cf}&&[^\n\t]]", "") if strip_controls else out
