"""Secret scans: plain key patterns, and guess-cost estimation of values in credential contexts.

Three base patterns (assignments, access keys, hex digests) are matched as they are. Beyond them, a value that follows
a credential word (``pwd: ...``, ``passphrase is ...``, ``DB_PASSWORD_2 := ...``, ``clientSecret = ...``, ``secret key: ...``) is a
secret if guessing it is costly, whatever characters it has. The word is whole or a hump of a camel-case name, so
``tokenization`` holds none, and a separator or a quote must follow its name; ``bearer`` needs a space only, and a value glued
on by ``_`` or ``-`` must mix digits, upper and lower case. Behind a mere ``is`` or ``bearer`` a plain word is prose. A value
that is itself a credential word with a separator and a value (``bearer token: ...``) gives way to the latter. Its cost is the cheapest
segmentation, found by dynamic programming, into dictionary words (cost: rank in the corpus, which counts every word of
every document), dates, repeats (of up to ``MAX_WORD`` characters, any number of times), keyboard walks, and brute force for the rest; segments add up on a log10 scale with a
small charge for each. ``8hunter2000`` is cheap, ``x9$Qv!7rT`` is not.

The dictionary holds the ``top_words`` most frequent words and no more on purpose: secrets are part of the corpus too, so
a dictionary of all its words would list every secret of plain letters as a word.

Edge cases: a null text counts as empty. Rows are scanned each on their own, and other columns are not read. Values under ``MIN_VALUE`` characters are
no secrets; those of any greater length are judged whole. Offsets count code points.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import blocks, durable

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Where a word may start and end: at other than letters and digits, or at a hump of camel case.
STARTS = r"(?:(?<![A-Za-z0-9])|(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z]))"
ENDS = r"(?:[sS]?(?![A-Za-z])|(?<=[a-z])(?=[A-Z]))"
CREDENTIAL = re.compile(rf"{STARTS}(?i:(?:api|access|private|auth|secret)[\s_-]?key|pass(?:word|wd|phrase|code)|pwd|pin|secret|token|credentials?|(?P<bearer>bearer)){ENDS}", re.ASCII)
#: The rest of the name that a credential word begins; atomic, so that no name is read twice.
NAME = re.compile(r"(?>[0-9]*(?:(?<=[a-z0-9])[A-Z][A-Za-z0-9]*)?(?:[_-][A-Za-z0-9]+)*)", re.ASCII)
BEGIN = r"""\s{0,4}["']?(?=[^\s"'<>,;])"""
#: What may stand between a name and its value: a separator, a quote, or after ``bearer`` a space.
ASSIGNED = re.compile(rf"""(?:\s{{1,4}}(?i:keys?|values?|codes?|strings?|phrases?)\b)?["']?\s{{0,4}}(?:(?P<prose>\b(?i:is)\b)\s{{0,4}}(?P<sign>:=|=>|->|=+|:+)?|:=|=>|->|=+|:+){BEGIN}""", re.ASCII)
QUOTED = re.compile(r"""\s{1,4}["'](?=[^\s"'<>,;])""", re.ASCII)
SPACED = re.compile(r"""\s{1,4}(?=[^\s"'<>,;])""", re.ASCII)
RUN = re.compile(r"""[^\s"'<>,;]+""", re.ASCII)
WORDLIKE = re.compile(r"(?:[A-Z]?[a-z]+|[A-Z]+)(?:[-\u2019](?:[A-Z]?[a-z]+|[A-Z]+))*")
REPEATED = re.compile(r"(.{1,24}?)\1{7,}", re.DOTALL)
HINTS = ("pass", "pwd", "pin", "secret", "token", "key", "credential", "bearer")
MIN_VALUE, MAX_WORD = 6, 24
TRAILING = ".:!?)]}"
SEGMENT_COST = math.log10(2)
LEET = str.maketrans("013457@$!", "oieastasi")
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
DATES = (
    re.compile(r"(?:19|20)\d\d"),
    re.compile(r"(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])"),
    re.compile(r"(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\1(?:(?:19|20)?\d\d)"),
)


def keyboard() -> dict[str, frozenset[str]]:
    """Neighbours of each key: the keys beside it and those above and below in staggered rows."""
    near: dict[str, set[str]] = {k: set() for row in ROWS for k in row}
    for r, row in enumerate(ROWS):
        for i, k in enumerate(row):
            for rr, ii in ((r, i + 1), (r + 1, i - 1), (r + 1, i)):
                if rr < len(ROWS) and 0 <= ii < len(ROWS[rr]):
                    near[k].add(ROWS[rr][ii])
                    near[ROWS[rr][ii]].add(k)
    return {k: frozenset(v) for k, v in near.items()}


NEAR = keyboard()


def brute_cost(c: str) -> float:
    """log10 of the size of the character's class."""
    if c.isdigit():
        return 1.0
    if c.isascii() and c.isalpha():
        return math.log10(26)
    return math.log10(33 if c.isascii() else 1000)


def unit_cost(unit: str, ranks: dict[str, int]) -> float:
    """log10 of the guesses of what a repeat repeats: brute force, or the rank of a word."""
    return min(sum(map(brute_cost, unit)), math.log10(ranks[unit.lower()]) if unit.lower() in ranks else math.inf)


def segment_cost(s: str, ranks: dict[str, int]) -> float:
    """log10 of the guesses that the cheapest single pattern for all of ``s`` takes; infinite where none fits."""
    best = math.inf
    low = s.lower()
    for word, extra in ((low, 0.0), (low.translate(LEET), math.log10(2))):
        if word in ranks:
            best = min(best, math.log10(ranks[word]) + extra + (math.log10(2) if low != s else 0.0))
    n = len(s)
    if s[0].isdigit() and s[-1].isdigit() and n <= 10:
        for i, pattern in enumerate(DATES):
            if pattern.fullmatch(s):
                best = min(best, math.log10(120.0 if i == 0 else 120.0 * 365 * (4 if not s.isdigit() else 1)))
    if n >= 2:
        for unit in range(1, n // 2 + 1):
            if n % unit == 0 and s == s[:unit] * (n // unit):
                inner = unit_cost(s[:unit], ranks)
                best = min(best, inner + math.log10(n // unit))
    if n >= 3:
        if all(b in NEAR.get(a, ()) for a, b in zip(low, low[1:], strict=False)):
            turns = sum(low[i + 2] != low[i] and _step(low[i], low[i + 1]) != _step(low[i + 1], low[i + 2]) for i in range(n - 2))
            best = min(best, math.log10(47 * n) + (turns + 1) * math.log10(4.6))
        steps = {ord(b) - ord(a) for a, b in zip(s, s[1:], strict=False)}
        if len(steps) == 1 and steps <= {-1, 1}:
            best = min(best, math.log10(26 * n))
    return best


def _step(a: str, b: str) -> tuple[int, int]:
    place = {k: (r, i) for r, row in enumerate(ROWS) for i, k in enumerate(row)}
    return place[b][0] - place[a][0], place[b][1] - place[a][1]


def repeats_cost(value: str, ranks: dict[str, int], enough: float) -> float:
    """Upper bound of the cost: each stretch of eight or more equal units is one repeat, what lies between is brute force."""
    total, at = 0.0, 0
    for m in REPEATED.finditer(value):
        total += sum(map(brute_cost, value[at : m.start()])) + unit_cost(m[1], ranks) + math.log10((m.end() - m.start()) // len(m[1])) + SEGMENT_COST
        at = m.end()
        if total >= enough:
            return total
    return total + sum(map(brute_cost, value[at:]))


def guess_cost(value: str, ranks: dict[str, int], enough: float = math.inf) -> float:
    """log10 of the guesses of the cheapest segmentation of the whole value.

    Segments are of ``MAX_WORD`` characters at most, apart from repeats. Of those that end at a place with the same unit,
    a later start that an earlier one has undercut never leads again, so a few starts stand for all. A segment that
    passes ``end`` starts among the last ``MAX_WORD`` places or is a repeat that still runs; once the former all cost
    ``enough``, and so do the starts and units of the latter, the whole does too, and a lower bound that is at least ``enough`` is returned, however long the value is.
    Long values that are cheap once their repeats are taken whole return that upper bound, under ``enough``.
    """
    if 4 * MAX_WORD < len(value) and enough < math.inf and (high := repeats_cost(value, ranks, enough)) < enough:
        return high
    single = lru_cache(100_000)(lambda part: segment_cost(part, ranks))
    unit_of = lru_cache(10_000)(lambda part: unit_cost(part, ranks))
    best = [0.0]
    same = [0] * (MAX_WORD + 1)  # by unit length: how many last characters equal those a unit before
    running = [math.inf] * (MAX_WORD + 1)  # the least cost of start and unit among the repeats that these characters can be of
    starts: list[dict[int, list[tuple[int, float]]]] = [{} for _ in same]
    for end in range(1, len(value) + 1):
        cost = best[end - 1] + brute_cost(value[end - 1])
        for start in range(max(0, end - MAX_WORD), end):
            one = single(value[start:end])
            if one < math.inf:
                cost = min(cost, best[start] + one + SEGMENT_COST)
        for unit in range(1, min(MAX_WORD, end - 1) + 1):
            if value[end - 1] != value[end - 1 - unit]:
                if same[unit]:
                    same[unit], running[unit] = 0, math.inf
                    starts[unit].clear()
                continue
            same[unit] += 1
            running[unit] = min(running[unit], best[end - 1 - unit] + unit_of(value[end - 1 - unit : end - 1]))
            if same[unit] < unit:
                continue
            start, kept, least = end - 2 * unit, [], math.inf
            for a, before in [*starts[unit].get(end % unit, ()), (start, best[start] + unit_of(value[start : start + unit]))]:
                one = before + math.log10((end - a) // unit)
                if one < least:
                    kept.append((a, before))
                    least = one
            starts[unit][end % unit] = kept
            cost = min(cost, least + SEGMENT_COST)
        best.append(cost)
        if cost >= enough and (low := min(*best[-(MAX_WORD + 1) :], *running)) >= enough:
            return low
    return best[-1]


def word_ranks(docs: DataFrame, top: int = 20_000) -> dict[str, int]:
    """Rank of the ``top`` most frequent ASCII words of 3 to 24 letters, counted over every document.

    A histogram of the counts on a log scale (a few hundred rows) gives the least count that can be among the top, so
    only about ``top`` rows ever leave the executors.
    """
    words = docs.select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word")).where(F.length("word").between(3, MAX_WORD))
    counts = durable(words.groupBy("word").agg(F.count("*").alias("n")).withColumn("step", F.floor(F.log2("n") * 16)))
    steps = counts.groupBy("step").agg(F.count("*").alias("words")).orderBy(F.desc("step")).collect()
    held, least = 0, 0
    for row in steps:
        held, least = held + row["words"], row["step"]
        if held >= top:
            break
    # the last step may hold far more words than are still wanted
    sure = counts.where(F.col("step") > least).select("word", "n").collect()
    rest = counts.where(F.col("step") == least).orderBy(F.desc("n"), "word").select("word", "n").limit(max(0, top - len(sure)))
    rows = sorted([*sure, *durable(rest).collect()], key=lambda r: (-r["n"], r["word"]))
    return {r["word"]: i for i, r in enumerate(rows, 1)}


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three base kinds, in that order; cheap substring tests spare the regular expressions."""
    found = []
    low = text.lower()
    if any(w in low for w in ("password", "passwd", "secret", "token", "apikey", "api_key")):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def mixed(value: str) -> bool:
    """Digits, upper and lower case in one."""
    return any(c.isdigit() for c in value) and any(c.isupper() for c in value) and any(c.islower() for c in value)


def guessed_spans(text: str, ranks: dict[str, int], base: list[tuple[int, int, int]], least: float) -> list[tuple[int, int, int]]:
    """Values in credential contexts, apart from the base spans, that cost at least 10**least guesses.

    The scan goes on behind each name and each judged value, so no character is read for more than a few words.
    """
    low = text.lower()
    if not any(h in low for h in HINTS):
        return []
    starts, ends = [s for s, _, _ in base], list(accumulate((e for _, _, e in base), max))
    found: list[tuple[int, int, int]] = []
    at = run_end = unmixed = 0

    def free(start: int, end: int) -> bool:
        before = bisect_left(starts, end)
        return before == 0 or ends[before - 1] <= start

    def judge(start: int, value: str) -> None:
        if guess_cost(value, ranks, least) >= least:
            found.append((start, 3, start + len(value)))

    while word := CREDENTIAL.search(text, at):
        after = at = NAME.match(text, word.end()).end()
        link = ASSIGNED.match(text, after) or QUOTED.match(text, after)
        prose = bool(link) and link.re is ASSIGNED and link["prose"] and not link["sign"]
        if not link and word["bearer"] and after == word.end():
            link, prose = SPACED.match(text, after), True
        if text[word.end() : word.end() + 1] in ("_", "-") and word.end() >= unmixed:
            # a value glued to the word: only what no name looks like
            if word.end() >= run_end:
                run_end = RUN.match(text, word.end()).end()
            if not (link and run_end > link.end()) and free(word.end(), run_end):
                value = text[word.end() : run_end].rstrip(TRAILING)
                if len(value) >= MIN_VALUE and mixed(value):
                    judge(word.end(), value)
                    at = run_end
                else:
                    unmixed = run_end
        if not link:
            continue
        start = at = max(at, link.end())
        if start >= run_end:
            run_end = RUN.match(text, start).end()
        if run_end - start < MIN_VALUE or not free(start, run_end):
            continue
        inner = CREDENTIAL.match(text, start)
        if inner and ASSIGNED.match(text, NAME.match(text, inner.end()).end()):
            continue
        value = text[start:run_end].rstrip(TRAILING)
        if len(value) < MIN_VALUE or (prose and WORDLIKE.fullmatch(value)):
            continue
        judge(start, value)
        at = run_end
    return found


def find_secrets(docs: DataFrame, least: float = 8.0, top_words: int = 20_000) -> DataFrame:
    """``doc_id``, counts ``n_assign``, ``n_access``, ``n_hex``, ``n_guess``, ``base_spans`` and ``spans`` of every row.

    Spans are kind:start:end by start, then kind, comma-joined. Two passes over the texts: word counts, then the scan;
    the ranks sent to the tasks are bounded by ``top_words``.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(word_ranks(docs, top_words))
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_spans", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        show = lambda spans: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)
        for batch in batches:
            for part, texts in blocks(batch, "text"):
                counts: list[list[int]] = [[] for _ in KINDS]
                plain, full = [], []
                for text in texts:
                    base = base_spans(text or "")
                    spans = sorted(base + guessed_spans(text or "", ranks.value, base, least))
                    for k, column in enumerate(counts):
                        column.append(sum(x[1] == k for x in spans))
                    plain.append(show(base))
                    full.append(show(spans))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(plain, pa.string()), pa.array(full, pa.string())], names=names)

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_spans string, spans string"
    return docs.select("doc_id", "text").mapInArrow(run, schema)
