"""Spelling variants against brute force and DuckDB, with block limits small enough to subdivide."""

import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from quern.llm import spelling
from quern.llm.queries import ORACLE_SQL


def brute_words(rows):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            low = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'null' if i is None else i}:{low}".encode())
            k = h % len(low)
            n[low[:k] + low[k + 1 :] if h % 199 == 0 else low] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}


def distance_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_forms(n, ratio=5):
    near = {w: [v for v in n if distance_one(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def crowded(rng, k):
    """Words that share halves: few letters, one common beginning and one common end, counts that make chains of forms."""
    words = set()
    while len(words) < k:
        w = "".join(rng.choice("abcé") for _ in range(rng.randrange(3, 8)))
        words.add(rng.choice([w + "lantern", "lantern" + w, w + w, "x" * 70 + w]))
    return {w: 5 ** rng.randrange(0, 5) for w in words if len(w) >= 6}


@pytest.mark.parametrize("limit", [2, 16, 10_000])
def test_forms_against_brute_force(spark, limit):
    n = crowded(random.Random(3), 220)
    found = spelling.forms(spark.createDataFrame(list(n.items()), "word string, n long"), limit=limit)
    assert sorted(map(tuple, found.collect())) == brute_forms(n)
    near = spelling.near_words(spark.createDataFrame(list(n.items()), "word string, n long"), limit).collect()
    assert len(near) == len(set(near)) == sum(distance_one(a, b) for a in n for b in n)


def test_subdivided_blocks_stay_small(spark):
    n = {f"lantern{a}{b}{c}{d}": 5 for a in "abcdefg" for b in "abcdefg" for c in "abcdefg" for d in "abcdefg"}
    rows = spelling.blocks_to_scan(spark.createDataFrame(list(n.items()), "word string, n long"), 32)
    sizes = rows.groupBy(*spelling.KEY).count()
    assert sizes.agg({"count": "max"}).first()[0] <= 32
    found = spelling.forms(spark.createDataFrame(list(n.items()), "word string, n long"), limit=32)
    assert {r["n_near"] for r in found.collect()} == {24}


def test_documents_against_brute_force_and_sql(spark):
    rng = random.Random(9)
    base = [w for w in crowded(rng, 60) if len(w) < 60] + ["Lantern", "lanterns", "LANTERN", "Àlantern", "lan×tern", "short"]
    rows = [(i, " ".join(rng.choice(base) for _ in range(rng.randrange(60))) + rng.choice(["", ". ", "9lantern_lanterm"])) for i in range(150)]
    rows += [(3, rows[3][1]), (3, "lantern again"), (None, rows[5][1]), (500, None), (501, ""), (502, "lantern " * 3000), (-7, rows[8][1])]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, word string, n int")
    want = brute_forms(brute_words(rows))
    assert sorted(map(tuple, spelling.spelling_variants(docs).collect())) == want
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    assert sorted(con.execute(ORACLE_SQL["op12_spelling_variants"]).fetchall()) == want
    assert spelling.spelling_variants(docs.limit(0)).count() == 0


def test_one_edit():
    assert spelling.one_edit("abc", "abd") and spelling.one_edit("abc", "xabc") and spelling.one_edit("aab", "aaab")
    assert not spelling.one_edit("abc", "abc") and not spelling.one_edit("abc", "acb") and not spelling.one_edit("abc", "abcde")
    assert spelling.one_edit("aaa", "aaaa", 3, 4) and not spelling.one_edit("aaa", "aaaa", 0, 3)
