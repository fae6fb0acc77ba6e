"""The prefix trie against a brute-force trie and DuckDB."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb

from quern.llm import prefixes
from quern.llm.queries import ORACLE_SQL


def mark(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, mark(role or "", text or ""), role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in own.items()}
    made = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        donor = c - (c % 5 if c >= 0 else -(-c % 5))
        made[c] = tuple(own.get(donor, [])[:h] + v[h:])
    members = defaultdict(list)
    for c in sorted(made):
        for d in range(len(made[c]) + 1):
            members[made[c][:d]].append(c)
    out = []
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        leaf = lambda q: not any(len(x) == len(q) + 1 and x[:-1] == q for x in members)
        saved = sum((len(members[q]) - 1) * (len(q[-1][1].encode()) if q else 0) for q in below)
        over = ",".join(str(c) for c in m if len(made[c]) == len(p))
        out.append((m[0], len(p), members[p[:-1]][0] if p else None, len(m), sum(len(q) == len(p) + 1 for q in below), sum(map(leaf, below)), saved, hashlib.sha256(over.encode()).hexdigest()))
    return sorted(out, key=repr)


def made_rows(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in [*range(n), -3, -5, 10**12]:
        if rng.random() < 0.1:
            continue
        for turn in range(rng.randrange(1, 12)):
            rows.append((c, turn if rng.random() < 0.95 else None, rng.choice(["user", "assistant", None]), rng.choice(["hé", "ok", "", None, "yes"])))
    rows += [rows[0], rows[0], (None, 1, "user", "lost"), (7, 3, "user", "tie"), (7, 3, "assistant", "tie")]
    rows += [(c, 0, "user", "common") for c in range(1000, 1060)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, digest string").repartition(3)


def test_against_brute_force_and_sql(spark):
    rows = made_rows(5, 60)
    want = brute(rows)
    found = prefixes.conversation_trie(frame(spark, rows))
    assert [t for _, t in found.dtypes] == ["bigint"] * 7 + ["string"]
    assert sorted(map(tuple, found.collect()), key=repr) == want
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    assert sorted(con.execute(ORACLE_SQL["op13_prefix_trie"]).fetchall(), key=repr) == want


def test_ends_in_many_pieces(spark):
    rows = [(c, 0, "user", "same") for c in range(0, 4000, 7)]
    written = prefixes.durable(prefixes.prefixes(prefixes.rebuilt(prefixes.turns_in_order(frame(spark, rows)))))
    few, many = (sorted(map(tuple, prefixes.ends(written, piece).collect())) for piece in (10**6, 10))
    assert few == many and len(few) == 2


def test_long_conversation_and_empty(spark):
    rows = [(1, k, "user", str(k)) for k in range(3000)]
    found = {r["depth"]: r for r in prefixes.conversation_trie(frame(spark, rows)).collect()}
    h = zlib.crc32(b"1") % 9
    assert len(found) == 3001 - h and all(r["n_leaves"] == 1 and r["saved_tokens"] == 0 for r in found.values())
    assert prefixes.conversation_trie(frame(spark, rows).limit(0)).count() == 0
