"""Operator 9 against a plain Python version of the same fingerprint."""

import hashlib
import struct

import xxhash

from quern.llm import minhash

SENTENCE = "the quick brown fox jumps over the lazy dog while seven wise owls watch from a tall old oak near the quiet river bank at dawn"


def signed(x):
    return struct.unpack("<q", struct.pack("<Q", x))[0]


def chain(values):
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(struct.pack("<q", v), h)
    return signed(h)


def brute(text, n_bins=256):
    words = " ".join((text or "").lower().split()).split(" ")
    w = [signed(xxhash.xxh64_intdigest(x.encode(), 42)) for x in words]
    if len(w) >= 5:
        hashes = [chain(w[i : i + 5]) for i in range(len(w) - 4)]
    else:
        h = 42
        for x in w:
            h = chain([h, x])
        hashes = [h]
    shift = 63 - 8
    low = [None] * n_bins
    for h in hashes:
        v = (h % 2**64) >> 1
        b = v >> shift
        low[b] = v if low[b] is None else min(low[b], v)
    walk = minhash.walks(n_bins)
    out = []
    for j in range(n_bins):
        v = low[j]
        if v is None:
            for a in range(minhash.WALK):
                v = low[walk[j * minhash.WALK + a]]
                if v is not None:
                    break
        if v is None:
            v = min((xx_int(j, t), low[t]) for t in range(n_bins) if low[t] is not None)[1]
        out.append(f"{v & 255:02x}")
    return "".join(out)


def xx_int(j, t):
    """Spark's xxhash64 of two ints, each hashed as four bytes."""
    return signed(xxhash.xxh64_intdigest(struct.pack("<i", t), xxhash.xxh64_intdigest(struct.pack("<i", j), 42)))


def test_fingerprints_and_edits(spark):
    long = " ".join(f"{SENTENCE} {i}" for i in range(60))
    texts = [None, "", "one", "Three  little\nwords", SENTENCE, SENTENCE, long, long + " tail", "\U0001f600 " * 50, SENTENCE[:40]]
    docs = spark.createDataFrame([(3 * i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"] // 3: r for r in minhash.compare_with_edits(docs, lots=4).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        t, nxt = t or "", texts[(i + 1) % len(texts)] or ""
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        assert got[i]["n_chars"] == len(t)
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest(), i
        assert got[i]["fingerprint"] == brute(t), i
        assert got[i]["edited_fingerprint"] == brute(edited), i
    assert got[4]["near_next"] == 1.0 and got[6]["near_next"] > 0.9 and got[3]["near_next"] < 0.1


def test_ties_empty_and_single(spark):
    docs = spark.createDataFrame([(None, "a"), (5, "b"), (5, "b"), (5, None)], "doc_id long, text string")
    assert minhash.compare_with_edits(docs).count() == 4
    assert minhash.compare_with_edits(docs.where("text = 'a'")).first()["near_next"] == 1.0
    assert minhash.compare_with_edits(docs.where("doc_id = 7")).count() == 0


def test_long_texts_and_clashing_columns(spark):
    long = " ".join(f"w{i % 5000}x{i % 7}" for i in range(100_000))
    docs = spark.createDataFrame([(1, long, 1, 2, "z"), (2, long + " end", 1, 2, "z")], "doc_id long, text string, low int, lot int, edited string")
    got = {r["doc_id"]: r for r in minhash.compare_with_edits(docs).collect()}
    assert got[1]["fingerprint"] == brute(long) and got[1]["near_next"] > 0.95


def test_ranges_follow_the_size_of_the_texts(spark, monkeypatch):
    seen = []
    with_next = minhash.with_next
    monkeypatch.setattr(minhash, "with_next", lambda docs, columns, lots: seen.append(lots) or with_next(docs, columns, lots))
    monkeypatch.setattr(minhash, "LOT_BYTES", 1000)
    docs = spark.createDataFrame([(i, SENTENCE) for i in range(160)], "doc_id long, text string")
    assert minhash.compare_with_edits(docs).count() == 160 and seen == [-(-160 * len(SENTENCE) // 1000)]


def test_bounds_in_blocks(spark):
    from pyspark.sql import functions as F

    for cuts in ([5], [1, 2], [-7, 0, 3, 9, 10], list(range(-50, 150, 3))):
        rows = spark.range(-60, 160).select("id", minhash.bounds_up_to(cuts, F.col("id")).alias("n")).collect()
        assert all(r["n"] == sum(c <= r["id"] for c in cuts) for r in rows), cuts
    assert spark.sql("select cast(null as bigint) id").select(minhash.bounds_up_to([1, 2], F.col("id"))).first()[0] is None
