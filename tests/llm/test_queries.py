"""The thirteen queries and the pipeline as registered: columns, types, flags, digests, and the pipeline's rows by brute force."""

import hashlib
import random
import tempfile
import zlib
from pathlib import Path

import corpus_pipeline
import duckdb
import numpy as np
import public_tokenizers
import pytest
from test_decontaminate import plain_distance
from test_pii import brute as brute_pii
from test_prefixes import brute as brute_trie
from test_prefixes import made_rows
from test_secrets import brute_base
from test_simhash import brute_components, brute_fp
from test_spelling import brute_forms, brute_words
from tokenizers import Tokenizer

import __spark_entry__
from quern.llm import common, decontaminate, queries, secrets, toxicity

CONTRACT = {
    "op1_language": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op2_span_dedup": {"doc_id": "bigint", "text": "string"},
    "op3_packing": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op4_decontamination": {"doc_id": "bigint", "item_id": "bigint"},
    "op5_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op6_secrets": {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"},
    "op7_simhash_near_dedup": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op8_url_filter": {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"},
    "op9_fingerprints": {"doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"},
    "op10_pii": {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string"},
    "op11_quality": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op12_spelling_variants": {"word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint"},
    "op13_prefix_trie": {"conv_id": "bigint", "depth": "bigint", "parent_conv_id": "bigint", "n_convs": "bigint", "n_children": "bigint", "n_leaves": "bigint", "saved_tokens": "bigint", "ends_sha256": "string"},
}
WORDS = "stone river amber castle violet engine lumber rocket pepper meadow harbour copper lantern saddle thunder willow".split()
ITEM = "which river runs past the copper castle before it meets the harbour of violet lanterns in the north"


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark):
    """A folder with documents of every odd kind, extra columns whose names the operators use inside, and small others."""
    rng = random.Random(21)
    rows = []
    for i in [*range(60), *range(200, 300)]:
        body = sentence(rng, rng.randrange(30, 90))
        if i % 4 == 0:
            body += " grob snark"
        rows.append((i, body, "aa"))
    rows += [(60, rows[1][1], "aa"), (61, rows[1][1] + " end", "aa"), (62, None, None), (63, "", "aa"), (64, f"{sentence(rng, 20)} {ITEM} {sentence(rng, 20)}", "bb")]
    rows += [(65, f"{sentence(rng, 30)} mail a.b@c.de and 1.2.3.4 or token=abcdefgh123 {sentence(rng, 5)}", "bb"), (66, sentence(rng, 9000), "bb"), (67, "½ 12", None), (None, sentence(rng, 40), "aa")]
    rows += [rows[3], (5, sentence(rng, 40), "aa")]
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    docs = [(i, t, lang, "s", len(t) if t else None, 1, "x", 2) for i, t, lang in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, row_key int, fp string, score int").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in [*range(0, 60), *range(200, 300)]] + [(62, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(0, "http://a.com/de/x", "h"), (1, None, "h"), (2, "junk", "h"), (3, "http://Q.net/p", "h"), (100, "http://q.net/p/", "h")], "page_id long, url string, host string").write.parquet(f"{folder}/pages.parquet")
    spark.createDataFrame([(*r, 7, "x") for r in made_rows(3, 25)], "conv_id long, turn long, role string, text string, depth int, digest string").write.parquet(f"{folder}/conversations.parquet")
    return folder, rows


def ids(rows):
    return sorted((str(r[0]) for r in rows))


@pytest.fixture(scope="module")
def results(spark, tables):
    return {name: (df.dtypes, df.collect()) for name in CONTRACT for df in [queries.QUERIES[name](spark, tables[0])]}


def test_columns_and_rows(results, tables):
    for name, columns in CONTRACT.items():
        assert columns.items() <= dict(results[name][0]).items(), name
    for name in ("op1_language", "op5_toxicity", "op6_secrets", "op7_simhash_near_dedup", "op9_fingerprints", "op10_pii", "op11_quality"):
        assert ids(results[name][1]) == ids(tables[1]), name
    assert {r["doc_id"] for r in results["op4_decontamination"][1]} == {64}


def crc(i, n):
    return zlib.crc32(("null" if i is None else str(i)).encode()) % n


def test_flags_and_digests(results, tables):
    for r in results["op11_quality"][1]:
        assert r["held_out"] == (crc(r["doc_id"], 5) == 0) and r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert all(r["held_out"] == (crc(r["doc_id"], 5) == 0) for r in results["op1_language"][1])
    assert {r["doc_id"]: r["lang_pred"] for r in results["op1_language"][1]}[67] == "und"
    for r in results["op5_toxicity"][1]:
        assert r["held_out"] == (crc(r["doc_id"], 3) == 1) and r["predicted"] == int(r["score"] >= 0.7) and 0 <= r["score"] <= 1
    texts = sorted((str(i), t or "") for i, t, _ in tables[1])
    shown = lambda spans: ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in spans)
    assert sorted((str(r["doc_id"]), r["base_sha256"]) for r in results["op6_secrets"][1]) == sorted((i, sha(shown(brute_base(t)))) for i, t in texts)
    assert sorted((str(r["doc_id"]), r["base_sha256"]) for r in results["op10_pii"][1]) == sorted((i, sha(brute_pii(t))) for i, t in texts)


def test_words_and_trie(results, tables):
    words = [tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in results["op12_spelling_variants"][1]]
    assert words and sorted(words) == brute_forms(brute_words([(i, t) for i, t, _ in tables[1]]))
    assert sorted(map(tuple, results["op13_prefix_trie"][1]), key=repr) == brute_trie(made_rows(3, 25))


def test_components(results, tables):
    fps = [brute_fp(t) for _, t, _ in tables[1]]
    label = brute_components(fps)
    least = {}
    for k, (i, *_) in zip(label, tables[1]):
        if i is not None:
            least[k] = min(least.get(k, i), i)
    want = sorted(((str(i), f"{fp:016x}", least.get(k)) for (i, *_), fp, k in zip(tables[1], fps, label)), key=str)
    assert sorted(((str(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in results["op7_simhash_near_dedup"][1]), key=str) == want


def test_url_query_against_its_sql(spark, tables):
    sql = __spark_entry__.oracle_sql()["op8_url_filter"]
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tables[0]}/pages.parquet/*.parquet'")
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    mine = queries.QUERIES["op8_url_filter"](spark, tables[0]).select(*names).collect()
    assert sorted(map(tuple, mine), key=str) == sorted(cursor.fetchall(), key=str)


def packed_ids(rows, texts):
    """Checks the places of all pieces and that they spell the texts' ids."""
    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    at = {}
    for r in rows:
        at.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in at.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    want = []
    for i, t in texts:
        all_ids = np.array([*encode.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(all_ids) % 2048 or 2048
        bounds = [0, *range(first, len(all_ids) + 1, 2048)]
        want += [(str(i), n, a, b - a, zlib.crc32(all_ids[a:b].tobytes())) for n, (a, b) in enumerate(zip(bounds, bounds[1:]))]
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)


def test_packing(results, tables):
    packed_ids(results["op3_packing"][1], [(i, t) for i, t, _ in tables[1]])


def test_pipeline_against_brute_force(spark, tables):
    folder, rows = tables
    docs = common.table(spark, folder, "documents")
    scored = toxicity.score_toxicity(docs, toxicity.fit(*toxicity.labelled_sample(docs, common.table(spark, folder, "labels"))))
    bad = {(r["doc_id"], r["n_words"]) for r in scored.collect() if r["score"] >= 0.7}
    left = [(i, t) for i, t, _ in rows if (i, len(toxicity.WORD.findall((t or "").lower()))) not in bad]
    assert bad and len(left) < len(rows)
    label = brute_components([brute_fp(t) for _, t in left])
    groups = {}
    for k, (i, t) in zip(label, left):
        groups.setdefault(k, []).append((i is None, i if i is not None else 0, t, i))
    found = []
    docs_in = common.durable(corpus_pipeline.drop_toxic(spark, docs, folder))
    kept = [(r["doc_id"], r["text"]) for r in common.durable(corpus_pipeline.drop_near_copies(spark, docs_in, folder)).collect()]
    assert len(kept) == len(groups)
    for members in groups.values():
        one = [(m[3], m[2]) for m in members]
        chosen = [k for k in kept if k in one]
        assert len(chosen) == 1 and (chosen[0][0] is None) == all(m[0] for m in members)
        assert chosen[0][0] is None or chosen[0][0] == min(m[1] for m in members if not m[0])
    for i, t in kept:
        plain = decontaminate.normal(t)
        if plain_distance(decontaminate.normal(ITEM), plain) > int(len(decontaminate.normal(ITEM)) * decontaminate.ERROR_RATE):
            found.append((i, t))
    assert len(found) == len(kept) - 1
    hidden = []
    for i, t in found:
        for span in sorted((s for s in brute_pii(t).split(",") if s), key=lambda s: -int(s.split(":")[1])):
            kind, a, b = span.split(":")
            t = t[: int(a)] + f"[{kind.upper()}]" + t[int(b) :]
        hidden.append((i, t))
    out = corpus_pipeline.run(spark, folder).collect()
    packed_ids(out, hidden)


def test_stages_keep_columns_and_take_empty_tables(spark, tables):
    folder, _ = tables
    docs = common.table(spark, folder, "documents")
    for source in (docs.where("doc_id = -1"), docs.unionAll(docs)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, source, folder)
            assert out.columns == docs.columns, name
            assert out.count() <= source.count(), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs.where("doc_id = -1"), folder).count() == 0


def test_empty_tables(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    for name, schema in (
        ("documents", "doc_id long, text string, lang string, source string, n_chars long"),
        ("labels", "doc_id long, quality int, toxic int"),
        ("benchmark", "item_id long, text string"),
        ("pages", "page_id long, url string, html string"),
        ("conversations", "conv_id long, turn long, role string, text string"),
    ):
        spark.createDataFrame([], schema).write.parquet(f"{folder}/{name}.parquet")
    for name, query in queries.QUERIES.items():
        assert query(spark, folder).count() == 0, name
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_every_registered_query_is_here():
    assert set(CONTRACT) == set(queries.QUERIES) and {"pipeline", *CONTRACT} <= set(__spark_entry__.queries())
    assert Path(corpus_pipeline.__file__).parent == Path(__spark_entry__.__file__).parent
