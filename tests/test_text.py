"""Text, HTML, cleaning, quality and personal data on inputs that the driver's tables lack."""

from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import charlm, html, pii_rules, quality


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("r")).first()["r"]


def test_unicode_white_space(spark):
    assert one(spark, "a b　c \n", T.words) == ["a", "b", "c"]
    assert one(spark, "　 x  ", T.strip) == "x"
    assert one(spark, None, T.words) is None


def test_shingles(spark):
    assert one(spark, " One TWO ", lambda c: T.shingles(c, 5)) == ["one two"]
    assert one(spark, "a b c d e a b c d e", lambda c: T.shingles(c, 5))[:2] == ["a b c d e", "b c d e a"]


def test_repetition_formulas_differ(spark):
    text = "a b c d e " * 4
    assert one(spark, text, T.duplicate_ngram_ratio) == 1.0
    assert one(spark, text, lambda c: quality.repeat_rate(c, 5)) == 1 - 5 / 16
    assert one(spark, "a b c d", T.duplicate_ngram_ratio) == 0.0


def test_rules_in_order(spark):
    rows = [(1, "short"), (2, "!@# " * 80), (3, "1234567890 " * 30), (4, None), (5, "The cat sat on the mat and it was not at all as happy as we had been in those days, for it had no milk and no fish to eat.")]
    got = {r["doc_id"]: (r["reason"], r["passed"]) for r in quality.rule_filter(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("too_short", False), 2: ("special_chars", False), 3: ("digits", False), 4: ("too_short", False), 5: ("pass", True)}


def test_html(spark):
    page = "<html><head><title>A <b>title</b></title><style>x{}</style></head><body><nav>menu</nav><!-- gone --><p>First paragraph, long enough &amp; kept &#65;&#x42;&#55357;</p><br/>tiny<br><footer>f</footer><p>Second one with &lt;b&gt;tags&lt;/b&gt; inside of it</p></body></html>"
    r = html.extract(spark.createDataFrame([(page,), (None,)], "html string")).collect()
    assert r[0]["title"] == "A title"
    assert r[0]["text"].split("\n\n")[0].endswith("kept AB") and "menu" not in r[0]["text"] and "tiny" not in r[0]["text"]
    assert "Second one with tags inside of it" in r[0]["text"]
    assert r[1]["text"] is None or r[1]["text"] == ""


def test_normalise(spark):
    assert one(spark, "Ａ​b c\r\nd\re\x07fﬁ", html.normalize) == "Ab c\nd\neffi"
    once = one(spark, "x　y­", html.normalize)
    assert one(spark, once, html.normalize) == once


def test_clean(spark):
    text = "Visit https://x.y/z?q now please\n\n\n\nok\nAll rights reserved by us\nthis line stays here"
    assert one(spark, text, html.clean) == "Visit  now please\n\nthis line stays here"


def test_pii_order_and_modes(spark):
    text = "Please contact John at john.doe@example.com or call 13812345678 for more information. His ID is 110101199001011234."
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = pii_rules.rewrite(docs).first()
    assert r["text"] == "Please contact John at [EMAIL] or call [PHONE] for more information. His ID is [ID_CARD]."
    assert (r["n_email"], r["n_phone_cn_mobile"], r["n_id_card_cn"], r["n_bank_card"]) == (1, 1, 1, 0)
    found = docs.select(pii_rules.detect(F.col("text")).alias("d")).first()["d"]
    assert found["bank_card"] == ["110101199001011234"] and set(found) == {"email", "phone_cn_mobile", "id_card_cn", "bank_card"}
    assert one(spark, "电话13800138000", lambda c: F.size(pii_rules.detect(c))) == 0
    assert pii_rules.rewrite(docs, "remove").first()["text"].startswith("Please contact John at  or call  for")


def test_perplexity(spark):
    ref = spark.createDataFrame([("abcabcabc",)], "text string")
    docs = spark.createDataFrame([(1, "abcabc"), (2, "zzzzzz"), (3, "ab"), (4, "")], "doc_id long, text string")
    got = {r["doc_id"]: r["perplexity"] for r in charlm.perplexity(docs, ref).collect()}
    assert got[1] < got[2] and got[3] == got[4] == float("inf")


def test_code_and_prose(spark):
    code = "import os\n\ndef f(x):\n    return x\n\ndef g():\n    return 1"
    assert one(spark, code, quality.looks_like_code) and one(spark, code, quality.source_material) == code
    assert one(spark, "x" * 99, quality.source_material) is None
    assert one(spark, "y" * 25000, lambda c: F.length(quality.source_material(c))) == 20_000 + len("\n\n[cut]")


def test_pairs_and_judge(spark):
    rows = spark.createDataFrame([("As an AI language model I cannot help with that today, sorry.",), ("ok",), ("good answer " * 3 + "with many other words that differ from one another",)], "response string")
    got = [r["reasons"] for r in quality.pair_filter(rows).collect()]
    assert got == [["meta_expression"], ["too_short"], []]
    assert one(spark, 'text {"overall": 4.5} more', lambda c: quality.judge_reply(c)[0]) == 4.5
    assert one(spark, "no json", lambda c: quality.judge_reply(c)[1]) is False
