"""Quality metrics, filters and scores of documents; all narrow: no operator here shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text as T

# The stop words that the stop-word ratio counts.
ENGLISH_STOP_WORDS = """
the a an is are was were be been being have has had do does did will would could should may might shall can need dare
ought to of in for on with at by from as into through during before after above below and but or nor not so yet both
either neither each every all any few more most other some such no only own same than too very just because if when
where how what which who whom this that these those i me my we our you your he him his she her it its they them their
""".split()
CHINESE_STOP_WORDS = "的 了 在 是 我 有 和 就 不 人 都 一 一个 上 也 很 到 说 要 去 你 会 着 没有 看 好 自己 这 他 她 它 们 那 些 什么 怎么 如何 可以 因为 所以".split()
STOP_WORDS = ENGLISH_STOP_WORDS + CHINESE_STOP_WORDS
# Signs that a response is a language model's talk about itself.
META_EXPRESSIONS = (
    (r"作为(一个)?AI(语言)?模型", "ai_role"),
    (r"As an AI( language model)?", "ai_role_en"),
    (r"I('m| am) (just )?an? AI", "ai_self_en"),
    (r"我(是|只是)(一个)?语言模型", "model_self"),
    (r"I (don't|cannot|can't) (actually )?have", "denial_en"),
    (r"我(没有|无法)(真正|实际)", "denial"),
)
# Openings and whole texts that make an instruction useless.
BAD_OPENINGS = ["作为一个AI", "作为AI", "我是一个", "我无法", "As an AI", "I'm an AI", "I cannot"]
TOO_SIMPLE = ["你好", "谢谢", "再见", "hello", "hi", "thanks"]

METRICS = ("length", "special_char_ratio", "digit_ratio", "avg_line_length", "duplicate_line_ratio", "duplicate_ngram_ratio", "stopword_ratio")


def rule_metrics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the seven metrics; null texts have null metrics."""
    t = F.col(text)
    return T.once(
        docs,
        {
            "length": F.char_length(t).cast("long"),
            "special_char_ratio": T.special_ratio(t),
            "digit_ratio": T.digit_ratio(t),
            "avg_line_length": T.mean_line_length(t),
            "duplicate_line_ratio": T.duplicate_line_ratio(t),
            "duplicate_ngram_ratio": T.duplicate_ngram_ratio(t),
            "stopword_ratio": T.share_of(T.words(t), STOP_WORDS),
        },
    )


def rule_score() -> Column:
    """Score in [0, 1] from the metric columns."""
    raw = 1 - 0.5 * F.col("special_char_ratio") - 0.5 * F.greatest(F.lit(0.0), F.col("digit_ratio") - 0.1) - 0.3 * F.col("duplicate_line_ratio") - 0.3 * F.col("duplicate_ngram_ratio")
    raw = raw + F.when(F.col("stopword_ratio") > 0.05, 0.1).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))


def rule_filter(
    docs: DataFrame,
    min_length: int = 100,
    max_length: int = 100_000,
    max_special: float = 0.3,
    max_digit: float = 0.5,
    min_line: float = 10.0,
    max_line: float = 500.0,
    max_dup_line: float = 0.5,
    max_dup_ngram: float = 0.3,
    min_stop: float = 0.0,
) -> DataFrame:
    """``docs`` with the metrics, ``reason`` (the first rule that fails, else 'pass'), ``passed`` and ``score``.

    A null text fails as too short. The score of a failed document is 0.
    """
    rules = (
        (F.coalesce(F.col("length"), F.lit(0)) < min_length, "too_short"),
        (F.col("length") > max_length, "too_long"),
        (F.col("special_char_ratio") > max_special, "special_chars"),
        (F.col("digit_ratio") > max_digit, "digits"),
        (F.col("avg_line_length") < min_line, "short_lines"),
        (F.col("avg_line_length") > max_line, "long_lines"),
        (F.col("duplicate_line_ratio") > max_dup_line, "repeated_lines"),
        (F.col("duplicate_ngram_ratio") > max_dup_ngram, "repeated_ngrams"),
        (F.col("stopword_ratio") < min_stop, "few_stop_words"),
    )
    reason = F.lit(None).cast("string")
    for failed, name in reversed(rules):
        reason = F.when(failed, name).otherwise(reason)
    out = rule_metrics(docs).withColumn("reason", F.coalesce(reason, F.lit("pass")))
    passed = F.col("reason") == "pass"
    return out.withColumn("passed", passed).withColumn("score", F.when(passed, rule_score()).otherwise(0.0))


def composite(filters: list[tuple[Column, Column, float]]) -> tuple[Column, Column]:
    """AND of (passed, score, weight) filters and the weighted mean of their scores, 0 where one fails."""
    passed = F.lit(True)
    for p, _, _ in filters:
        passed = passed & F.coalesce(p, F.lit(False))
    total = sum(w for *_, w in filters)
    mean = sum((s * w for _, s, w in filters), F.lit(0.0)) / total
    return passed, F.when(passed, mean).otherwise(0.0)


def quality_score(text: Column, rule: Column | None = None) -> Column:
    """Length band + vocabulary band + paragraphs on a base of 0.5, averaged with the rule score where there is one."""
    n, ttr = F.char_length(text), T.type_token_ratio(text)
    has_words = F.size(T.words(text)) > 0
    s = F.lit(0.5) + F.when(n.between(200, 50_000), 0.15).when(n.between(100, 100_000), 0.05).otherwise(0.0)
    s = s + F.when(has_words, T.let(ttr, lambda r: F.when(r.between(0.3, 0.8), 0.15).when(r.between(0.2, 0.9), 0.05).otherwise(0.0))).otherwise(0.0)
    s = s + F.when(F.size(F.filter(F.split(text, "\n\n"), lambda p: T.strip(p) != "")) >= 2, 0.1).otherwise(0.0)
    if rule is not None:
        s = F.when(rule.isNull(), s).otherwise(0.5 * s + 0.5 * rule)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), s))


def short_rule(text: Column) -> Column:
    """The brief filter: length bounds, special characters, and at least half of the raw lines distinct."""
    raw = T.lines(text)
    return F.char_length(text).between(100, 100_000) & (T.special_ratio(text) <= 0.3) & (F.size(F.array_distinct(raw)) / F.size(raw) >= 0.5)


def c4_filter(text: Column, bad_words: list[str] = ()) -> Column:
    """At least five kept lines (three words or more, ended by . ! or ?, without 'javascript') and no bad word in them."""
    kept = F.filter(
        F.transform(T.lines(text), T.strip),
        lambda x: (F.size(T.words(x, lower=False)) >= 3) & F.substring(x, -1, 1).isin(".", "!", "?") & ~F.lower(x).contains("javascript"),
    )

    def clean(a: Column) -> Column:
        joined = F.lower(F.array_join(a, " "))
        bad = F.lit(False)
        for w in bad_words:
            bad = bad | joined.contains(w)
        return (F.size(a) >= 5) & ~bad

    return T.let(kept, clean)


def perplexity_band(ppl: Column) -> Column:
    return F.when(ppl < 30, "high").when(ppl < 200, "medium").when(ppl < 500, "low").otherwise("noise")


def repeat_rate(text: Column, n: int = 10) -> Column:
    """1 - distinct / all n-grams of the text as it is; 0 with fewer than n words."""
    return T.let(T.ngrams(T.words(text, lower=False), n), lambda a: T.share(F.size(a) - F.size(F.array_distinct(a)), F.size(a)))


def control_rate(text: Column) -> Column:
    """Share of control characters other than line ends and tabs."""
    return T.share(F.char_length(F.regexp_replace(text, r"[^\x00-\x08\x0b\x0c\x0e-\x1f]", "")), F.char_length(text))


def meta_expressions(text: Column) -> Column:
    """Labels of the expressions found, as an array."""
    found = F.array(*[F.when(text.rlike(f"(?i){p}"), label) for p, label in META_EXPRESSIONS])
    return F.filter(found, lambda x: x.isNotNull())


def pair_filter(pairs: DataFrame, response: str = "response", min_length: int = 50, max_length: int = 10_000, max_repeat: float = 0.3, n: int = 10) -> DataFrame:
    """``pairs`` with ``repeat_rate``, ``control_rate``, ``meta`` labels, all ``reasons`` and ``passed``."""
    r = F.col(response)
    size = F.char_length(r)
    out = pairs.withColumns({"response_length": size.cast("long"), "repeat_rate": F.round(repeat_rate(r, n), 4), "control_rate": F.round(control_rate(r), 6), "meta": meta_expressions(r)})
    reasons = F.array(
        F.when(F.coalesce(F.col("response_length"), F.lit(0)) < min_length, "too_short"),
        F.when(F.col("response_length") > max_length, "too_long"),
        F.when(F.col("repeat_rate") > max_repeat, "repeats"),
        F.when(F.size("meta") > 0, "meta_expression"),
        F.when(F.col("control_rate") > 0.01, "control_chars"),
    )
    return out.withColumn("reasons", F.filter(reasons, lambda x: x.isNotNull())).withColumn("passed", F.size("reasons") == 0)


def judge_reply(reply: Column, threshold: float = 3.5) -> tuple[Column, Column]:
    """Overall score salvaged from the first {...} of a judge's reply, and whether it reaches the threshold."""
    scores = F.from_json(F.regexp_extract(reply, r"(?s)\{.*\}", 0), "accuracy double, completeness double, clarity double, helpfulness double, overall double, reasoning string")
    return scores["overall"], F.coalesce(scores["overall"] >= threshold, F.lit(False))


def instruction_ok(text: Column) -> Column:
    """10 to 2000 characters, no refusing opening, no bare greeting."""
    opening = T.strip(text)
    bad = F.lit(False)
    for p in BAD_OPENINGS:
        bad = bad | opening.startswith(p)
    return F.char_length(text).between(10, 2000) & ~bad & ~F.lower(opening).isin(*TOO_SIMPLE)


def looks_like_code(text: Column) -> Column:
    """More than a fifth of the lines open with a keyword of source code."""
    opens = F.filter(F.transform(T.lines(text), T.strip), lambda x: x.rlike(r"^(def |class |import |from |return )"))
    return F.size(opens) / F.size(T.lines(text)) > 0.2


def source_material(text: Column) -> Column:
    """The text if usable as source: code of 5 to 500 lines with a definition, prose of 100 characters or more, cut at 20000."""
    body = T.strip(text)
    n = F.size(T.lines(body))
    code = F.when(n.between(5, 500) & body.rlike(r"(?m)^[ \t]*(def |class |async def )"), body)
    prose = F.when(F.char_length(body) > 20_000, F.concat(F.substring(body, 1, 20_000), F.lit("\n\n[cut]"))).when(F.char_length(body) >= 100, body)
    return F.when(looks_like_code(text), code).otherwise(prose)


def comment_ratio(text: Column) -> Column:
    """Share of the lines that are not blank which open with a comment sign."""
    return T.let(T.solid_lines(text), lambda a: T.share(F.size(F.filter(a, lambda x: x.rlike(r"^(#|//|/\*|\*)"))), F.size(a)))


def rewrite_metrics(pairs: DataFrame, source: str = "source", rewritten: str = "rewritten") -> DataFrame:
    """Lengths, structure counts and density of a rewritten text against its source."""
    s, r = F.col(source), F.col(rewritten)
    count = lambda what: ((F.char_length(r) - F.char_length(F.replace(r, F.lit(what)))) / len(what)).cast("long")
    out = pairs.withColumns({"source_length": F.char_length(s).cast("long"), "rewritten_length": F.char_length(r).cast("long"), "num_headers": count("#"), "num_lists": count("\n- ") + count("\n* "), "num_code_blocks": F.floor(count("```") / 2), "num_bold_terms": F.floor(count("**") / 2)})
    return out.withColumns(
        {
            "length_ratio": F.round(F.col("rewritten_length") / F.greatest("source_length", F.lit(1)), 2),
            "concept_density": F.round((F.col("num_bold_terms") + F.col("num_headers")) / F.greatest(F.col("rewritten_length") / 200.0, F.lit(1.0)), 3),
        }
    )


def language_filter(docs: DataFrame, languages: list[str], least: float = 0.0, lang: str = "lang", score: str | None = None) -> DataFrame:
    """Rows in one of the languages, by a label column and, if there is one, its score; rows without a label go."""
    sure = F.lit(True) if score is None else F.coalesce(F.col(score) >= least, F.lit(False))
    return docs.where(F.col(lang).isin(languages) & sure)


def pair_pipeline(pairs: DataFrame, reply: str | None = None, perplexity: str | None = None, judge_least: float = 3.5, ppl_low: float = 5.0, ppl_high: float = 500.0, **rules) -> DataFrame:
    """Rules, then a judge's score, then a perplexity range, the latter two where their columns are given.

    Adds ``failed_at`` (rules, judge, perplexity or null) and ``final_passed``; a later layer does not ask what an earlier
    one refused.
    """
    out = pair_filter(pairs, **rules)
    judged = F.lit(True) if reply is None else judge_reply(F.col(reply), judge_least)[1]
    fluent = F.lit(True) if perplexity is None else F.coalesce(F.col(perplexity).between(ppl_low, ppl_high), F.lit(False))
    failed = F.when(~F.col("passed"), "rules").when(~judged, "judge").when(~fluent, "perplexity")
    return out.withColumn("failed_at", failed).withColumn("final_passed", F.col("failed_at").isNull())


def quality_report(docs: DataFrame, by: str = "lang") -> DataFrame:
    """For each language: documents, mean length, mean repetition, share of noisy texts and share of texts at risk."""
    from quern.operators.answers import safety

    m = T.once(docs.select(by, "text"), {"rep": T.duplicate_ngram_ratio(F.col("text")), "special": T.special_ratio(F.col("text")), "risk": (safety(F.col("text")) != "safe").cast("double")})
    return m.groupBy(by).agg(F.count("*").alias("n"), F.avg(F.char_length("text")).alias("avg_length"), F.avg("rep").alias("avg_repetition"), F.avg((F.col("special") > 0.3).cast("double")).alias("noisy"), F.avg("risk").alias("at_risk"))


def document_report(docs: DataFrame, reference: DataFrame, weights: dict[str, float] | None = None, threshold: float = 0.5, key: str = "doc_id", n: int = 10) -> DataFrame:
    """``key``, ``fluency``, ``uniqueness``, ``harmlessness``, ``density``, ``score``, ``kept``: each text on several scales from 0 to 1.

    Fluency is nearness of the character model's perplexity (fitted on ``reference``) to the middle of its bounds, uniqueness
    the share of ``n``-grams that don't repeat, harmlessness whether no risk pattern occurs, density the type-token ratio.
    ``weights`` may leave scales out or name further columns of ``docs``; the score is their weighted mean, and texts of
    ``threshold`` or more are kept. A null text counts as empty: unique, harmless, without fluency and density.
    """
    from quern.operators import charlm
    from quern.operators.answers import safety

    weights = weights or {"fluency": 0.3, "uniqueness": 0.3, "harmlessness": 0.2, "density": 0.2}
    named = docs.withColumn("text", F.coalesce("text", F.lit(""))).withColumnRenamed(key, "doc_id")
    own = named.withColumn("harmlessness", (safety(F.col("text")) == "safe").cast("double")).withColumn("_words", T.word_measures(F.col("text"), n))
    own = own.withColumns({"uniqueness": 1 - F.col("_words.repeated"), "density": F.col("_words.distinct")})
    fluency = charlm.perplexity_filter(F.col("perplexity"))[1]
    joined = own.drop("perplexity").join(charlm.perplexity(named, reference), "doc_id").withColumn("fluency", fluency)
    score = sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * w for c, w in weights.items()), F.lit(0.0)) / sum(weights.values())
    out = joined.withColumn("score", score).withColumn("kept", F.col("score") >= threshold)
    return out.select(F.col("doc_id").alias(key), "fluency", "uniqueness", "harmlessness", "density", "score", "kept")
