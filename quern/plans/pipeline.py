"""The default cleaning pipeline as one lazy plan of DataFrame functions, with counts of each stage observed in passing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import dedup, html, pii_rules, quality

Stage = Callable[[DataFrame], DataFrame]


def extract_text(docs: DataFrame, min_length: int = 100, clean_html: bool = False) -> DataFrame:
    """HTML documents are extracted (and cleaned if asked), others cleaned; results under ``min_length`` go."""
    is_page = docs.where(html.is_html(F.col("text")))
    plain = T.once(docs.where(~html.is_html(F.coalesce("text", F.lit("")))), {"text": html.clean(F.col("text"))})
    taken = html.extract(is_page, "text").select(docs.columns)
    if clean_html:
        taken = T.once(taken, {"text": html.clean(F.col("text"))})
    return plain.unionByName(taken).where(F.char_length("text") >= min_length)


def normalise(docs: DataFrame) -> DataFrame:
    return T.once(docs, {"text": html.normalize(F.col("text"))})


def apply_rules(docs: DataFrame) -> DataFrame:
    kept = quality.rule_filter(docs).where("passed")
    return kept.select(*docs.columns, F.col("score").alias("rule_score"))


def remove_pii(docs: DataFrame) -> DataFrame:
    return pii_rules.rewrite(docs).select(docs.columns)


def exact_dedup(docs: DataFrame) -> DataFrame:
    return dedup.keep_first(docs, dedup.sha256_key(F.col("text")))


def near_dedup(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    return dedup.without(docs, dedup.greedy_removals(docs, threshold))


def score(docs: DataFrame, least: float = 0.3) -> DataFrame:
    rule = F.col("rule_score") if "rule_score" in docs.columns else None
    return T.once(docs, {"quality_score": quality.quality_score(F.col("text"), rule)}).where(F.col("quality_score") >= least)


DEFAULT: list[tuple[str, Stage]] = [("extract", extract_text), ("normalise", normalise), ("rules", apply_rules), ("pii", remove_pii), ("exact dedup", exact_dedup), ("near dedup", near_dedup), ("score", score)]


def run(docs: DataFrame, stages: list[tuple[str, Stage]] | None = None) -> tuple[DataFrame, dict[str, Observation]]:
    """The stages one after the other. A stage is any function of a DataFrame. Row counts come from observations, which
    are filled by the action that consumes the result, not by an action of their own.

    The text is written once before the duplicate stages, whose passes would else compute everything above them again; these
    stages write the ids that they drop, not the text.
    """
    seen: dict[str, Observation] = {}
    for name, stage in stages or DEFAULT:
        docs = stage(docs)
        if name == "pii":
            docs = dedup.persisted(docs)
        seen[name] = Observation(name)
        docs = docs.observe(seen[name], F.count(F.lit(1)).alias("rows"))
    return docs, seen


def report(rows_in: int, seen: dict[str, Observation]) -> str:
    """The rows that went into and came out of each stage, what it removed, and the totals, as lines of text; to be asked
    after the action that consumes ``run``'s result."""
    lines, before = [f"{'stage':<14}{'in':>12}{'out':>12}{'removed':>10}"], rows_in
    for name, found in seen.items():
        after = found.get["rows"]
        lines.append(f"{name:<14}{before:>12}{after:>12}{1 - after / before if before else 0.0:>10.1%}")
        before = after
    return "\n".join([*lines, f"{'total':<14}{rows_in:>12}{before:>12}{1 - before / rows_in if rows_in else 0.0:>10.1%}"])
