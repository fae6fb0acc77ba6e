"""The corpus pipeline: toxicity, near duplicates, benchmark contamination, personal data, packing.

Each stage reads all that the stage before it kept, as a written table, and its decisions take effect: rejected
documents go, personal data is replaced in the texts, and the last stage packs what is left. ``ORACLE_SQL`` is None
because SQL expresses none of the stages; the tests hold them against brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm import decontaminate, packing, pii, simhash, toxicity
from quern.llm.common import durable, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: keep the documents whose toxicity score is under 0.7."""
    model = toxicity.fit(*toxicity.labelled_sample(docs, table(spark, sf_dir, "labels")))
    return toxicity.reject_toxic(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: of each component of fingerprints within 3 bits, keep the document of the smallest id."""
    return simhash.keep_one_each(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: drop the documents that hold a benchmark item within its edit budget."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: replace each span of personal data by its kind in brackets; every document stays."""
    return pii.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: tokenise, cut and pack into sequences of 2048 tokens; a row for each piece."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("pii", redact_personal_data),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each one's result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
