"""The corpus pipeline: each stage works on all that the one before kept.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a
DataFrame, which ``run`` writes as Parquet and reads again as the next one's docs.

Defined cases: null and empty texts are never toxic by label alone, are no near-duplicates of anything, hold no passage
and no secret, and are packed as one closing id; rows that repeat a doc_id and text count as near-duplicates; rows without
doc_id take part in all stages; very long texts are taken whole; empty tables give no rows; extra columns stay until packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from twinleaf.llm import decontamination, jaccard_join, packing, secrets, toxicity
from twinleaf.llm.common import durable, read
from twinleaf.llm.queries import vocabulary


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return toxicity.reject(docs, read(spark, sf_dir, "labels"), docs)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return jaccard_join.keep_first(docs)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go."""
    return decontamination.keep_clean(docs, read(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text."""
    return secrets.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become token sequences."""
    return packing.pack(docs, vocabulary())


STAGES = [
    ("toxicity", reject_toxic),
    ("jaccard_join", keep_one_of_each_group),
    ("decontamination", drop_benchmark_passages),
    ("secret_scans", redact_secrets),
    ("packing", pack_sequences),
]

#: The classifier and the automaton have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir))
    return docs
