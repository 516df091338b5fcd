"""Corpus preparation: each stage works on all that the one before it kept.

Toxic documents go, one document of each near-duplicate group stays, contaminated documents go,
personal data is masked, and what is left is encoded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from refillspark.llm import bpe, decontam, pii, simhash, toxicity
from refillspark.llm.common import stored, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at 0.7 or more go; null and empty texts have the score of its bias alone."""
    return toxicity.keep_civil(docs, table(spark, sf_dir, "labels"))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts with a five-word similarity of 0.8 or more stays, that of the smallest id; texts without words are one group, rows without an id stay."""
    return simhash.keep_one_of_similar(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark question, also with other numbers and names, go; null and empty texts and rows without an id stay."""
    return decontam.keep_uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each span of personal data becomes the name of its kind in angle brackets; null texts stay null."""
    return pii.mask_personal_data(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text by byte-level BPE, as counts and digests; null texts count as empty."""
    return bpe.encode_texts(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontamination", decontamination_stage),
    ("personal_data", personal_data_stage),
    ("encoding", encoding_stage),
]

#: Fitted scores, fingerprints and merges aren't SQL; tests compare the rows with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; what a stage returns is written and read again as the next one's input.

    Null and empty texts are clean: the first of them stays for each group, with 0 tokens. Rows
    without an id pass every stage that compares rows by id; of repeated ids, rows with similar
    texts count as one. Further columns are kept up to the last stage. An empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
