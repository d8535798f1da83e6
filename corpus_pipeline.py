"""A corpus pipeline of five stages, each over all that the one before kept.

Toxic documents go, one document of each group of near duplicates stays,
documents that hold a test item go, secrets are masked, and what is left is
encoded. Every stage but the last returns the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import bpe, decontaminate, secrets, simhash, toxicity
from quire.llm.common import stored, table

#: A document goes from this score on.
REJECT = 0.5
MASK = "[SECRET]"


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays under REJECT; the model is fitted on the labelled ones that are not held out."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"), REJECT)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exactly one row of each group that hangs together by five-word shingle similarity of 0.8: that with the smallest doc_id, of repeated or missing doc_ids the first row."""
    return simhash.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item, whatever their doc_id."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with every secret's span replaced by MASK and n_chars to match."""
    out = secrets.masked(docs, MASK)
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, their count and digests, and whether decoding gives the text again."""
    return bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic),
    ("simhash_near_dedup", near_duplicates),
    ("decontamination", decontaminated),
    ("secrets", masked),
    ("bpe", encoded),
]

#: A fitted model cannot be put in SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
