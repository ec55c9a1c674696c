"""A training corpus from raw documents: five stages, each over all that the one before kept.

Rejects of the quality classifier go; of each group of near duplicates the document with the least id
stays; documents that hold a benchmark item go; secrets are replaced by a mask; at last every document is
encoded (and decoded again). Every stage but the last returns the columns of documents.

Defined cases are those of the operators: null and empty texts are scored, kept once each (they have no
shingles) and encoded to nothing; documents without an id are never grouped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewright.llm import bpe, decontaminate, near_duplicates, quality, secrets
from tracewright.llm.common import discard, durable, table
from tracewright.llm.queries import byte_vocabulary

#: No SQL states the trained stages.
ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.good_documents(docs, table(spark, sf_dir, "labels"))


def keep_first_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_duplicates.first_of_groups(docs, shingle=5, similarity=(80, 100))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs, secrets.fit(secrets.labelled_samples(spark)))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_column(docs, byte_vocabulary(), digests=True)


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", keep_first_of_near_duplicates),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("secret scans", mask_secrets),
    ("BPE encoding and decoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each one's result written to the shared folder and read again, and deleted once the next is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            discard(before)
        before = docs
    return docs
