"""From raw documents to packed training sequences.

Each stage works on all that its predecessor kept and is written as Parquet before the next reads it:
quality rules (documents that fail go), near-duplicates (one document of each group stays), personal data
(spans become marks), packing (pieces of sequences with their token ids, packed little-endian in 32 bits each).
All but the last return the columns of documents, whatever further columns those have.

Null and empty texts fail the quality rules; rows that share an id but not a component of near-duplicates all stay; an
empty table gives an empty result. The tables between the stages go when the last of them is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from recollect.llm import neardup, packing, pii, quality, registry
from recollect.llm.common import documents, materialise, scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


#: Links of five-word shingles at 0.8; with 12 sides a pair at 0.8 exactly meets in no table with probability 1e-5.
LINKS = neardup.Params(shingle=5, percent=80, side=12)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.one_of_each(docs, LINKS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, registry.tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("personal data", personal_data),
    ("packing", pack),
]

#: The word pieces and best-fit places of the last stage are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    with scratch(spark) as keep:
        for n, (name, stage) in enumerate(STAGES[:-1]):
            made = stage(spark, docs, sf_dir)
            docs = (keep if n + 2 == len(STAGES) else materialise)(made, name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
