"""From raw documents to packed sequences: five stages, each over all that the stage before kept.

quality rules -> language ID -> near-duplicates -> secret scans -> packing. Every stage but the last returns the columns of
``documents``; its decisions take effect: rejected rows go, secrets are replaced by a mark. Each stage is written to the
shared folder before the next one reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pulsegrid.llm import langid, near_dup, packing, quality, secrets
from pulsegrid.llm.common import id_residue, written
from pulsegrid.llm.queries import vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base check and are more likely good than not."""
    return quality.passing(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter whose n-grams stand within three quarters of the greatest distance to a profile."""
    return langid.identified(docs, langid.fit(docs.filter(id_residue(5) != 0)), most_away=0.75)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group at five-word shingles and a similarity of 0.8."""
    return near_dup.one_of_each(docs, size=5, percent=80)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the text of secrets replaced."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"), with_ids=False)


STAGES = [("quality rules", quality_rules), ("language id", language_id), ("near duplicates", near_duplicates), ("secret scan", secret_scan), ("packing", pack)]

#: SQL can't express expectation-maximisation, tokenisation or profiles at scale; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
