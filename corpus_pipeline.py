"""A training-data pipeline over ``documents``: quality rules, exact dedup, near-duplicate join, mixing, encoding.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept and returns
documents with the columns it was given; the last returns token counts and digests.

Cases, for every stage: null or empty texts fail the quality rules, and where a stage meets them all the same they are
copies of one another, have no near copies, are left out by the mix and have no tokens; null ids are never trusted, come last among
copies, have no near copies and are mixed as rows; repeated rows are copies; the null source is one source; further columns pass through all
stages but the last, whatever their names; an empty table gives an empty result. One very long text is one row throughout.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import bpe, exact_dedup, jaccard_join, mixing, quality_rules
from weftline.llm.common import discard, materialize, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep(docs, quality_rules.trusted_ids(table(spark, sf_dir, "labels")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal but for white space."""
    return exact_dedup.dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts that share at least 0.8 of their five-word shingles."""
    return jaccard_join.dedup(docs, size=5, num=80, den=100)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes: one row for each copy."""
    return bpe.digests(docs, *bpe.default_vocabulary())


STAGES = [("quality_rules", quality), ("exact_dedup", exact), ("jaccard_join", near), ("source_mix", mix), ("byte_bpe", encode)]

#: Hashing and tokenizing stages have no SQL form; tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, written = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(*written)
        written = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
