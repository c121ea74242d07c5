"""The corpus pipeline: quality rules, near-duplicates, repeated passages, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns of
documents; every decision takes effect on the rows or texts handed on. Nulls, empty tables, repeated rows and extra
columns are handled as each operator's docstring states; extra columns pass through up to the last stage, which
returns one row for each packed piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftline.llm import minhash_dedup, packing, quality_rules, secret_scan, suffix_dedup
from driftline.llm.common import stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each class stays."""
    return minhash_dedup.keep_first(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of passages that an earlier document holds go; the document stays."""
    return suffix_dedup.remove_repeats(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret found is masked."""
    return secret_scan.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document in a sequence."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality),
    ("minhash_dedup", near_duplicates),
    ("suffix_dedup", repeated_passages),
    ("secret_scan", secrets),
    ("packing", packed),
]

#: The near-duplicate, suffix, secret and packing stages are not expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
