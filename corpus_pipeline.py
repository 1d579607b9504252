"""Corpus pipeline: classifier, rules, near-duplicates, repeated passages, packing.

Every stage takes what its predecessor wrote as Parquet to the shared folder; all but the last return the columns of
`documents`. The first two drop documents, the third leaves one document of each near-duplicate group, the fourth
cuts passages out of texts (a text may become empty; its row stays), the last returns packed pieces. SQL can't
express the classifier, the fingerprints or the packing, so there is no oracle: tests hold each stage against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from verdance.llm import packing, quality, rules, simhash, suffixdedup
from verdance.llm.common import bounded, table, written

STAGES = [
    ("quality_classifier", lambda spark, docs, sf_dir: quality.keep_good(docs, table(spark, sf_dir, "labels"))),
    ("quality_rules", lambda spark, docs, sf_dir: bounded(spark) and rules.keep_good(docs)),
    ("simhash_near_dedup", lambda spark, docs, sf_dir: bounded(spark) and simhash.keep_one(docs)),
    ("suffix_array_dedup", lambda spark, docs, sf_dir: bounded(spark) and suffixdedup.cut_repeats(docs)),
    ("pattern_packing", lambda spark, docs, sf_dir: bounded(spark) and packing.op8(docs)),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs


QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
