"""The corpus pipeline: documents to packed token sequences, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import stages
from tessera.llm.common import settings_kept, stored, table

STAGES = [
    ("toxicity", stages.drop_toxic),
    ("quality_rules", stages.keep_quality),
    ("jaccard_join", stages.drop_near_copies),
    ("secret_scan", stages.hide_secrets),
    ("packing", stages.pack_documents),
]

#: The stages learn models and follow a curve; tests/llm/test_pipeline.py holds them against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with settings_kept(spark):
        for name, stage in STAGES:
            docs = stored(stage(spark, docs, sf_dir), name, keep=True)
    return docs
