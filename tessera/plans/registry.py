"""All queries over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import q_box, q_eval, q_explorer, q_files, q_labels, q_more, q_raster, q_tracks  # noqa: F401  each module registers its queries
from tessera.plans._register import QUERIES, SQL  # noqa: F401


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["ap_per_class"](spark, sf_dir)
