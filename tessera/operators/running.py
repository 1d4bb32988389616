"""Running sums and maxima over whole tables or groups of any size, and tables written to the shared folder."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``); a local one only where none is set and the
    executors are threads of the driver."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file:///tmp/checkpoints"


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again: computed once, and a lost executor costs nothing that is written."""
    path = f"{shared_dir(df.sparkSession)}/tessera-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def running(df: DataFrame, groups: list[str], order: list[Column], sums: dict[str, Column] | None = None, tops: dict[str, Column] | None = None) -> DataFrame:
    """``df`` with, by name, sums and maxima over each row and those before it in its group, in the given (total) order.

    A range sort deals the rows out, groups of any size among them; each part is folded by itself and then raised by what the parts
    before it hold of the group. So no task sorts a whole group; a row for each part and group is all that meets.
    """
    sums, tops = sums or {}, tops or {}
    by = [F.col(g) for g in groups] + order
    values = {**sums, **tops}
    given = stored(df.select("*", *(c.alias(f"_v_{n}") for n, c in values.items())), "given")  # a range sort reads its input twice
    part = stored(given.repartitionByRange(*by).withColumn("_part", F.spark_partition_id()), "running")
    fold = {n: F.sum if n in sums else F.max for n in values}
    within = W.partitionBy("_part", *groups).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    local = part.select("*", *(f(F.col(f"_v_{n}")).over(within).alias(f"_l_{n}") for n, f in fold.items()))
    before = (W.partitionBy(*groups) if groups else W.partitionBy(F.lit(0))).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    total = part.groupBy("_part", *groups).agg(*(f(f"_v_{n}").alias(n) for n, f in fold.items()))
    carry = total.select(F.col("_part").alias("_p"), *(F.col(g).alias(f"_g_{g}") for g in groups), *(f(F.col(n)).over(before).alias(f"_c_{n}") for n, f in fold.items()))
    on = (F.col("_part") == F.col("_p")) & F.lit(True)
    for g in groups:
        on = on & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    joined = local.join(carry, on)
    own = [c for c in df.columns if c not in values]
    out = [F.col(f"_l_{n}") + F.coalesce(F.col(f"_c_{n}"), F.lit(0)) if n in sums else F.greatest(F.col(f"_l_{n}"), F.col(f"_c_{n}")) for n in values]
    return joined.select(*(F.col(f"`{c}`") for c in own), *(x.alias(n) for x, n in zip(out, values, strict=True)))
