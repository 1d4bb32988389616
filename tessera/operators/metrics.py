"""Evaluation: average precision, confusion matrices and summaries; nothing is gathered but per-class rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.running import running, stored

#: Overlap thresholds of a mean average precision.
THRESHOLDS = [0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95]


def wide_curve(pred: DataFrame, matches: DataFrame, gt: DataFrame, thresholds: list[float], key: str = "det_id") -> DataFrame:
    """(cls, det, conf, rank, n_gt, t0, t1, ...): true positives up to each detection along falling confidence, per class, a column for
    each threshold. Detections are sorted once, by class and confidence; classes may be of any size.
    """
    hit = matches.groupBy(key).agg(F.collect_set("thr").alias("_at"))  # as many as thresholds, at most
    rows = pred.select(key, "cls", "conf").join(hit, key, "left")
    sums = {f"t{i}": F.when(F.array_contains("_at", F.lit(t)), 1).otherwise(0) for i, t in enumerate(thresholds)}
    wide = running(rows, ["cls"], [F.desc("conf"), F.col(key)], sums={"rank": F.lit(1), **sums}).drop("_at")
    return wide.join(F.broadcast(gt.groupBy("cls").agg(F.count("*").alias("n_gt"))), "cls")  # a row for each class


def precision_recall(pred: DataFrame, matches: DataFrame, gt: DataFrame, thresholds: list[float], key: str = "det_id") -> DataFrame:
    """(thr, cls, det, conf, tp, rank, n_gt, recall, precision) along falling confidence, per class and threshold."""
    wide = wide_curve(pred, matches, gt, thresholds, key)
    at = F.explode(F.array(*(F.struct(F.lit(t).alias("thr"), F.col(f"t{i}").alias("tp")) for i, t in enumerate(thresholds))))
    curve = wide.select("cls", key, "conf", "rank", "n_gt", at.alias("t")).select("*", "t.*")
    return curve.select("thr", "cls", key, "conf", "tp", "rank", "n_gt", (F.col("tp") / (F.col("n_gt") + 1e-16)).alias("recall"), (F.col("tp") / F.col("rank")).alias("precision"))


def average_precision(wide: DataFrame, thresholds: list[float]) -> DataFrame:
    """(thr, cls, ap, n_gt) of ``wide_curve``: the envelope of precision at 101 recalls, trapezoid area.

    The envelope's value between two recalls is interpolated; before the first recall it is the envelope's first value, and
    after the last it falls to 0 at recall 1. Of points of equal recall the last one's envelope counts. Of all points between
    two grid points the first and the last alone are kept, which groups find; so a class takes 101 rows from there on.
    """
    c, n = F.col, range(len(thresholds))
    tops = {f"e{i}": c(f"t{i}") / c("rank") for i in n}
    env = running(wide.select("cls", "n_gt", "rank", *(f"t{i}" for i in n)), ["cls"], [F.desc("rank")], tops=tops)
    at = F.explode(F.array(*(F.struct(F.lit(t).alias("thr"), (c(f"t{i}") / (c("n_gt") + 1e-16)).alias("recall"), c(f"e{i}").alias("env")) for i, t in enumerate(thresholds))))
    env = env.select("cls", "n_gt", at.alias("p")).select("cls", "n_gt", "p.*")
    # the first grid point at or after a recall
    near = F.ceil(c("recall") * 100 - 1e-6)
    env = env.withColumn("k", F.when(near / 100 >= c("recall"), near).otherwise(near + 1).cast("int"))
    point = F.struct("recall", (-c("env")).alias("down"))
    ends = stored(env.groupBy("thr", "cls", "n_gt", "k").agg(F.min(point).alias("first"), F.max(point).alias("last")), "ends")
    groups = ends.select("thr", "cls", "n_gt").distinct()
    grid = groups.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(100)))).join(ends, ["thr", "cls", "n_gt", "k"], "left")
    by = W.partitionBy("thr", "cls", "n_gt").orderBy("k")  # 101 rows
    start = F.struct(F.lit(0.0).alias("recall"), F.lit(-1.0).alias("down"))
    grid = grid.withColumn("left", F.coalesce(F.last("last", ignorenulls=True).over(by.rowsBetween(W.unboundedPreceding, 0)), start))
    grid = grid.withColumn("right", F.first("first", ignorenulls=True).over(by.rowsBetween(1, W.unboundedFollowing)))
    x, r, leave = c("k") / 100, c("left.recall"), -c("left.down")
    to, enter = F.coalesce(c("right.recall"), F.lit(1.0)), F.coalesce(-c("right.down"), F.lit(0.0))
    # at recall 1 the last point is the closing one, at height 0
    y = F.when(c("k") == 100, 0.0).otherwise(leave + (enter - leave) * (x - r) / (to - r))
    weight = F.when((c("k") == 0) | (c("k") == 100), 0.005).otherwise(0.01)
    return grid.groupBy("thr", "cls", "n_gt").agg(F.sum(y * weight).alias("ap"))


def best_confidence(curve: DataFrame, n_classes: int) -> DataFrame:
    """(k, f1): mean F1 over the classes at confidence k / 100, from each class's last row at or above it."""
    c = F.col
    f1 = 2 * c("precision") * c("recall") / (c("precision") + c("recall") + 1e-16)
    last = curve.withColumn("k", F.floor(c("conf") * 100 + 1e-9)).groupBy("cls", "k").agg(F.max(F.struct("rank", f1.alias("f1"))).alias("at"))  # 101 rows a class
    down = W.partitionBy("cls").orderBy(F.desc("k")).rowsBetween(W.unboundedPreceding, 0)
    grid = last.select("cls").distinct().withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(100).cast("long")))).join(last, ["cls", "k"], "full")
    held = grid.withColumn("at", F.max("at").over(down)).filter("k between 0 and 100")
    mean = held.groupBy("k").agg((F.sum("at.f1") / n_classes).alias("f1"))
    return mean.select("k", F.coalesce("f1", F.lit(0.0)).alias("f1"))


def confusion_matrix(pred: DataFrame, gt: DataFrame, matches: DataFrame, background: int, parity: bool = True) -> DataFrame:
    """(pred_cls, gt_cls, n). With ``parity``, false positives of an image that has labels but no match are left out."""
    image = "image_id"
    hit = matches.select(F.col("det_cls").alias("pred_cls"), F.col("gt_cls"))
    missed = gt.join(matches.select(image, "gt_id"), [image, "gt_id"], "left_anti").select(F.lit(background).cast("long").alias("pred_cls"), F.col("cls").cast("long").alias("gt_cls"))
    spare = pred.join(matches.select(image, "det_id"), [image, "det_id"], "left_anti")
    if parity:
        counted = matches.select(image).distinct()
        unlabelled = pred.select(image).distinct().join(gt.select(image).distinct(), image, "left_anti")
        spare = spare.join(counted.union(unlabelled), image, "left_semi")
    spare = spare.select(F.col("cls").cast("long").alias("pred_cls"), F.lit(background).cast("long").alias("gt_cls"))
    return hit.select(F.col("pred_cls").cast("long"), F.col("gt_cls").cast("long")).unionByName(missed).unionByName(spare).groupBy("pred_cls", "gt_cls").agg(F.count("*").alias("n"))
