"""Tiles, windows and pixel relations."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def starts(size: Column, window: int, step: int) -> Column:
    """Starts of windows along one axis: every step from 0 while they start inside."""
    return F.sequence(F.lit(0).cast("long"), F.greatest(size.cast("long") - 1, F.lit(0).cast("long")), F.lit(step).cast("long"))


def tiles(rasters: DataFrame, size: int) -> DataFrame:
    """Disjoint grid, clipped to the raster."""
    c = F.col
    t = rasters.withColumn("x", F.explode(starts(c("width"), size, size))).withColumn("y", F.explode(starts(c("height"), size, size)))
    return t.withColumn("w", F.least(F.lit(size), c("width") - c("x")).cast("long")).withColumn("h", F.least(F.lit(size), c("height") - c("y")).cast("long"))


def _shifted(at: Column, size: Column, window: int) -> Column:
    """The last window moves back inside; below 0 where the raster is smaller than the window."""
    return F.when(size - at < window, size - window).otherwise(at).cast("long")


def sliding_windows(rasters: DataFrame, size: int, step: int) -> DataFrame:
    """Overlapping windows; those that would stick out move back, so some may repeat."""
    c = F.col
    t = rasters.withColumn("x", F.explode(starts(c("width"), size, step))).withColumn("y", F.explode(starts(c("height"), size, step)))
    return t.withColumn("x", _shifted(c("x"), c("width"), size)).withColumn("y", _shifted(c("y"), c("height"), size))


def patch_windows(rasters: DataFrame, size: int, least: float = 0.25) -> DataFrame:
    """Disjoint windows; a remainder of at least ``least`` of a patch is a whole patch moved back, a smaller one is clipped."""
    t = tiles(rasters, size)
    for at, length, whole in (("x", "w", "width"), ("y", "h", "height")):
        move = (F.col(length) < size) & (F.col(length) >= least * size) & (F.col(whole) >= size)
        t = t.withColumn("_m", move).withColumn(at, F.when(F.col("_m"), F.col(whole) - size).otherwise(F.col(at)).cast("long")).withColumn(length, F.when(F.col("_m"), size).otherwise(F.col(length)).cast("long")).drop("_m")
    return t


def inner_windows(rasters: DataFrame, size: int, step: int) -> DataFrame:
    """Windows that lie inside the raster."""
    c = F.col
    along = lambda n: F.sequence(F.lit(0).cast("long"), (n - size).cast("long"), F.lit(step).cast("long"))
    fit = rasters.filter((c("width") >= size) & (c("height") >= size))
    return fit.withColumn("x", F.explode(along(c("width")))).withColumn("y", F.explode(along(c("height"))))


def rated_windows(rasters: DataFrame, size: int, gap: int, rate: float = 0.6) -> DataFrame:
    """Windows aligned to the far edge, of which more than ``rate`` lies in the image; else those of the largest share."""
    c = F.col
    step = size - gap

    def along(n: Column) -> Column:
        k = F.when(n <= size, F.lit(1)).otherwise(F.ceil((n - size) / step + 1)).cast("int")
        return F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.when((i > 0) & (i == k - 1) & (i * step + size > n), n - size).otherwise(i * step).cast("long"))

    t = rasters.withColumn("x", F.explode(along(c("width")))).withColumn("y", F.explode(along(c("height"))))
    share = (F.least(c("x") + size, c("width")) - c("x")) * (F.least(c("y") + size, c("height")) - c("y")) / float(size * size)
    t = t.withColumn("share", share).withColumn("best", F.max("share").over(W.partitionBy("raster_id")))
    return t.filter((c("share") > rate) | ((c("best") <= rate) & (c("share") == c("best")))).drop("best")


def adaptive_windows(counts: DataFrame, size: int = 336, low: float = 0.5, high: float = 0.8, many: int = 30) -> DataFrame:
    """Windows whose overlap grows after a crowded one, raster by raster: each step was fixed before the window it follows was
    seen, so a change comes one window late. ``counts`` has raster_id, width, height and points (array of x, y)."""
    steps = {False: max(1, int(size * (1 - low))), True: max(1, int(size * (1 - high)))}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in pdf.itertuples():
            p = np.array([(q["x"], q["y"]) for q in r.points], float).reshape(-1, 2)
            y, crowded = 0, False
            while y < r.height:
                x, step = 0, steps[crowded]
                while x < r.width:
                    n = int(((p[:, 0] >= x) & (p[:, 0] < x + size) & (p[:, 1] >= y) & (p[:, 1] < y + size)).sum())
                    out.append((r.raster_id, x, y, n))
                    step = steps[crowded]
                    crowded = n > many
                    x += step
                y += step
        return pd.DataFrame(out, columns=["raster_id", "x", "y", "n"])

    return counts.groupBy("raster_id").applyInPandas(run, "raster_id long, x long, y long, n long")


def resized(pixels: DataFrame, keys: list[str], size: tuple[int, int], to: tuple[int, int]) -> DataFrame:
    """(keys, row, col, v) on a frame of another size (rows, columns), bilinear between pixels' middles; missing pixels are 0.

    Each pixel goes to the few places of the new frame that it weighs on, which add up: no join, and one shuffle.
    """

    def weighs(n: int, m: int) -> Column:
        """Per old place the new places it weighs on: an array of arrays of (at, u)."""
        out: list[list] = [[] for _ in range(n)]
        for i in range(m):
            s = max((i + 0.5) * n / m - 0.5, 0.0)
            p = int(s)
            out[min(p, n - 1)].append((i, 1 - (s - p)))
            out[min(p + 1, n - 1)].append((i, s - p))
        pair = lambda i, u: F.struct(F.lit(i).cast("long").alias("at"), F.lit(u).alias("u"))
        kind = "array<struct<at:bigint,u:double>>"
        return F.array(*(F.array(*(pair(i, u) for i, u in x)).cast(kind) for x in out))

    y = pixels.withColumn("_y", F.explode(F.get(weighs(size[0], to[0]), F.col("row").cast("int"))))
    x = y.withColumn("_x", F.explode(F.get(weighs(size[1], to[1]), F.col("col").cast("int"))))
    return x.groupBy(*keys, F.col("_y.at").alias("row"), F.col("_x.at").alias("col")).agg(F.sum(F.col("v") * F.col("_y.u") * F.col("_x.u")).alias("v"))


def histogram_match(source: DataFrame, reference: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, value, matched): least reference value whose cumulative share reaches the source value's; 256 rows a channel."""

    def cdf(df: DataFrame, name: str) -> DataFrame:
        n = df.groupBy(*keys, "value").agg(F.count("*").alias("n"))
        w = W.partitionBy(*keys)
        up = w.orderBy("value").rowsBetween(W.unboundedPreceding, 0)
        return n.select(*keys, F.col("value").alias(name), F.floor(F.sum("n").over(up) * 255 / F.sum("n").over(w)).alias(f"{name}_cdf"))

    s, r = cdf(source, "value"), cdf(reference, "ref")
    return s.join(r, keys).filter("ref_cdf >= value_cdf").groupBy(*keys, "value").agg(F.min("ref").alias("matched"))


def percentile_stretch(pixels: DataFrame, keys: list[str], low: float = 0.005, high: float = 0.995) -> DataFrame:
    """Pixels with ``stretched``: 0 to 255 between two exact percentiles of each group."""
    q = pixels.groupBy(*keys).agg(F.percentile("value", F.array(F.lit(low), F.lit(high))).alias("q"))
    c = F.col
    share = (c("value") - c("q")[0]) / F.greatest(c("q")[1] - c("q")[0], F.lit(1e-9))
    return pixels.join(q, keys).withColumn("stretched", F.floor(F.greatest(F.least(share, F.lit(1.0)), F.lit(0.0)) * 255).cast("int")).drop("q")


def sigma_clip(df: DataFrame, column: str, sigma: float = 2.0, rounds: int = 3) -> DataFrame:
    """Rows within ``sigma`` population deviations of the mean, again and again; each round is one aggregate."""
    for _ in range(rounds):
        m = df.agg(F.avg(column).alias("m"), F.stddev_pop(column).alias("s"))
        df = df.join(F.broadcast(m), (F.col(column) >= F.col("m") - sigma * F.col("s")) & (F.col(column) <= F.col("m") + sigma * F.col("s"))).drop("m", "s")
    return df


def connected_regions(pixels: DataFrame, keys: list[str], diagonal: bool = True) -> DataFrame:
    """(keys, label, n, row, col): 8- (or 4-) connected regions of each group's pixels (row, col) with size and mean place."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        at = {p: i for i, p in enumerate(sorted(set(zip(pdf["row"], pdf["col"], strict=True))))}
        above = list(range(len(at)))

        def top(i):
            while above[i] != i:
                above[i] = above[above[i]]
                i = above[i]
            return i

        steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if diagonal else [])
        for (y, x), i in at.items():
            for dy, dx in steps:
                j = at.get((y + dy, x + dx))
                if j is not None:
                    a, b = sorted((top(i), top(j)))
                    above[b] = a
        d = pd.DataFrame([(top(i), y, x) for (y, x), i in at.items()], columns=["label", "row", "col"])
        out = d.groupby("label").agg(n=("row", "size"), row=("row", "mean"), col=("col", "mean")).reset_index()
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[[*keys, "label", "n", "row", "col"]]

    kinds = dict(pixels.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", label long, n long, row double, col double"
    return pixels.select(*keys, "row", "col").groupBy(*keys).applyInPandas(run, schema)
