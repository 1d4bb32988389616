"""Rings (arrays of (x, y) structs) and map coordinates as Column expressions."""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.box import Box, area, clip


def _after(ring: Column) -> Column:
    """The ring moved on by one point."""
    return F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))


def _sum(ring: Column, term) -> Column:
    return F.aggregate(F.zip_with(ring, _after(ring), term), F.lit(0.0), lambda a, x: a + x)


def signed_area(ring: Column) -> Column:
    return _sum(ring, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]) / 2


def centroid(ring: Column) -> tuple[Column, Column, Column]:
    """(x, y, area) of a ring with area."""
    a = signed_area(ring)
    cross = lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]
    return _sum(ring, lambda p, q: (p["x"] + q["x"]) * cross(p, q)) / (6 * a), _sum(ring, lambda p, q: (p["y"] + q["y"]) * cross(p, q)) / (6 * a), F.abs(a)


def contains(ring: Column, x: Column, y: Column) -> Column:
    """Ray casting; a point on the lower or left border may count as inside."""
    crossings = F.zip_with(ring, _after(ring), lambda p, q: ((p["y"] > y) != (q["y"] > y)) & (x < (q["x"] - p["x"]) * (y - p["y"]) / F.nullif(q["y"] - p["y"], F.lit(0.0)) + p["x"]))
    return F.size(F.filter(crossings, lambda c: F.coalesce(c, F.lit(False)))) % 2 == 1


def ring_box(ring: Column) -> Box:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return Box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def segment_box(ring: Column, width: float, height: float) -> Box:
    """Box of the points inside the image; zeros where there are none (or all of their x are 0)."""
    inside = F.filter(ring, lambda p: p["x"].between(0, width) & p["y"].between(0, height))
    b = ring_box(inside)
    any_ = F.exists(inside, lambda p: p["x"] != 0)
    return Box(*(F.when(any_, v).otherwise(0.0) for v in b))


def closest(ring: Column, other: Column) -> Column:
    """(d, i, j): least squared distance of two rings' points, and their places; first come first among equals."""
    gap = lambda p, q: (p["x"] - q["x"]) * (p["x"] - q["x"]) + (p["y"] - q["y"]) * (p["y"] - q["y"])
    pairs = F.flatten(F.transform(ring, lambda p, i: F.transform(other, lambda q, j: F.struct(gap(p, q).alias("d"), i.alias("i"), j.alias("j")))))
    return F.array_min(pairs)


def resample(ring: Column, n: int) -> Column:
    """``n`` points at even index steps along the closed ring, by linear interpolation."""
    closed = F.concat(ring, F.slice(ring, 1, 1))

    def at(i: Column) -> Column:
        t = i * F.size(ring) / (n - 1)
        k = F.least(F.floor(t).cast("int"), F.size(ring) - 1)
        p, q, f = F.get(closed, k), F.get(closed, k + 1), t - k
        return F.struct((p["x"] + (q["x"] - p["x"]) * f).alias("x"), (p["y"] + (q["y"] - p["y"]) * f).alias("y"))

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), at)


def crop_boxes(spark: SparkSession, width: int, height: int, layers: int, share: float) -> DataFrame:
    """Layer i cuts the image into 2**i by 2**i crops that overlap by a share of its shorter side."""
    rows = []
    for layer in range(1, layers + 1):
        n = 2**layer
        o = int(share * min(width, height) * (2 / n))
        rows.append((layer, n, o, math.ceil((o * (n - 1) + width) / n), math.ceil((o * (n - 1) + height) / n)))
    z = spark.createDataFrame(rows, "layer long, n long, o long, cw long, ch long")
    z = z.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    x0, y0 = F.col("i") * (F.col("cw") - F.col("o")), F.col("j") * (F.col("ch") - F.col("o"))
    return z.select("layer", x0.alias("x0"), y0.alias("y0"), F.least(x0 + F.col("cw"), F.lit(width)).alias("x1"), F.least(y0 + F.col("ch"), F.lit(height)).alias("y1"))


def mosaic(labels: DataFrame, size: float) -> DataFrame:
    """Labels of four consecutive images in one frame of ``size``: shifted by half, clipped, those without area dropped."""
    k = F.col("image_id") % 4
    dx, dy = F.when(k.isin(1, 3), size / 2).otherwise(-size / 2), F.when(k >= 2, size / 2).otherwise(-size / 2)
    x = clip(Box(F.col("x1") + dx, F.col("y1") + dy, F.col("x2") + dx, F.col("y2") + dy), size, size)
    out = labels.select(F.floor(F.col("image_id") / 4).cast("long").alias("mosaic"), "gt_id", "cls", *x.named("x1", "y1", "x2", "y2", digits=None))
    return out.filter(area(Box(*(F.col(c) for c in ("x1", "y1", "x2", "y2")))) > 0)


#: Where the images of a mosaic lie, in image sides from the middle one, in their order: for three the middle, the right and
#: the left one; for nine the middle one and those around it, clockwise from the top.
PLACES = {3: [(1, 1), (2, 1), (0, 1)], 9: [(1, 1), (1, 0), (2, 0), (2, 1), (2, 2), (1, 2), (0, 2), (0, 1), (0, 0)]}


def mosaic_row(labels: DataFrame, n: int, side: float) -> DataFrame:
    """Labels of ``n`` (3 or 9) consecutive images of one side around a middle one, in the frame of twice the side about it."""
    k = F.col("image_id") % n
    dx, dy = (sum((F.when(k == i, F.lit(p[a] * side)).otherwise(0.0) for i, p in enumerate(PLACES[n])), F.lit(0.0)) - side / 2 for a in (0, 1))
    x = clip(Box(F.col("x1") + dx, F.col("y1") + dy, F.col("x2") + dx, F.col("y2") + dy), 2 * side, 2 * side)
    out = labels.select(F.floor(F.col("image_id") / n).cast("long").alias("mosaic"), "gt_id", "cls", *x.named("x1", "y1", "x2", "y2", digits=None))
    return out.filter(area(Box(*(F.col(c) for c in ("x1", "y1", "x2", "y2")))) > 0)


def mixup(labels: DataFrame, order: DataFrame) -> DataFrame:
    """Labels of each image and of its partner, the next in ``order`` (image_id, rank from 0); ``own`` tells them apart."""
    n = order.count()
    partners = order.select(F.col("image_id").alias("of"), "rank").withColumn("rank", (F.col("rank") + 1) % n).join(order.withColumnRenamed("image_id", "partner"), "rank").drop("rank")
    both = partners.select("of", F.explode(F.array_distinct(F.array("of", "partner"))).alias("image_id"))
    out = both.join(labels, "image_id").withColumn("own", F.col("of") == F.col("image_id"))
    return out.drop("image_id").withColumnRenamed("of", "image_id")


def mixup_ratio(seed: int) -> float:
    """How much of the image itself a blend holds: Beta(32, 32), near one half."""
    return random.Random(seed).betavariate(32.0, 32.0)


def perspective_matrix(width: float, height: float, angle: float, scale: float, shear: tuple[float, float], shift: tuple[float, float], tilt: tuple[float, float]) -> list[list[float]]:
    """Shift times shear times rotation and scale times tilt times centring, as a 3 by 3 matrix; angles in degrees."""
    turn, a = math.radians(angle), [math.tan(math.radians(x)) for x in shear]
    cos, sin = scale * math.cos(turn), scale * math.sin(turn)
    parts = [
        [[1, 0, shift[0] * width], [0, 1, shift[1] * height], [0, 0, 1]],
        [[1, a[0], 0], [a[1], 1, 0], [0, 0, 1]],
        [[cos, sin, 0], [-sin, cos, 0], [0, 0, 1]],
        [[1, 0, 0], [0, 1, 0], [tilt[0], tilt[1], 1]],
        [[1, 0, -width / 2], [0, 1, -height / 2], [0, 0, 1]],
    ]
    out = parts[0]
    for m in parts[1:]:
        out = [[sum(r[k] * m[k][j] for k in range(3)) for j in range(3)] for r in out]
    return [[float(x) for x in r] for r in out]


def through(x: Box, m: list[list[float]]) -> Box:
    """The upright box around a box's four corners, each through the matrix."""
    at = lambda u, v: [r[0] * u + r[1] * v + r[2] for r in m]
    points = [at(u, v) for u, v in ((x.a, x.b), (x.c, x.d), (x.a, x.d), (x.c, x.b))]
    xs, ys = [p[0] / p[2] for p in points], [p[1] / p[2] for p in points]
    return Box(F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys))


def utm(lon: Column, lat: Column, zone: int, south: bool) -> tuple[Column, Column]:
    """(easting, northing) on WGS 84, by Krueger's series to the third order in the flattening."""
    a, f = 6378137.0, 1 / 298.257223563
    n = f / (2 - f)
    big = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    k0, e = 0.9996, 2 * math.sqrt(n) / (1 + n)
    phi, lam = F.radians(lat), F.radians(lon - (6 * zone - 183))
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, c in enumerate(alpha, 1):
        east = east + c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500000 + k0 * big * east, (10000000 if south else 0) + k0 * big * north


def utm_sql(places: str, zone: int) -> str:
    """The projection of a SELECT of (c_custkey, lon, lat), southern zone, by the series' published form in SQL."""
    n = 1 / 298.257223563 / (2 - 1 / 298.257223563)
    radius = 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64) * 0.9996
    a = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * math.sqrt(n) / (1 + n)
    east = "eta" + "".join(f" + {c!r}*cos({2 * j}*xi)*sinh({2 * j}*eta)" for j, c in enumerate(a, 1))
    north = "xi" + "".join(f" + {c!r}*sin({2 * j}*xi)*cosh({2 * j}*eta)" for j, c in enumerate(a, 1))
    return f"""WITH p AS ({places}), r AS (SELECT c_custkey, radians(lat) phi, radians(lon - {6 * zone - 183}) lam FROM p), t AS (SELECT *, sinh(atanh(sin(phi)) - {e!r}*atanh({e!r}*sin(phi))) t FROM r),
x AS (SELECT c_custkey, atan2(t, cos(lam)) xi, atanh(sin(lam)/sqrt(1 + t*t)) eta FROM t) SELECT c_custkey, round(500000 + {radius!r}*({east}), 3) easting, round(10000000 + {radius!r}*({north}), 3) northing FROM x"""
