import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import shapes as Q
from tessera.sources import vector as V


def shp(kind, bodies):
    recs = b"".join(struct.pack(">2i", i + 1, len(b) // 2) + b for i, b in enumerate(bodies))
    return struct.pack(">i", 9994) + bytes(20) + struct.pack(">i", (100 + len(recs)) // 2) + struct.pack("<2i", 1000, kind) + bytes(64) + recs


def dbf(name, values, width=12):
    head = 32 + 32 + 1
    field = name.encode().ljust(11, b"\0") + b"N" + bytes(4) + bytes([width, 3]) + bytes(14)
    return bytes([3, 24, 1, 1]) + struct.pack("<IHH", len(values), head, width + 1) + bytes(20) + field + b"\r" + b"".join(b" " + f"{v:>{width}}".encode() for v in values)


def test_shapefiles(spark, tmp_path):
    (tmp_path / "p.shp").write_bytes(shp(1, [struct.pack("<i2d", 1, 3.0, 4.0), struct.pack("<i", 0), struct.pack("<i2d", 1, 5.0, 6.0)]))
    (tmp_path / "p.dbf").write_bytes(dbf("Conf", [0.5, 0.1, 0.75]))
    rows = V.points(V.read_shapefile(spark, str(tmp_path / "p.shp"))).collect()
    assert [tuple(r) for r in rows] == [(0, 3.0, 4.0, 0.5), (2, 5.0, 6.0, 0.75)]
    ring = [(0, 0), (0, 2), (2, 2), (2, 0), (0, 0)]
    body = struct.pack("<i4d2i", 5, 0, 0, 2, 2, 1, 5) + struct.pack("<i", 0) + b"".join(struct.pack("<2d", *p) for p in ring)
    (tmp_path / "q.shp").write_bytes(shp(5, [body]))
    (r,) = V.rings(V.read_shapefile(spark, str(tmp_path / "q.shp"))).collect()
    assert [(p.x, p.y) for p in r.ring] == ring[:-1]
    with pytest.raises(ValueError):
        list(V.parse_shapes(b"x" * 200))


def test_windows_of_a_pixel_relation(spark):
    px = spark.range(400).select(F.lit(1).alias("raster_id"), F.floor(F.col("id") / 20).alias("row"), (F.col("id") % 20).alias("col"), F.col("id").alias("value"))
    w = spark.createDataFrame([(1, 0, 3, 4, 6, 5), (1, 1, 15, 15, 10, 10)], "raster_id int, window_id int, x long, y long, w long, h long")
    n = {r.window_id: r["count"] for r in V.window_pixels(px, w, 8).groupBy("window_id").count().collect()}
    assert n == {0: 30, 1: 25}


def test_cache_follows_version_and_fingerprint(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    for version, mark in (("1", "a"), ("1", "a"), ("2", "a"), ("2", "b")):
        assert V.cached(spark, str(tmp_path / "c"), version, mark, make).columns == ["id"]
    assert len(made) == 3


def test_least_rectangles(spark):
    t = 0.4
    turn = np.array([[np.cos(t), -np.sin(t)], [np.sin(t), np.cos(t)]])
    p = (np.array([[-3, -1], [3, -1], [3, 1], [-3, 1], [0, 0]]) @ turn.T) + 5
    cx, cy, w, h, _ = Q.least_rectangle(p)
    assert (cx, cy, *sorted((w, h))) == pytest.approx((5, 5, 2, 6))
    ring = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in p))
    r = spark.range(1).select(Q.rectangles(ring).alias("r")).first().r
    assert sorted((r.w, r.h)) == pytest.approx([2, 6])
    assert Q.least_rectangle(np.zeros((0, 2))) == (0.0,) * 5 and Q.least_rectangle(np.array([[0, 0], [3, 4]]))[2] == 5


def test_share_of_a_polygon_in_a_box(spark):
    tri = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (4, 0), (0, 4))))
    box = [F.lit(v) for v in (0.0, 0.0, 2.0, 2.0)]
    assert spark.range(1).select(Q.share_inside(tri, *box)).first()[0] == pytest.approx(0.5)


def test_contours_and_cleaning(spark):
    square = {(y, x) for y in range(5) for x in range(5)}
    (c,) = Q.contours(square)
    assert len(c) == 16 and set(c) == {(x, y) for y, x in square if y in (0, 4) or x in (0, 4)}
    assert sorted(map(len, Q.contours({(0, 0), (9, 9), (9, 8)}))) == [1, 2]
    holed = [(y, x) for y, x in square if (y, x) != (2, 2)] + [(20, 20)]
    df = spark.createDataFrame([(1, y, x) for y, x in holed], "k long, row long, col long")
    assert {(r.row, r.col) for r in Q.cleaned_masks(df, ["k"], 3).collect()} == square
    assert Q.cleaned_masks(df.filter("row = 20"), ["k"], 3).count() == 1
    assert len(Q.mask_rings(df, ["k"]).first().ring) == 16
    assert len(Q.mask_rings(df, ["k"], "concat").first().ring) == 17


def test_seams():
    a, b = np.array([[0, 0], [4, 0], [4, 4], [0, 4.0]]), np.array([[6, 1], [9, 1], [9, 3.0]])
    assert Q.seam(a, b) == (1, 0)
    assert len(Q.stitched([a, b])) == len(a) + len(b) + 2
    assert Q.point_grid(2) == [(0.25, 0.25), (0.75, 0.25), (0.25, 0.75), (0.75, 0.75)]


def test_registered_functions(spark):
    Q.register(spark)
    assert spark.sql("SELECT tess_iou(0D, 0D, 2D, 2D, 1D, 0D, 3D, 2D)").first()[0] == pytest.approx(1 / 3)
    assert spark.sql("SELECT * FROM tess_tiles(1000, 600, 500)").count() == 4
