"""Queries over box algebra, coordinates and polygons (row-local projections: no shuffle, one scan)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tessera.functions import box as B
from tessera.functions import polygon as P
from tessera.plans._register import query
from tessera.plans.fixtures import cte, view

GT = cte("gt")


@query("box_convert", f"""{GT} SELECT gt_id, round((x1+x2)/2, 6) cx, round((y1+y2)/2, 6) cy, round(x2-x1, 6) w, round(y2-y1, 6) h,
  round(x1, 6) l, round(y1, 6) t, round((x1+x2)/2 - (x2-x1)/2, 6) rx1, round((y1+y2)/2 + (y2-y1)/2, 6) ry2, round(x1 + (x2-x1), 6) lx2, round(y1 + (y2-y1)/2, 6) lcy FROM gt""")
def box_convert(spark, sf):
    """GEO1, GEO2, GEO5: corners, centres and corner-size forms, there and back."""
    x = B.box()
    c = B.xyxy_to_xywh(x)
    lt = B.xywh_to_ltwh(c)
    back, lback, lc = B.xywh_to_xyxy(c), B.ltwh_to_xyxy(B.xyxy_to_ltwh(x)), B.ltwh_to_xywh(lt)
    r = lambda v, n: F.round(v, 6).alias(n)
    return view(spark, sf, "gt").select("gt_id", *c.named("cx", "cy", "w", "h"), r(lt.a, "l"), r(lt.b, "t"), r(back.a, "rx1"), r(back.d, "ry2"), r(lback.c, "lx2"), r(lc.b, "lcy"))


@query("box_normalise", f"""{GT}, c AS (SELECT gt_id, least(greatest(x1,0),639.9) a, least(greatest(y1,0),639.9) b, least(greatest(x2,0),639.9) c, least(greatest(y2,0),639.9) d FROM gt)
SELECT gt_id, round((a+c)/2/640, 8) cx, round((b+d)/2/640, 8) cy, round((c-a)/640, 8) w, round((d-b)/640, 8) h,
  round(((a+c)/2/640 - (c-a)/640/2)*320 + 5, 8) px1, round(((b+d)/2/640 + (d-b)/640/2)*240 + 7, 8) py2 FROM c""")
def box_normalise(spark, sf):
    """GEO3, GEO4: shares of the image (clipped first), and back to pixels of another size with padding."""
    n = B.xyxy_to_xywhn(B.box(), 640.0, 640.0, clipped=True, eps=0.1)
    p = B.xywhn_to_xyxy(n, 320.0, 240.0, 5.0, 7.0)
    return view(spark, sf, "gt").select("gt_id", *n.named("cx", "cy", "w", "h", digits=8), F.round(p.a, 8).alias("px1"), F.round(p.d, 8).alias("py2"))


_G, _PX, _PY = B.letterbox((640, 640), (480.0, 602.0))


@query("box_unletterbox", f"""{GT} SELECT gt_id, round(greatest(least((x1-{_PX})/{_G!r}, 602), 0), 8) x1, round(greatest(least((y1-{_PY})/{_G!r}, 480), 0), 8) y1,
  round(greatest(least((x2-{_PX})/{_G!r}, 602), 0), 8) x2, round(greatest(least((y2-{_PY})/{_G!r}, 480), 0), 8) y2 FROM gt""")
def box_unletterbox(spark, sf):
    """GEO9: boxes of a letterboxed image in the original's pixels; pads round half to even."""
    return view(spark, sf, "gt").select("gt_id", *B.unletterbox(B.box(), (640, 640), (480.0, 602.0)).named("x1", "y1", "x2", "y2", digits=8))


_PADX = (640 - 602.0 * _G) / 2


@query("coords_unletterbox", f"""{GT} SELECT gt_id, round(greatest(least((x1 - {_PADX!r})/{_G!r}, 602), 0)/602, 8) x, round(greatest(least((y1 - {(640 - 480.0 * _G) / 2!r})/{_G!r}, 480), 0)/480, 8) y FROM gt""")
def coords_unletterbox(spark, sf):
    """GEO10: points the same way, with unrounded pads, as shares of the image."""
    x, y = (F.col("x1") - _PADX) / _G, (F.col("y1") - (640 - 480.0 * _G) / 2) / _G
    hold = lambda v, m: F.greatest(F.least(v, F.lit(m)), F.lit(0.0)) / m
    return view(spark, sf, "gt").select("gt_id", F.round(hold(x, 602.0), 8).alias("x"), F.round(hold(y, 480.0), 8).alias("y"))


@query("box_clip", f"{GT} SELECT gt_id, greatest(least(x1,600),0) x1, greatest(least(y1,500),0) y1, greatest(least(x2,600),0) x2, greatest(least(y2,500),0) y2 FROM gt")
def box_clip(spark, sf):
    """GEO8."""
    return view(spark, sf, "gt").select("gt_id", *B.clip(B.box(), 600.0, 500.0).named("x1", "y1", "x2", "y2", digits=None))


@query("box_container", f"""{GT}, s AS (SELECT gt_id, x1*2+3 a, y1*2+4 b, x2*2+3 c, y2*2+4 d FROM gt)
SELECT gt_id, 1300-c fx1, a, 1300-a fx2, 1290-d fy1, 1290-b fy2, (least(c,1000)-least(greatest(a,0),1000))*(least(d,900)-least(greatest(b,0),900)) AS area
FROM s WHERE (least(c,1000)-least(greatest(a,0),1000))*(least(d,900)-least(greatest(b,0),900)) > 0""")
def box_container(spark, sf):
    """GEO19: scale, pad, flip both ways, clip, area, and drop boxes without area."""
    x = B.Box(F.col("x1") * 2 + 3, F.col("y1") * 2 + 4, F.col("x2") * 2 + 3, F.col("y2") * 2 + 4)
    out = view(spark, sf, "gt").select("gt_id", (1300 - x.c).alias("fx1"), x.a.alias("a"), (1300 - x.a).alias("fx2"), (1290 - x.d).alias("fy1"), (1290 - x.b).alias("fy2"), B.area(B.clip(x, 1000.0, 900.0)).alias("area"))
    return out.filter("area > 0")


@query("obb_corners", f"""{cte('obb')} SELECT gt_id, round(cx + w/2*cos(theta) - h/2*sin(theta), 5) x1, round(cy + w/2*sin(theta) + h/2*cos(theta), 5) y1,
  round(cx + w/2*cos(theta) + h/2*sin(theta), 5) x2, round(cy + w/2*sin(theta) - h/2*cos(theta), 5) y2, round(w, 4) rw, round(h, 4) rh FROM obb""")
def obb_corners(spark, sf):
    """GEO6: corners of rotated boxes, and their sizes again from the corners."""
    p = B.obb_corners(*(F.col(c) for c in ("cx", "cy", "w", "h", "theta")))
    _, _, w, h, _ = B.obb_from_corners(p)
    r = lambda v, n, d=5: F.round(v, d).alias(n)
    return view(spark, sf, "obb").select("gt_id", r(p[0][0], "x1"), r(p[0][1], "y1"), r(p[1][0], "x2"), r(p[1][1], "y2"), r(w, "rw", 4), r(h, "rh", 4))


_RING = [("x1", "y1"), ("x2", "y1 + gt_id % 5"), ("x2 - gt_id % 7", "y2"), ("x1 + 3", "y2 - gt_id % 11")]


@query("least_rectangles", f"""{GT}, p AS (SELECT gt_id, [{", ".join(f"{{'x': {x}, 'y': {y}}}" for x, y in _RING)}] r FROM gt), e AS (SELECT gt_id, r, unnest([1,2,3,4]) i FROM p), d AS (SELECT gt_id, r, r[i % 4 + 1].x - r[i].x dx, r[i % 4 + 1].y - r[i].y dy FROM e),
t AS (SELECT gt_id, list_transform(r, lambda q: (q.x*dx + q.y*dy)/sqrt(dx*dx+dy*dy)) u, list_transform(r, lambda q: (q.y*dx - q.x*dy)/sqrt(dx*dx+dy*dy)) v FROM d) SELECT gt_id, round(min((list_max(u)-list_min(u))*(list_max(v)-list_min(v))), 4) AS area FROM t GROUP BY gt_id""")
def least_rectangles(spark, sf):
    """GEO7: the rectangle of least area around a quadrilateral; one of its sides lies along one of the hull's."""
    from tessera.operators import shapes as S

    ring = F.array(*(F.struct(F.expr(x).cast("double").alias("x"), F.expr(y).cast("double").alias("y")) for x, y in _RING))
    r = S.rectangles(ring)
    return view(spark, sf, "gt").withColumn("r", r).select("gt_id", F.round(F.col("r.w") * F.col("r.h"), 4).alias("area"))


@query("results_accessors", f"""{cte('pred')} SELECT det_id, cls, conf, round((x1+x2)/2/640, 8) cxn, round((y1+y2)/2/480, 8) cyn, round(x1/640, 8) x1n, round(y2/480, 8) y2n FROM pred""")
def results_accessors(spark, sf):
    """GEO20: derived views of detections."""
    n = B.xyxy_to_xywhn(B.box(), 640.0, 480.0)
    r = lambda v, k: F.round(v, 8).alias(k)
    return view(spark, sf, "pred").select("det_id", "cls", "conf", r(n.a, "cxn"), r(n.b, "cyn"), r(F.col("x1") / 640, "x1n"), r(F.col("y2") / 480, "y2n"))


@query("probs_top", f"""{cte('raw')} SELECT det_id, greatest(s0,s1,s2) top1_score, CASE WHEN s0 >= s1 AND s0 >= s2 THEN 0 WHEN s1 >= s2 THEN 1 ELSE 2 END top1,
  s0+s1+s2-greatest(s0,s1,s2)-least(s0,s1,s2) AS second FROM raw WHERE s0 <> s1 AND s1 <> s2 AND s0 <> s2""".replace("s0+s1+s2-greatest(s0,s1,s2)-least(s0,s1,s2) AS second", "list_sort([s0,s1,s2])[2] AS second"))
def probs_top(spark, sf):
    """GEO21: best class and the scores in order."""
    s = F.array("s0", "s1", "s2")
    order = F.sort_array(s, asc=False)
    out = view(spark, sf, "raw").filter("s0 <> s1 AND s1 <> s2 AND s0 <> s2")
    return out.select("det_id", F.get(order, 0).alias("top1_score"), (F.array_position(s, F.array_max(s)) - 1).cast("int").alias("top1"), F.get(order, 1).alias("second"))


@query("letterbox_geometry", """WITH r AS (SELECT p_partkey, 300 + p_size*40 w, 300 + p_partkey % 2000 h FROM part), g AS (SELECT *, least(640e0/h, 640e0/w, 1e0) gain FROM r),
u AS (SELECT *, CAST(round_even(w*gain, 0) AS BIGINT) uw, CAST(round_even(h*gain, 0) AS BIGINT) uh FROM g)
SELECT p_partkey, round(gain, 9) gain, uw, uh, ((640-uw) % 32)/2e0 dw, ((640-uh) % 32)/2e0 dh, CAST(round_even(((640-uw) % 32)/2e0 - 0.1, 0) AS BIGINT) pad_left, CAST(round_even(((640-uw) % 32)/2e0 + 0.1, 0) AS BIGINT) pad_right FROM u""")
def letterbox_geometry(spark, sf):
    """GEO22: gain without enlarging, unpadded size, padding modulo the stride and its split."""
    r = view(spark, sf, "raster").withColumnRenamed("raster_id", "p_partkey")
    gain = F.least(640.0 / F.col("height"), 640.0 / F.col("width"), F.lit(1.0))
    u = r.select("p_partkey", gain.alias("gain"), F.rint(F.col("width") * gain).cast("long").alias("uw"), F.rint(F.col("height") * gain).cast("long").alias("uh"))
    dw, dh = ((640 - F.col("uw")) % 32) / 2, ((640 - F.col("uh")) % 32) / 2
    return u.select("p_partkey", F.round("gain", 9).alias("gain"), "uw", "uh", dw.alias("dw"), dh.alias("dh"), F.rint(dw - 0.1).cast("long").alias("pad_left"), F.rint(dw + 0.1).cast("long").alias("pad_right"))


_M = (0.9, 0.2, 5.0, -0.1, 1.1, -3.0)


@query("box_affine", f"""{GT}, t AS (SELECT gt_id, 0.9*x1+0.2*y1+5.0 ax, -0.1*x1+1.1*y1-3.0 ay, 0.9*x2+0.2*y1+5.0 bx, -0.1*x2+1.1*y1-3.0 "by", 0.9*x1+0.2*y2+5.0 cx, -0.1*x1+1.1*y2-3.0 cy, 0.9*x2+0.2*y2+5.0 dx, -0.1*x2+1.1*y2-3.0 dy FROM gt)
SELECT gt_id, round(least(ax,bx,cx,dx), 5) x1, round(least(ay,"by",cy,dy), 5) y1, round(greatest(ax,bx,cx,dx), 5) x2, round(greatest(ay,"by",cy,dy), 5) y2 FROM t""")
def box_affine(spark, sf):
    """GEO23, AUG4: boxes through an affine map."""
    return view(spark, sf, "gt").select("gt_id", *B.affine_box(B.box(), _M).named("x1", "y1", "x2", "y2", digits=5))


@query("box_candidates", f"""{GT}, t AS (SELECT gt_id, x1, y1, x2, y2, least(greatest(x1,0),500) a, least(greatest(y1,0),400) b, least(greatest(x2,0),500) c, least(greatest(y2,0),400) d FROM gt)
SELECT gt_id FROM t WHERE c-a > 2 AND d-b > 2 AND (c-a)*(d-b)/((x2-x1)*(y2-y1)+1e-16) > 0.1 AND greatest((c-a)/((d-b)+1e-16), (d-b)/((c-a)+1e-16)) < 100""")
def box_candidates(spark, sf):
    """GEO24: boxes that are still worth keeping after a crop."""
    return view(spark, sf, "gt").filter(B.box_candidates(B.box(), B.clip(B.box(), 500.0, 400.0))).select("gt_id")


@query("anchor_grid", """WITH l AS (SELECT * FROM (VALUES (8, 80), (16, 40), (32, 20)) v(stride, n))
SELECT stride, i + 0.5e0 AS x, j + 0.5e0 AS y FROM (SELECT l.stride, l.n, unnest(range(l.n)) i FROM l) a, LATERAL (SELECT unnest(range(a.n)) j) b""")
def anchor_grid(spark, sf):
    """GEO25: centres of all cells of each level."""
    levels = spark.createDataFrame([(8, 80), (16, 40), (32, 20)], "stride int, n int")
    cells = levels.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return cells.select("stride", (F.col("i") + 0.5).alias("x"), (F.col("j") + 0.5).alias("y"))


@query("anchor_distances", f"""{GT}, a AS (SELECT *, floor((x1+x2)/16)*8+4 ax, floor((y1+y2)/16)*8+4 ay FROM gt), d AS (SELECT gt_id, ax, ay, least(greatest((ax-x1)/8,0),15.99) l, least(greatest((ay-y1)/8,0),15.99) t, least(greatest((x2-ax)/8,0),15.99) r, least(greatest((y2-ay)/8,0),15.99) b FROM a)
SELECT gt_id, round(l,6) l, round(t,6) t, round(r,6) r, round(b,6) b, round(ax - l*8, 6) x1, round(ay + b*8, 6) y2 FROM d""")
def anchor_distances(spark, sf):
    """GEO26: boxes as clamped distances from an anchor, and back."""
    g = view(spark, sf, "gt").withColumn("ax", F.floor((F.col("x1") + F.col("x2")) / 16) * 8 + 4).withColumn("ay", F.floor((F.col("y1") + F.col("y2")) / 16) * 8 + 4)
    x = B.Box(*((F.col(c)) / 8 for c in ("x1", "y1", "x2", "y2")))
    d = B.bbox_to_dist(F.col("ax") / 8, F.col("ay") / 8, x, 16)
    back = B.dist_to_bbox(F.col("ax") / 8, F.col("ay") / 8, d)
    return g.select("gt_id", *d.named("l", "t", "r", "b"), F.round(back.a * 8, 6).alias("x1"), F.round(back.d * 8, 6).alias("y2"))


@query("crop_boxes", """WITH l AS (SELECT unnest(range(1, 3)) layer), g AS (SELECT layer, CAST(power(2, layer) AS BIGINT) n FROM l), s AS (SELECT layer, n, CAST(floor(0.341e0*480*(2e0/n)) AS BIGINT) o FROM g),
z AS (SELECT layer, n, o, CAST(ceil((o*(n-1)+640)/CAST(n AS DOUBLE)) AS BIGINT) cw, CAST(ceil((o*(n-1)+480)/CAST(n AS DOUBLE)) AS BIGINT) ch FROM s)
SELECT z.layer, i*(cw-o) AS x0, j*(ch-o) AS y0, least(i*(cw-o)+cw, 640) AS x1, least(j*(ch-o)+ch, 480) AS y1 FROM z, LATERAL (SELECT unnest(range(z.n)) i) a, LATERAL (SELECT unnest(range(z.n)) j) b""")
def crop_boxes(spark, sf):
    """GEO27: 4**i overlapping crops in layer i."""
    return P.crop_boxes(spark, 640, 480, layers=2, share=0.341)


@query("crop_edges", f"""{GT} SELECT gt_id, (abs(x1-100) <= 20 AND NOT abs(x1) <= 20) OR (abs(y1-80) <= 20 AND NOT abs(y1) <= 20) OR (abs(x2-500) <= 20 AND NOT abs(x2-640) <= 20) OR (abs(y2-400) <= 20 AND NOT abs(y2-640) <= 20) near_edge,
  CASE WHEN x1 < 20 THEN 0 ELSE x1 END ax1, CASE WHEN x2 > 620 THEN 640 ELSE x2 END ax2 FROM gt""")
def crop_edges(spark, sf):
    """GEO28, GEO29: boxes near a crop's edge that isn't the image's; boxes drawn to the image border."""
    near = F.lit(False)
    for c, crop, image in (("x1", 100, 0), ("y1", 80, 0), ("x2", 500, 640), ("y2", 400, 640)):
        near = near | ((F.abs(F.col(c) - crop) <= 20) & ~(F.abs(F.col(c) - image) <= 20))
    return view(spark, sf, "gt").select("gt_id", near.alias("near_edge"), F.when(F.col("x1") < 20, 0.0).otherwise(F.col("x1")).alias("ax1"), F.when(F.col("x2") > 620, 640.0).otherwise(F.col("x2")).alias("ax2"))


@query("three_point_angle", f"""{GT}, a AS (SELECT gt_id, abs(degrees(atan2(y2-200, x2-300) - atan2(y1-200, x1-300))) t FROM gt) SELECT gt_id, round(CASE WHEN t > 180 THEN 360 - t ELSE t END, 5) angle FROM a""")
def three_point_angle(spark, sf):
    """GEO30."""
    c = F.col
    return view(spark, sf, "gt").select("gt_id", F.round(B.angle(c("x1"), c("y1"), F.lit(300.0), F.lit(200.0), c("x2"), c("y2")), 5).alias("angle"))


@query("centre_distance", f"""{GT} SELECT a.gt_id, b.gt_id other, round(sqrt(power((a.x1+a.x2)/2-(b.x1+b.x2)/2, 2) + power((a.y1+a.y2)/2-(b.y1+b.y2)/2, 2))/10, 6) metres FROM gt a JOIN gt b ON a.image_id = b.image_id AND b.gt_id = a.gt_id + 1""")
def centre_distance(spark, sf):
    """GEO31: distance of consecutive boxes' centres at ten pixels a metre."""
    g = view(spark, sf, "gt").select("image_id", "gt_id", ((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y"))
    h = g.select("image_id", (F.col("gt_id") - 1).alias("gt_id"), F.col("gt_id").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    return g.join(h, ["image_id", "gt_id"]).select("gt_id", "other", F.round(F.sqrt(F.pow(F.col("x") - F.col("ox"), 2) + F.pow(F.col("y") - F.col("oy"), 2)) / 10, 6).alias("metres"))


@query("pixel_crs", f"""{cte('points')} SELECT det_id, round(x, 4) x, round(y, 4) y, CAST(floor((9800000e0 - y)/0.33) AS BIGINT) "row", CAST(floor((x - 500000e0)/0.33) AS BIGINT) col,
  CAST(trunc((x - 500010e0)/0.33) AS BIGINT) cut_col FROM points""")
def pixel_crs(spark, sf):
    """GEO32 to GEO34: pixel to map and back; floors, and truncation toward zero."""
    c = F.col
    return view(spark, sf, "points").select("det_id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), F.floor((9800000.0 - c("y")) / 0.33).cast("long").alias("row"), F.floor((c("x") - 500000.0) / 0.33).cast("long").alias("col"), ((c("x") - 500010.0) / 0.33).cast("long").alias("cut_col"))


@query("polygon_centroid", f"""{cte('obb')} SELECT gt_id, round(cx, 4) cx, round(cy, 4) cy, round(w*h, 3) area FROM obb""")
def polygon_centroid(spark, sf):
    """GEO35: shoelace centroid and area of the rotated boxes as rings."""
    p = B.obb_corners(*(F.col(c) for c in ("cx", "cy", "w", "h", "theta")))
    ring = F.array(*(F.struct(x.alias("x"), y.alias("y")) for x, y in p))
    out = view(spark, sf, "obb").select("gt_id", ring.alias("ring"))
    x, y, area = P.centroid(F.col("ring"))
    return out.select("gt_id", F.round(x, 4).alias("cx"), F.round(y, 4).alias("cy"), F.round(area, 3).alias("area"))


@query("utm_project", P.utm_sql("SELECT c_custkey, 31 + (c_custkey % 50)/25e0 lon, -3 + (c_custkey % 37)/20e0 lat FROM customer", 36))
def utm_project(spark, sf):
    """GEO36: longitude and latitude of customers to UTM zone 36 south, by Krueger's series."""
    from tessera.plans.fixtures import table

    c = table(spark, sf, "customer").select("c_custkey", (31 + F.col("c_custkey") % 50 / 25).alias("lon"), (-3 + F.col("c_custkey") % 37 / 20).alias("lat"))
    e, n = P.utm(F.col("lon"), F.col("lat"), zone=36, south=True)
    return c.select("c_custkey", F.round(e, 3).alias("easting"), F.round(n, 3).alias("northing"))


@query("segment_boxes", f"""{GT} SELECT gt_id, CASE WHEN least(x1,x2) < 0 OR x2 > 640 OR y1 < 0 OR y2 > 640 THEN NULL ELSE x1 END sx1, x1 bx1, y2 by2 FROM gt WHERE x1 >= 0 AND x2 <= 640 AND y1 >= 0 AND y2 <= 640""")
def segment_boxes(spark, sf):
    """GEO11, GEO12: boxes around rings, all points or those inside the image."""
    c = F.col
    ring = F.array(*(F.struct(c(x).alias("x"), c(y).alias("y")) for x, y in (("x1", "y1"), ("x2", "y1"), ("x2", "y2"), ("x1", "y2"))))
    g = view(spark, sf, "gt").filter("x1 >= 0 AND x2 <= 640 AND y1 >= 0 AND y2 <= 640").withColumn("ring", ring)
    inside, around = P.segment_box(c("ring"), 640, 640), P.ring_box(c("ring"))
    return g.select("gt_id", inside.a.alias("sx1"), around.a.alias("bx1"), around.d.alias("by2"))


@query("segment_resample", f"""{GT}, k AS (SELECT unnest(range(9)) k) SELECT gt_id, k, round(CASE WHEN k*0.5 < 1 THEN x1 + (x2-x1)*k*0.5 WHEN k*0.5 < 2 THEN x2 WHEN k*0.5 < 3 THEN x2 - (x2-x1)*(k*0.5-2) ELSE x1 END, 6) x,
  round(CASE WHEN k*0.5 < 1 THEN y1 WHEN k*0.5 < 2 THEN y1 + (y2-y1)*(k*0.5-1) WHEN k*0.5 < 3 THEN y2 ELSE y2 - (y2-y1)*(k*0.5-3) END, 6) y FROM gt, k""")
def segment_resample(spark, sf):
    """GEO13: n points at even index steps along the closed ring."""
    c = F.col
    ring = F.array(*(F.struct(c(x).alias("x"), c(y).alias("y")) for x, y in (("x1", "y1"), ("x2", "y1"), ("x2", "y2"), ("x1", "y2"))))
    out = view(spark, sf, "gt").withColumn("ring", ring).select("gt_id", F.posexplode(P.resample(c("ring"), 9)).alias("k", "p"))
    return out.select("gt_id", F.col("k").cast("long").alias("k"), F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


@query("mask_boxes", f"""{cte('pixel')} SELECT image, channel, min(px_col) x1, min(px_row) y1, max(px_col) x2, max(px_row) y2, count(*) n FROM pixel WHERE value > 200 GROUP BY image, channel""")
def mask_boxes(spark, sf):
    """GEO38: boxes around masks that are pixel relations."""
    p = view(spark, sf, "pixel").filter("value > 200")
    return p.groupBy("image", "channel").agg(F.min("px_col").alias("x1"), F.min("px_row").alias("y1"), F.max("px_col").alias("x2"), F.max("px_row").alias("y2"), F.count("*").alias("n"))


@query("mask_process", f"""{cte('pixel')} SELECT image, px_row, px_col, count(*) n FROM (SELECT image, px_row, px_col, l_orderkey, sum(CASE channel WHEN 1 THEN 2e0 WHEN 2 THEN -1e0 ELSE 0.5e0 END * (p0 - 0.05e0)) z FROM pixel GROUP BY ALL) s
  WHERE 1/(1+exp(-round(z, 9))) > 0.5 AND px_col >= 8 AND px_col < 40 AND px_row >= 4 AND px_row < 60 GROUP BY image, px_row, px_col""")
def mask_process(spark, sf):
    """GEO15, GEO16: prototype values times coefficients, squashed, cropped to a half-open box, cut at one half."""
    z = F.sum(F.when(F.col("channel") == 1, 2.0).when(F.col("channel") == 2, -1.0).otherwise(0.5) * (F.col("p0") - 0.05))
    s = view(spark, sf, "pixel").groupBy("image", "px_row", "px_col", "l_orderkey").agg(z.alias("z"))
    on = (1 / (1 + F.exp(-F.round("z", 9))) > 0.5) & F.col("px_col").between(8, 39) & F.col("px_row").between(4, 59)
    return s.filter(on).groupBy("image", "px_row", "px_col").agg(F.count("*").alias("n"))


@query("name_cleaning", """SELECT p_partkey, regexp_replace(p_name || '|#' || p_type, '[|@#!¡·$€%&()=?¿^*;:,¨´><+]', '_', 'g') AS name, CAST(ceil((p_size*37)/32e0)*32 AS BIGINT) AS size FROM part""")
def name_cleaning(spark, sf):
    """GEO17, GEO18."""
    from tessera.plans.fixtures import table

    p = table(spark, sf, "part")
    return p.select("p_partkey", B.clean_str(F.concat("p_name", F.lit("|#"), "p_type")).alias("name"), B.make_divisible(F.col("p_size") * 37, 32).alias("size"))


@query("logged_boxes", f"""{GT} SELECT gt_id, round(greatest(least((x1-0)/1.25, 512),0), 6) x, round(greatest(least((y1-20)/1.25, 480),0), 6) y, round(greatest(least(x2/1.25,512),0) - greatest(least(x1/1.25,512),0), 6) w, 100*(gt_id % 100)/100e0 score FROM gt""")
def logged_boxes(spark, sf):
    """GEO39: boxes and scores as an experiment log wants them."""
    x = B.Box(*(F.greatest(F.least((F.col(c) - p) / 1.25, F.lit(m)), F.lit(0.0)) for c, p, m in (("x1", 0, 512.0), ("y1", 20, 480.0), ("x2", 0, 512.0), ("y2", 20, 480.0))))
    lt = B.xyxy_to_ltwh(x)
    return view(spark, sf, "gt").select("gt_id", F.round(lt.a, 6).alias("x"), F.round(lt.b, 6).alias("y"), F.round(lt.c, 6).alias("w"), (F.col("gt_id") % 100 / 100 * 100).alias("score"))


@query("flip_labels", f"""{GT} SELECT gt_id, 640-x2 fx1, y1, 640-x1 fx2, y2, 640 - (x1 + 2*(1 - gt_id % 2)) k0x, 640 - (x1 + 2*(gt_id % 2)) k1x FROM gt""")
def flip_labels(spark, sf):
    """AUG5: mirrored boxes and keypoints, the latter renamed by ``flip_idx``."""
    c = F.col
    points = F.array(c("x1") + 2 * (c("gt_id") % 2), c("x1") + 2 * (1 - c("gt_id") % 2))
    flipped = F.transform(F.array(F.lit(1), F.lit(0)), lambda i: 640 - F.get(points, i))
    return view(spark, sf, "gt").select("gt_id", (640 - c("x2")).alias("fx1"), "y1", (640 - c("x1")).alias("fx2"), "y2", F.get(flipped, 0).alias("k0x"), F.get(flipped, 1).alias("k1x"))


@query("hsv_tables", """SELECT CAST(x AS INT) x, CAST(floor(x*1.013e0) AS BIGINT) % 180 hue, CAST(floor(least(greatest(x*1.4e0, 0), 255)) AS INT) sat, CAST(floor(least(greatest(x*0.7e0, 0), 255)) AS INT) val FROM (SELECT unnest(range(256)) x)""")
def hsv_tables(spark, sf):
    """AUG7: look-up tables of 256 rows."""
    x = F.col("id").cast("double")
    level = lambda r: F.floor(F.least(F.greatest(x * r, F.lit(0.0)), F.lit(255.0))).cast("int")
    return spark.range(256).select(F.col("id").cast("int").alias("x"), (F.floor(x * 1.013).cast("long") % 180).alias("hue"), level(1.4).alias("sat"), level(0.7).alias("val"))


@query("mosaic_labels", f"""{GT}, m AS (SELECT image_id, gt_id, cls, x1 + CASE WHEN image_id % 4 IN (1,3) THEN 320 ELSE -320 END x1, y1 + CASE WHEN image_id % 4 >= 2 THEN 320 ELSE -320 END y1, x2 + CASE WHEN image_id % 4 IN (1,3) THEN 320 ELSE -320 END x2, y2 + CASE WHEN image_id % 4 >= 2 THEN 320 ELSE -320 END y2 FROM gt),
c AS (SELECT CAST(floor(image_id/4e0) AS BIGINT) mosaic, gt_id, cls, least(greatest(x1,0),640) x1, least(greatest(y1,0),640) y1, least(greatest(x2,0),640) x2, least(greatest(y2,0),640) y2 FROM m) SELECT * FROM c WHERE (x2-x1)*(y2-y1) > 0""")
def mosaic_labels(spark, sf):
    """AUG2: four images' labels in one frame, clipped, without empty boxes."""
    return P.mosaic(view(spark, sf, "gt"), 640.0)


def _tiles_sql(n):
    """Boxes of ``n`` images in a frame of twice their side: every tile's offset, clipped, without empty ones."""
    places = " ".join(f"WHEN {i} THEN {{}}" for i in range(n))
    dx, dy = (places.format(*(p[k] for p in P.PLACES[n])) for k in (0, 1))
    edge = lambda c, d: f"least(greatest({c} + CASE image_id % {n} {d} END * 640 - 320, 0), 1280)"
    return f"{GT}, m AS (SELECT CAST(floor(image_id/{n}e0) AS BIGINT) mosaic, gt_id, cls, {edge('x1', dx)} x1, {edge('y1', dy)} y1, {edge('x2', dx)} x2, {edge('y2', dy)} y2 FROM gt) SELECT * FROM m WHERE (x2-x1)*(y2-y1) > 0"


@query("mosaic_of_three", _tiles_sql(3))
def mosaic_of_three(spark, sf):
    """AUG2: three images side by side; the outer two are cut at the frame."""
    return P.mosaic_row(view(spark, sf, "gt"), 3, 640.0)


@query("mosaic_of_nine", _tiles_sql(9))
def mosaic_of_nine(spark, sf):
    """AUG2: one image and the eight around it, cut at the frame."""
    return P.mosaic_row(view(spark, sf, "gt"), 9, 640.0)


@query("mixup_labels", f"{GT}, p AS (SELECT image_id, lead(image_id, 1, (SELECT min(image_id) FROM gt)) OVER (ORDER BY image_id) partner FROM (SELECT DISTINCT image_id FROM gt) i) SELECT p.image_id, gt_id, cls, gt.image_id = p.image_id AS own, x1, y1, x2, y2 FROM p JOIN gt ON gt.image_id IN (p.image_id, p.partner)")
def mixup_labels(spark, sf):
    """AUG3: an image's labels and those of the next image, which is blended with it (``P.mixup_ratio`` draws how much)."""
    from tessera.operators.datasets import numbered

    g = view(spark, sf, "gt")
    order = numbered(g.select("image_id").distinct(), ["image_id"])
    return P.mixup(g, order).select("image_id", "gt_id", "cls", "own", "x1", "y1", "x2", "y2")


_TILT = P.perspective_matrix(640, 480, angle=7.0, scale=0.9, shear=(3.0, -2.0), shift=(0.52, 0.47), tilt=(0.0002, -0.0001))
_AT = lambda x, y: tuple(f"(({r[0]!r})*{x} + ({r[1]!r})*{y} + ({r[2]!r}))" for r in _TILT)
_CORNERS = [("x1", "y1"), ("x2", "y2"), ("x1", "y2"), ("x2", "y1")]


@query("perspective_boxes", f"{GT}, p AS (SELECT gt_id, " + ", ".join(f"{_AT(x, y)[0]}/{_AT(x, y)[2]} px{i}, {_AT(x, y)[1]}/{_AT(x, y)[2]} py{i}" for i, (x, y) in enumerate(_CORNERS)) + " FROM gt) SELECT gt_id, round(greatest(least(least(px0,px1,px2,px3),640),0), 5) x1, round(greatest(least(least(py0,py1,py2,py3),480),0), 5) y1, round(greatest(least(greatest(px0,px1,px2,px3),640),0), 5) x2, round(greatest(least(greatest(py0,py1,py2,py3),480),0), 5) y2 FROM p")
def perspective_boxes(spark, sf):
    """AUG4: boxes through the product of centring, tilt, rotation and scale, shear and shift, clipped."""
    x = B.clip(P.through(B.box(), _TILT), 640.0, 480.0)
    return view(spark, sf, "gt").select("gt_id", *x.named("x1", "y1", "x2", "y2", digits=5))


@query("format_labels", f"{cte('obb')} SELECT gt_id, cls, image_id AS batch_idx, round(cx/640, 8) cx, round(cy/480, 8) cy, round(w/640, 8) w, round(h/480, 8) h, round(theta, 8) theta FROM obb")
def format_labels(spark, sf):
    """AUG8: labels as a model takes them: class, box as shares, angle, number in the batch."""
    c = F.col
    r = lambda x, n: F.round(x, 8).alias(n)
    return view(spark, sf, "obb").select("gt_id", "cls", c("image_id").alias("batch_idx"), r(c("cx") / 640, "cx"), r(c("cy") / 480, "cy"), r(c("w") / 640, "w"), r(c("h") / 480, "h"), r("theta", "theta"))


@query("wasserstein_similarity", f"""{GT} SELECT a.gt_id, round(exp(-sqrt(power((a.x1+a.x2-b.x1-b.x2)/2,2) + power((a.y1+a.y2-b.y1-b.y2)/2,2) + (power(a.x2-a.x1-b.x2+b.x1,2) + power(a.y2-a.y1-b.y2+b.y1,2))/4 + 1e-7)/12.8), 8) similarity FROM gt a JOIN gt b ON a.image_id = b.image_id AND b.gt_id = a.gt_id + 1""")
def wasserstein_similarity(spark, sf):
    """MSC6: exp(-W2/12.8) of boxes as Gaussians."""
    g = view(spark, sf, "gt").select("image_id", "gt_id", *B.xyxy_to_xywh(B.box()).named("cx", "cy", "w", "h", digits=None))
    h = g.select("image_id", (F.col("gt_id") - 1).alias("gt_id"), *(F.col(c).alias(f"o{c}") for c in ("cx", "cy", "w", "h")))
    d = lambda c: F.pow(F.col(c) - F.col(f"o{c}"), 2)
    return g.join(h, ["image_id", "gt_id"]).select("gt_id", F.round(F.exp(-F.sqrt(d("cx") + d("cy") + (d("w") + d("h")) / 4 + 1e-7) / 12.8), 8).alias("similarity"))


@query("label_smoothing", "SELECT CAST(eps AS DOUBLE) eps, 1 - 0.5e0*eps positive, 0.5e0*eps negative FROM (VALUES (0.0e0), (0.1e0), (0.2e0)) v(eps)")
def label_smoothing(spark, sf):
    """MSC8."""
    return spark.createDataFrame([(0.0,), (0.1,), (0.2,)], "eps double").select("eps", (1 - 0.5 * F.col("eps")).alias("positive"), (0.5 * F.col("eps")).alias("negative"))


assert math.isclose(4 / math.pi**2, 0.4052847345693511)
