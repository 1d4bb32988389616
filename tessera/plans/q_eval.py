"""Queries over overlap joins, suppression, matching and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import box as B
from tessera.operators import matching as M
from tessera.operators import metrics as E
from tessera.plans._register import query
from tessera.plans.fixtures import cte, view



def sides():
    return B.box("l_"), B.box("r_")


INTER = "greatest(least(l.x2,r.x2)-greatest(l.x1,r.x1),0)*greatest(least(l.y2,r.y2)-greatest(l.y1,r.y1),0)"
AREA = "(({0}.x2-{0}.x1)*({0}.y2-{0}.y1))"
MEET = "l.image_id = r.image_id AND l.x1 < r.x2 AND r.x1 < l.x2 AND l.y1 < r.y2 AND r.y1 < l.y2"
IOU = f"({INTER} / ({AREA.format('l')} + {AREA.format('r')} - {INTER} + 1e-7))"
PAIRS = cte("gt", "pred") + f""", pairs AS (SELECT l.image_id, gt_id, det_id, r.conf, l.cls gt_cls, r.cls det_cls, {IOU} iou FROM gt l JOIN pred r ON {MEET})"""
THR = "(VALUES " + ",".join(f"({t}e0)" for t in E.THRESHOLDS) + ") v(thr)"
MATCH = PAIRS + f""", t AS (SELECT * FROM pairs, {THR} WHERE gt_cls = det_cls AND iou >= thr),
b AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY thr, image_id, det_id ORDER BY iou DESC, gt_id) = 1),
m AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY thr, image_id, gt_id ORDER BY conf DESC, det_id) = 1)"""
CONF = PAIRS + """, b AS (SELECT * FROM pairs WHERE iou > 0.45 QUALIFY row_number() OVER (PARTITION BY image_id, det_id ORDER BY iou DESC, gt_id) = 1),
m AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY image_id, gt_id ORDER BY iou DESC, det_id) = 1)"""


def greedy_sql(rows: str, groups: str, threshold: float, keep: str) -> str:
    """Greedy suppression as a recursion over ranks: a box stays unless one that stayed before overlaps it too much.

    ``rows`` is the WITH list that ends in a relation ``p`` (image_id, det_id, cls, conf, box); ``keep`` is the select list.
    """
    on = " AND ".join(f"l.{g} = r.{g}" for g in groups.split(", "))
    iou = f"({INTER} / ({AREA.format('l')} + {AREA.format('r')} - {INTER}))"
    return f"""{rows.replace("WITH ", "WITH RECURSIVE ", 1)}, rk AS (SELECT *, row_number() OVER (PARTITION BY {groups} ORDER BY conf DESC, det_id) k FROM p),
hits AS (SELECT l.det_id, list(r.det_id) others FROM p l JOIN p r ON {on} AND l.det_id <> r.det_id AND l.x1 < r.x2 AND r.x1 < l.x2 AND l.y1 < r.y2 AND r.y1 < l.y2 AND {iou} > {threshold} GROUP BY l.det_id),
todo AS (SELECT rk.*, coalesce(others, []) others FROM rk LEFT JOIN hits USING (det_id)),
walk AS (SELECT {groups}, CAST(0 AS BIGINT) k, CAST([] AS BIGINT[]) kept FROM p GROUP BY {groups}
  UNION ALL SELECT {", ".join(f"walk.{g}" for g in groups.split(", "))}, t.k, CASE WHEN len(list_intersect(kept, others)) > 0 THEN kept ELSE list_append(kept, det_id) END FROM walk JOIN todo t ON {" AND ".join(f"t.{g} = walk.{g}" for g in groups.split(", "))} AND t.k = walk.k + 1),
done AS (SELECT unnest(arg_max(kept, k)) det_id FROM walk GROUP BY {groups}) SELECT {keep} FROM p JOIN done USING (det_id)"""


def radius_sql(nearest: bool, parity: bool) -> str:
    """Sequential matching as a recursion over truth points: the first free candidate of each."""
    order = "d, f.det_id" if nearest else "f.det_id"
    return cte("gt", "pred").replace("WITH ", "WITH RECURSIVE ", 1) + f""", t AS (SELECT image_id, gt_id, (x1+x2)/2 x, (y1+y2)/2 y, row_number() OVER (PARTITION BY image_id ORDER BY gt_id) k FROM gt), f AS (SELECT image_id, det_id, (x1+x2)/2 x, (y1+y2)/2 y FROM pred),
c AS (SELECT gt_id, list(det_id ORDER BY {order}) near FROM (SELECT t.gt_id, f.det_id, sqrt(power(t.x-f.x,2)+power(t.y-f.y,2)) d FROM t JOIN f ON f.image_id = t.image_id) f WHERE d < 5*sqrt(2) GROUP BY gt_id),
n AS (SELECT image_id, count(*) np FROM f GROUP BY image_id),
w AS (SELECT image_id, CAST(0 AS BIGINT) k, CAST([] AS BIGINT[]) used, CAST(0 AS BIGINT) fn FROM n
  UNION ALL SELECT image_id, k, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick) END, fn + CASE WHEN pick IS NULL AND ({"len(used) < np" if parity else "true"}) THEN 1 ELSE 0 END
  FROM (SELECT w.image_id, t.k, w.used, w.fn, n.np, list_filter(coalesce(c.near, []), lambda x: NOT list_contains(w.used, x))[1] pick FROM w JOIN t ON t.image_id = w.image_id AND t.k = w.k + 1 JOIN n ON n.image_id = w.image_id LEFT JOIN c ON c.gt_id = t.gt_id) s)
SELECT w.image_id, CAST(len(arg_max(used, k)) AS BIGINT) tp, CAST(any_value(np) - len(arg_max(used, k)) AS BIGINT) fp, CAST(max(fn) AS BIGINT) fn FROM w JOIN n USING (image_id) GROUP BY w.image_id"""


_PRIOR = cte("gt", "pred") + """, p AS (SELECT image_id, det_id, cls, conf, x1, y1, x2, y2 FROM pred UNION ALL SELECT image_id, -1 - gt_id, cls, 1e0, x1, y1, x2, y2 FROM gt
UNION ALL SELECT image_id, det_id + 1000000000, cls, conf*0.9e0, x1+1, y1+1, x2+1, y2+1 FROM pred)"""


def pairs(spark, sf):
    return M.pairs_iou(view(spark, sf, "gt"), view(spark, sf, "pred"), ["image_id"], cell=128.0)


@query("iou_join", f"{PAIRS} SELECT image_id, gt_id, det_id, round(iou, 6) iou FROM pairs")
def iou_join(spark, sf):
    """JN1: overlapping pairs per image, found by grid cell so that no image is one key."""
    j = M.overlap_join(view(spark, sf, "gt"), view(spark, sf, "pred"), ["image_id"], cell=128.0)
    return j.select("image_id", F.col("l_gt_id").alias("gt_id"), F.col("r_det_id").alias("det_id"), F.round(B.iou(*sides()), 6).alias("iou"))


@query("ioa_join", f"{cte('gt', 'pred')} SELECT gt_id, det_id, round({INTER}/({AREA.format('r')}+1e-7), 6) ioa FROM gt l JOIN pred r ON {MEET}")
def ioa_join(spark, sf):
    """JN2: intersection over the detection's area."""
    j = M.overlap_join(view(spark, sf, "gt"), view(spark, sf, "pred"), ["image_id"], cell=128.0)
    return j.select(F.col("l_gt_id").alias("gt_id"), F.col("r_det_id").alias("det_id"), F.round(B.ioa(*sides()), 6).alias("ioa"))


@query("iou_family", cte("gt", "pred") + f""", p AS (SELECT gt_id, det_id, l.x2-l.x1 w1, l.y2-l.y1+1e-7 h1, r.x2-r.x1 w2, r.y2-r.y1+1e-7 h2, {INTER} inter,
  greatest(l.x2,r.x2)-least(l.x1,r.x1) cw, greatest(l.y2,r.y2)-least(l.y1,r.y1) ch, (power(r.x1+r.x2-l.x1-l.x2,2)+power(r.y1+r.y2-l.y1-l.y2,2))/4 rho FROM gt l JOIN pred r ON {MEET}),
q AS (SELECT *, w1*h1+w2*h2-inter+1e-7 u, inter/(w1*h1+w2*h2-inter+1e-7) iou, 4/power(pi(),2)*power(atan(w2/h2)-atan(w1/h1),2) v FROM p)
SELECT gt_id, det_id, round(iou,6) iou, round(iou-(cw*ch+1e-7-u)/(cw*ch+1e-7),6) giou, round(iou-rho/(cw*cw+ch*ch+1e-7),6) diou, round(iou-(rho/(cw*cw+ch*ch+1e-7)+v*v/(v-iou+1+1e-7)),6) ciou FROM q""")
def iou_family(spark, sf):
    """JN3."""
    j = M.overlap_join(view(spark, sf, "gt"), view(spark, sf, "pred"), ["image_id"], cell=128.0)
    return j.select(F.col("l_gt_id").alias("gt_id"), F.col("r_det_id").alias("det_id"), *(F.round(v, 6).alias(k) for k, v in B.iou_family(*sides()).items()))


@query("mask_iou", cte("pixel") + """, p AS (SELECT DISTINCT image, channel, px_row, px_col FROM pixel WHERE value > 150), n AS (SELECT image, channel, count(*) n FROM p GROUP BY ALL),
i AS (SELECT a.image, a.channel ca, b.channel cb, count(*) both_on FROM p a JOIN p b ON a.image = b.image AND a.px_row = b.px_row AND a.px_col = b.px_col AND a.channel < b.channel GROUP BY ALL)
SELECT i.image, ca, cb, both_on, round(both_on/(a.n+b.n-both_on+1e-7), 8) iou FROM i JOIN n a ON a.image = i.image AND a.channel = ca JOIN n b ON b.image = i.image AND b.channel = cb""")
def mask_iou(spark, sf):
    """JN4: overlap of masks as pixel relations."""
    p = view(spark, sf, "pixel").filter("value > 150").select("image", "channel", "px_row", "px_col").distinct()
    both = p.withColumnRenamed("channel", "ca").join(p.withColumnRenamed("channel", "cb"), ["image", "px_row", "px_col"]).filter("ca < cb").groupBy("image", "ca", "cb").agg(F.count("*").alias("both_on"))
    n = p.groupBy("image", "channel").agg(F.count("*").alias("n"))
    out = both.join(n.select("image", F.col("channel").alias("ca"), F.col("n").alias("na")), ["image", "ca"]).join(n.select("image", F.col("channel").alias("cb"), F.col("n").alias("nb")), ["image", "cb"])
    return out.select("image", "ca", "cb", "both_on", F.round(F.col("both_on") / (F.col("na") + F.col("nb") - F.col("both_on") + 1e-7), 8).alias("iou"))


#: How far each of the 17 keypoints of a person may be off, in tenths.
SIGMAS = [x / 10 for x in (0.26, 0.25, 0.25, 0.35, 0.35, 0.79, 0.79, 0.72, 0.72, 0.62, 0.62, 1.07, 1.07, 0.87, 0.87, 0.89, 0.89)]
_KPT = lambda s: [(F.col(f"{s}x1") + (F.col(f"{s}x2") - F.col(f"{s}x1")) * (k / 16), F.col(f"{s}y1") + (F.col(f"{s}y2") - F.col(f"{s}y1")) * (k * 5 % 17 / 16)) for k in range(17)]
_OFF = "power(l.{0}1+(l.{0}2-l.{0}1)*{1!r}e0-r.{0}1-(r.{0}2-r.{0}1)*{1!r}e0,2)"
_OKS = "+".join(f"exp(-({_OFF.format('x', k / 16)}+{_OFF.format('y', k * 5 % 17 / 16)})/(power(2*{s!r}e0,2)*({AREA.format('l')}*0.53+1e-7)*2))" for k, s in enumerate(SIGMAS))


@query("keypoint_similarity", cte("gt", "pred") + f" SELECT gt_id, det_id, round(({_OKS})/17, 8) oks FROM gt l JOIN pred r ON {MEET}")
def keypoint_similarity(spark, sf):
    """JN5: object keypoint similarity over seventeen points of each box."""
    j = M.overlap_join(view(spark, sf, "gt"), view(spark, sf, "pred"), ["image_id"], cell=128.0)
    return j.select(F.col("l_gt_id").alias("gt_id"), F.col("r_det_id").alias("det_id"), F.round(M.oks(_KPT("l_"), _KPT("r_"), SIGMAS, B.area(sides()[0]) * 0.53), 8).alias("oks"))


_COV = "SELECT image_id, gt_id, cx, cy, w*w/12*cos(theta)*cos(theta)+h*h/12*sin(theta)*sin(theta) a, w*w/12*sin(theta)*sin(theta)+h*h/12*cos(theta)*cos(theta) b, (w*w/12-h*h/12)*cos(theta)*sin(theta) c FROM obb"
PROB = cte("obb") + f""", g AS ({_COV}), t AS (SELECT l.image_id, l.gt_id, r.gt_id other, l.a+r.a sa, l.b+r.b sb, l.c+r.c sc, l.cx-r.cx dx, l.cy-r.cy dy, greatest(l.a*l.b-l.c*l.c,0) da, greatest(r.a*r.b-r.c*r.c,0) db
  FROM g l JOIN g r ON l.image_id = r.image_id AND l.gt_id < r.gt_id AND abs(l.cx-r.cx) < 40 AND abs(l.cy-r.cy) < 40),
d AS (SELECT *, (sa*dy*dy+sb*dx*dx)/(sa*sb-sc*sc+1e-7)*0.25 + sc*(-dx)*dy/(sa*sb-sc*sc+1e-7)*0.5 + ln((sa*sb-sc*sc)/(4*sqrt(da*db)+1e-7)+1e-7)*0.5 bd FROM t)"""


@query("probiou_pairs", PROB + " SELECT gt_id, other, round(1-sqrt(1-exp(-least(greatest(bd,1e-7),100))+1e-7), 5) similarity FROM d")
def probiou_pairs(spark, sf):
    """JN6: rotated boxes as Gaussians, for pairs of near centres."""
    # centres less than 40 apart both ways: squares of side 40 around them overlap
    around = [(F.col(c) + d).alias(n) for n, c, d in (("x1", "cx", -20), ("y1", "cy", -20), ("x2", "cx", 20), ("y2", "cy", 20))]
    o = view(spark, sf, "obb").select("image_id", "gt_id", "cx", "cy", "w", "h", "theta", *around)
    of = lambda s: tuple(F.col(s + c) for c in ("cx", "cy", "w", "h", "theta"))
    j = M.overlap_join(o, o, ["image_id"], cell=128.0).filter("l_gt_id < r_gt_id")
    return j.select(F.col("l_gt_id").alias("gt_id"), F.col("r_gt_id").alias("other"), F.round(B.probiou(of("l_"), of("r_")), 5).alias("similarity"))


@query("nms_fast", cte("pred") + f" SELECT l.image_id, l.det_id FROM pred l WHERE NOT EXISTS (SELECT 1 FROM pred r WHERE {MEET} AND l.cls = r.cls AND (r.conf > l.conf OR r.conf = l.conf AND r.det_id < l.det_id) AND {IOU} >= 0.5)")
def nms_fast(spark, sf):
    """NMS2 over upright boxes: one anti-join."""
    p = view(spark, sf, "pred")
    return M.fast_nms(p, ["image_id", "cls"], lambda s, t: B.iou(B.box(s), B.box(t)), 0.5, cell=128.0).select("image_id", "det_id")


@query("nms_greedy", greedy_sql(cte("pred") + ", p AS (SELECT * FROM pred WHERE conf > 0.05 AND cls IN (0, 1, 2, 3))", "image_id, cls", 0.45, "image_id, det_id, cls, conf"))
def nms_greedy(spark, sf):
    """NMS1, FLT1, FLT2: confident boxes of some classes, suppressed per image and class."""
    p = view(spark, sf, "pred").filter((F.col("conf") > 0.05) & F.col("cls").isin(0, 1, 2, 3))
    return M.greedy_nms(p, ["image_id", "cls"], 0.45).select("image_id", "det_id", "cls", "conf")


@query("nms_with_priors", greedy_sql(_PRIOR, "image_id, cls", 0.5, "image_id, det_id, cls, conf"))
def nms_with_priors(spark, sf):
    """NMS3, NMS5: labels as detections of score 1 and a second model's boxes join before suppression."""
    p, g = view(spark, sf, "pred"), view(spark, sf, "gt")
    prior = g.select("image_id", (-1 - F.col("gt_id")).alias("det_id"), "cls", F.lit(1.0).alias("conf"), "x1", "y1", "x2", "y2")
    second = p.select("image_id", (F.col("det_id") + 10**9).alias("det_id"), "cls", (F.col("conf") * 0.9).alias("conf"), *((F.col(c) + 1).alias(c) for c in ("x1", "y1", "x2", "y2")))
    return M.greedy_nms(p.unionByName(prior).unionByName(second), ["image_id", "cls"], 0.5).select("image_id", "det_id", "cls", "conf")



_CELL = cte("points") + """, c AS (SELECT image_id, CAST(floor(py/8) AS BIGINT) "row", CAST(floor(px/8) AS BIGINT) col, conf FROM points),
g AS (SELECT CAST(floor("row"/16e0) AS BIGINT) bi, CAST(floor(col/16e0) AS BIGINT) bj, "row", col, count(*) n, max(conf) conf FROM c GROUP BY ALL)"""


@query("grid_local_max", _CELL + """, a AS (SELECT g."row", g.col, any_value(g.n) n, any_value(g.conf) conf, max(o.n) mn, max(o.conf) mc FROM g LEFT JOIN g o ON o.bi = g.bi AND o.bj = g.bj AND abs(o."row"-g."row") <= 1 AND abs(o.col-g.col) <= 1 AND (o."row" <> g."row" OR o.col <> g.col) GROUP BY g."row", g.col)
SELECT "row", col, n, conf FROM a WHERE mn IS NULL OR n > mn OR n = mn AND conf > mc""")
def grid_local_max(spark, sf):
    """NMS6: pixels that beat their eight neighbours of the same block."""
    p = view(spark, sf, "points").select(F.floor(F.col("py") / 8).cast("long").alias("row"), F.floor(F.col("px") / 8).cast("long").alias("col"), "conf")
    return M.grid_local_max(p, block=16)


@query("points_in_areas", cte("points", "roi") + " SELECT p.det_id, r.roi_id, r.category FROM points p JOIN roi r ON x > left_x AND x < left_x + width AND y < top_y AND y > top_y - height")
def points_in_areas(spark, sf):
    """JN9 to JN11: points strictly inside areas, one row for each pair."""
    return M.points_within(view(spark, sf, "points"), F.broadcast(view(spark, sf, "roi"))).select("det_id", "roi_id", "category")  # 25 areas, a fixed table


@query("window_objects", cte("gt") + """, w AS (SELECT i*200 wx, j*200 wy FROM (SELECT unnest(range(4)) i) a, (SELECT unnest(range(4)) j) b)
SELECT gt_id, wx, wy, round(greatest(least(x2,wx+256)-greatest(x1,wx),0)*greatest(least(y2,wy+256)-greatest(y1,wy),0)/((x2-x1)*(y2-y1)), 6) share FROM gt, w
  WHERE greatest(least(x2,wx+256)-greatest(x1,wx),0)*greatest(least(y2,wy+256)-greatest(y1,wy),0)/((x2-x1)*(y2-y1)) >= 0.7""")
def window_objects(spark, sf):
    """JN7, JN8: objects go to every window that holds at least 0.7 of them; windows come from the object, not from a join."""
    c = F.col
    span = lambda lo, hi: F.sequence(F.greatest(F.ceil((c(lo) - 256) / 200), F.lit(0)), F.least(F.floor(c(hi) / 200), F.lit(3)))
    g = view(spark, sf, "gt").filter("x2 >= 0 AND y2 >= 0 AND x1 <= 856 AND y1 <= 856")
    g = g.withColumn("wx", F.explode(F.transform(span("x1", "x2"), lambda i: i * 200))).withColumn("wy", F.explode(F.transform(span("y1", "y2"), lambda i: i * 200)))
    share = B.intersection(B.box(), B.Box(c("wx"), c("wy"), c("wx") + 256, c("wy") + 256)) / B.area(B.box())
    return g.filter(share >= 0.7).select("gt_id", c("wx").cast("long").alias("wx"), c("wy").cast("long").alias("wy"), F.round(share, 6).alias("share"))


@query("tp_matching", f"{MATCH} SELECT thr, image_id, gt_id, det_id, round(iou, 6) iou FROM m")
def tp_matching(spark, sf):
    """JN12."""
    return M.true_positives(pairs(spark, sf), E.THRESHOLDS).select("thr", "image_id", "gt_id", "det_id", F.round("iou", 6).alias("iou"))


@query("optimal_matching")
def optimal_matching(spark, sf):
    """JN13: assignment of largest total overlap per image."""
    return M.optimal_matches(pairs(spark, sf).filter("gt_cls = det_cls"), 0.5, ["image_id"])


def set_sides(spark, sf):
    """Labels and detections of images of nine objects, boxes as shares of 640."""
    c = F.col
    share = [(v / 640).alias(n) for v, n in zip(B.xyxy_to_xywh(B.box()), ("cx", "cy", "w", "h"), strict=True)]
    g = view(spark, sf, "gt").select(F.floor(c("gt_id") / 9).alias("image_id"), "gt_id", "cls", *share)
    scores = F.array(*(F.when(c("cls") == k, c("conf")).otherwise(c("conf") / 4) for k in range(5)))
    return g, view(spark, sf, "pred").select(F.floor(c("det_id") / 18).alias("image_id"), "det_id", scores.alias("scores"), *share)


@query("set_matching")
def set_matching(spark, sf):
    """JN27: one-to-one by class, distance and generalised overlap, at least total cost per image."""
    return M.set_matches(*set_sides(spark, sf), ["image_id"])


@query("confusion_matching", f"{CONF} SELECT image_id, gt_id, det_id, det_cls, gt_cls FROM m")
def confusion_matching(spark, sf):
    """JN14."""
    return M.confusion_matches(pairs(spark, sf)).select("image_id", "gt_id", "det_id", "det_cls", "gt_cls")


_CM = CONF + """, z AS (SELECT det_cls pred_cls, gt_cls FROM m UNION ALL SELECT 5, cls FROM gt WHERE gt_id NOT IN (SELECT gt_id FROM m)
UNION ALL SELECT cls, 5 FROM pred WHERE det_id NOT IN (SELECT det_id FROM m) AND (image_id IN (SELECT image_id FROM m) OR image_id NOT IN (SELECT image_id FROM gt))), c AS (SELECT pred_cls, gt_cls, count(*) n FROM z GROUP BY ALL)"""


def matrix(spark, sf):
    p = pairs(spark, sf)
    return E.confusion_matrix(view(spark, sf, "pred"), view(spark, sf, "gt"), M.confusion_matches(p), background=5)


@query("confusion_matrix", f"{_CM} SELECT CAST(pred_cls AS BIGINT) pred_cls, CAST(gt_cls AS BIGINT) gt_cls, n FROM c")
def confusion_matrix(spark, sf):
    """AGG1."""
    return matrix(spark, sf)


@query("confusion_rates", f"""{_CM} SELECT CAST(k AS BIGINT) cls, CAST(coalesce((SELECT sum(n) FROM c WHERE pred_cls = k AND gt_cls = k), 0) AS BIGINT) tp, CAST(coalesce((SELECT sum(n) FROM c WHERE pred_cls = k AND gt_cls <> k), 0) AS BIGINT) fp,
  round(coalesce((SELECT sum(n) FROM c WHERE pred_cls = k AND gt_cls = k), 0)/((SELECT sum(n) FROM c WHERE gt_cls = k)+1e-9), 8) AS share FROM (SELECT unnest(range(5)) k) t""")
def confusion_rates(spark, sf):
    """AGG3: per class true and false positives, and the diagonal of the column-normalised matrix."""
    m = matrix(spark, sf)
    k = F.explode(F.array(*(F.lit(i).cast("long") for i in range(5)))).alias("cls")
    hit = F.col("pred_cls") == F.col("cls")
    own = F.col("gt_cls") == F.col("cls")
    total = lambda w: F.coalesce(F.sum(F.when(w, F.col("n"))), F.lit(0))
    return m.select("*", k).groupBy("cls").agg(total(hit & own).alias("tp"), total(hit & ~own).alias("fp"), F.round(total(hit & own) / (total(own) + 1e-9), 8).alias("share"))


_CURVE = MATCH + f""", q AS (SELECT thr, cls, det_id, conf FROM pred, {THR}), cu AS (SELECT q.*, sum(CASE WHEN m.det_id IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY q.thr, cls ORDER BY q.conf DESC, q.det_id ROWS UNBOUNDED PRECEDING) tp,
  row_number() OVER (PARTITION BY q.thr, cls ORDER BY q.conf DESC, q.det_id) rk FROM q LEFT JOIN m ON m.thr = q.thr AND m.det_id = q.det_id), ng AS (SELECT cls, count(*) n_gt FROM gt GROUP BY cls)"""
_AP = _CURVE + """, pt AS (SELECT thr, cls, rk, tp/(n_gt+1e-16) r, tp/CAST(rk AS DOUBLE) p FROM cu JOIN ng USING (cls) UNION ALL SELECT DISTINCT thr, cls, 0, 0e0, 1e0 FROM cu UNION ALL SELECT thr, cls, max(rk)+1, 1e0, 0e0 FROM cu GROUP BY thr, cls),
en AS (SELECT thr, cls, rk, r, max(p) OVER (PARTITION BY thr, cls ORDER BY rk DESC) e, lead(r) OVER (PARTITION BY thr, cls ORDER BY rk) r2 FROM pt), ex AS (SELECT *, lead(e) OVER (PARTITION BY thr, cls ORDER BY rk) e2 FROM en),
gr AS (SELECT k, k/100e0 x FROM (SELECT unnest(range(101)) k) t), ay AS (SELECT thr, cls, k, CASE WHEN r2 IS NULL OR r2 = r THEN e ELSE e + (e2-e)*(x-r)/(r2-r) END y FROM gr JOIN ex ON r <= x AND (r2 IS NULL OR x < r2)),
ap AS (SELECT thr, cls, sum(y*CASE WHEN k IN (0,100) THEN 0.005 ELSE 0.01 END) ap FROM ay GROUP BY thr, cls)"""


def curve(spark, sf, threshold):
    tp = M.true_positives(pairs(spark, sf), [threshold])
    return E.precision_recall(view(spark, sf, "pred"), tp, view(spark, sf, "gt"), [threshold])


def areas(spark, sf):
    tp = M.true_positives(pairs(spark, sf), E.THRESHOLDS)
    return E.average_precision(E.wide_curve(view(spark, sf, "pred"), tp, view(spark, sf, "gt"), E.THRESHOLDS), E.THRESHOLDS)


@query("pr_curve", f"{_CURVE} SELECT cls, det_id, CAST(tp AS BIGINT) tp, round(tp/(n_gt+1e-16), 8) recall, round(tp/CAST(rk AS DOUBLE), 8) AS precision FROM cu JOIN ng USING (cls) WHERE thr = 0.5")
def pr_curve(spark, sf):
    """AGG4 at overlap 0.5."""
    return curve(spark, sf, 0.5).select("cls", "det_id", F.col("tp").cast("long").alias("tp"), F.round("recall", 8).alias("recall"), F.round("precision", 8).alias("precision"))


@query("ap_per_class", f"{_AP} SELECT thr, cls, round(ap, 6) ap, n_gt FROM ap JOIN ng USING (cls)")
def ap_per_class(spark, sf):
    """AGG4, AGG5: the flagship: overlap join, matching, curves and areas in one plan."""
    return areas(spark, sf).select("thr", "cls", F.round("ap", 6).alias("ap"), "n_gt")


@query("map_summary", f"""{_AP}, s AS (SELECT avg(CASE WHEN thr = 0.5 THEN ap END) m50, avg(CASE WHEN thr = 0.75 THEN ap END) m75, avg(ap) m FROM ap) SELECT round(m50, 6) map50, round(m75, 6) map75, round(m, 6) map, round(0.1*m50+0.9*m, 6) fitness FROM s""")
def map_summary(spark, sf):
    """AGG7, AGG8."""
    ap = areas(spark, sf)
    at = lambda t: F.avg(F.when(F.col("thr") == t, F.col("ap")))
    s = ap.agg(at(0.5).alias("m50"), at(0.75).alias("m75"), F.avg("ap").alias("m"))
    return s.select(F.round("m50", 6).alias("map50"), F.round("m75", 6).alias("map75"), F.round("m", 6).alias("map"), F.round(0.1 * F.col("m50") + 0.9 * F.col("m"), 6).alias("fitness"))


@query("f1_operating_point", f"""{_CURVE}, f AS (SELECT cls, rk, conf, tp/(n_gt+1e-16) r, tp/CAST(rk AS DOUBLE) p FROM cu JOIN ng USING (cls) WHERE thr = 0.5), g AS (SELECT k, k/100e0 x FROM (SELECT unnest(range(101)) k) t),
bb AS (SELECT k, cls, max(rk) rk FROM g JOIN f ON f.conf >= x GROUP BY ALL), mm AS (SELECT k, sum(2*p*r/(p+r+1e-16))/5 f1 FROM bb JOIN f USING (cls, rk) GROUP BY k), z AS (SELECT g.k, coalesce(f1, 0) f1 FROM g LEFT JOIN mm USING (k)),
s AS (SELECT k, avg(f1) OVER (ORDER BY k ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) f1 FROM z) SELECT k/100e0 AS conf, round(f1, 6) f1 FROM s ORDER BY round(f1, 9) DESC, k LIMIT 1""")
def f1_operating_point(spark, sf):
    """AGG6: the confidence at which the mean F1 of the classes, smoothed, is best; on a grid of hundredths."""
    from pyspark.sql import Window as W

    c = F.col
    z = E.best_confidence(curve(spark, sf, 0.5), 5).withColumn("one", F.lit(0))
    s = z.select("k", F.avg("f1").over(W.partitionBy("one").orderBy("k").rowsBetween(-5, 5)).alias("f1"))  # 101 rows
    return s.orderBy(F.desc(F.round("f1", 9)), "k").limit(1).select((c("k") / 100).alias("conf"), F.round("f1", 6).alias("f1"))


@query("class_accuracy", cte("raw") + """, t AS (SELECT cls, CASE WHEN s0 >= s1 AND s0 >= s2 THEN 0 WHEN s1 >= s2 THEN 1 ELSE 2 END p, s0, s1, s2 FROM raw WHERE cls < 3)
SELECT CAST(cls AS BIGINT) cls, CAST(p AS BIGINT) AS pred, count(*) n, round(avg(CASE WHEN cls = p THEN 1e0 ELSE 0 END), 8) top1 FROM t GROUP BY cls, p""")
def class_accuracy(spark, sf):
    """AGG2, AGG8: classification confusion and accuracy of the best class."""
    s = F.array("s0", "s1", "s2")
    t = view(spark, sf, "raw").filter("cls < 3").select(F.col("cls").cast("long").alias("cls"), (F.array_position(s, F.array_max(s)) - 1).cast("long").alias("pred"))
    return t.groupBy("cls", "pred").agg(F.count("*").alias("n"), F.round(F.avg((F.col("cls") == F.col("pred")).cast("double")), 8).alias("top1"))


def _points(spark, sf):
    g = view(spark, sf, "gt").select("image_id", F.col("gt_id").alias("id"), ((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y"))
    p = view(spark, sf, "pred").select("image_id", F.col("det_id").alias("id"), ((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y"))
    return g, p


@query("radius_accuracy", radius_sql(nearest=False, parity=True))
def radius_accuracy(spark, sf):
    """JN15: sequential matching within a radius, per image."""
    return M.radius_matches(*_points(spark, sf), ["image_id"], 5.0)


@query("radius_accuracy_nearest", radius_sql(nearest=True, parity=False))
def radius_accuracy_nearest(spark, sf):
    """JN16: the same with the nearest free point."""
    return M.radius_matches(*_points(spark, sf), ["image_id"], 5.0, nearest=True, parity=False)


@query("accuracy_rollup", f"""{CONF}, h AS (SELECT image_id, count(*) tp FROM m GROUP BY 1), a AS (SELECT g.image_id, g.image_id % 3 AS category, coalesce(tp, 0) tp, np - coalesce(tp, 0) fp, n - coalesce(tp, 0) fn FROM (SELECT image_id, count(*) n FROM gt GROUP BY 1) g JOIN (SELECT image_id, count(*) np FROM pred GROUP BY 1) p USING (image_id) LEFT JOIN h USING (image_id))
SELECT coalesce(category, -1) category, CAST(sum(tp) AS BIGINT) tp, CAST(sum(fp) AS BIGINT) fp, CAST(sum(fn) AS BIGINT) fn, round(sum(tp)/(sum(tp)+sum(fp)+1e-7), 8) AS precision, round(sum(tp)/(sum(tp)+sum(fn)+1e-7), 8) recall, CAST(sum(CASE WHEN fp > 10 OR fn > 10 THEN 1 ELSE 0 END) AS BIGINT) bad_grids FROM a GROUP BY ROLLUP(category)""")
def accuracy_rollup(spark, sf):
    """AGG15, FLT10: per category and in total."""
    m = M.confusion_matches(pairs(spark, sf)).groupBy("image_id").agg(F.count("*").alias("tp"))
    g = view(spark, sf, "gt").groupBy("image_id").agg(F.count("*").alias("n"))
    p = view(spark, sf, "pred").groupBy("image_id").agg(F.count("*").alias("np"))
    tp = F.coalesce(F.col("tp"), F.lit(0))
    a = g.join(p, "image_id").join(m, "image_id", "left").select((F.col("image_id") % 3).alias("category"), tp.alias("tp"), (F.col("np") - tp).alias("fp"), (F.col("n") - tp).alias("fn"))
    s = lambda c: F.sum(c)
    out = a.rollup("category").agg(s("tp").alias("tp"), s("fp").alias("fp"), s("fn").alias("fn"), F.sum(((F.col("fp") > 10) | (F.col("fn") > 10)).cast("long")).alias("bad_grids"))
    return out.select(F.coalesce("category", F.lit(-1)).alias("category"), "tp", "fp", "fn", F.round(F.col("tp") / (F.col("tp") + F.col("fp") + 1e-7), 8).alias("precision"), F.round(F.col("tp") / (F.col("tp") + F.col("fn") + 1e-7), 8).alias("recall"), "bad_grids")


@query("fused_scores", f"{PAIRS} SELECT gt_id, det_id, round(1 - iou*conf, 6) AS cost FROM pairs")
def fused_scores(spark, sf):
    """JN18: association cost of overlap and score."""
    return pairs(spark, sf).select("gt_id", "det_id", F.round(1 - F.col("iou") * F.col("conf"), 6).alias("cost"))


@query("prompt_boxes", f"{PAIRS} SELECT gt_id, max(iou) >= 0.9 AS close, CAST(sum(CASE WHEN iou > 0.9 THEN 1 ELSE 0 END) AS BIGINT) n_close, arg_max(det_id, struct_pack(a := iou, b := -det_id)) det_id FROM pairs GROUP BY gt_id")
def prompt_boxes(spark, sf):
    """JN24, JN25: the detection that a box prompt picks, and how many overlap it by more than 0.9."""
    p = pairs(spark, sf).groupBy("gt_id").agg((F.max("iou") >= 0.9).alias("close"), F.sum((F.col("iou") > 0.9).cast("long")).alias("n_close"), F.max_by("det_id", F.struct("iou", -F.col("det_id"))).alias("det_id"))
    return p


@query("task_assignment", cte("gt", "pred") + f""", a AS (SELECT l.image_id, gt_id, det_id, power(r.conf, 1) * power({IOU}, 6) AS metric, {IOU} iou FROM gt l JOIN pred r ON {MEET} WHERE (r.x1+r.x2)/2 > l.x1 AND (r.x1+r.x2)/2 < l.x2 AND (r.y1+r.y2)/2 > l.y1 AND (r.y1+r.y2)/2 < l.y2),
t AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY gt_id ORDER BY round(metric, 9) DESC, det_id) <= 3) SELECT det_id, gt_id, round(iou, 6) iou FROM t QUALIFY row_number() OVER (PARTITION BY det_id ORDER BY round(iou, 9) DESC, gt_id) = 1""")
def task_assignment(spark, sf):
    """JN26: anchors inside a label, the best three by score times overlap, conflicts to the larger overlap."""
    from pyspark.sql import Window as W

    c = F.col
    j = M.overlap_join(view(spark, sf, "gt"), view(spark, sf, "pred"), ["image_id"], cell=128.0)
    x, y = (c("r_x1") + c("r_x2")) / 2, (c("r_y1") + c("r_y2")) / 2
    j = j.filter((x > c("l_x1")) & (x < c("l_x2")) & (y > c("l_y1")) & (y < c("l_y2")))
    a = j.select(c("l_gt_id").alias("gt_id"), c("r_det_id").alias("det_id"), c("r_conf").alias("conf"), B.iou(*sides()).alias("iou")).withColumn("metric", c("conf") * F.pow("iou", F.lit(6)))
    t = a.withColumn("k", F.row_number().over(W.partitionBy("gt_id").orderBy(F.desc(F.round("metric", 9)), "det_id"))).filter("k <= 3")
    one = t.withColumn("k", F.row_number().over(W.partitionBy("det_id").orderBy(F.desc(F.round("iou", 9)), "gt_id"))).filter("k = 1")
    return one.select("det_id", "gt_id", F.round("iou", 6).alias("iou"))


@query("edge_filter", cte("pred") + ", d AS (SELECT *, x1*0.53 a, y1*0.53 b, x1*0.53 + (x2-x1)*0.26 c, y1*0.53 + (y2-y1)*0.26 d FROM pred), k AS (SELECT * FROM d WHERE a > 2 AND b > 2 AND c < 334 AND d < 334 AND c-a <= 10 AND d-b <= 10) SELECT image_id, det_id FROM k QUALIFY count(*) OVER (PARTITION BY image_id) > 1")
def edge_filter(spark, sf):
    """FLT3: small detections off the window's edge, of windows with more than one."""
    from pyspark.sql import Window as W

    c = F.col
    d = view(spark, sf, "pred").select("image_id", "det_id", (c("x1") * 0.53).alias("a"), (c("y1") * 0.53).alias("b"), (c("x1") * 0.53 + (c("x2") - c("x1")) * 0.26).alias("c"), (c("y1") * 0.53 + (c("y2") - c("y1")) * 0.26).alias("d"))
    k = d.filter("a > 2 AND b > 2 AND c < 334 AND d < 334 AND c - a <= 10 AND d - b <= 10")
    return k.withColumn("n", F.count("*").over(W.partitionBy("image_id"))).filter("n > 1").select("image_id", "det_id")


@query("stable_masks", cte("pixel") + " SELECT image, channel, count(*) n, round(sum(CASE WHEN value > 110 THEN 1e0 ELSE 0 END)/sum(CASE WHEN value > 90 THEN 1 ELSE 0 END), 8) stability FROM pixel GROUP BY ALL HAVING sum(CASE WHEN value > 110 THEN 1e0 ELSE 0 END)/sum(CASE WHEN value > 90 THEN 1 ELSE 0 END) > 0.8")
def stable_masks(spark, sf):
    """FLT12: masks whose size hardly depends on the threshold."""
    n = lambda v: F.sum((F.col("value") > v).cast("long"))
    return view(spark, sf, "pixel").groupBy("image", "channel").agg(F.count("*").alias("n"), (n(110) / n(90)).alias("s")).filter("s > 0.8").select("image", "channel", "n", F.round("s", 8).alias("stability"))


@query("best_class_filter", cte("raw") + " SELECT det_id, CASE WHEN s0 >= s1 AND s0 >= s2 THEN 0 WHEN s1 >= s2 THEN 1 ELSE 2 END cls, greatest(s0,s1,s2) score FROM raw WHERE greatest(s0,s1,s2) > 0.25 AND CASE WHEN s0 >= s1 AND s0 >= s2 THEN 0 WHEN s1 >= s2 THEN 1 ELSE 2 END IN (0, 2)")
def best_class_filter(spark, sf):
    """FLT14: best class above a score, some classes, no suppression."""
    s = F.array("s0", "s1", "s2")
    out = view(spark, sf, "raw").select("det_id", (F.array_position(s, F.array_max(s)) - 1).cast("int").alias("cls"), F.array_max(s).alias("score"))
    return out.filter((F.col("score") > 0.25) & F.col("cls").isin(0, 2))


_PASSES = [(0, 1.0, False), (1, 0.83, True), (2, 0.67, False)]


@query("augmented_detections", cte("pred") + " SELECT det_id, k, round(x1, 5) x1, round(y1, 5) y1, round(x2, 5) x2, round(y2, 5) y2 FROM pred, (SELECT unnest([0, 1, 2]) k) t")
def augmented_detections(spark, sf):
    """NMS5: detections of three passes, at scales 1, 0.83 (mirrored) and 0.67, back on the image's own scale, one below the other."""
    p, out = view(spark, sf, "pred").select("det_id", "x1", "y1", "x2", "y2"), None
    for k, scale, mirrored in _PASSES:
        x = ("640 - x2", "640 - x1") if mirrored else ("x1", "x2")
        seen = p.select("det_id", *(F.expr(f"({e}) * {scale}D").alias(n) for e, n in zip((x[0], "y1", x[1], "y2"), ("x1", "y1", "x2", "y2"), strict=True)))
        back = M.descaled(seen, scale, mirrored, 640.0).select("det_id", F.lit(k).alias("k"), *(F.round(c, 5).alias(c) for c in ("x1", "y1", "x2", "y2")))
        out = back if out is None else out.unionByName(back)
    return out
