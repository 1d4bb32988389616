"""Queries over tiles, pixels, series and small statistics."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators import raster as R
from tessera.operators.datasets import numbered
from tessera.operators.running import running
from tessera.plans._register import query
from tessera.plans.fixtures import cte, table, view

RASTER = cte("raster")


def rasters(spark, sf):
    return view(spark, sf, "raster").select("raster_id", F.col("width").cast("long").alias("width"), F.col("height").cast("long").alias("height"))


def flat(name, size, step):
    """SQL for starts of windows along both axes."""
    return f"""{RASTER}, r AS (SELECT raster_id, CAST(width AS BIGINT) width, CAST(height AS BIGINT) height FROM raster), gx AS (SELECT r.*, unnest(range(0, width, {step})) x FROM r), {name} AS (SELECT gx.*, unnest(range(0, height, {step})) y FROM gx)"""


@query("tile_grid", flat("g", 500, 500) + " SELECT raster_id, x, y, least(500, width - x) w, least(500, height - y) h FROM g")
def tile_grid(spark, sf):
    """TIL1."""
    return R.tiles(rasters(spark, sf), 500).select("raster_id", "x", "y", "w", "h")


@query("sliding_windows", flat("g", 336, 256) + " SELECT raster_id, CASE WHEN width - x < 336 THEN width - 336 ELSE x END x, CASE WHEN height - y < 336 THEN height - 336 ELSE y END y FROM g")
def sliding_windows(spark, sf):
    """TIL2."""
    return R.sliding_windows(rasters(spark, sf), 336, 256).select("raster_id", "x", "y")


@query("patch_directory", flat("g", 336, 336) + """, t AS (SELECT *, least(336, width - x) w, least(336, height - y) h FROM g) SELECT raster_id, CASE WHEN w < 336 AND w >= 84 AND width >= 336 THEN width - 336 ELSE x END x, CASE WHEN h < 336 AND h >= 84 AND height >= 336 THEN height - 336 ELSE y END y,
  CASE WHEN w < 336 AND w >= 84 AND width >= 336 THEN 336 ELSE w END w, CASE WHEN h < 336 AND h >= 84 AND height >= 336 THEN 336 ELSE h END h FROM t""")
def patch_directory(spark, sf):
    """TIL3, SNK8."""
    return R.patch_windows(rasters(spark, sf), 336).select("raster_id", "x", "y", "w", "h")


@query("full_patches", flat("g", 336, 336) + " SELECT raster_id, x, y FROM g WHERE least(336, width - x) >= 335 AND least(336, height - y) >= 335")
def full_patches(spark, sf):
    """FLT4."""
    return R.tiles(rasters(spark, sf), 336).filter("w >= 335 AND h >= 335").select("raster_id", "x", "y")


@query("inner_windows", f"{RASTER}, r AS (SELECT raster_id, CAST(width AS BIGINT) width, CAST(height AS BIGINT) height FROM raster WHERE width >= 336 AND height >= 336), gx AS (SELECT r.*, unnest(range(0, width - 335, 168)) x FROM r) SELECT raster_id, x, unnest(range(0, height - 335, 168)) y FROM gx")
def inner_windows(spark, sf):
    """TIL5."""
    return R.inner_windows(rasters(spark, sf), 336, 168).select("raster_id", "x", "y")


_AX = "list_transform(range(0, CASE WHEN {n} <= 1024 THEN 1 ELSE CAST(ceil(({n} - 1024)/824e0 + 1) AS BIGINT) END), lambda i: CASE WHEN i > 0 AND i = CAST(ceil(({n} - 1024)/824e0 + 1) AS BIGINT) - 1 AND i*824 + 1024 > {n} THEN {n} - 1024 ELSE i*824 END)"


@query("rated_windows", f"""{RASTER}, r AS (SELECT raster_id, CAST(width AS BIGINT) width, CAST(height AS BIGINT) height FROM raster), gx AS (SELECT *, unnest({_AX.format(n='width')}) x FROM r), g AS (SELECT *, unnest({_AX.format(n='height')}) y FROM gx),
s AS (SELECT *, (least(x+1024,width)-x)*(least(y+1024,height)-y)/1048576e0 share FROM g), b AS (SELECT *, max(share) OVER (PARTITION BY raster_id) best FROM s) SELECT raster_id, x, y, round(share, 8) share FROM b WHERE share > 0.6 OR best <= 0.6 AND share = best""")
def rated_windows(spark, sf):
    """TIL6."""
    return R.rated_windows(rasters(spark, sf), 1024, 200).select("raster_id", "x", "y", F.round("share", 8).alias("share"))


_SEEN = "(SELECT count(*) FROM points p WHERE p.image_id = {0} AND p.px >= {1} AND p.px < {1} + 336 AND p.py >= {2} AND p.py < {2} + 336)"


@query("adaptive_windows", cte("points").replace("WITH ", "WITH RECURSIVE ", 1) + f""", w AS (SELECT image_id, 0 x, 0 y, false crowded, {_SEEN.format('i.image_id', 0, 0)} n FROM (SELECT DISTINCT image_id FROM points) i
UNION ALL SELECT image_id, nx, ny, nc, {_SEEN.format('s.image_id', 's.nx', 's.ny')} FROM (SELECT image_id, CASE WHEN x + step < 640 THEN x + step ELSE 0 END nx, CASE WHEN x + step < 640 THEN y ELSE y + step END ny, n > 30 nc
  FROM (SELECT *, CASE WHEN crowded THEN 67 ELSE 168 END step FROM w) t) s WHERE ny < 640) SELECT image_id raster_id, CAST(x AS BIGINT) x, CAST(y AS BIGINT) y, n FROM w""")
def adaptive_windows(spark, sf):
    """TIL4: one raster for each image."""
    p = view(spark, sf, "points").groupBy(F.col("image_id").alias("raster_id")).agg(F.collect_list(F.struct(F.col("px").alias("x"), F.col("py").alias("y"))).alias("points"))
    return R.adaptive_windows(p.withColumn("width", F.lit(640)).withColumn("height", F.lit(640)))


@query("crop_labels", f"""{cte('gt')}, t AS (SELECT gt_id, cls, image_id, CAST(floor(x1/256) AS BIGINT)*256 wx, CAST(floor(y1/256) AS BIGINT)*256 wy, x1, y1, x2, y2 FROM gt WHERE x1 >= 0 AND y1 >= 0) SELECT gt_id, printf('%d__256__%d___%d', image_id, wx, wy) AS name, round((x1-wx)/256, 6) x1, round((y2-wy)/256, 6) y2 FROM t""")
def crop_labels(spark, sf):
    """TIL7: labels moved into their window and put on its scale."""
    t = view(spark, sf, "gt").filter("x1 >= 0 AND y1 >= 0").withColumn("wx", F.floor(F.col("x1") / 256).cast("long") * 256).withColumn("wy", F.floor(F.col("y1") / 256).cast("long") * 256)
    return t.select("gt_id", F.format_string("%d__256__%d___%d", "image_id", "wx", "wy").alias("name"), F.round((F.col("x1") - F.col("wx")) / 256, 6).alias("x1"), F.round((F.col("y2") - F.col("wy")) / 256, 6).alias("y2"))


@query("collage_places", "SELECT p_partkey, (row_number() OVER (ORDER BY p_partkey) - 1) % 8 AS col, CAST(floor((row_number() OVER (ORDER BY p_partkey) - 1)/8e0) AS BIGINT) AS \"row\" FROM part")
def collage_places(spark, sf):
    """TIL8, TIL9: places of a collage's images, eight in a row."""
    p = numbered(table(spark, sf, "part").select("p_partkey"), ["p_partkey"], "i")
    return p.select("p_partkey", (F.col("i") % 8).alias("col"), F.floor(F.col("i") / 8).alias("row"))


@query("histogram_match", f"""{cte('pixel')}, n AS (SELECT image, channel, value, count(*) n FROM pixel WHERE image < 2 GROUP BY ALL),
c AS (SELECT image, channel, value, CAST(floor(sum(n) OVER (PARTITION BY image, channel ORDER BY value)*255/sum(n) OVER (PARTITION BY image, channel)) AS BIGINT) f FROM n)
SELECT s.channel, s.value, min(r.value) AS matched FROM c s JOIN c r ON s.channel = r.channel AND s.image = 0 AND r.image = 1 AND r.f >= s.f GROUP BY s.channel, s.value""")
def histogram_match(spark, sf):
    """AGG9, AGG17."""
    p = view(spark, sf, "pixel")
    return R.histogram_match(p.filter("image = 0"), p.filter("image = 1"), ["channel"])


@query("percentile_stretch", f"""{cte('pixel')}, q AS (SELECT image, channel, quantile_cont(value, 0.005) lo, quantile_cont(value, 0.995) hi FROM pixel GROUP BY ALL) SELECT image, channel, CAST(floor(greatest(least((value-lo)/greatest(hi-lo,1e-9),1),0)*255) AS INT) stretched, count(*) n FROM pixel JOIN q USING (image, channel) GROUP BY ALL""")
def percentile_stretch(spark, sf):
    """AGG10."""
    return R.percentile_stretch(view(spark, sf, "pixel"), ["image", "channel"]).groupBy("image", "channel", "stretched").agg(F.count("*").alias("n"))


@query("fold_ensemble", f"""{cte('pixel')}, f AS (SELECT channel AS fold, image, px_row, px_col, avg(p0) p FROM pixel GROUP BY ALL), s AS (SELECT *, CASE WHEN max(p) OVER w > 0.05 THEN (p - min(p) OVER w)/(max(p) OVER w - min(p) OVER w) ELSE p END q FROM f WINDOW w AS (PARTITION BY fold, image))
SELECT image, px_row, px_col, round(avg(q), 7) p FROM s GROUP BY ALL HAVING avg(q) > 0.5000001""")
def fold_ensemble(spark, sf):
    """AGG22: folds rescaled per image, averaged, cut at one half."""
    f = view(spark, sf, "pixel").groupBy(F.col("channel").alias("fold"), "image", "px_row", "px_col").agg(F.avg("p0").alias("p"))
    w = W.partitionBy("fold", "image")
    f = f.withColumn("hi", F.max("p").over(w)).withColumn("lo", F.min("p").over(w))
    q = F.when(F.col("hi") > 0.05, (F.col("p") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(F.col("p"))
    return f.groupBy("image", "px_row", "px_col").agg(F.avg(q).alias("p")).filter("p > 0.5000001").select("image", "px_row", "px_col", F.round("p", 7).alias("p"))


@query("overlap_merge", f"{cte('pixel')} SELECT px_row, px_col, max(value) most, min(CASE WHEN value % 7 > 0 THEN value END) least, arg_max(value, struct_pack(a := l_orderkey, b := channel, c := value)) AS last FROM pixel GROUP BY ALL")
def overlap_merge(spark, sf):
    """AGG23: overlapping tiles merged by maximum, by minimum of valid values, by the last written."""
    p = view(spark, sf, "pixel")
    return p.groupBy("px_row", "px_col").agg(F.max("value").alias("most"), F.min(F.when(F.col("value") % 7 > 0, F.col("value"))).alias("least"), F.max_by("value", F.struct("l_orderkey", "channel", "value")).alias("last"))


@query("pixel_metrics", f"""{cte('pixel')}, m AS (SELECT image, sum(CASE WHEN value > 120 AND p0 > 0.05 THEN 1e0 ELSE 0 END) tp, sum(CASE WHEN value <= 120 AND p0 > 0.05 THEN 1e0 ELSE 0 END) fp, sum(CASE WHEN value > 120 AND p0 <= 0.05 THEN 1e0 ELSE 0 END) fn, count(*) n FROM pixel GROUP BY image)
SELECT image, round(tp/(tp+0.5*fp+0.5*fn), 8) tversky, round((n-fp-fn)/n, 8) accuracy, round(tp/(tp+fp+1e-7), 8) AS precision, round(tp/(tp+fn+1e-7), 8) recall FROM m""")
def pixel_metrics(spark, sf):
    """AGG24."""
    on, hit = F.col("value") > 120, F.col("p0") > 0.05
    s = lambda c: F.sum(c.cast("double"))
    m = view(spark, sf, "pixel").groupBy("image").agg(s(on & hit).alias("tp"), s(~on & hit).alias("fp"), s(on & ~hit).alias("fn"), F.count("*").alias("n"))
    c = F.col
    r = lambda x, n: F.round(x, 8).alias(n)
    return m.select("image", r(c("tp") / (c("tp") + 0.5 * c("fp") + 0.5 * c("fn")), "tversky"), r((c("n") - c("fp") - c("fn")) / c("n"), "accuracy"), r(c("tp") / (c("tp") + c("fp") + 1e-7), "precision"), r(c("tp") / (c("tp") + c("fn") + 1e-7), "recall"))


@query("point_mask", f"{cte('points')}, p AS (SELECT image_id, CAST(floor(px) AS BIGINT) x, CAST(floor(py) AS BIGINT) y FROM points), o AS (SELECT unnest(range(-1, 2)) d) SELECT DISTINCT image_id, y + a.d AS \"row\", x + b.d AS col FROM p, o a, o b")
def point_mask(spark, sf):
    """AGG30: squares of 9 pixels around points."""
    p = view(spark, sf, "points").select("image_id", F.floor("px").cast("long").alias("x"), F.floor("py").cast("long").alias("y"))
    d = F.array(*(F.lit(i) for i in (-1, 0, 1)))
    return p.withColumn("dy", F.explode(d)).withColumn("dx", F.explode(d)).select("image_id", (F.col("y") + F.col("dy")).alias("row"), (F.col("x") + F.col("dx")).alias("col")).distinct()


@query("painted_masks", f"""{cte('gt')}, g AS (SELECT image_id, gt_id, row_number() OVER (PARTITION BY image_id ORDER BY (x2-x1)*(y2-y1) DESC, gt_id) k, CAST(floor(x1/16) AS BIGINT) a, CAST(floor(y1/16) AS BIGINT) b, CAST(floor(x2/16) AS BIGINT) c, CAST(floor(y2/16) AS BIGINT) d FROM gt),
x AS (SELECT g.*, unnest(range(a, c+1)) px FROM g), p AS (SELECT *, unnest(range(b, d+1)) py FROM x) SELECT image_id, px, py, max(k) k FROM p GROUP BY ALL""")
def painted_masks(spark, sf):
    """AGG29: larger objects are painted first, so smaller ones win."""
    f = lambda c: F.floor(F.col(c) / 16)
    k = F.row_number().over(W.partitionBy("image_id").orderBy(F.desc((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))), "gt_id"))
    g = view(spark, sf, "gt").withColumn("k", k.cast("long")).withColumn("px", F.explode(F.sequence(f("x1"), f("x2")))).withColumn("py", F.explode(F.sequence(f("y1"), f("y2"))))
    return g.groupBy("image_id", "px", "py").agg(F.max("k").alias("k"))


@query("connected_regions")
def connected_regions(spark, sf):
    """AGG21, FLT13: regions of bright pixels per image."""
    p = view(spark, sf, "pixel").filter("value > 225").select("image", F.col("px_row").alias("row"), F.col("px_col").alias("col"))
    return R.connected_regions(p, ["image"])


@query("sigma_clip", """WITH a AS (SELECT l_extendedprice v FROM lineitem), m1 AS (SELECT avg(v) m, stddev_pop(v) s FROM a), b AS (SELECT v FROM a, m1 WHERE v >= m - 2*s AND v <= m + 2*s), m2 AS (SELECT avg(v) m, stddev_pop(v) s FROM b), c AS (SELECT v FROM b, m2 WHERE v >= m - 2*s AND v <= m + 2*s)
SELECT count(*) n, round(avg(v), 4) mean, round(stddev_pop(v), 4) spread FROM c""")
def sigma_clip(spark, sf):
    """FLT15, AGG31: two rounds, then mean and deviation."""
    c = R.sigma_clip(table(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("v")), "v", rounds=2)
    return c.agg(F.count("*").alias("n"), F.round(F.avg("v"), 4).alias("mean"), F.round(F.stddev_pop("v"), 4).alias("spread"))


EPOCHS = "SELECT CAST(floor(event_id/10e0) AS BIGINT) epoch, round(avg(value), 6) fitness FROM events GROUP BY 1"


def epochs(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy(F.floor(F.col("event_id") / 10).alias("epoch")).agg(F.round(F.avg("value"), 6).alias("fitness"), F.lit(1).alias("run"))


@query("early_stop", f"WITH e AS ({EPOCHS}), b AS (SELECT *, max(fitness) OVER (ORDER BY epoch) best FROM e), l AS (SELECT *, max(CASE WHEN fitness = best THEN epoch END) OVER (ORDER BY epoch) last_best FROM b) SELECT epoch, best, last_best, epoch - last_best >= 20 AS stop FROM l")
def early_stop(spark, sf):
    """AGG27: epochs since the best; ties count as better."""
    b = running(epochs(spark, sf).drop("run"), [], [F.col("epoch")], tops={"top": F.struct("fitness", "epoch")})
    best, last = F.col("top.fitness"), F.col("top.epoch")
    return b.select("epoch", best.alias("best"), last.alias("last_best"), (F.col("epoch") - last >= 20).alias("stop"))


@query("smoothed_series", f"WITH e AS ({EPOCHS}) SELECT a.epoch, round(sum(b.fitness*exp(-power(a.epoch-b.epoch,2)/18e0))/sum(exp(-power(a.epoch-b.epoch,2)/18e0)), 6) AS smooth FROM e a JOIN e b ON abs(a.epoch-b.epoch) <= 12 GROUP BY a.epoch")
def smoothed_series(spark, sf):
    """AGG28: Gaussian weights, sigma 3; each epoch sends its value to its neighbours."""
    e = epochs(spark, sf).withColumn("d", F.explode(F.sequence(F.lit(-12), F.lit(12))))
    weight = F.exp(-F.pow("d", F.lit(2)) / 18)
    near = e.groupBy((F.col("epoch") + F.col("d")).alias("epoch")).agg(F.round(F.sum(F.col("fitness") * weight) / F.sum(weight), 6).alias("smooth"))
    return near.join(epochs(spark, sf).select("epoch"), "epoch", "left_semi")


@query("best_epoch", f"WITH e AS ({EPOCHS}) SELECT arg_min(epoch, struct_pack(f := fitness, e := epoch)) best_epoch, min(fitness) AS loss, min(fitness) < 1 AS retrain FROM e")
def best_epoch(spark, sf):
    """AGG25."""
    return epochs(spark, sf).agg(F.min_by("epoch", F.struct("fitness", "epoch")).alias("best_epoch"), F.min("fitness").alias("loss"), (F.min("fitness") < 1).alias("retrain"))


@query("tune_parents", f"WITH e AS ({EPOCHS}), t AS (SELECT * FROM e ORDER BY fitness DESC, epoch LIMIT 5), w AS (SELECT *, fitness - min(fitness) OVER () + 1e-6 g FROM t) SELECT epoch, round(g/sum(g) OVER (), 6) AS weight FROM w")
def tune_parents(spark, sf):
    """AGG26, MSC5: weights of the best five."""
    t = epochs(spark, sf).orderBy(F.desc("fitness"), "epoch").limit(5)
    w = W.partitionBy("run")  # five rows
    t = t.withColumn("g", F.col("fitness") - F.min("fitness").over(w) + 1e-6)
    return t.select("epoch", F.round(F.col("g") / F.sum("g").over(w), 6).alias("weight"))


@query("linear_fit", "SELECT round(regr_slope(l_extendedprice, l_quantity), 6) slope, round(regr_intercept(l_extendedprice, l_quantity), 4) intercept, round((30000 - regr_intercept(l_extendedprice, l_quantity))/regr_slope(l_extendedprice, l_quantity), 5) AS solved FROM lineitem")
def linear_fit(spark, sf):
    """MSC1: fit, and the input at which the fit reaches a budget."""
    y, x = F.col("l_extendedprice"), F.col("l_quantity")
    s, i = F.regr_slope(y, x), F.regr_intercept(y, x)
    return table(spark, sf, "lineitem").agg(F.round(s, 6).alias("slope"), F.round(i, 4).alias("intercept"), F.round((30000 - i) / s, 5).alias("solved"))


@query("heat_map", f"""{cte('track')}, l AS (SELECT stream_id, max(frame) last FROM track GROUP BY 1) SELECT stream_id, CAST(floor(x/10) AS BIGINT) gx, CAST(floor(y/40) AS BIGINT) gy, round(sum(2*power(0.99e0, last-frame)), 6) heat FROM track JOIN l USING (stream_id) GROUP BY ALL""")
def heat_map(spark, sf):
    """AGG18: heat that fades by a hundredth a frame, in closed form."""
    t = view(spark, sf, "track")
    last = t.groupBy("stream_id").agg(F.max("frame").alias("last"))
    h = t.join(last, "stream_id").groupBy("stream_id", F.floor(F.col("x") / 10).alias("gx"), F.floor(F.col("y") / 40).alias("gy"))
    return h.agg(F.round(F.sum(2 * F.pow(F.lit(0.99), F.col("last") - F.col("frame"))), 6).alias("heat"))


@query("roi_windows", cte("roi") + ', p AS (SELECT category, min(left_x) a, max(left_x+width) b, max(top_y) c, min(top_y-height) d FROM roi GROUP BY category) SELECT category, CAST(floor((a-500000)/0.33) AS BIGINT) col0, CAST(ceil((b-500000)/0.33) AS BIGINT) col1, CAST(floor((9800000-c)/0.33) AS BIGINT) row0, CAST(ceil((9800000-d)/0.33) AS BIGINT) row1 FROM p')
def roi_windows(spark, sf):
    """GEO37: pixel windows around the areas of each category."""
    c = F.col
    p = view(spark, sf, "roi").groupBy("category").agg(F.min("left_x").alias("a"), F.max(c("left_x") + c("width")).alias("b"), F.max("top_y").alias("c"), F.min(c("top_y") - c("height")).alias("d"))
    return p.select("category", F.floor((c("a") - 500000) / 0.33).alias("col0"), F.ceil((c("b") - 500000) / 0.33).alias("col1"), F.floor((9800000 - c("c")) / 0.33).alias("row0"), F.ceil((9800000 - c("d")) / 0.33).alias("row1"))


@query("curve_melt", f"WITH e AS ({EPOCHS}), m AS (SELECT max(epoch) last FROM e), g AS (SELECT k, k*last/99e0 t FROM (SELECT unnest(range(100)) k) u, m) SELECT k, round(a.fitness + (coalesce(b.fitness, a.fitness) - a.fitness)*(t - floor(t)), 6) AS value FROM g JOIN e a ON a.epoch = CAST(floor(t) AS BIGINT) LEFT JOIN e b ON b.epoch = a.epoch + 1")
def curve_melt(spark, sf):
    """MSC2: a curve at 100 even places, as long rows."""
    e = epochs(spark, sf).select("epoch", "fitness")
    last = e.agg(F.max("epoch").alias("last"))
    g = spark.range(100).withColumnRenamed("id", "k").join(F.broadcast(last), F.lit(True)).withColumn("t", F.col("k") * F.col("last") / 99).withColumn("epoch", F.floor("t"))  # one row
    nxt = e.select((F.col("epoch") - 1).alias("epoch"), F.col("fitness").alias("after"))
    at = g.join(e, "epoch").join(nxt, "epoch", "left")
    return at.select("k", F.round(F.col("fitness") + (F.coalesce("after", "fitness") - F.col("fitness")) * (F.col("t") - F.floor("t")), 6).alias("value"))
