"""Queries over annotation ETL: parsing, verification, statistics, splits, conversions and sink formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import datasets as D
from tessera.plans._register import query
from tessera.plans.fixtures import cte, table, view
from tessera.sources import labels as S
from tessera.sources import sinks as K

GT, PRED = cte("gt"), cte("pred")
NAMES = {0: "person", 1: "dog", 2: "cat", 3: "car", 4: "bus"}


def names():
    return F.create_map(*(F.lit(x) for kv in NAMES.items() for x in kv))


_NAME = "CASE cls WHEN 0 THEN 'person' WHEN 1 THEN 'dog' WHEN 2 THEN 'cat' WHEN 3 THEN 'car' ELSE 'bus' END"
#: Label texts made from the boxes: some classes out of range, some rows short, negative or repeated.
LINES = GT + """, ll AS (SELECT image_id, gt_id, cls + CASE WHEN gt_id % 97 = 5 THEN 9 ELSE 0 END k, (x1+x2)/2/640 a, (y1+y2)/2/640 b, (x2-x1)/640 c, (y2-y1)/640 d, gt_id % 89 = 3 short FROM gt WHERE x1 > -15)"""


def lines(spark, sf):
    c = F.col
    g = view(spark, sf, "gt").filter("x1 > -15")
    k = c("cls") + F.when(c("gt_id") % 97 == 5, 9).otherwise(0)
    four = F.concat_ws(" ", *(F.format_string("%.8f", x) for x in ((c("x1") + c("x2")) / 2 / 640, (c("y1") + c("y2")) / 2 / 640, (c("x2") - c("x1")) / 640, (c("y2") - c("y1")) / 640)))
    return g.select(c("image_id").alias("file"), "gt_id", F.concat(F.lit("  "), k.cast("string"), F.lit(" "), F.when(c("gt_id") % 89 == 3, "0.5").otherwise(four), F.lit(" ")).alias("value"))


@query("label_parse", LINES + " SELECT image_id AS file, gt_id, CAST(k AS INT) cls, CASE WHEN short THEN 0.5 ELSE round(a, 8) END cx, CASE WHEN short THEN NULL ELSE round(d, 8) END h FROM ll")
def label_parse(spark, sf):
    """SRC7: tokens of label lines."""
    p = S.parse_labels(lines(spark, sf))
    return p.select("file", "gt_id", "cls", F.col("box.cx").alias("cx"), F.col("box.h").alias("h"))


@query("label_verify", LINES + """, w AS (SELECT image_id, CASE WHEN short THEN 1 ELSE 0 END bad, CASE WHEN NOT short AND a > 1 OR NOT short AND b > 1 THEN 1 ELSE 0 END high, CASE WHEN NOT short AND (a < 0 OR b < 0) THEN 1 ELSE 0 END low, CASE WHEN k > 5 THEN 1 ELSE 0 END far FROM ll)
SELECT image_id AS file, CASE WHEN sum(bad)+sum(high)+sum(low)+sum(far) = 0 THEN 'found' ELSE 'corrupt' END status, count(*) n FROM w GROUP BY image_id""")
def label_verify(spark, sf):
    """FLT6, AGG13: each file's first complaint; classes up to nc pass, as the count goes from 1."""
    return S.verify_labels(S.parse_labels(lines(spark, sf)), 5).select("file", "status", "n")


@query("label_dedupe", GT + " SELECT DISTINCT cls, CAST(floor(x1/64) AS BIGINT) gx, CAST(floor(y1/64) AS BIGINT) gy FROM gt")
def label_dedupe(spark, sf):
    """FLT7: rows without repeats."""
    return view(spark, sf, "gt").select("cls", F.floor(F.col("x1") / 64).alias("gx"), F.floor(F.col("y1") / 64).alias("gy")).dropDuplicates()


@query("label_paths", "SELECT p_partkey, 'data/images/' || p_partkey || '/labels/img.' || p_partkey || '.txt' AS label, 'jpg' AS ext, 'img.' || p_partkey AS stem FROM part")
def label_paths(spark, sf):
    """SRC8, JN23: label path, extension and stem of image paths."""
    k = F.col("p_partkey").cast("string")
    p = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("data/images/"), k, F.lit("/images/img."), k, F.lit(".JPG")).alias("path"))
    return p.select("p_partkey", S.label_path(F.col("path")).alias("label"), S.extension(F.col("path")).alias("ext"), S.stem(F.col("path")).alias("stem"))


@query("image_label_pairs", GT + ", i AS (SELECT image_id FROM gt UNION SELECT image_id + 5 FROM gt) SELECT i.image_id, count(gt_id) n, count(gt_id) = 0 AS missing FROM i LEFT JOIN gt ON gt.image_id = i.image_id GROUP BY i.image_id")
def image_label_pairs(spark, sf):
    """JN19, JN20: images with their labels by key; an image may have none, as the five after the last."""
    g = view(spark, sf, "gt").select("image_id", "gt_id")
    i = g.select("image_id").union(g.select(F.col("image_id") + 5)).distinct()
    j = i.join(g, "image_id", "left")
    return j.groupBy("image_id").agg(F.count("gt_id").alias("n"), (F.count("gt_id") == 0).alias("missing"))


@query("dataset_stats", GT + ", c AS (SELECT unnest(range(7)) cls) SELECT c.cls, count(gt_id) instances, count(DISTINCT image_id) images FROM c LEFT JOIN gt ON gt.cls = c.cls GROUP BY c.cls")
def dataset_stats(spark, sf):
    """AGG11, AGG20, SNK13: instances and images of each class, zeros included."""
    return D.class_statistics(view(spark, sf, "gt"), 7)


@query("box_segment_counts", GT + " SELECT image_id, count(*) boxes, CAST(sum(CASE WHEN gt_id % 10 > 0 THEN 1 ELSE 0 END) AS BIGINT) segments, count(*) <> sum(CASE WHEN gt_id % 10 > 0 THEN 1 ELSE 0 END) AS mixed FROM gt GROUP BY image_id")
def box_segment_counts(spark, sf):
    """AGG14: whether boxes and segments are as many."""
    s = F.sum((F.col("gt_id") % 10 > 0).cast("long"))
    return view(spark, sf, "gt").groupBy("image_id").agg(F.count("*").alias("boxes"), s.alias("segments"), (F.count("*") != s).alias("mixed"))


@query("label_hist2d", GT + " SELECT cls, least(greatest(CAST(floor((x1+x2)/2/12.8) AS INT), 0), 49) bx, least(greatest(CAST(floor((y1+y2)/2/12.8) AS INT), 0), 49) \"by\", count(*) n FROM gt GROUP BY ALL")
def label_hist2d(spark, sf):
    """AGG16: centres in 50 by 50 bins."""
    b = lambda u, v: F.least(F.greatest(F.floor((F.col(u) + F.col(v)) / 2 / 12.8).cast("int"), F.lit(0)), F.lit(49))
    return view(spark, sf, "gt").groupBy("cls", b("x1", "x2").alias("bx"), b("y1", "y2").alias("by")).agg(F.count("*").alias("n"))


@query("said_counts", PRED + f", n AS (SELECT image_id, cls, count(*) n FROM pred WHERE conf > 0.5 GROUP BY ALL) SELECT image_id, string_agg(n || ' ' || {_NAME} || CASE WHEN n > 1 THEN 's' ELSE '' END, ', ' ORDER BY cls) said FROM n GROUP BY image_id")
def said_counts(spark, sf):
    """AGG12, AGG19."""
    return D.count_phrases(view(spark, sf, "pred").filter("conf > 0.5"), names())


@query("rect_batches", """WITH i AS (SELECT p_partkey image_id, 300 + p_size*40 w, 300 + p_partkey % 2000 h FROM part), r AS (SELECT *, h/w ar, row_number() OVER (ORDER BY h/w, image_id) - 1 k FROM (SELECT image_id, CAST(w AS DOUBLE) w, CAST(h AS DOUBLE) h FROM i) j),
b AS (SELECT CAST(floor(k/16e0) AS BIGINT) batch, min(ar) lo, max(ar) hi FROM r GROUP BY 1) SELECT image_id, batch, CAST(ceil(CASE WHEN hi < 1 THEN hi ELSE 1 END*640/32 + 0.5)*32 AS BIGINT) h, CAST(ceil(CASE WHEN hi >= 1 AND lo > 1 THEN 1/lo ELSE 1 END*640/32 + 0.5)*32 AS BIGINT) w FROM r JOIN b ON batch = CAST(floor(k/16e0) AS BIGINT)""")
def rect_batches(spark, sf):
    """ORD2."""
    i = view(spark, sf, "raster").select(F.col("raster_id").alias("image_id"), F.col("width").cast("double").alias("width"), F.col("height").cast("double").alias("height"))
    return D.rect_batches(i, 16, 640, 32, 0.5)


HASH = "CAST('0x' || substr(md5({0} || '/{1}'), 1, 8) AS BIGINT)"


@query("kfold_split", f"SELECT c_custkey, CAST({HASH.format('c_custkey', 3)} % 5 AS INT) AS fold FROM customer")
def kfold_split(spark, sf):
    """ORD3 by hash: folds of customers."""
    return D.kfold_by_hash(table(spark, sf, "customer").select("c_custkey"), "c_custkey")


@query("autosplit", f"SELECT p_partkey, CASE WHEN {HASH.format('p_partkey', 0)} % 1000000 < 800000 THEN 'train' WHEN {HASH.format('p_partkey', 0)} % 1000000 < 950000 THEN 'val' ELSE 'test' END AS split FROM part")
def autosplit(spark, sf):
    """ORD4, SNK11 by hash, in shares of 0.8, 0.15 and 0.05."""
    return D.autosplit_by_hash(table(spark, sf, "part").select("p_partkey"), "p_partkey", (0.8, 0.15, 0.05))


@query("whole_batches", "WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 k, count(*) OVER () n FROM orders) SELECT o_orderkey, CAST(floor(k/64e0) AS BIGINT) batch FROM r WHERE floor(k/64e0) < floor(n/64e0)")
def whole_batches(spark, sf):
    """ORD6, CNV12: batches of 64, the last incomplete one dropped."""
    o = D.numbered(table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"])
    full = o.groupBy(F.floor(F.col("rank") / 64).alias("batch")).agg(F.count("*").alias("n")).filter("n = 64").select("batch")
    return o.select("o_orderkey", F.floor(F.col("rank") / 64).alias("batch")).join(full, "batch", "left_semi").select("o_orderkey", "batch")


def _coco(spark, sf):
    g = view(spark, sf, "gt")
    images = g.select(F.col("image_id").alias("id")).distinct().select("id", F.format_string("%06d.jpg", "id").alias("file_name"), F.lit(640.0).alias("width"), F.lit(480.0).alias("height"))
    a = g.select("image_id", (F.col("cls") + 1).alias("category_id"), F.array("x1", "y1", F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1") - F.when(F.col("gt_id") % 17 == 0, 100).otherwise(0)).alias("bbox"), (F.col("gt_id") % 13 == 0).cast("int").alias("iscrowd"))
    return images, a


@query("coco_convert", GT + " SELECT DISTINCT printf('%06d.jpg', image_id) file_name, CAST(cls AS INT) cls, round((x1+x2)/2/640, 8) cx, round((y1+y2)/2/480, 8) cy, round((x2-x1)/640, 8) w, round((y2-y1)/480, 8) h FROM gt WHERE gt_id % 13 <> 0 AND gt_id % 17 <> 0")
def coco_convert(spark, sf):
    """SRC9, SRC10, JN21, FLT8, CNV1."""
    c = D.convert_coco(*_coco(spark, sf))
    return c.select("file_name", "cls", *(F.round(x, 8).alias(x) for x in ("cx", "cy", "w", "h"))).dropDuplicates()


_USED = "(SELECT id, row_number() OVER (ORDER BY id) - 1 AS cls FROM (SELECT unnest(range(1, 91)) id) t WHERE id NOT IN (12, 26, 29, 30, 45, 66, 68, 69, 71, 83))"


@query("coco_shapes", GT + f""", u AS {_USED} SELECT gt_id, CAST(u.cls AS INT) cls, round(x1/640, 8) s0, round(y1/480, 8) s1, round(x2/640, 8) s2, round(y2/480, 8) s3, round((x1+x2)/2/640, 8) k0, round((y1+y2)/2/480, 8) k1, CAST(gt_id % 3 AS DOUBLE) v
  FROM gt JOIN u ON u.id = gt_id % 95 WHERE gt_id % 13 <> 0 AND gt_id % 17 <> 0""")
def coco_shapes(spark, sf):
    """CNV1, JN22: categories 1 to 90 as classes 0 to 79, with segments and keypoints as shares."""
    c = F.col
    images, a = _coco(spark, sf)
    g = view(spark, sf, "gt").select("image_id", "gt_id", "x1", "y1", "x2", "y2")
    a = g.select("image_id", F.when(D.class_of_category(c("gt_id") % 95).isNotNull(), D.class_of_category(c("gt_id") % 95) + 1).alias("category_id"), F.array("x1", "y1", c("x2") - c("x1"), c("y2") - c("y1") - F.when(c("gt_id") % 17 == 0, 100).otherwise(0)).alias("bbox"), (c("gt_id") % 13 == 0).cast("int").alias("iscrowd"),
                 F.array("x1", "y1", "x2", "y2").alias("segmentation"), F.array((c("x1") + c("x2")) / 2, (c("y1") + c("y2")) / 2, (c("gt_id") % 3).cast("double"), c("gt_id").cast("double")).alias("keypoints"))
    out = D.convert_coco(images, a, shapes=True)
    at = lambda x, i, n: F.round(F.get(x, i), 8).alias(n)
    gt_id = F.round(F.get("keypoints", 3) * 640).cast("long").alias("gt_id")  # carried as a fourth number
    return out.select(gt_id, "cls", *(at("segment", i, f"s{i}") for i in range(4)), at("keypoints", 0, "k0"), at("keypoints", 1, "k1"), F.get("keypoints", 2).alias("v"))


@query("clipped_convert", GT + """, c AS (SELECT DISTINCT image_id, cls, least(greatest(x1,0),600) a, least(greatest(y1,0),440) b, least(greatest(x2,0),600) c, least(greatest(y2,0),440) d FROM gt WHERE gt_id % 13 <> 0 AND gt_id % 17 <> 0)
SELECT DISTINCT printf('%06d.jpg', image_id) file_name, CAST(cls AS INT) cls, round((a+c)/2/600, 8) cx, round((b+d)/2/440, 8) cy, round((c-a)/600, 8) w, round((d-b)/440, 8) h FROM c""")
def clipped_convert(spark, sf):
    """CNV8: boxes end at the image's border."""
    images, a = _coco(spark, sf)
    images = images.withColumn("width", F.lit(600.0)).withColumn("height", F.lit(440.0))
    c = D.convert_coco(images, a, clipped=True)
    return c.select("file_name", "cls", *(F.round(x, 8).alias(x) for x in ("cx", "cy", "w", "h"))).dropDuplicates()


@query("quad_convert", cte("obb") + """, q AS (SELECT image_id, gt_id, cls, cx-w/2 a, cy-h/2 b, cx+w/2 c, cy+h/2 d FROM obb WHERE cls < 3)
SELECT CAST(gt_id AS VARCHAR) AS image, cls || ' ' || printf('%.8f', a/640) || ' ' || printf('%.8f', b/480) || ' ' || printf('%.8f', c/640) || ' ' || printf('%.8f', b/480) || ' ' || printf('%.8f', c/640) || ' ' || printf('%.8f', d/480) || ' ' || printf('%.8f', a/640) || ' ' || printf('%.8f', d/480) AS line FROM q""")
def quad_convert(spark, sf):
    """CNV2: four corners as shares."""
    c = F.col
    g = view(spark, sf, "gt")
    r = g.select(c("gt_id").cast("string").alias("image"), F.element_at(names(), c("cls").cast("int")).alias("category"), F.lit(640.0).alias("width"), F.lit(480.0).alias("height"), c("x1").alias("x1"), c("y1").alias("y1"), c("x2").alias("x2"), c("y1").alias("y2"), c("x2").alias("x3"), c("y2").alias("y3"), c("x1").alias("x4"), c("y2").alias("y4"))
    number = F.create_map(*(F.lit(x) for i, n in NAMES.items() if i < 3 for x in (n, i)))
    return D.convert_quads(r.withColumn("category", F.when(F.col("category").isin("person", "dog", "cat"), F.col("category"))).filter("category is not null"), number)


@query("voc_convert", GT + f" SELECT gt_id AS file, CAST(cls AS INT) cls, round(((x1+x2)/2-1)/640, 8) cx, round(((y1+y2)/2-1)/480, 8) cy, round((x2-x1)/640, 8) w, round((y2-y1)/480, 8) h FROM gt WHERE cls < 4 AND gt_id % 7 <> 0")
def voc_convert(spark, sf):
    """CNV3, FLT9."""
    c = F.col
    r = view(spark, sf, "gt").select(c("gt_id").alias("file"), F.lit(640.0).alias("width"), F.lit(480.0).alias("height"), F.element_at(names(), c("cls").cast("int")).alias("name"), (c("gt_id") % 7 == 0).cast("int").alias("difficult"), c("x1").alias("xmin"), c("y1").alias("ymin"), c("x2").alias("xmax"), c("y2").alias("ymax"))
    return D.convert_voc(r, [NAMES[i] for i in range(4)]).select("file", "cls", *(F.round(x, 8).alias(x) for x in ("cx", "cy", "w", "h")))


@query("comma_convert", GT + " SELECT gt_id AS file, CAST(cls AS INT) cls, round((x1+(x2-x1)/2)/640, 8) cx, round((y2-y1)/480, 8) h FROM gt WHERE gt_id % 11 <> 0")
def comma_convert(spark, sf):
    """CNV4, CNV7: corner and size with a mark for rows to ignore."""
    c = F.col
    g = view(spark, sf, "gt")
    r = g.select(c("gt_id").alias("file"), c("x1").alias("x"), c("y1").alias("y"), (c("x2") - c("x1")).alias("w"), (c("y2") - c("y1")).alias("h"), F.when(c("gt_id") % 11 == 0, "0").otherwise("1").alias("ignored"), (c("cls") + 1).cast("int").alias("category"))
    sizes = g.select(c("gt_id").alias("file"), F.lit(640.0).alias("width"), F.lit(480.0).alias("height"))
    return D.convert_comma_boxes(r, sizes).select("file", "cls", F.round("cx", 8).alias("cx"), F.round("h", 8).alias("h"))


@query("bounds_convert", GT + ", c AS (SELECT gt_id, cls, least(greatest(x1,0),600) a, least(greatest(x2,0),600) c, least(greatest(y1,0),450) b, least(greatest(y2,0),450) d FROM gt WHERE cls IN (1, 3)) SELECT gt_id AS image, CASE cls WHEN 1 THEN 7 ELSE 8 END cls, round((a+c)/2/600, 8) cx, round((d-b)/450, 8) h FROM c")
def bounds_convert(spark, sf):
    """SRC11, CNV5, JN22: features clipped to their image, types mapped to classes."""
    c = F.col
    g = view(spark, sf, "gt")
    r = g.select(c("gt_id").alias("image"), c("cls").cast("int").alias("type_id"), "x1", "y1", "x2", "y2")
    sizes = g.select(c("gt_id").alias("image"), F.lit(600.0).alias("width"), F.lit(450.0).alias("height"))
    return D.convert_bounds(r, sizes, {1: 7, 3: 8}).select("image", "cls", F.round("cx", 8).alias("cx"), F.round("h", 8).alias("h"))


@query("csv_convert", GT + " SELECT gt_id AS image, 0 AS cls, round((x1+x2)/2/640, 8) cx, round((y1+y2)/2/480, 8) cy FROM gt")
def csv_convert(spark, sf):
    """SRC12, CNV6: one class."""
    g = view(spark, sf, "gt").select(F.col("gt_id").alias("image"), "x1", "y1", "x2", "y2", F.lit(640).alias("image_width"), F.lit(480).alias("image_height"))
    return D.convert_box_csv(g).select("image", "cls", F.round("cx", 8).alias("cx"), F.round("cy", 8).alias("cy"))


@query("label_text_lines", PRED + " SELECT image_id, cls || ' ' || printf('%g', (x1+x2)/2/1000) || ' ' || printf('%g', (y1+y2)/2/1000) || ' ' || printf('%g', (x2-x1)/1000) || ' ' || printf('%g', (y2-y1)/1000) || ' ' || printf('%g', conf) AS line FROM pred WHERE x1 > 0 AND y1 > 0")
def label_text_lines(spark, sf):
    """SNK1: lines of label text with scores; numbers as %g writes them."""
    return K.label_lines(view(spark, sf, "pred").filter("x1 > 0 AND y1 > 0"), 1000, 1000, conf=True)


@query("detections_json", PRED + f", o AS (SELECT image_id, conf, det_id, {{'name': {_NAME}, 'class': cls, 'confidence': round(conf, 5), 'box': {{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}}} o FROM pred WHERE conf > 0.05) SELECT image_id, CAST(to_json(list(o ORDER BY conf DESC, det_id)) AS VARCHAR) AS json FROM o GROUP BY image_id")
def detections_json(spark, sf):
    """SNK2: a JSON text for each image."""
    return K.detections_json(view(spark, sf, "pred").filter("conf > 0.05"), names())


@query("coco_predictions", PRED + " SELECT CAST(image_id AS VARCHAR) image_id, cls + 1 AS category_id, round(x1, 3) x, round(x2-x1, 3) w, round(conf, 5) score FROM pred")
def coco_predictions(spark, sf):
    """SNK3."""
    p = K.coco_predictions(view(spark, sf, "pred"), F.format_string("%06d", "image_id"))
    return p.select("image_id", "category_id", F.get("bbox", 0).alias("x"), F.get("bbox", 2).alias("w"), "score")


@query("polygons_wkt", PRED + " SELECT det_id, conf, printf('POLYGON ((%.3f %.3f, %.3f %.3f, %.3f %.3f, %.3f %.3f, %.3f %.3f))', x1,y1,x2,y1,x2,y2,x1,y2,x1,y1) AS wkt FROM pred")
def polygons_wkt(spark, sf):
    """SNK4."""
    return K.polygons_wkt(view(spark, sf, "pred"))


@query("point_features", cte("points") + " SELECT row_number() OVER (ORDER BY det_id) - 1 AS id, round(x, 4) x, round(y, 4) y FROM points")
def point_features(spark, sf):
    """SNK5: points with ids from 0."""
    return D.numbered(view(spark, sf, "points").select("det_id", "x", "y"), ["det_id"], "id").select("id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query("crop_windows", PRED + ", c AS (SELECT det_id, cls, (x1+x2)/2 cx, (y1+y2)/2 cy, (x2-x1)*1.02+10 w, (y2-y1)*1.02+10 h FROM pred) SELECT det_id, cls, greatest(least(CAST(trunc(cx-w/2) AS BIGINT),640),0) x1, greatest(least(CAST(trunc(cy-h/2) AS BIGINT),480),0) y1, greatest(least(CAST(trunc(cx+w/2) AS BIGINT),640),0) x2, greatest(least(CAST(trunc(cy+h/2) AS BIGINT),480),0) y2 FROM c")
def crop_windows(spark, sf):
    """SNK12."""
    return K.crop_windows(view(spark, sf, "pred"), 640, 480)


@query("plot_targets", PRED + " SELECT image_id, cls, round((x1+x2)/2, 6) cx, round((y1+y2)/2, 6) cy, conf FROM pred QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY conf DESC, det_id) <= 20")
def plot_targets(spark, sf):
    """CNV10, CNV11, ORD1: an image's best detections as rows to draw."""
    from pyspark.sql import Window as W

    k = F.row_number().over(W.partitionBy("image_id").orderBy(F.desc("conf"), "det_id"))
    p = view(spark, sf, "pred").withColumn("k", k).filter("k <= 20")
    return p.select("image_id", "cls", F.round((F.col("x1") + F.col("x2")) / 2, 6).alias("cx"), F.round((F.col("y1") + F.col("y2")) / 2, 6).alias("cy"), "conf")


@query("copy_paste", GT + """, m AS (SELECT image_id, gt_id, 640-x2 x1, y1, 640-x1 x2, y2 FROM gt) SELECT m.gt_id FROM m WHERE NOT EXISTS (SELECT 1 FROM gt WHERE gt.image_id = m.image_id AND greatest(least(m.x2,gt.x2)-greatest(m.x1,gt.x1),0)*greatest(least(m.y2,gt.y2)-greatest(m.y1,gt.y1),0)/((gt.x2-gt.x1)*(gt.y2-gt.y1)+1e-7) >= 0.3)""")
def copy_paste(spark, sf):
    """AUG6: mirrored objects that cover less than 0.3 of every object there."""
    from tessera.functions.box import box, ioa
    from tessera.operators.matching import overlap_join

    g = view(spark, sf, "gt")
    m = g.select("image_id", "gt_id", (640 - F.col("x2")).alias("x1"), "y1", (640 - F.col("x1")).alias("x2"), "y2")
    hit = overlap_join(m, g.drop("cls"), ["image_id"], cell=128.0).filter(ioa(box("l_"), box("r_")) >= 0.3).select(F.col("l_gt_id").alias("gt_id")).distinct()
    return m.select("gt_id").join(hit, "gt_id", "left_anti")


@query("concat_features", cte("gt", "pred") + " SELECT 'truth' AS part, gt_id AS id, cls FROM gt UNION ALL SELECT 'found', det_id, cls FROM pred")
def concat_features(spark, sf):
    """SRC16, NMS5 inputs: tables one below the other."""
    g, p = (view(spark, sf, v).select(F.lit(n).alias("part"), F.col(k).alias("id"), "cls") for v, n, k in (("gt", "truth", "gt_id"), ("pred", "found", "det_id")))
    return g.unionByName(p)


@query("clipped_read", cte("points") + " SELECT det_id, conf FROM points WHERE x BETWEEN 500010 AND 500060 AND y BETWEEN 9799900 AND 9799990")
def clipped_read(spark, sf):
    """SRC17, JN11: points of a map rectangle."""
    return view(spark, sf, "points").filter("x BETWEEN 500010 AND 500060 AND y BETWEEN 9799900 AND 9799990").select("det_id", "conf")
