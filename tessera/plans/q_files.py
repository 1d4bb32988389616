"""Readers and writers: each query writes files of the format to the shared folder and reads them back, or works on a listing."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.operators.running import shared_dir
from tessera.plans._register import query
from tessera.plans.fixtures import cte, table, view
from tessera.sources import labels as S
from tessera.sources import sinks as K
from tessera.sources import vector as V

GT, PART = cte("gt"), "SELECT p_partkey, p_size, p_type FROM part"


def folder(spark, label: str) -> str:
    return f"{shared_dir(spark)}/tessera-files-{label}-{uuid.uuid4().hex}"


@query("comma_files", GT + " SELECT gt_id, x1 x, y1 y, x2-x1 w, y2-y1 h, CAST(gt_id % 2 AS VARCHAR) ignored, CAST(cls + 1 AS INT) category FROM gt")
def comma_files(spark, sf):
    """SRC13: comma-separated boxes, a folder for each class."""
    c, path = F.col, folder(spark, "comma")
    g = view(spark, sf, "gt").select("x1", "y1", (c("x2") - c("x1")).alias("w"), (c("y2") - c("y1")).alias("h"), (c("gt_id") % 2).cast("string").alias("ignored"), (c("cls") + 1).cast("int").alias("category"), c("gt_id").cast("int").alias("truncation"), F.lit(0).alias("occlusion"), c("cls").alias("folder"))
    g.write.partitionBy("folder").csv(path)
    rows = S.read_comma_boxes(spark, f"{path}/*")
    return rows.select(c("truncation").cast("long").alias("gt_id"), "x", "y", "w", "h", "ignored", "category")


@query("voc_files", GT + " SELECT gt_id, image_id, 'class ' || cls AS name, CAST(gt_id % 7 = 0 AS INT) difficult, x1 xmin, y1 ymin, x2 xmax, y2 ymax FROM gt")
def voc_files(spark, sf):
    """SRC14: annotations in XML, one for each image, sixteen to a file."""
    c, path = F.col, folder(spark, "voc")
    tag = lambda n, v: F.concat(F.lit(f"<{n}>"), v.cast("string"), F.lit(f"</{n}>"))
    bounds = F.concat(*(tag(n, c(x)) for n, x in (("xmin", "x1"), ("ymin", "y1"), ("xmax", "x2"), ("ymax", "y2"))))
    thing = tag("object", F.concat(tag("name", F.concat_ws(" ", F.lit("class"), c("cls").cast("string"), c("gt_id").cast("string"))), tag("difficult", (c("gt_id") % 7 == 0).cast("int")), tag("bndbox", bounds)))
    images = view(spark, sf, "gt").groupBy("image_id").agg(F.array_join(F.collect_list(thing), "").alias("things"))  # an image's labels
    note = tag("annotation", F.concat(tag("size", F.concat(tag("width", c("image_id")), tag("height", F.lit(480)))), c("things")))
    files = images.groupBy(F.floor(c("image_id") / 16).alias("folder")).agg(tag("annotations", F.array_join(F.collect_list(note), "")).alias("value"))  # 16 images to a file
    files.write.partitionBy("folder").text(path)
    r = S.read_voc(spark, path)
    words = F.split("name", " ")
    return r.select(F.get(words, 2).cast("long").alias("gt_id"), c("width").cast("long").alias("image_id"), F.concat_ws(" ", F.get(words, 0), F.get(words, 1)).alias("name"), "difficult", "xmin", "ymin", "xmax", "ymax")


@query("frame_files", GT + " SELECT DISTINCT printf('seq%d/%d.jpg', image_id % 3, image_id) AS file, CAST(cls AS BIGINT) category_id, x1 x, y1 y, x2-x1 w, y2-y1 h FROM gt")
def frame_files(spark, sf):
    """SRC15: documents of images, annotations and sequences."""
    c, path = F.col, folder(spark, "frames")
    note = F.struct("image_id", c("cls").alias("category_id"), F.array("x1", "y1", c("x2") - c("x1"), c("y2") - c("y1")).alias("bbox"))
    docs = view(spark, sf, "gt").groupBy("image_id").agg(F.collect_list(note).alias("annotations"))  # an image's labels
    image = F.array(F.struct(c("image_id").alias("id"), (c("image_id") % 3).alias("sid"), F.format_string("%d.jpg", "image_id").alias("name")))
    docs.select(F.array(F.lit("seq0"), F.lit("seq1"), F.lit("seq2")).alias("sequences"), image.alias("images"), "annotations").write.json(path)
    return S.read_frames(spark, path, lines=True).distinct()


@query("listed_files", "SELECT 'n_regionkey=' || n_regionkey AS folder, 'txt' AS ext, count(*) > 0 AS found, 1 AS kind FROM nation GROUP BY n_regionkey UNION ALL SELECT 'split=' || CASE WHEN n_nationkey % 4 = 0 THEN 'val' ELSE 'train' END, 'txt', true, 2 FROM nation GROUP BY 1")
def listed_files(spark, sf):
    """SRC1, SRC2, SNK11: files below folders, found without reading them."""
    n, path = table(spark, sf, "nation"), folder(spark, "listing")
    n.select("n_regionkey", F.col("n_name").alias("value")).coalesce(1).write.partitionBy("n_regionkey").text(f"{path}/a")
    K.write_manifests(n.select("n_name", F.when(F.col("n_nationkey") % 4 == 0, "val").otherwise("train").alias("split")).withColumnRenamed("n_name", "path").coalesce(1), f"{path}/b")
    files = S.listing(spark, path).filter(S.extension(F.col("path")) == "txt")
    at = F.regexp_extract("path", "([^/]+)/[^/]+$", 1)
    return files.select(at.alias("folder"), S.extension(F.col("path")).alias("ext"), (F.col("length") > 0).alias("found"), F.when(at.startswith("split"), 2).otherwise(1).alias("kind"))


@query("wanted_images", "SELECT p_partkey, '/data/images/' || p_partkey || '.jpg' AS path FROM part WHERE p_partkey % 3 > 0")
def wanted_images(spark, sf):
    """SRC3: the lines of a list file that exist."""
    path, k = folder(spark, "list"), F.col("p_partkey").cast("string")
    p = table(spark, sf, "part")
    p.select(F.concat(F.lit("/data/images/"), k, F.lit(".jpg")).alias("value")).write.text(path)
    there = p.filter("p_partkey % 3 > 0").select(F.concat(F.lit("/data/images/"), k, F.lit(".jpg")).alias("path"))
    return S.present(S.listed(spark, f"{path}/*.txt"), there).select(F.regexp_extract("path", "([0-9]+)[.]jpg$", 1).cast("long").alias("p_partkey"), "path")


def _files(spark, sf):
    """A listing as made of parts: images, videos and others in folders by split and class."""
    c = F.col
    p = table(spark, sf, "part").select("p_partkey", "p_size", "p_type")
    ext = F.when(c("p_partkey") % 7 == 0, "MP4").when(c("p_partkey") % 7 == 1, "txt").otherwise("jpg")
    split = F.when(c("p_size") % 5 == 0, "val").otherwise("train")
    path = F.concat(F.lit("/set/"), split, F.lit("/"), F.regexp_replace(F.lower("p_type"), " ", "_"), F.lit("/"), c("p_partkey").cast("string"), F.lit("."), ext)
    return p.select("p_partkey", path.alias("path"), (c("p_size") * 1000).cast("long").alias("length"), F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, cast(p_partkey % 1000 as int))").alias("modificationTime"))


FILES = """WITH f AS (SELECT p_partkey, '/set/' || CASE WHEN p_size % 5 = 0 THEN 'val' ELSE 'train' END || '/' || replace(lower(p_type), ' ', '_') || '/' || p_partkey || '.' || CASE p_partkey % 7 WHEN 0 THEN 'MP4' WHEN 1 THEN 'txt' ELSE 'jpg' END AS path,
  CAST(p_size*1000 AS BIGINT) length, p_partkey % 1000 at_hour FROM part)"""


@query("media_kinds", FILES + " SELECT path, CASE p_partkey % 7 WHEN 0 THEN 1 ELSE 0 END kind FROM f WHERE p_partkey % 7 <> 1")
def media_kinds(spark, sf):
    """SRC4: images and videos of a listing, told apart."""
    return S.images_then_videos(_files(spark, sf)).select("path", "kind")


@query("folder_classes", FILES + ", s AS (SELECT split_part(path, '/', 3) split, split_part(path, '/', 4) name, count(*) n FROM f WHERE p_partkey % 7 > 1 GROUP BY ALL), c AS (SELECT name, row_number() OVER (ORDER BY name) - 1 cls FROM s WHERE split = 'train') SELECT split, name, CAST(cls AS INT) cls, n FROM s LEFT JOIN c USING (name)")
def folder_classes(spark, sf):
    """SRC21: classes and counts from folders."""
    return S.folder_classes(S.images(_files(spark, sf)))


@query("listing_fingerprint", FILES + ", g AS (SELECT substr(md5(path), 1, 4) part, sum(length) size, sha256(string_agg(path, chr(10) ORDER BY path)) d FROM f GROUP BY 1) SELECT sha256(CAST(CAST(sum(size) AS BIGINT) AS VARCHAR) || string_agg(part || ':' || d, '' ORDER BY part || ':' || d)) fingerprint FROM g")
def listing_fingerprint(spark, sf):
    """SRC23: one digest of all sizes and paths."""
    return S.fingerprint(_files(spark, sf))


@query("file_ages", FILES + " SELECT path, round(length/1048576e0, 9) mib, path = (SELECT arg_max(path, struct_pack(h := at_hour, p := path)) FROM f) AS latest FROM f")
def file_ages(spark, sf):
    """MSC3: sizes, and which file is the latest."""
    return V.file_ages(_files(spark, sf)).select("path", F.round("mib", 9).alias("mib"), "latest")


@query("label_cache", GT + " SELECT cls, count(*) n FROM gt GROUP BY cls")
def label_cache(spark, sf):
    """SRC22: a table made once for a version and a fingerprint, and read where both are the same."""
    path = folder(spark, "cache")
    make = lambda: view(spark, sf, "gt").groupBy("cls").agg(F.count("*").alias("n"))
    V.cached(spark, path, "1", "abc", make)
    return V.cached(spark, path, "1", "abc", lambda: spark.createDataFrame([], "cls long, n long"))


@query("descriptor_names", "SELECT CAST(n_nationkey AS INT) cls, n_name AS name, 25 AS nc FROM nation")
def descriptor_names(spark, sf):
    """SRC20: a descriptor's class names, checked."""
    rows = table(spark, sf, "nation").orderBy("n_nationkey").select("n_name").collect()  # 25 rows
    d = S.check_descriptor({"train": "a", "validation": "b", "names": [r.n_name for r in rows], "nc": len(rows)})
    return spark.createDataFrame([(k, v, d["nc"]) for k, v in d["names"].items()], "cls int, name string, nc int")


_WINDOWS = [(i, 7 + 9 * i, 5 + 11 * i, 17, 13) for i in range(4)]


@query("raster_windows", f"{cte('pixel')}, m AS (SELECT image, px_row, px_col, max(value) v FROM pixel GROUP BY ALL), w AS (SELECT * FROM (VALUES {', '.join(map(str, _WINDOWS))}) t(window_id, x, y, w, h)) SELECT image raster_id, CAST(window_id AS INT) window_id, px_row \"row\", px_col col, v AS value FROM m JOIN w ON px_row >= y AND px_row < y + h AND px_col >= x AND px_col < x + w")
def raster_windows(spark, sf):
    """SRC19, SNK6: pixels of windows, from a relation that is laid out and written by block."""
    c, path = F.col, folder(spark, "mask")
    m = view(spark, sf, "pixel").groupBy(c("image").alias("raster_id"), c("px_row").alias("row"), c("px_col").alias("col")).agg(F.max("value").alias("value"))
    K.write_mask(m, path)
    blocks = spark.read.parquet(path).drop("block")
    windows = m.select("raster_id").distinct().crossJoin(F.broadcast(spark.createDataFrame(_WINDOWS, "window_id int, x int, y int, w int, h int")))  # four windows
    return V.window_pixels(blocks, windows, 16)


@query("metric_rows", "SELECT o_orderpriority AS name, count(*) n, 1 AS round FROM orders GROUP BY 1 UNION ALL SELECT o_orderpriority, count(*), 2 FROM orders GROUP BY 1")
def metric_rows(spark, sf):
    """SNK7, SNK10: rows put below those of a report."""
    path, n = folder(spark, "report"), table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("name")).agg(F.count("*").alias("n"))
    for k in (1, 2):
        K.append_metrics(n.withColumn("round", F.lit(k)), path)
    return spark.read.csv(path, header=True, schema="name string, n long, round int")
