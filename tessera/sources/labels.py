"""Readers of listings, label texts and annotation files as DataFrames. Text never runs: descriptors are parsed, not executed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Image and video file extensions.
IMAGES = ["bmp", "dng", "jpeg", "jpg", "mpo", "png", "tif", "tiff", "webp", "pfm"]
VIDEOS = ["asf", "avi", "gif", "m4v", "mkv", "mov", "mp4", "mpeg", "mpg", "ts", "wmv", "webm"]


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """SRC1, SRC2: (path, length, modificationTime) of all files below a folder; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length", "modificationTime")


def listed(spark: SparkSession, list_file: str) -> DataFrame:
    """SRC3: (path) of a text file's lines; ``./`` stands for the file's folder."""
    base = list_file.rsplit("/", 1)[0]
    line = F.trim("value")
    return spark.read.text(list_file).filter(line != "").select(F.when(line.startswith("./"), F.concat(F.lit(base + "/"), F.expr("substring(trim(value), 3)"))).otherwise(line).alias("path"))


def images(files: DataFrame, fraction: float = 1.0) -> DataFrame:
    """Image files; of a fraction below 1 the first round(n * fraction) by path."""
    found = files.filter(extension(F.col("path")).isin(*IMAGES))
    if fraction >= 1:
        return found
    n = round(found.count() * fraction)
    return found.orderBy("path").limit(n)


def images_then_videos(files: DataFrame) -> DataFrame:
    """SRC4: Files with ``kind`` 0 for images and 1 for videos."""
    e = extension(F.col("path"))
    return files.withColumn("kind", F.when(e.isin(*IMAGES), 0).when(e.isin(*VIDEOS), 1)).filter("kind is not null")


def present(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """Wanted paths that exist; none at all is an error."""
    out = wanted.join(files.select("path"), "path", "left_semi")
    if out.isEmpty():
        raise FileNotFoundError("none of the listed files exists")
    return out


def label_path(image: Column) -> Column:
    """The last /images/ becomes /labels/, the extension .txt."""
    return F.regexp_replace(F.regexp_replace(image, r"^(.*)/images/", "$1/labels/"), r"\.[^./]*$", ".txt")


def fingerprint(files: DataFrame) -> DataFrame:
    """SRC23: One row: a digest of total size and all paths. The digest is over sorted digests of 65,536 parts, so no task gets all paths."""
    parts = files.withColumn("part", F.substring(F.md5(F.col("path").cast("binary")), 1, 4)).groupBy("part").agg(F.sum("length").alias("size"), F.sha2(F.array_join(F.array_sort(F.collect_list("path")), "\n"), 256).alias("digest"))
    return parts.agg(F.sum("size").alias("size"), F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "part", "digest"))), "").alias("all")).select(F.sha2(F.concat(F.col("size").cast("string"), "all"), 256).alias("fingerprint"))


def read_label_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value) of label text files; a file is one record, so lines keep their order."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return whole.select("file", F.posexplode(F.split(F.regexp_replace("value", r"\s+$", ""), "\n")).alias("line_no", "value")).filter(F.trim("value") != "")


def parse_labels(lines: DataFrame, keypoints: bool = False) -> DataFrame:
    """``lines`` with cls, box (cx, cy, w, h) and segment (points), from tokens; a file with a row of more than 6 tokens has
    polygons unless ``keypoints``. Numbers that don't parse are null."""
    v = F.transform(F.split(F.trim("value"), r"\s+"), lambda x: x.try_cast("double"))
    p = lines.withColumn("v", v).withColumn("polygon", (F.max(F.size("v")).over(W.partitionBy("file")) > 6) & F.lit(not keypoints))
    rest = F.slice("v", 2, F.greatest(F.size("v") - 1, F.lit(0)))
    xs, ys = (F.transform(F.filter(rest, lambda _, i: i % 2 == k), lambda x: x) for k in (0, 1))
    points = F.arrays_zip(xs.alias("x"), ys.alias("y"))
    lo_x, hi_x, lo_y, hi_y = F.array_min(xs), F.array_max(xs), F.array_min(ys), F.array_max(ys)
    around = F.struct(((lo_x + hi_x) / 2).alias("cx"), ((lo_y + hi_y) / 2).alias("cy"), (hi_x - lo_x).alias("w"), (hi_y - lo_y).alias("h"))
    plain = F.struct(*(F.get("v", i).alias(n) for i, n in enumerate(("cx", "cy", "w", "h"), 1)))
    return p.select(*lines.columns, "v", F.get("v", 0).cast("int").alias("cls"), F.when(F.col("polygon"), around).otherwise(plain).alias("box"), F.when(F.col("polygon"), points).alias("segment"))


def verify_labels(parsed: DataFrame, classes: int, keypoints: int = 0, parity: bool = True) -> DataFrame:
    """(file, status, message, n, n_duplicates) per file. With ``parity`` a class equal to ``classes`` passes, as counted from 1."""
    v, size = F.col("v"), F.size("v")
    width = 5 + keypoints
    wrong = (
        F.when(F.exists(v, lambda x: x.isNull()), "a token is not a number")
        .when(F.col("segment").isNull() & (size != width), f"{width} columns are required")
        .when(F.exists(F.slice(v, 2, F.greatest(size - 1, F.lit(0))), lambda x: x > 1), "a coordinate is above 1")
        .when(F.exists(v, lambda x: x < 0), "a value is negative")
        .when(F.col("cls") > (classes if parity else classes - 1), "a class is out of range")
    )
    rows = parsed.withColumn("wrong", wrong).withColumn("row_text", F.array_join(F.transform(v, lambda x: x.cast("string")), " "))
    by_file = rows.groupBy("file").agg(F.min("wrong").alias("message"), F.count("*").alias("n"), F.countDistinct("row_text").alias("different"))
    return by_file.select("file", F.when(F.col("message").isNull(), "found").otherwise("corrupt").alias("status"), "message", "n", (F.col("n") - F.col("different")).alias("n_duplicates"))


def read_coco(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(images, annotations) of an instances file."""
    doc = spark.read.json(path, multiLine=True)
    return doc.select(F.explode("images").alias("i")).select("i.*"), doc.select(F.explode("annotations").alias("a")).select("a.*")


def read_voc(spark: SparkSession, path: str) -> DataFrame:
    """SRC14: (file, width, height, name, difficult, xmin, ymin, xmax, ymax) of annotation files in XML."""
    schema = "size struct<width: int, height: int>, object array<struct<name: string, difficult: int, bndbox: struct<xmin: double, ymin: double, xmax: double, ymax: double>>>"
    rows = spark.read.format("xml").option("rowTag", "annotation").schema(schema).load(path).withColumn("file", F.input_file_name())
    return rows.select("file", "size.width", "size.height", F.explode("object").alias("o")).select("file", "width", "height", "o.name", "o.difficult", "o.bndbox.*")


def read_comma_boxes(spark: SparkSession, path: str) -> DataFrame:
    """SRC13: (file, x, y, w, h, ignored, category) of comma-separated files, one for each image."""
    schema = "x double, y double, w double, h double, ignored string, category int, truncation int, occlusion int"
    return spark.read.csv(path, schema=schema).select(F.input_file_name().alias("file"), "*")


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """(image, type_id, x1, y1, x2, y2) of features with four comma-separated bounds; others are left out."""
    f = spark.read.json(path, multiLine=True).select(F.explode("features").alias("f")).select(F.col("f.properties.image_id").alias("image"), F.col("f.properties.type_id").cast("int").alias("type_id"), F.split("f.properties.bounds_imcoords", ",").alias("b"))
    return f.filter(F.size("b") == 4).select("image", "type_id", *(F.get("b", i).try_cast("double").alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))))


def read_frames(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """SRC15: (file, category_id, x, y, w, h) of JSON documents of images, annotations and their sequences, each on its own: one to a file,
    or one to a line."""
    doc = spark.read.json(path, multiLine=not lines).withColumn("doc", F.monotonically_increasing_id())
    seq = doc.select("doc", F.posexplode("sequences").alias("sid", "folder"))
    i = doc.select("doc", F.explode("images").alias("i")).select("doc", F.col("i.id").alias("image_id"), F.col("i.sid").cast("int").alias("sid"), F.col("i.name").alias("name")).join(seq, ["doc", "sid"])
    a = doc.select("doc", F.explode("annotations").alias("a")).select("doc", "a.image_id", "a.category_id", "a.bbox")
    return a.join(i, ["doc", "image_id"]).select(F.concat_ws("/", "folder", "name").alias("file"), "category_id", *(F.get("bbox", k).cast("double").alias(n) for k, n in enumerate("xywh")))


def read_box_csv(spark: SparkSession, path: str) -> DataFrame:
    """(image, x1, y1, x2, y2, class, width, height) of a CSV file without header."""
    return spark.read.csv(path, schema="image string, x1 double, y1 double, x2 double, y2 double, class string, image_width int, image_height int")


def read_series(spark: SparkSession, path: str) -> DataFrame:
    """SRC16, D15: A training or tuning log whose header is padded with blanks."""
    df = spark.read.csv(path, header=True, inferSchema=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    return df.toDF(*(c.strip() for c in df.columns))


def folder_classes(files: DataFrame) -> DataFrame:
    """SRC21: (split, name, cls, n) of images in <split>/<class>/ folders; class numbers go by name."""
    c = files.select(F.regexp_extract("path", r"([^/]+)/([^/]+)/[^/]+$", 1).alias("split"), F.regexp_extract("path", r"([^/]+)/([^/]+)/[^/]+$", 2).alias("name"))
    n = c.groupBy("split", "name").agg(F.count("*").alias("n"))
    names = n.filter("split = 'train'").select("name", F.lit(1).alias("one")).withColumn("cls", F.row_number().over(W.partitionBy("one").orderBy("name")) - 1)  # a row for each class
    return n.join(names.drop("one"), "name", "left").select("split", "name", "cls", "n")


def check_descriptor(d: dict) -> dict:
    """SRC20: A dataset descriptor with its names as a dict and its parts present; nothing in it is executed."""
    out = dict(d)
    if "validation" in out and "val" not in out:
        out["val"] = out.pop("validation")
    for k in ("train", "val"):
        if k not in out:
            raise ValueError(f"the descriptor has no {k!r}")
    if "names" not in out and "nc" not in out:
        raise ValueError("the descriptor has neither names nor nc")
    if "names" in out and "nc" in out and len(out["names"]) != out["nc"]:
        raise ValueError(f"{len(out['names'])} names, but nc is {out['nc']}")
    names = out.get("names") or [f"class_{i}" for i in range(out["nc"])]
    out["names"] = dict(enumerate(names)) if isinstance(names, list) else {int(k): v for k, v in names.items()}
    out["nc"] = len(out["names"])
    return out
