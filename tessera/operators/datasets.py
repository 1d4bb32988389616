"""Dataset statistics, splits, batches and annotation conversions."""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.box import Box, clip, ltwh_to_xywh, ltwh_to_xyxy, xyxy_to_xywh
from tessera.operators.running import running


def class_statistics(labels: DataFrame, n_classes: int) -> DataFrame:
    """(cls, instances, images) with zeros for classes that don't occur."""
    spark = labels.sparkSession
    n = labels.groupBy("cls").agg(F.count("*").alias("instances"), F.countDistinct("image_id").alias("images"))
    return spark.range(n_classes).withColumnRenamed("id", "cls").join(n, "cls", "left").na.fill(0, ["instances", "images"])


def rect_batches(images: DataFrame, batch: int, size: int, stride: int, pad: float) -> DataFrame:
    """(image_id, batch, h, w): images by aspect ratio in batches of one shape each.

    Ranks come from partition counts and ranks within partitions, so that no task sorts all images.
    """
    r = numbered(images.withColumn("ar", F.col("height") / F.col("width")), ["ar", "image_id"]).withColumn("batch", F.floor(F.col("rank") / batch))
    span = r.groupBy("batch").agg(F.min("ar").alias("lo"), F.max("ar").alias("hi"))
    h = F.when(F.col("hi") < 1, F.col("hi")).otherwise(1.0)
    w = F.when((F.col("hi") >= 1) & (F.col("lo") > 1), 1 / F.col("lo")).otherwise(1.0)
    up = lambda x: (F.ceil(x * size / stride + pad) * stride).cast("long")
    return r.join(span, "batch").select("image_id", "batch", up(h).alias("h"), up(w).alias("w"))


def numbered(df: DataFrame, by: list[str], name: str = "rank") -> DataFrame:
    """``df`` with each row's place from 0 in the order of ``by`` (unique), by a range sort and partition counts."""
    return running(df, [], [F.col(c) for c in by], sums={name: F.lit(1)}).withColumn(name, F.col(name) - 1)


def kfold(keys: list, k: int = 5, seed: int = 3) -> list[list]:
    """Shuffled folds of a small list of names; the first len % k folds are one longer."""
    order = np.arange(len(keys))
    np.random.RandomState(seed).shuffle(order)
    sizes = [len(keys) // k + (i < len(keys) % k) for i in range(k)]
    out, at = [], 0
    for n in sizes:
        out.append([keys[i] for i in order[at : at + n]])
        at += n
    return out


def hashed(key: str, seed: int) -> Column:
    """A number below 2**32 from a seeded digest of the key's text, alike in any engine."""
    return F.conv(F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit(f"/{seed}"))), 1, 8), 16, 10).cast("long")


def kfold_by_hash(df: DataFrame, key: str, k: int = 5, seed: int = 3) -> DataFrame:
    """The same for tables: folds by a seeded digest, without an order over all rows."""
    return df.withColumn("fold", (hashed(key, seed) % k).cast("int"))


def autosplit(paths: list[str], weights: tuple[float, ...] = (0.9, 0.1, 0.0), seed: int = 0) -> list[tuple[str, str]]:
    """(path, split) of a sorted list of names, by weighted draws."""
    return list(zip(sorted(paths), random.Random(seed).choices(("train", "val", "test"), weights=weights, k=len(paths)), strict=True))


def autosplit_by_hash(df: DataFrame, key: str, weights: tuple[float, ...] = (0.9, 0.1, 0.0)) -> DataFrame:
    """The same for tables: by a seeded digest in whole millionths, as sums of shares are not exact (0.8 + 0.15 > 0.95)."""
    train, val = (math.ceil(round(sum(weights[:i]) * 10**6, 3)) for i in (1, 2))
    part = hashed(key, 0) % 10**6
    return df.withColumn("split", F.when(part < train, "train").when(part < val, "val").otherwise("test"))


def random_crops(seed: int, n: int, width: int, height: int, size: int) -> list[tuple[int, int]]:
    """(x, y) of a raster's crops: all x are drawn before all y."""
    r = random.Random(seed)
    xs = [r.randint(0, max(0, width - size)) for _ in range(n)]
    return list(zip(xs, [r.randint(0, max(0, height - size)) for _ in range(n)], strict=True))


def crops(rasters: DataFrame, n: int, size: int) -> DataFrame:
    """(raster_id, x, y): ``n`` random crops of each raster (raster_id, width, height), whose id is the seed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("raster_id", "width", "height")), strict=True))
            for at in range(0, len(rows), 256):
                some = rows[at : at + 256]
                places = np.array([random_crops(int(r), n, int(w), int(h), size) for r, w, h in some], np.int64).reshape(-1, 2)
                ids = np.repeat(np.array([r for r, _, _ in some], np.int64), n)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(places[:, 0]), pa.array(places[:, 1])], ["raster_id", "x", "y"])

    return rasters.select("raster_id", "width", "height").mapInArrow(run, "raster_id long, x long, y long")


def count_phrases(df: DataFrame, names: Column) -> DataFrame:
    """(image_id, said): '2 dogs, 1 cat' by class number."""
    n = df.groupBy("image_id", "cls").agg(F.count("*").alias("n"))
    part = F.concat_ws(" ", F.col("n").cast("string"), F.concat(F.element_at(names, F.col("cls").cast("int")), F.when(F.col("n") > 1, "s").otherwise("")))
    return n.groupBy("image_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cls", part.alias("p")))), lambda s: s["p"]), ", ").alias("said"))


# --- conversions to (image, cls, cx, cy, w, h) in shares ------------------------------------------------------------------


def _shares(df: DataFrame, b: Box, width: Column, height: Column, *keep) -> DataFrame:
    return df.select(*keep, (b.a / width).alias("cx"), (b.b / height).alias("cy"), (b.c / width).alias("w"), (b.d / height).alias("h"))


#: The category ids below 91 that have no class of their own; the 80 others are numbered in order.
UNUSED = [12, 26, 29, 30, 45, 66, 68, 69, 71, 83]


def class_of_category(category: Column) -> Column:
    """The class, 0 to 79, of a category id, 1 to 90; null for ids without a class."""
    skipped = sum(((category > u).cast("int") for u in UNUSED), F.lit(0))
    return F.when(category.between(1, 90) & ~category.isin(UNUSED), category.cast("int") - 1 - skipped)


def category_of_class(cls: Column) -> Column:
    """The category id of a class, 0 to 79."""
    ids = [i for i in range(1, 91) if i not in UNUSED]
    return F.get(F.array(*(F.lit(i) for i in ids)), cls.cast("int"))


def convert_coco(images: DataFrame, annotations: DataFrame, classes: Column | None = None, clipped: bool = False, shapes: bool = False) -> DataFrame:
    """Crowds, empty boxes, repeats and categories without a class go. ``classes`` is a map, or else classes are ids less 1. With
    ``clipped``, boxes end at the image's border; with ``shapes``, segments (an array of x and y in turn) and keypoints (x, y,
    visibility in turn) come along, as shares of the image."""
    c = F.col
    a = annotations.filter("iscrowd = 0").join(images.select(c("id").alias("image_id"), "file_name", "width", "height"), "image_id").filter((F.get("bbox", 2) > 0) & (F.get("bbox", 3) > 0))
    given = Box(*(F.get("bbox", i) for i in range(4)))
    b = xyxy_to_xywh(clip(ltwh_to_xyxy(given), c("width"), c("height"))) if clipped else ltwh_to_xywh(given)
    cls = F.element_at(classes, c("category_id").cast("int")) if classes is not None else c("category_id").cast("int") - 1
    share = lambda x, i, n: F.when(i % n == 0, x / c("width")).when(i % n == 1, x / c("height")).otherwise(x)
    more = [F.transform("segmentation", lambda x, i: share(x, i, 2)).alias("segment"), F.transform("keypoints", lambda x, i: share(x, i, 3)).alias("keypoints")] if shapes else []
    return _shares(a, b, c("width"), c("height"), "file_name", cls.alias("cls"), *more).filter("cls is not null").dropDuplicates()


def convert_quads(rows: DataFrame, classes: Column) -> DataFrame:
    """(image, line): class and four corners as shares, of rows with x1..y4, a category name and the image's size."""
    c = F.col
    corners = [c(f"{a}{i}") / c("width" if a == "x" else "height") for i in range(1, 5) for a in "xy"]
    return rows.withColumn("cls", F.element_at(classes, c("category"))).filter("cls is not null").select("image", F.concat_ws(" ", c("cls").cast("string"), *(F.format_string("%.8f", x) for x in corners)).alias("line"))


def convert_voc(rows: DataFrame, names: list[str]) -> DataFrame:
    """Named classes that aren't difficult; centres are one pixel less, as the format counts from 1."""
    c = F.col
    number = F.create_map(*(F.lit(x) for i, n in enumerate(names) for x in (n, i)))
    r = rows.withColumn("cls", F.try_element_at(number, c("name"))).filter("cls is not null AND difficult <> 1")
    b = xyxy_to_xywh(Box(c("xmin"), c("ymin"), c("xmax"), c("ymax")))
    return _shares(r, Box(b.a - 1, b.b - 1, b.c, b.d), c("width"), c("height"), "file", "cls")


def convert_comma_boxes(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """Rows that aren't marked as ignored; classes count from 1."""
    c = F.col
    r = rows.filter("ignored <> '0'").join(sizes, "file")
    return _shares(r, ltwh_to_xywh(Box(c("x"), c("y"), c("w"), c("h"))), c("width"), c("height"), "file", (c("category") - 1).alias("cls"))


def convert_bounds(rows: DataFrame, sizes: DataFrame, numbers: dict[int, int]) -> DataFrame:
    """Features with four bounds and a type that has a class; boxes are clipped to the image."""
    c = F.col
    table = F.create_map(*(F.lit(x) for kv in numbers.items() for x in kv))
    r = rows.withColumn("cls", F.try_element_at(table, c("type_id"))).filter("cls is not null").join(sizes, "image")
    return _shares(r, xyxy_to_xywh(clip(Box(c("x1"), c("y1"), c("x2"), c("y2")), c("width"), c("height"))), c("width"), c("height"), "image", "cls")


def convert_box_csv(rows: DataFrame) -> DataFrame:
    """One class; corners with the image's size on each row."""
    c = F.col
    return _shares(rows, xyxy_to_xywh(Box(c("x1"), c("y1"), c("x2"), c("y2"))), c("image_width"), c("image_height"), "image", F.lit(0).alias("cls"))
