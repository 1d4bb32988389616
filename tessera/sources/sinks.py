"""Writers of detections, labels, manifests and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def general(x: Column, digits: int = 6) -> Column:
    """A number as %g writes it, for magnitudes from 1e-4 up to 10**digits: significant digits, no trailing zeros."""
    places = F.greatest(F.lit(digits - 1) - F.floor(F.log10(F.greatest(F.abs(x), F.lit(1e-4)))), F.lit(0)).cast("int")
    text = F.coalesce(*(F.when(places == i, F.format_string(f"%.{i}f", F.bround(x, i))) for i in range(digits + 4)))  # makes one of them
    text = F.when(text.contains("."), F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")).otherwise(text)
    return F.when(x == 0, "0").otherwise(text)


def label_lines(df: DataFrame, width: float, height: float, conf: bool = False, track: bool = False) -> DataFrame:
    """(image_id, line): cls cx cy w h as shares, then the score and the track if asked for."""
    c = F.col
    numbers = [(c("x1") + c("x2")) / 2 / width, (c("y1") + c("y2")) / 2 / height, (c("x2") - c("x1")) / width, (c("y2") - c("y1")) / height] + [c("conf")] * conf
    texts = F.transform(F.array(*numbers), lambda x: general(x))  # one expression for all of them
    return df.select("image_id", F.concat_ws(" ", c("cls").cast("string"), texts, *[c("track_id").cast("string")] * track).alias("line"))


def write_label_text(lines: DataFrame, path: str) -> None:
    """One folder of text for each image; images are dealt out first, so a task writes few files."""
    lines.repartition("image_id").select("image_id", F.col("line").alias("value")).write.mode("overwrite").partitionBy("image_id").text(path)


def detections_json(df: DataFrame, names: Column) -> DataFrame:
    """(image_id, json): an image's detections by score, as an array of objects."""
    c = F.col
    one = F.struct(F.element_at(names, c("cls").cast("int")).alias("name"), c("cls").alias("class"), F.round("conf", 5).alias("confidence"), F.struct("x1", "y1", "x2", "y2").alias("box"))
    return df.select("image_id", F.struct((-c("conf")).alias("k"), c("det_id").alias("id"), one.alias("o")).alias("s")).groupBy("image_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["o"])).alias("json"))


def coco_predictions(df: DataFrame, image: Column) -> DataFrame:
    """(image_id, category_id, bbox, score) of a predictions file; the image's name is a number where it reads as one."""
    c = F.col
    box = F.array(*(F.round(x, 3) for x in (c("x1"), c("y1"), c("x2") - c("x1"), c("y2") - c("y1"))))
    return df.select(F.coalesce(image.try_cast("long").cast("string"), image).alias("image_id"), (c("cls") + 1).alias("category_id"), box.alias("bbox"), F.round("conf", 5).alias("score"))


def polygons_wkt(df: DataFrame) -> DataFrame:
    """(det_id, conf, wkt): upright boxes as closed rings."""
    p = ["x1 y1", "x2 y1", "x2 y2", "x1 y2", "x1 y1"]
    ring = F.concat_ws(", ", *(F.concat_ws(" ", *(F.format_string("%.3f", n) for n in pair.split())) for pair in p))
    return df.select("det_id", "conf", F.concat(F.lit("POLYGON (("), ring, F.lit("))")).alias("wkt"))


def crop_windows(df: DataFrame, width: int, height: int, gain: float = 1.02, pad: float = 10) -> DataFrame:
    """Whole-pixel windows around boxes, grown and clipped."""
    c = F.col
    cx, cy, w, h = (c("x1") + c("x2")) / 2, (c("y1") + c("y2")) / 2, (c("x2") - c("x1")) * gain + pad, (c("y2") - c("y1")) * gain + pad
    cut = lambda v, m: F.greatest(F.least(v.cast("long"), F.lit(m).cast("long")), F.lit(0).cast("long"))
    return df.select("det_id", "cls", cut(cx - w / 2, width).alias("x1"), cut(cy - h / 2, height).alias("y1"), cut(cx + w / 2, width).alias("x2"), cut(cy + h / 2, height).alias("y2"))


def write_manifests(df: DataFrame, path: str) -> None:
    """Split manifests: a folder of text for each split."""
    df.select("split", F.col("path").alias("value")).write.mode("overwrite").partitionBy("split").text(path)


def write_table(df: DataFrame, name: str, force: bool = False) -> DataFrame:
    """A managed table, made unless it is there already."""
    spark = df.sparkSession
    if force or not spark.catalog.tableExists(name):
        df.write.mode("overwrite").saveAsTable(name)
    return spark.table(name)


def append_metrics(df: DataFrame, path: str) -> None:
    """SNK7, SNK8, SNK10: rows below those of a CSV report."""
    df.write.mode("append").csv(path, header=True)


def write_mask(pixels: DataFrame, path: str) -> None:
    """SNK6: a mask as a pixel relation, clustered by block so that a window read touches few files."""
    pixels.withColumn("block", F.floor(F.col("row") / 1024) * 100000 + F.floor(F.col("col") / 1024)).repartition("block").sortWithinPartitions("block", "row", "col").write.mode("overwrite").parquet(path)
