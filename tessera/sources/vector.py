"""Point and polygon layers in shapefiles, and raster blocks, as DataFrames.

The files' main part is read by Spark as binary records, so any store that Spark reads will do; a file is parsed in one task.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Shape types of the format, by what they hold; Z and M variants start alike.
POINTS, RINGS = (1, 11, 21), (3, 5, 13, 15, 23, 25)


def parse_shapes(data: bytes) -> Iterator[tuple[int, list[list[tuple[float, float]]]]]:
    """(number from 0, parts) of each shape; a point is one part of one point, a null shape has no parts."""
    if len(data) < 100 or struct.unpack(">i", data[:4])[0] != 9994:
        raise ValueError("not a shapefile")
    at, n = 100, 0
    while at + 8 <= len(data):
        size = struct.unpack_from(">i", data, at + 4)[0] * 2
        body = data[at + 8 : at + 8 + size]
        kind = struct.unpack_from("<i", body)[0]
        parts: list[list[tuple[float, float]]] = []
        if kind in POINTS:
            parts = [[struct.unpack_from("<2d", body, 4)]]
        elif kind in RINGS:
            n_parts, n_points = struct.unpack_from("<2i", body, 36)
            starts = [*struct.unpack_from(f"<{n_parts}i", body, 44), n_points]
            flat = struct.unpack_from(f"<{2 * n_points}d", body, 44 + 4 * n_parts)
            points = list(zip(flat[::2], flat[1::2], strict=True))
            parts = [points[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]
        elif kind != 0:
            raise ValueError(f"shape type {kind} is not read")
        yield n, parts
        at += 8 + size
        n += 1


def parse_attributes(data: bytes) -> list[dict[str, str]]:
    """Rows of a dBASE table as texts; deleted rows are kept, for shapes go by place."""
    count, head, width = struct.unpack_from("<IHH", data, 4)
    fields, at = [], 32
    while data[at] != 0x0D:
        fields.append((data[at : at + 11].split(b"\0")[0].decode("latin-1"), data[at + 16]))
        at += 32
    rows = []
    for i in range(count):
        at, row = head + i * width + 1, {}
        for name, size in fields:
            row[name] = data[at : at + size].decode("utf-8", "replace").strip()
            at += size
        rows.append(row)
    return rows


SCHEMA = "file string, feature_id long, parts array<array<struct<x: double, y: double>>>, attributes map<string, string>"


def read_shapefile(spark: SparkSession, path: str) -> DataFrame:
    """SRC18: (file, feature_id, parts, attributes) of the .shp files that ``path`` names, with the .dbf beside each."""
    base = F.regexp_replace("path", r"\.[^./]*$", "")
    files = lambda p: spark.read.format("binaryFile").load(p).select(base.alias("file"), "content")
    shapes = files(path)
    try:
        tables = files(path[:-4] + ".dbf" if path.lower().endswith(".shp") else path.replace(".shp", ".dbf"))
        both = shapes.join(tables.withColumnRenamed("content", "dbf"), "file", "left")
    except Exception:  # no table at all beside the shapes
        both = shapes.withColumn("dbf", F.lit(None).cast("binary"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                rows = parse_attributes(r.dbf) if r.dbf is not None else []
                yield pd.DataFrame([(r.file, n, [[{"x": x, "y": y} for x, y in p] for p in parts], rows[n] if n < len(rows) else {}) for n, parts in parse_shapes(r.content)], columns=["file", "feature_id", "parts", "attributes"])

    return both.mapInPandas(run, SCHEMA)


def points(features: DataFrame, conf: str = "Conf") -> DataFrame:
    """FLT5: (feature_id, x, y, conf) of a point layer; empty shapes go."""
    p = F.get(F.get("parts", 0), 0)
    return features.filter(F.size("parts") > 0).select("feature_id", p["x"].alias("x"), p["y"].alias("y"), F.element_at("attributes", conf).try_cast("double").alias("conf"))


def rings(features: DataFrame) -> DataFrame:
    """(feature_id, ring, attributes): the outer ring without its closing point; empty shapes go."""
    outer = F.get("parts", 0)
    return features.filter(F.size("parts") > 0).select("feature_id", F.slice(outer, 1, F.size(outer) - 1).alias("ring"), "attributes")


def window_pixels(blocks: DataFrame, windows: DataFrame, block: int) -> DataFrame:
    """SRC19: Pixels (raster_id, window_id, row, col, value) of windows (raster_id, window_id, x, y, w, h) from a pixel relation that is
    laid out by block: an equi-join on the blocks that each window touches."""
    c = F.col
    b = blocks.withColumn("bi", F.floor(c("row") / block)).withColumn("bj", F.floor(c("col") / block))
    span = lambda at, n: F.explode(F.sequence(F.floor(c(at) / block), F.floor((c(at) + c(n) - 1) / block)))
    w = windows.withColumn("bi", span("y", "h")).withColumn("bj", span("x", "w"))
    inside = (c("row") >= c("y")) & (c("row") < c("y") + c("h")) & (c("col") >= c("x")) & (c("col") < c("x") + c("w"))
    return b.join(w, ["raster_id", "bi", "bj"]).filter(inside).select("raster_id", "window_id", "row", "col", "value")


def cached(spark: SparkSession, path: str, version: str, fingerprint: str, make) -> DataFrame:
    """SRC22: The table at ``path`` if it was made by this version from files of this fingerprint; else ``make()``, written there."""
    try:
        old = spark.read.parquet(path)
        if old.filter((F.col("_version") == version) & (F.col("_fingerprint") == fingerprint)).limit(1).count():
            return old.drop("_version", "_fingerprint")
    except Exception:  # there is none yet
        pass
    make().withColumn("_version", F.lit(version)).withColumn("_fingerprint", F.lit(fingerprint)).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path).drop("_version", "_fingerprint")


def file_ages(files: DataFrame) -> DataFrame:
    """MSC3: (path, mib, days) and which is the latest, of a listing."""
    age = F.datediff(F.current_timestamp(), "modificationTime")
    newest = files.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("newest"))
    return files.join(F.broadcast(newest), F.lit(True)).select("path", (F.col("length") / 2**20).alias("mib"), age.alias("days"), (F.col("path") == F.col("newest")).alias("latest"))  # one row
