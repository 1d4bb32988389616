"""Deterministic views that turn the driver's tables into detections, points, tracks and so on.

Each view is one SELECT that Spark and a second engine read alike; ``view`` gives it as a DataFrame and ``cte`` as text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings"]

BASE = """SELECT o_orderkey, o_custkey, o_totalprice, (o_orderkey*37 + o_custkey*11) % 640 cx, (o_orderkey*53 + o_custkey*29) % 640 cy,
  20 + o_custkey % 21 w, 20 + o_orderkey % 17 h, (CAST(floor(o_totalprice) AS BIGINT) % 1000)/1000e0 conf FROM orders"""

VIEWS = {
    "base": ((), BASE),
    "gt": (("base",), """SELECT CAST(floor(o_orderkey/100e0) AS BIGINT) image_id, o_orderkey gt_id, o_custkey % 5 cls,
      cx - w/2e0 x1, cy - h/2e0 y1, cx + w/2e0 x2, cy + h/2e0 y2 FROM base"""),
    "pred": (("base",), """SELECT CAST(floor(o_orderkey/100e0) AS BIGINT) image_id, o_orderkey*2 det_id,
      CASE WHEN o_orderkey % 11 = 0 THEN (o_custkey+1) % 5 ELSE o_custkey % 5 END cls, conf,
      cx+dx-w/2e0 x1, cy+dy-h/2e0 y1, cx+dx+w/2e0 x2, cy+dy+h/2e0 y2
      FROM (SELECT *, o_custkey % 7 - 3 dx, o_orderkey % 5 - 2 dy FROM base) c WHERE o_orderkey % 10 <> 0
      UNION ALL
      SELECT CAST(floor(o_orderkey/100e0) AS BIGINT), o_orderkey*2+1, o_custkey % 5, conf/2e0,
      cx+6-w/2e0, cy+4-h/2e0, cx+6+w/2e0, cy+4+h/2e0 FROM base WHERE o_orderkey % 4 = 0"""),
    "obb": (("gt",), "SELECT image_id, gt_id, cls, (x1+x2)/2e0 cx, (y1+y2)/2e0 cy, x2-x1 w, y2-y1 h, (gt_id % 90) * 0.017453292519943295e0 theta FROM gt"),
    "raw": (("pred",), """SELECT image_id, det_id, cls, conf, (x1+x2)/2e0 cx, (y1+y2)/2e0 cy, x2-x1 w, y2-y1 h,
      CASE WHEN cls = 0 THEN conf ELSE conf/3e0 END s0, CASE WHEN cls = 1 THEN conf ELSE conf/4e0 END s1, CASE WHEN cls = 2 THEN conf ELSE conf/5e0 END s2 FROM pred"""),
    "points": (("pred",), "SELECT image_id, det_id, conf, (x1+x2)/2e0 px, (y1+y2)/2e0 py, 500000e0 + 0.33e0*((x1+x2)/2e0) x, 9800000e0 - 0.33e0*((y1+y2)/2e0) y FROM pred"),
    "roi": ((), "SELECT n_nationkey roi_id, n_regionkey category, 500000e0 + (n_nationkey % 5)*40e0 left_x, 9800000e0 - (n_nationkey % 7)*25e0 top_y, 30e0 + n_nationkey width, 20e0 + n_nationkey height FROM nation"),
    "track": ((), """SELECT user_id % 5 stream_id, user_id track_id, event_id, ts, value % 100e0 x, CAST(event_id % 480 AS DOUBLE) y,
      CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) frame FROM events"""),
    "pixel": ((), "SELECT l_linenumber channel, l_suppkey % 4 image, l_orderkey, CAST(floor(l_quantity*5e0) AS INT) % 256 value, l_partkey % 64 px_row, l_suppkey % 64 px_col, l_discount p0 FROM lineitem"),
    "raster": ((), "SELECT p_partkey raster_id, 300 + p_size*40 width, 300 + p_partkey % 2000 height FROM part"),
}


def needed(*names: str) -> list[str]:
    out: list[str] = []
    for n in names:
        out += [x for x in [*needed(*VIEWS[n][0]), n] if x not in out]
    return out


def cte(*names: str) -> str:
    """``WITH`` the named views and those that they read."""
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n][1]})" for n in needed(*names))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named view; tables are passed by reference, so no name is left in the catalog."""
    tables = {t: table(spark, sf_dir, t) for t in TABLES if any(f"FROM {t}" in VIEWS[n][1] for n in needed(name))}
    text = cte(name) + f" SELECT * FROM {name}"
    for t in tables:
        text = text.replace(f"FROM {t} ", f"FROM {{{t}}} ").replace(f"FROM {t})", f"FROM {{{t}}})").replace(f"FROM {t}\n", f"FROM {{{t}}}\n")
    return spark.sql(text, **tables)
