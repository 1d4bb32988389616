"""Overlap joins, suppression and one-to-one matchings of detections.

Pairs are always found by an equi-join on the image plus range predicates; very large images can be given a grid ``cell`` so
that the equi-key is (image, cell). Order-dependent cores (greedy suppression, optimal assignment) run per image, and
class, in ``applyInPandas``: an image's boxes are bounded by its detector, not by the table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.box import EPS, Box, iou, overlap
from tessera.functions.polygon import contains, ring_box


def side(df: DataFrame, prefix: str, keep: list[str]) -> DataFrame:
    """``df`` with every column but ``keep`` under a prefix."""
    return df.select(*(F.col(c) if c in keep else F.col(c).alias(prefix + c) for c in df.columns))


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], cell: float | None = None) -> DataFrame:
    """Pairs of boxes of equal ``keys`` that overlap; columns get the prefixes l_ and r_.

    With ``cell``, boxes are put into the grid cells that they touch, and a pair is kept in the cell that holds the corner
    of its intersection alone: the same pairs, but no key is larger than a cell's boxes.
    """
    a, b = side(left, "l_", keys), side(right, "r_", keys)
    p, q = (Box(*(F.col(f"{s}{c}") for c in ("x1", "y1", "x2", "y2"))) for s in ("l_", "r_"))
    if cell is None:
        return a.join(b, keys).filter(overlap(p, q))

    def spread(df: DataFrame, s: str) -> DataFrame:
        at = lambda c: F.floor(F.col(f"{s}{c}") / cell)
        return df.withColumn("cell_x", F.explode(F.sequence(at("x1"), at("x2")))).withColumn("cell_y", F.explode(F.sequence(at("y1"), at("y2"))))

    owner = (F.col("cell_x") == F.floor(F.greatest(p.a, q.a) / cell)) & (F.col("cell_y") == F.floor(F.greatest(p.b, q.b) / cell))
    return spread(a, "l_").join(spread(b, "r_"), [*keys, "cell_x", "cell_y"]).filter(overlap(p, q) & owner).drop("cell_x", "cell_y")


def greedy_nms(df: DataFrame, keys: list[str], threshold: float, score: str = "conf", key: str = "det_id", most: int = 300, most_in: int = 30000) -> DataFrame:
    """Survivors of greedy suppression per ``keys``: best score first (ties by ``key``), a box goes if it overlaps a survivor
    by more than ``threshold``; at most ``most`` of the best ``most_in`` stay."""
    schema = df.schema

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([score, key], ascending=[False, True], kind="stable").head(most_in)
        x = pdf[["x1", "y1", "x2", "y2"]].to_numpy(float)
        areas = (x[:, 2] - x[:, 0]) * (x[:, 3] - x[:, 1])
        alive, keep = np.ones(len(x), bool), []
        for i in range(len(x)):
            if not alive[i]:
                continue
            keep.append(i)
            if len(keep) == most:
                break
            rest = slice(i + 1, None)
            w = np.minimum(x[i, 2], x[rest, 2]) - np.maximum(x[i, 0], x[rest, 0])
            h = np.minimum(x[i, 3], x[rest, 3]) - np.maximum(x[i, 1], x[rest, 1])
            inter = np.clip(w, 0, None) * np.clip(h, 0, None)
            with np.errstate(invalid="ignore", divide="ignore"):
                alive[rest] &= ~(inter / (areas[i] + areas[rest] - inter) > threshold)
        return pdf.iloc[keep]

    return df.groupBy(*keys).applyInPandas(run, schema)


def fast_nms(df: DataFrame, keys: list[str], similarity, threshold: float, score: str = "conf", key: str = "det_id", cell: float | None = None) -> DataFrame:
    """Boxes without any better-scored box (suppressed or not) at or above ``threshold``: one anti-join, no iteration. With ``cell``,
    boxes must overlap to be similar, and pairs are found by grid cell."""
    better = (F.col(f"r_{score}") > F.col(f"l_{score}")) | ((F.col(f"r_{score}") == F.col(f"l_{score}")) & (F.col(f"r_{key}") < F.col(f"l_{key}")))
    both = overlap_join(df, df, keys, cell) if cell else side(df, "l_", keys).join(side(df, "r_", keys), keys)
    hit = both.filter(better & (similarity("l_", "r_") >= threshold)).select(*keys, F.col(f"l_{key}").alias(key)).distinct()
    return df.join(hit, [*keys, key], "left_anti")


def pairs_iou(gt: DataFrame, pred: DataFrame, keys: list[str], cell: float | None = None) -> DataFrame:
    """(keys, gt_id, det_id, conf, iou) of overlapping pairs."""
    j = overlap_join(gt, pred, keys, cell)
    p, q = (Box(*(F.col(f"{s}{c}") for c in ("x1", "y1", "x2", "y2"))) for s in ("l_", "r_"))
    return j.select(*keys, F.col("l_gt_id").alias("gt_id"), F.col("r_det_id").alias("det_id"), F.col("r_conf").alias("conf"), F.col("l_cls").alias("gt_cls"), F.col("r_cls").alias("det_cls"), iou(p, q).alias("iou"))


def true_positives(pairs: DataFrame, thresholds: list[float], image: str = "image_id") -> DataFrame:
    """One-to-one matches at each threshold, within classes: each detection takes its best label (ties by gt_id), then each
    label keeps the detection of best confidence (ties by det_id), whatever the overlap.

    One shuffle by image, before each pair becomes a row for each threshold, serves both windows.
    """
    t = pairs.filter(f"gt_cls = det_cls AND iou >= {min(thresholds)!r}").repartition(image).withColumn("thr", F.explode(F.array(*(F.lit(x) for x in thresholds)))).filter("iou >= thr")
    best = t.withColumn("r", F.row_number().over(W.partitionBy("thr", image, "det_id").orderBy(F.desc("iou"), "gt_id"))).filter("r = 1")
    one = best.withColumn("r", F.row_number().over(W.partitionBy("thr", image, "gt_id").orderBy(F.desc("conf"), "det_id"))).filter("r = 1")
    return one.drop("r")


def confusion_matches(pairs: DataFrame, threshold: float = 0.45, image: str = "image_id") -> DataFrame:
    """Class-agnostic matches above ``threshold``: best label per detection, then best detection per label, both by overlap."""
    t = pairs.filter(F.col("iou") > threshold).repartition(image)  # serves both windows
    best = t.withColumn("r", F.row_number().over(W.partitionBy(image, "det_id").orderBy(F.desc("iou"), "gt_id"))).filter("r = 1")
    return best.withColumn("r", F.row_number().over(W.partitionBy(image, "gt_id").orderBy(F.desc("iou"), "det_id"))).filter("r = 1").drop("r")


def hungarian(cost: np.ndarray) -> list[tuple[int, int]]:
    """Assignment of least total cost of a finite matrix; rows and columns beyond the smaller side stay free."""
    if cost.size == 0:
        return []
    flip = cost.shape[0] > cost.shape[1]
    c = cost.T if flip else cost
    n, m = c.shape
    u, v, owner, way = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        least, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            i0 = owner[j0]
            slack = c[i0 - 1] - u[i0] - v[1:]
            free = ~used[1:]
            better = free & (slack < least[1:])
            least[1:][better] = slack[better]
            way[1:][better] = j0
            j1 = int(np.argmin(np.where(free, least[1:], np.inf))) + 1
            delta = least[j1]
            u[owner[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
            if owner[j0] == 0:
                break
        while j0:
            owner[j0] = owner[way[j0]]
            j0 = way[j0]
    out = [(int(owner[j]) - 1, j - 1) for j in range(1, m + 1) if owner[j]]
    return sorted((b, a) for a, b in out) if flip else sorted(out)


def components(near: np.ndarray) -> list[tuple[list[int], list[int]]]:
    """(rows, columns) of each group that pairs within ``near`` connect: no assignment under a limit crosses groups."""
    by_row, by_col = [np.flatnonzero(r).tolist() for r in near], [np.flatnonzero(c).tolist() for c in near.T]
    out, seen = [], set()
    for start in range(len(by_row)):
        if start in seen or not by_row[start]:
            continue
        seen.add(start)
        rows, cols, todo = [start], set(), [start]
        while todo:
            for j in by_row[todo.pop()]:
                if j not in cols:
                    cols.add(j)
                    more = [i for i in by_col[j] if i not in seen]
                    seen.update(more)
                    rows += more
                    todo += more
        out.append((sorted(rows), sorted(cols)))
    return out


def assign(cost: np.ndarray, limit: float) -> tuple[list[tuple[int, int]], list[int], list[int]]:
    """(pairs, free rows, free columns) of the assignment that leaves out pairs above ``limit`` at the cost of ``limit`` each."""
    n, m = cost.shape
    if not n or not m:
        return [], list(range(n)), list(range(m))
    pairs = []
    for rows, cols in components(cost <= limit):
        k, l = len(rows), len(cols)  # noqa: E741
        if min(k, l) == 1:  # the least of one row or column
            at = int(np.argmin(cost[np.ix_(rows, cols)]))
            pairs.append((rows[at // l], cols[at % l]))
            continue
        if min(k, l) == 1:  # the least of one row or column
            at = int(np.argmin(cost[np.ix_(rows, cols)]))
            pairs.append((rows[at // l], cols[at % l]))
            continue
        wide = np.full((k + l, k + l), limit / 2.0)
        wide[k:, l:] = 0
        wide[:k, :l] = cost[np.ix_(rows, cols)]
        pairs += [(rows[i], cols[j]) for i, j in hungarian(wide) if i < k and j < l and cost[rows[i], cols[j]] <= limit]
    pairs.sort()
    return pairs, sorted(set(range(n)) - {i for i, _ in pairs}), sorted(set(range(m)) - {j for _, j in pairs})


def optimal_matches(pairs: DataFrame, threshold: float, keys: list[str]) -> DataFrame:
    """(keys, gt_id, det_id, iou) of the assignment of largest total overlap among pairs at or above ``threshold``."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["gt_id", "det_id"])
        m = pdf.pivot(index="gt_id", columns="det_id", values="iou").fillna(0.0)
        cost = m.to_numpy(float)
        got = [(m.index[i], m.columns[j], cost[i, j]) for i, j in hungarian(-cost) if cost[i, j] > 0]
        head = {k: pdf[k].iloc[0] for k in keys}
        return pd.DataFrame([{**head, "gt_id": g, "det_id": d, "iou": x} for g, d, x in got], columns=[*keys, "gt_id", "det_id", "iou"])

    some = pairs.filter(F.col("iou") >= threshold).select(*keys, "gt_id", "det_id", "iou")
    return some.groupBy(*keys).applyInPandas(run, some.schema)


#: Weights of class, distance and overlap in a set matching's cost, and the shape of its class cost.
CLASS_COST, L1_COST, GIOU_COST, ALPHA, GAMMA = 1.0, 5.0, 2.0, 0.25, 2.0


def set_cost(scores: np.ndarray, found: np.ndarray, classes: np.ndarray, truth: np.ndarray) -> np.ndarray:
    """(detections, labels): the cost of each pair. ``scores`` are probabilities per class, boxes are (cx, cy, w, h) as shares."""
    p = scores[:, classes]
    hit, miss = ALPHA * (1 - p) ** GAMMA * -np.log(p + 1e-8), (1 - ALPHA) * p**GAMMA * -np.log(1 - p + 1e-8)
    l1 = np.abs(found[:, None] - truth[None]).sum(axis=2)
    corners = lambda b: (b[..., 0] - b[..., 2] / 2, b[..., 1] - b[..., 3] / 2, b[..., 0] + b[..., 2] / 2, b[..., 1] + b[..., 3] / 2)
    a, b = corners(found[:, None]), corners(truth[None])
    both = np.clip(np.minimum(a[2], b[2]) - np.maximum(a[0], b[0]), 0, None) * np.clip(np.minimum(a[3], b[3]) - np.maximum(a[1], b[1]), 0, None)
    either = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both + EPS
    around = (np.maximum(a[2], b[2]) - np.minimum(a[0], b[0])) * (np.maximum(a[3], b[3]) - np.minimum(a[1], b[1])) + EPS
    cost = CLASS_COST * (hit - miss) + L1_COST * l1 + GIOU_COST * (1 - (both / either - (around - either) / around))
    return np.where(np.isfinite(cost), cost, 0.0)


def set_matches(truth: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, gt_id, det_id, cost) of the assignment of least total cost in each image, as many pairs as the smaller side has.

    ``truth`` has gt_id, cls and ``found`` det_id, scores (array), both cx, cy, w, h as shares. An image's boxes are bounded.
    """
    from itertools import chain

    def run(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        names = [*keys, "gt_id", "det_id", "cost"]
        if a.empty or b.empty:
            return pd.DataFrame(columns=names)
        a, b = a.sort_values("gt_id"), b.sort_values("det_id")
        boxes = ["cx", "cy", "w", "h"]
        cost = set_cost(np.stack(b["scores"].to_numpy()).astype(float), b[boxes].to_numpy(float), a["cls"].to_numpy(int), a[boxes].to_numpy(float))
        return pd.DataFrame([[*key, a["gt_id"].iloc[j], b["det_id"].iloc[i], cost[i, j]] for i, j in hungarian(cost)], columns=names)

    kinds = dict(chain(truth.dtypes, found.dtypes))
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + f", gt_id {kinds['gt_id']}, det_id {kinds['det_id']}, cost double"
    return truth.groupBy(*keys).cogroup(found.groupBy(*keys)).applyInPandas(run, schema)


def descaled(found: DataFrame, scale: float, mirrored: bool, width: float) -> DataFrame:
    """Boxes found on an image that was scaled, and perhaps mirrored, on the image's own scale (of ``width``)."""
    x = [F.col(c) / scale for c in ("x1", "x2")]
    x = [width - x[1], width - x[0]] if mirrored else x
    new = {"x1": x[0], "x2": x[1], "y1": F.col("y1") / scale, "y2": F.col("y2") / scale}
    return found.select(*(new[c].alias(c) if c in new else F.col(c) for c in found.columns))


def radius_matches(truth: DataFrame, found: DataFrame, keys: list[str], radius: float, nearest: bool = False, parity: bool = True) -> DataFrame:
    """(keys, tp, fp, fn): truth points in id order each take a free found point closer than radius * sqrt(2): the first in id
    order or, with ``nearest``, the nearest. With ``parity``, a truth point met after found points ran out isn't a miss."""
    from itertools import chain

    reach = radius * np.sqrt(2)
    names = ["x", "y", "id"]

    def run(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        t, f = (d.sort_values("id")[["x", "y"]].to_numpy(float) for d in (a, b))
        free, tp, fn = np.ones(len(f), bool), 0, 0
        for p in t:
            if not free.any():
                if not parity:
                    fn += 1
                continue
            d = np.where(free, np.hypot(*(f - p).T), np.inf)
            hit = np.flatnonzero(d < reach)
            if len(hit):
                free[hit[np.argmin(d[hit])] if nearest else hit[0]] = False
                tp += 1
            else:
                fn += 1
        return pd.DataFrame([[*key, tp, int(free.sum()), fn]], columns=[*keys, "tp", "fp", "fn"])

    kinds = dict(chain(truth.dtypes, found.dtypes))
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", tp long, fp long, fn long"
    return truth.select(*keys, *names).groupBy(*keys).cogroup(found.select(*keys, *names).groupBy(*keys)).applyInPandas(run, schema)


def oks(a: list[tuple[Column, Column]], b: list[tuple[Column, Column]], sigmas: list[float], size: Column) -> Column:
    """Object keypoint similarity."""
    terms = [F.exp(-((p[0] - q[0]) * (p[0] - q[0]) + (p[1] - q[1]) * (p[1] - q[1])) / ((2 * s) ** 2 * (size + EPS) * 2)) for p, q, s in zip(a, b, sigmas, strict=True)]
    return sum(terms[1:], terms[0]) / len(terms)


def grid_local_max(points: DataFrame, block: int = 1024) -> DataFrame:
    """(row, col, n, conf) of pixels that hold more points than any neighbour of their block, or as many and better ones."""
    c = F.col
    cells = points.groupBy(F.floor(c("row") / block).alias("bi"), F.floor(c("col") / block).alias("bj"), "row", "col").agg(F.count("*").alias("n"), F.max("conf").alias("conf"))
    steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j))
    shifted = cells.withColumn("s", F.explode(steps)).select("bi", "bj", (c("row") + c("s.i")).alias("row"), (c("col") + c("s.j")).alias("col"), c("n").alias("on"), c("conf").alias("oc"))
    around = shifted.groupBy("bi", "bj", "row", "col").agg(F.max("on").alias("on"), F.max("oc").alias("oc"))
    joined = cells.join(around, ["bi", "bj", "row", "col"], "left")
    wins = c("on").isNull() | (c("n") > c("on")) | ((c("n") == c("on")) & (c("conf") > c("oc")))
    return joined.filter(wins).select("row", "col", "n", "conf")


def points_within(points: DataFrame, areas: DataFrame) -> DataFrame:
    """Pairs of points (x, y) and upright areas (left_x, top_y, width, height), borders outside: a range join."""
    c = F.col
    return points.join(areas, (c("x") > c("left_x")) & (c("x") < c("left_x") + c("width")) & (c("y") < c("top_y")) & (c("y") > c("top_y") - c("height")))


def points_within_rings(points: DataFrame, areas: DataFrame) -> DataFrame:
    """Pairs of points (x, y) and areas with a ``ring``: a range join on the rings' boxes, then ray casting."""
    c = F.col
    b = ring_box(c("ring"))
    boxed = areas.select("*", b.a.alias("_x1"), b.b.alias("_y1"), b.c.alias("_x2"), b.d.alias("_y2"))
    near = points.join(boxed, c("x").between(c("_x1"), c("_x2")) & c("y").between(c("_y1"), c("_y2")))
    return near.filter(contains(c("ring"), c("x"), c("y"))).drop("_x1", "_y1", "_x2", "_y2")
