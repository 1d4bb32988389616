"""Shapes that need more than a column expression: rectangles around points, clipping, contours, seams; Arrow functions per row."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RING = "array<struct<x: double, y: double>>"


def _xy(ring) -> np.ndarray:
    return np.array([(p["x"], p["y"]) for p in ring], float).reshape(-1, 2) if ring is not None else np.zeros((0, 2))


def hull(p: np.ndarray) -> np.ndarray:
    """Convex hull, counter-clockwise, by a monotone chain."""
    p = np.unique(p, axis=0)
    if len(p) < 3:
        return p

    def half(points):
        out: list = []
        for q in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-1][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-1][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(half(p) + half(p[::-1]))


def least_rectangle(p: np.ndarray) -> tuple[float, float, float, float, float]:
    """(cx, cy, w, h, theta) of the rectangle of least area around points; one of its sides lies on the hull."""
    h = hull(p)
    if not len(h):
        return (0.0,) * 5
    if len(h) < 3:
        a, b = h[0], h[-1]
        return (*((a + b) / 2), float(np.hypot(*(b - a))), 0.0, math.atan2(*(b - a)[::-1]))
    best = None
    for a, b in zip(h, np.roll(h, -1, axis=0), strict=True):
        t = math.atan2(b[1] - a[1], b[0] - a[0])
        turn = np.array([[math.cos(t), math.sin(t)], [-math.sin(t), math.cos(t)]])
        q = h @ turn.T
        lo, hi = q.min(axis=0), q.max(axis=0)
        w, height = hi - lo
        if best is None or w * height < best[0] - 1e-12:
            c = turn.T @ ((lo + hi) / 2)
            best = (w * height, float(c[0]), float(c[1]), float(w), float(height), t)
    return best[1:]


def rectangles(ring: Column) -> Column:
    @F.pandas_udf("cx double, cy double, w double, h double, theta double")
    def of(r: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([least_rectangle(_xy(x)) for x in r], columns=["cx", "cy", "w", "h", "theta"])

    return of(ring)


def clipped(p: np.ndarray, x1: float, y1: float, x2: float, y2: float) -> np.ndarray:
    """A ring cut to an upright box, side by side."""
    for axis, limit, sign in ((0, x1, 1), (0, x2, -1), (1, y1, 1), (1, y2, -1)):
        out = []
        for a, b in zip(p, np.roll(p, -1, axis=0), strict=True):
            da, db = sign * (a[axis] - limit), sign * (b[axis] - limit)
            if da >= 0:
                out.append(a)
            if da * db < 0:
                out.append(a + (b - a) * da / (da - db))
        p = np.array(out).reshape(-1, 2)
        if not len(p):
            break
    return p


def ring_area(p: np.ndarray) -> float:
    return abs(float(np.dot(p[:, 0], np.roll(p[:, 1], -1)) - np.dot(p[:, 1], np.roll(p[:, 0], -1)))) / 2 if len(p) > 2 else 0.0


def share_inside(ring: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """How much of a polygon lies in a box."""

    @F.pandas_udf("double")
    def of(r: pd.Series, a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([ring_area(clipped(_xy(x), *box)) / max(ring_area(_xy(x)), 1e-12) for x, *box in zip(r, a, b, c, d, strict=True)])

    return of(ring, x1, y1, x2, y2)


def contours(on: set[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """Outer borders (x, y) of the 8-connected regions of pixels (row, col): each is walked round from its first pixel."""
    turn = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]
    left, out = set(on), []
    while left:
        first = min(left)
        region, todo = {first}, [first]
        while todo:
            y, x = todo.pop()
            for dy, dx in turn:
                q = (y + dy, x + dx)
                if q in left and q not in region:
                    region.add(q)
                    todo.append(q)
        left -= region
        path, at, back = [first], first, 4
        start = None
        for _ in range(8 * len(region) + 8):
            for k in range(1, 9):
                d = (back + k) % 8
                q = (at[0] + turn[d][0], at[1] + turn[d][1])
                if q in region:
                    break
            else:
                break
            if start is None:
                start = (at, d)
            elif (at, d) == start:
                break
            at, back = q, (d + 4) % 8
            path.append(at)
        if len(path) > 1 and path[-1] == first:
            path.pop()
        out.append([(x, y) for y, x in path])
    return out


def mask_rings(pixels: DataFrame, keys: list[str], strategy: str = "largest") -> DataFrame:
    """(keys, ring) of masks that are pixel relations (row, col): the longest border, or all of them in a row (``concat``)."""
    if strategy not in ("largest", "concat"):
        raise ValueError("strategy is largest or concat")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = contours(set(zip(pdf["row"].astype(int), pdf["col"].astype(int), strict=True)))
        path = max(found, key=len) if strategy == "largest" else [p for c in found for p in c]
        return pd.DataFrame([[*(pdf[k].iloc[0] for k in keys), [{"x": float(x), "y": float(y)} for x, y in path]]], columns=[*keys, "ring"])

    kinds = dict(pixels.dtypes)
    return pixels.groupBy(*keys).applyInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + f", ring {RING}")


def seam(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """JN30: places of the closest points of two rings."""
    d = ((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2)
    i, j = np.unravel_index(d.argmin(), d.shape)
    return int(i), int(j)


def stitched(parts: list[np.ndarray]) -> np.ndarray:
    """One ring of several: each next one is entered at its seam, walked round, and left where it was entered."""
    ring = parts[0]
    for p in parts[1:]:
        i, j = seam(ring, p)
        ring = np.concatenate([ring[: i + 1], np.roll(p, -j, axis=0), p[j : j + 1], ring[i:]])
    return ring


def cleaned_masks(pixels: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Pixels without regions smaller than ``least``, and with holes smaller than that filled; if all are small the largest stays."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        on = set(zip(pdf["row"].astype(int), pdf["col"].astype(int), strict=True))

        def regions(cells: set) -> list[set]:
            left, out = set(cells), []
            while left:
                todo = [left.pop()]
                found = set(todo)
                while todo:
                    y, x = todo.pop()
                    for q in ((y + dy, x + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)):
                        if q in left:
                            left.remove(q)
                            found.add(q)
                            todo.append(q)
                out.append(found)
            return out

        ys, xs = [y for y, _ in on], [x for _, x in on]
        frame = {(y, x) for y in range(min(ys) - 1, max(ys) + 2) for x in range(min(xs) - 1, max(xs) + 2)}
        for hole in regions(frame - on):
            if len(hole) < least and not any(y in (min(ys) - 1, max(ys) + 1) or x in (min(xs) - 1, max(xs) + 1) for y, x in hole):
                on |= hole
        parts = regions(on)
        kept = [r for r in parts if len(r) >= least] or [max(parts, key=lambda r: (len(r), [-v for v in min(r)]))]
        cells = sorted(c for r in kept for c in r)
        out = pd.DataFrame(cells, columns=["row", "col"])
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[[*keys, "row", "col"]]

    kinds = dict(pixels.dtypes)
    return pixels.select(*keys, "row", "col").groupBy(*keys).applyInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", row long, col long")


def point_grid(n: int) -> list[tuple[float, float]]:
    """n by n points in the middle of even cells of the unit square, row by row."""
    at = [(i + 0.5) / n for i in range(n)]
    return [(x, y) for y in at for x in at]


def register(spark) -> None:
    """SQL functions under one prefix, and a table function for tiles: ``tess_iou``, ``tess_tiles``."""
    from pyspark.sql.functions import udtf

    @F.pandas_udf("double")
    def tess_iou(a1: pd.Series, b1: pd.Series, a2: pd.Series, b2: pd.Series, c1: pd.Series, d1: pd.Series, c2: pd.Series, d2: pd.Series) -> pd.Series:
        w = np.minimum(a2, c2) - np.maximum(a1, c1)
        h = np.minimum(b2, d2) - np.maximum(b1, d1)
        inter = w.clip(lower=0) * h.clip(lower=0)
        return inter / ((a2 - a1) * (b2 - b1) + (c2 - c1) * (d2 - d1) - inter + 1e-7)

    @udtf(returnType="x long, y long, w long, h long")
    class Tiles:
        def eval(self, width: int, height: int, size: int):
            for x in range(0, width, size):
                for y in range(0, height, size):
                    yield x, y, min(size, width - x), min(size, height - y)

    spark.udf.register("tess_iou", tess_iou)
    spark.udtf.register("tess_tiles", Tiles)
