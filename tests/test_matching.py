import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import box as B
from tessera.functions import polygon as P
from tessera.operators import matching as M

BOXES = "image_id long, det_id long, cls long, conf double, x1 double, y1 double, x2 double, y2 double"


def boxes(spark, n, seed=0, images=2):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        x, y, w, h = r.uniform(0, 90), r.uniform(0, 90), r.uniform(5, 40), r.uniform(5, 40)
        rows.append((i % images, i, i % 3, r.choice([0.1, 0.5, 0.5, 0.9, r.random()]), x, y, x + w, y + h))
    return rows, spark.createDataFrame(rows, BOXES)


def iou(a, b):
    w, h = min(a[6], b[6]) - max(a[4], b[4]), min(a[7], b[7]) - max(a[5], b[5])
    inter = max(w, 0) * max(h, 0)
    return inter / ((a[6] - a[4]) * (a[7] - a[5]) + (b[6] - b[4]) * (b[7] - b[5]) - inter)


def test_greedy_suppression_equals_brute_force(spark):
    rows, df = boxes(spark, 120)
    want = set()
    for image, cls in itertools.product(range(2), range(3)):
        kept = []
        for r in sorted((r for r in rows if r[0] == image and r[2] == cls), key=lambda r: (-r[3], r[1])):
            if all(iou(r, k) <= 0.3 for k in kept):
                kept.append(r)
        want |= {k[1] for k in kept}
    assert {r.det_id for r in M.greedy_nms(df, ["image_id", "cls"], 0.3).collect()} == want
    assert M.greedy_nms(df, ["image_id"], 0.3, most=3).count() == 6
    assert M.greedy_nms(df.filter("false"), ["image_id"], 0.3).collect() == []


def test_overlap_join_by_cells_gives_the_same_pairs(spark):
    _, df = boxes(spark, 80)
    plain = M.overlap_join(df, df, ["image_id"])
    cells = M.overlap_join(df, df, ["image_id"], cell=16.0)
    key = lambda d: sorted((r.l_det_id, r.r_det_id) for r in d.collect())
    assert key(plain) == key(cells)


@pytest.mark.parametrize("shape", [(1, 1), (3, 5), (5, 3), (4, 4), (0, 3)])
def test_assignment_is_optimal(shape):
    r = np.random.default_rng(sum(shape))
    for _ in range(20):
        c = r.random(shape).round(2)
        got = M.hungarian(c)
        n = min(shape)
        assert len(got) == n and len({i for i, _ in got}) == n and len({j for _, j in got}) == n
        if n:
            long = c if shape[0] <= shape[1] else c.T
            best = min(sum(long[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(long.shape[1]), n))
            assert sum(c[i, j] for i, j in got) == pytest.approx(best)


def test_assignment_with_limit():
    pairs, rows, cols = M.assign(np.array([[0.1, 0.9], [0.95, 0.99]]), 0.8)
    assert (pairs, rows, cols) == ([(0, 0)], [1], [1])
    assert M.assign(np.zeros((0, 2)), 0.5) == ([], [], [0, 1])


def test_label_keeps_first_detection_by_confidence_not_overlap(spark):
    pairs = spark.createDataFrame([(0, 1, 10, 0.9, 0, 0, 0.6), (0, 1, 11, 0.8, 0, 0, 0.9), (0, 2, 11, 0.8, 0, 0, 0.55)], "image_id long, gt_id long, det_id long, conf double, gt_cls long, det_cls long, iou double")
    assert [(r.gt_id, r.det_id) for r in M.true_positives(pairs, [0.5]).collect()] == [(1, 10)]
    assert [(r.gt_id, r.det_id) for r in M.confusion_matches(pairs).collect()] == [(1, 11)]


def test_radius_matching_quirks(spark):
    s = "k long, id long, x double, y double"
    truth = spark.createDataFrame([(0, 0, 0.0, 0.0), (0, 1, 5.0, 0.0), (0, 2, 50.0, 0.0)], s)
    found = spark.createDataFrame([(0, 0, 6.0, 0.0), (0, 1, 0.5, 0.0)], s)
    got = lambda **a: tuple(M.radius_matches(truth, found, ["k"], 5.0, **a).first())[1:]
    assert got() == (2, 0, 0)  # the third truth comes after the last found point: not counted as missed
    assert got(parity=False) == (2, 0, 1)
    assert got(nearest=True, parity=False) == (2, 0, 1)


def test_centroid_and_containment(spark):
    ring = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (4, 0), (4, 2), (0, 2))))
    x, y, area = P.centroid(ring)
    row = spark.range(1).select(x, y, area, P.contains(ring, F.lit(1.0), F.lit(1.0)), P.contains(ring, F.lit(5.0), F.lit(1.0))).first()
    assert tuple(row) == (2.0, 1.0, 8.0, True, False)


def test_projection_known_places(spark):
    e, n = P.utm(F.lit(33.0), F.lit(0.0), 36, south=False)
    assert spark.range(1).select(F.round(e, 3), F.round(n, 3)).first()[:] == (500000.0, 0.0)
    e, n = P.utm(F.lit(34.0), F.lit(-2.0), 36, south=True)
    row = spark.range(1).select(e, n).first()
    assert row[0] == pytest.approx(611203, abs=60) and row[1] == pytest.approx(9778905, abs=60)


def test_box_round_trips(spark):
    r = random.Random(4)
    rows = [tuple(sorted((r.random(), r.random()))) + tuple(sorted((r.random(), r.random()))) for _ in range(50)]
    df = spark.createDataFrame([(a, c, b, d) for a, b, c, d in rows], "x1 double, y1 double, x2 double, y2 double")
    x = B.box()
    for back in (B.xywh_to_xyxy(B.xyxy_to_xywh(x)), B.ltwh_to_xyxy(B.xyxy_to_ltwh(x)), B.xywhn_to_xyxy(B.xyxy_to_xywhn(x, 640.0, 480.0), 640.0, 480.0)):
        for row in df.select(*(F.abs(p - q).alias(f"d{i}") for i, (p, q) in enumerate(zip(x, back, strict=True)))).collect():
            assert max(row) < 1e-12
    corners = B.obb_corners(F.lit(3.0), F.lit(4.0), F.lit(5.0), F.lit(2.0), F.lit(0.3))
    assert spark.range(1).select(*B.obb_from_corners(corners)).first()[:] == pytest.approx((3, 4, 5, 2, 0.3))


def test_assignment_by_groups_costs_the_least():
    r = np.random.default_rng(3)
    for _ in range(60):
        n, m = r.integers(1, 6, 2)
        cost, limit = np.where(r.random((n, m)) < 0.5, r.random((n, m)), 1.0), 0.7
        pairs, rows, cols = M.assign(cost, limit)
        assert sorted([i for i, _ in pairs] + rows) == list(range(n)) and sorted([j for _, j in pairs] + cols) == list(range(m))
        least = lambda i, left: 0.0 if i == n else min([least(i + 1, left)] + [cost[i, j] - limit + least(i + 1, left - {j}) for j in left if cost[i, j] <= limit])
        assert abs(sum(cost[i, j] - limit for i, j in pairs) - least(0, frozenset(range(m)))) < 1e-9
