"""Queries that SQL can't express, whole results against plain loops."""

import itertools
from collections import defaultdict

import numpy as np
import pytest

from tessera.operators import matching as M
from tessera.plans.fixtures import view
from tessera.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def by(items, *keys):
    out = defaultdict(list)
    for r in items:
        out[tuple(r[k] for k in keys)].append(r)
    return out


def area(a):
    return max(0, a["x2"] - a["x1"]) * max(0, a["y2"] - a["y1"])


def meet(a, b):
    return max(0, min(a["x2"], b["x2"]) - max(a["x1"], b["x1"])) * max(0, min(a["y2"], b["y2"]) - max(a["y1"], b["y1"]))


def greedy(items, score, limit):
    kept = []
    for a in sorted(items, key=lambda r: (-score(r), r["det_id"])):
        if len(kept) < 300 and all(meet(a, b) / (area(a) + area(b) - meet(a, b)) <= limit for b in kept):
            kept.append(a)
    return kept


def test_nms_masks(spark):
    want = set()
    for (image,), items in by(rows(view(spark, SF, "pred")), "image_id").items():
        crops = defaultdict(list)
        for r in items:
            crops[int((r["x1"] + r["x2"]) / 2 // 320), int((r["y1"] + r["y2"]) / 2 // 320)].append(r)
        stay = [r for c in crops.values() for r in greedy(c, lambda r: r["conf"], 0.7)]
        want |= {(image, r["det_id"], r["cls"]) for r in greedy(stay, lambda r: 1 / max(area(r), 1.0), 0.7)}
    assert {(r["image_id"], r["det_id"], r["cls"]) for r in rows(QUERIES["nms_masks"](spark, SF))} == want


def regions(cells):
    left, out = set(cells), []
    while left:
        todo = [left.pop()]
        found = set(todo)
        while todo:
            y, x = todo.pop()
            near = {(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)} & left
            left -= near
            found |= near
            todo += near
        out.append(found)
    return out


def pixels(spark, least):
    out = defaultdict(set)
    for r in rows(view(spark, SF, "pixel")):
        if r["value"] > least:
            out[r["image"]].add((r["px_row"], r["px_col"]))
    return out


def test_connected_regions(spark):
    want = set()
    for image, on in pixels(spark, 225).items():
        for g in regions(on):
            want.add((image, sorted(on).index(min(g)), len(g), round(sum(y for y, _ in g) / len(g), 9), round(sum(x for _, x in g) / len(g), 9)))
    assert {(r["image"], r["label"], r["n"], round(r["row"], 9), round(r["col"], 9)) for r in rows(QUERIES["connected_regions"](spark, SF))} == want


def test_cleaned_regions(spark):
    want, changed = set(), 0
    for image, on in pixels(spark, 200).items():
        frame = {(y, x) for y in range(-1, 66) for x in range(-1, 66)}
        filled = on | {c for g in regions(frame - on) if len(g) < 6 and all(min(y for y, _ in on) <= y <= max(y for y, _ in on) and min(x for _, x in on) <= x <= max(x for _, x in on) for y, x in g) for c in g}
        parts = regions(filled)
        big = [g for g in parts if len(g) >= 6]
        assert big
        want |= {(image, y, x) for g in big for y, x in g}
        changed += len(on ^ set().union(*big))
    assert changed > 10 and {(r["image"], r["row"], r["col"]) for r in rows(QUERIES["cleaned_regions"](spark, SF))} == want


def test_mask_contours(spark):
    """Every border walks its mask's largest outline: neighbours all the way round, and only pixels at the outer border."""
    on = defaultdict(set)
    for r in rows(view(spark, SF, "pixel")):
        if r["value"] > 200:
            on[r["image"], r["channel"]].add((r["px_row"], r["px_col"]))
    got = {(r["image"], r["channel"]): [(int(p["y"]), int(p["x"])) for p in r["ring"]] for r in rows(QUERIES["mask_contours"](spark, SF))}
    assert got.keys() == on.keys()
    frame = {(y, x) for y in range(-1, 66) for x in range(-1, 66)}

    def outside(cells):
        todo, seen = [(-1, -1)], {(-1, -1)}
        while todo:
            y, x = todo.pop()
            for q in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                if q in frame and q not in cells and q not in seen:
                    seen.add(q)
                    todo.append(q)
        return seen

    for k, ring in got.items():
        (home,) = [g for g in regions(on[k]) if ring[0] in g]
        free = outside(home)
        border = {(y, x) for y, x in home if {(y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)} & free}
        assert set(ring) >= border and set(ring) <= home
        assert len(ring) == 1 or all(max(abs(a[0] - b[0]), abs(a[1] - b[1])) == 1 for a, b in zip(ring, ring[1:] + ring[:1]))


def test_optimal_matching(spark):
    """Largest total overlap per image: no image's total can be raised along an alternating path of any pairs."""
    from tessera.plans.q_eval import pairs

    all_pairs = by([r for r in rows(pairs(spark, SF)) if r["gt_cls"] == r["det_cls"] and r["iou"] >= 0.5], "image_id")
    got = by(rows(QUERIES["optimal_matching"](spark, SF)), "image_id")
    for image, items in all_pairs.items():
        mine = got[image]
        assert len({r["gt_id"] for r in mine}) == len(mine) == len({r["det_id"] for r in mine})
        near = defaultdict(list)
        for r in items:
            near[r["gt_id"]].append(r)
        best = 0.0
        for part in parts_of(items):  # small groups, all ways tried
            labels = sorted({r["gt_id"] for r in part})
            best += most(labels, {g: [(r["det_id"], r["iou"]) for r in part if r["gt_id"] == g] for g in labels}, frozenset())
        assert sum(r["iou"] for r in mine) == pytest.approx(best)


def parts_of(items):
    left, out = list(items), []
    while left:
        part = [left.pop()]
        while True:
            more = [r for r in left if any(r["gt_id"] == p["gt_id"] or r["det_id"] == p["det_id"] for p in part)]
            if not more:
                break
            part += more
            left = [r for r in left if r not in more]
        out.append(part)
    return out


def most(labels, choices, used):
    if not labels:
        return 0.0
    rest = most(labels[1:], choices, used)
    return max([rest, *(x + most(labels[1:], choices, used | {d}) for d, x in choices[labels[0]] if d not in used)])


def test_set_matching(spark):
    from tessera.plans.q_eval import set_sides

    truth, found = (by(rows(x), "image_id") for x in set_sides(spark, SF))
    got = by(rows(QUERIES["set_matching"](spark, SF)), "image_id")
    for image, labels in truth.items():
        dets, mine = found[image], got[image]
        assert len(mine) == min(len(labels), len(dets)) == len({r["gt_id"] for r in mine}) == len({r["det_id"] for r in mine})
    r = np.random.default_rng(1)
    for n, m in ((3, 5), (5, 3), (4, 4)):
        cost = M.set_cost(r.random((n, 5)), r.random((n, 4)) / 2, r.integers(0, 5, m), r.random((m, 4)) / 2)
        total = sum(cost[i, j] for i, j in M.hungarian(cost))
        small = cost if n <= m else cost.T
        assert total == pytest.approx(min(sum(small[i, p[i]] for i in range(len(small))) for p in itertools.permutations(range(small.shape[1]), len(small))))


def test_set_cost_of_one_pair():
    import math

    p, found, truth = 0.7, (0.5, 0.5, 0.2, 0.2), (0.55, 0.5, 0.2, 0.2)
    cost = M.set_cost(np.array([[0.1, p]]), np.array([found]), np.array([1]), np.array([truth]))[0, 0]
    focal = 0.25 * 0.3**2 * -math.log(p) - 0.75 * 0.7**2 * -math.log(0.3)
    giou = 0.15 / 0.25 - (0.25 - 0.25) / 0.25
    assert cost == pytest.approx(focal + 5 * 0.05 + 2 * (1 - giou * 0.2 / 0.2), abs=1e-5)


def test_pruned_blocks_lose_nothing(spark, monkeypatch):
    from tessera.operators import explorer as X

    monkeypatch.setattr(X, "BLOCK", 100)
    r = np.random.default_rng(2)
    middle = r.normal(0, 5, (6, 8))
    v = np.concatenate([m + r.normal(0, 0.3, (300, 8)) for m in middle]).astype(np.float32)
    df = spark.createDataFrame([(i, [float(x) for x in u]) for i, u in enumerate(v)], "vec_id long, embedding array<float>")
    d = ((v[:, None].astype(float) - v[None]) ** 2).sum(axis=2)
    got = {x.vec_id: list(x.similar) for x in X.similarity_index(df, 1.5).collect()}
    assert got == {i: [int(j) for j in sorted(np.flatnonzero(d[i] <= 1.5), key=lambda j: (d[i, j], j))] for i in range(len(v))}


def test_index_is_remembered(spark, tmp_path):
    from tessera.operators import explorer as X

    def table(shift):
        spark.createDataFrame([(i, [float(i + shift), 0.0]) for i in range(5)], "vec_id long, embedding array<float>").write.mode("overwrite").parquet(str(tmp_path / "v"))
        return spark.read.parquet(str(tmp_path / "v"))

    read = lambda df: sorted((r.vec_id, r["count"]) for r in X.remembered_index(df, "v", 1.0).collect())
    t = table(0)
    first = X.remembered_index(t, "v", 1.0)
    at = {f: __import__("os").path.getmtime(f.removeprefix("file://")) for f in first.inputFiles()}
    assert set(X.remembered_index(t, "v", 1.0).inputFiles()) == set(at)
    assert {f: __import__("os").path.getmtime(f.removeprefix("file://")) for f in X.remembered_index(t, "v", 1.0).inputFiles()} == at
    assert set(X.remembered_index(t, "v", 1.0, force=True).inputFiles()) != set(at)
    assert read(t) == [(0, 2), (1, 3), (2, 3), (3, 3), (4, 2)]
    assert set(X.remembered_index(table(3), "v", 1.0).inputFiles()).isdisjoint(at)
