import random
import re

import numpy as np
import pytest

from tessera.llm import jaccard
from tessera.llm.components import components
from tessera.llm.jaccard import jaccard_components, op2_jaccard
from tests.llm.conftest import ODD


def brute(rows):
    """doc_id -> (n, component) by comparing all pairs."""
    sets = []
    for i, t in rows:
        t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        sets.append((i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())))
    above = {i: i for i, _ in sets}

    def top(x):
        while above[x] != x:
            x = above[x]
        return x

    by_size = sorted(sets, key=lambda x: len(x[1]))
    for a, (i, s) in enumerate(by_size):
        for j, r in by_size[a + 1 :]:
            if 100 * len(s) < 80 * len(r):
                break
            both = len(s & r)
            if s and 100 * both >= 80 * (len(s) + len(r) - both):
                x, y = sorted((top(i), top(j)))
                above[y] = x
    return {i: (len(s), top(i)) for i, s in sets}


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def near_copies(r, n):
    base = [f"w{r.randrange(500)}" for _ in range(200)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randrange(12)):
            w[r.randrange(len(w))] = f"v{r.randrange(9999)}"
        out.append(" ".join(w[: len(w) - r.randrange(30)]))
    return out


def test_equals_brute_force(spark, documents):
    r = random.Random(3)
    texts = [*ODD, *near_copies(r, 120), *near_copies(r, 40), *(" ".join(f"u{r.randrange(60)}" for _ in range(r.randrange(1, 15))) for _ in range(150))]
    line = "the common line that many of these texts share in the middle of all"
    texts += [" ".join(f"z{r.randrange(10**6)}" for _ in range(r.randrange(3, 20))) + " " + line for _ in range(150)]
    texts += r.sample(texts, 40)
    assert got(jaccard_components(documents(texts))) == brute(list(enumerate(texts)))


@pytest.mark.parametrize("slot, small", [(4, 2), (64, 2), (64, 40)])
def test_large_blocks_are_split_without_loss(spark, documents, monkeypatch, slot, small):
    monkeypatch.setattr(jaccard, "SLOT", slot)
    monkeypatch.setattr(jaccard, "SMALL", small)
    texts = near_copies(random.Random(8), 150)
    assert got(jaccard_components(documents(texts))) == brute(list(enumerate(texts)))


def test_tree_gives_each_pair_that_the_bound_allows():
    r = np.random.default_rng(1)
    points = r.poisson(2, (300, jaccard.GROUPS)).astype(np.int32)
    points[::2] = points[0] + (r.random((150, jaccard.GROUPS)) < 0.05)
    n = points.sum(axis=1)
    want = {(i, j) for i in range(300) for j in range(i) if 100 * min(n[i], n[j]) >= 80 * max(n[i], n[j]) and np.minimum(points[i], points[j]).sum() >= jaccard.least_overlap(n[i], n[j], 80)}
    found = [(max(i, int(j)), min(i, int(j))) for i, js in jaccard.Tree(points, n).pairs(80) for j in js]
    assert len(found) == len(set(found)) and set(found) == want


def test_points_bound_the_overlap():
    r = np.random.default_rng(2)
    for n in (3, 100, 3000, 20000):
        a = np.unique(r.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
        b = np.unique(np.concatenate([a[: len(a) * 9 // 10], r.integers(0, 2**63, n // 5, dtype=np.uint64) * np.uint64(2)]))
        both = len(np.intersect1d(a, b))
        p, q = jaccard.counts(a), jaccard.counts(b)
        assert both <= jaccard.overlap_bound(p, q) <= np.minimum(jaccard.point(p, 256), jaccard.point(q, 256)).sum()
        assert jaccard.point(p).sum() == len(a)


def test_long_near_copies(spark, documents):
    r = random.Random(5)
    base = [f"w{r.randrange(10**6)}" for _ in range(20000)]
    texts = [" ".join(base), " ".join(base[:18500]), " ".join(base[:15500]), " ".join(f"w{r.randrange(10**6)}" for _ in range(20000))]
    assert got(jaccard_components(documents(texts))) == brute(list(enumerate(texts)))


def test_whole_table(spark):
    import pyarrow.parquet as pq

    t = pq.read_table("/root/testdata/sf0.001/documents.parquet")
    assert got(op2_jaccard(spark, "/root/testdata/sf0.001")) == brute(list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True)))


def test_empty_null_ids_and_repeats(spark, documents):
    assert jaccard_components(documents([])).collect() == []
    rows = [(None, "a b c d e f", "en", "s", 1), (7, "a b c d e f", "en", "s", 1), (7, "A b c d e f", "en", "s", 1), (None, None, None, None, None)]
    df = documents([], rows)
    assert sorted(map(str, jaccard_components(df).collect())) == sorted(["Row(doc_id=None, n_shingles=2, component_id=7)", "Row(doc_id=7, n_shingles=2, component_id=7)", "Row(doc_id=7, n_shingles=2, component_id=7)", "Row(doc_id=None, n_shingles=0, component_id=None)"])


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5)], "a long, b long")
    assert {r.node: r.component for r in components(edges, "a", "b").collect()} == {i: 0 for i in range(61)} | {100: 100, 101: 100}
