import math

from tessera.plans.registry import QUERIES


def unit(v):
    n = math.sqrt(sum(x * x for x in v))
    return [x / n for x in v]


def test_moving_vectors_fold_every_row(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("label", "vec_id", "embedding").collect()
    want, folded = {}, {}
    for r in sorted(rows, key=lambda r: r.vec_id):
        u, acc = unit(r.embedding), want.get(r.label)
        want[r.label] = u if acc is None else unit([0.9 * a + 0.1 * x for a, x in zip(acc, u)])
        folded[r.label] = folded.get(r.label, 0) + 1
    assert max(folded.values()) > 51
    got = {r.label: r.vector for r in QUERIES["moving_vectors"](spark, sf).collect()}
    assert got.keys() == want.keys()
    assert all(abs(x - y) < 2e-6 for k in want for x, y in zip(got[k], want[k]))
