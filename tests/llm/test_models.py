import zlib

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tessera.llm.pu_quality import BINS, best_bin, bins, features, fit_pu, fit_quality, moments, moments_of, op3_pu_quality, score_quality
from tessera.llm.toxicity import GRADES, fit_ordinal, fit_toxicity, op7_toxicity, spread_evenly, with_toxicity
from tests.llm.conftest import ODD

SF = "/root/testdata/sf0.01"
LABELS = {r["doc_id"]: r for r in pq.read_table(f"{SF}/labels.parquet").to_pylist()}


def test_pu_risk_recovers_the_negatives():
    r = np.random.default_rng(0)
    pos, neg = r.normal(1, 1, (2000, 4)), r.normal(-1, 1, (400, 4))
    unlabelled = np.concatenate([pos[1000:], neg])
    model = fit_pu(moments_of(pos[:1000]), moments_of(unlabelled), 1000 / 1400)
    assert (model.scores(pos) >= 0.5).mean() > 0.9 and (model.scores(neg) < 0.5).mean() > 0.85


def test_non_negative_risk_equals_descent():
    """A prior that is too high, so that the second part has to be held at 0."""
    r = np.random.default_rng(3)
    pos, unl = r.normal(1, 1, (300, 3)), np.concatenate([r.normal(1, 1, (150, 3)), r.normal(-1, 1, (150, 3))])
    prior, ridge = 0.9, 0.05
    p, u = (np.column_stack([x, np.ones(len(x))]) for x in (pos, unl))
    spread = np.append(u[:, :-1].var(axis=0), 1e-9)

    def risk(w):
        plus, minus = ((1 - p @ w) ** 2).mean() / 4, ((1 + u @ w) ** 2).mean() / 4 - prior * ((1 + p @ w) ** 2).mean() / 4
        return prior * plus + max(0.0, minus) + ridge / 2 * (spread * w * w).sum(), minus

    model = fit_pu(moments_of(pos), moments_of(unl), prior, ridge)
    w = np.append(model.weights, model.bias).astype(float)
    best, minus = risk(w)
    assert abs(minus) < 1e-3
    for _ in range(2000):
        assert risk(w + r.normal(0, 0.02, 4))[0] > best - 1e-4


def test_prior_from_positives_and_unlabelled():
    r = np.random.default_rng(4)
    for share in (0.3, 0.6, 0.85):
        n = 20000
        positive, unlabelled = r.normal(1, 0.4, 4000), np.where(r.random(n) < share, r.normal(1, 0.4, n), r.normal(-1, 0.4, n))
        count = lambda x: np.bincount(bins(x), minlength=BINS)
        assert abs(best_bin(count(positive), count(unlabelled)) - share) < 0.03


def test_moments_of_all_texts(spark, documents):
    texts = [*ODD, "Some text. More of it!"]
    got, want = moments(documents(texts).repartition(3)), moments_of(np.array([features(t) for t in texts]))
    assert got.n == want.n and np.allclose(got.second, want.second, atol=1e-5)


def test_quality_on_held_out_rows(spark):
    rows = op3_pu_quality(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [(r.predicted, LABELS[r.doc_id]["quality"]) for r in rows if r.held_out and r.doc_id in LABELS]
    good = [p for p, q in held if q]
    assert np.mean([p == q for p, q in held]) > 0.95 and np.mean(good) > 0.97
    bad = [r.score for r in rows if r.held_out and r.doc_id in LABELS and not LABELS[r.doc_id]["quality"]]
    fine = [r.score for r in rows if r.held_out and r.doc_id in LABELS and LABELS[r.doc_id]["quality"]]
    assert np.mean([a > b for a in fine for b in bad]) > 0.99


def test_whole_quality_query_equals_brute_force(spark):
    """The fit once more, from all feature rows at once."""
    docs = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    x = np.array([features(d["text"]) for d in docs])
    fitting = np.array([zlib.crc32(str(d["doc_id"]).encode()) % 5 != 0 for d in docs])
    good = np.array([LABELS.get(d["doc_id"], {}).get("quality") == 1 for d in docs]) & fitting
    p, u = moments_of(x[good]), moments_of(x[fitting])
    first = fit_pu(p, type(p)(0, (p.second + u.second) / 2), 0.5)
    count = lambda rows: np.bincount(bins(first.margins(x[rows])), minlength=BINS)
    model = fit_pu(p, u, best_bin(count(good), count(fitting)))
    want = dict(zip((d["doc_id"] for d in docs), model.scores(x)))
    got = {r.doc_id: r.score for r in op3_pu_quality(spark, SF).collect()}
    assert got.keys() == want.keys() and max(abs(got[i] - want[i]) for i in got) < 1e-3


def test_quality_of_odd_tables(spark, documents):
    labels = spark.createDataFrame([(0, 1, 0), (1, None, None), (None, 1, 1), (4, 1, 1), (4, 0, 1), (999, 1, 1), (6, 0, 0)], "doc_id long, quality int, toxic int")
    docs = documents(ODD).withColumn("x", F.lit("clash")).withColumn("score", F.lit("clash"))
    for given in (labels, labels.filter("false"), labels.filter("quality = 0")):
        model = fit_quality(docs, given)
        assert score_quality(docs, model).filter("score between 0 and 1").count() == len(ODD)
        tox = with_toxicity(docs.withColumn("toxic", F.lit("clash")), fit_toxicity(docs, given))
        assert tox.filter("_toxicity.severity >= 0").count() == len(ODD)
    assert score_quality(documents([]), fit_quality(documents([]), labels)).collect() == []
    assert with_toxicity(documents([]), fit_toxicity(documents([]), labels)).collect() == []
    assert features(None).shape == features("é" * 9).shape


def test_ordinal_model_orders_its_thresholds():
    r = np.random.default_rng(1)
    x = r.normal(0, 1, (3000, 3))
    z = x @ np.array([2.0, -1.0, 0.0]) + r.logistic(size=3000)
    w, t = fit_ordinal(x, np.searchsorted([-1.0, 0.5, 2.0], z), rate=0.05)
    assert (np.diff(t) > 0).all() and abs(w[0] / -w[1] - 2) < 0.4 and abs(w[2]) < 0.2


def test_censored_grades_fix_weights_and_the_first_threshold():
    r = np.random.default_rng(2)
    x = r.normal(0, 1, (4000, 3))
    z = x @ np.array([2.0, -1.0, 0.0]) + r.logistic(size=4000)
    toxic = (z > 0.5).astype(int)
    w, t = fit_ordinal(x, toxic, most=toxic * GRADES)
    assert abs(w[0] / -w[1] - 2) < 0.4 and abs(w[2]) < 0.2
    t = spread_evenly((x @ w)[toxic == 1], np.ones(toxic.sum()), t[0])
    p = 1 / (1 + np.exp(-((x @ w)[toxic == 1][:, None] - t)))
    share = p.mean(axis=0)
    assert (np.diff(t) > 0).all() and np.allclose(share / share[0], [1, 2 / 3, 1 / 3], atol=1e-6)


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"  # sf0.01 holds out six toxic texts
    rows = op7_toxicity(spark, sf).collect()
    labels = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{sf}/labels.parquet").to_pylist()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(0 <= r.severity <= GRADES for r in rows)
    for held, least in ((True, 0.9), (False, 0.9)):
        known = [(r, labels[r.doc_id]) for r in rows if r.doc_id in labels and (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) == held]
        assert np.mean([r.toxic for r, t in known if t]) > least and np.mean([r.toxic for r, t in known if not t]) < 0.02
    severe = [r.severity for r in rows if r.toxic]
    assert len(set(severe)) > 10 and max(severe) > 2 * min(severe)


def test_severity_equals_brute_force(spark, documents):
    """Counts, weights and thresholds put together by hand."""
    import math
    import re

    texts = [*ODD, "You trash, TRASHY pathetic trash!", "a pathetic-loser idiotic idiot"]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = fit_toxicity(spark.read.parquet(f"{SF}/documents.parquet"), labels)
    rows = {r.doc_id: r["_toxicity"] for r in with_toxicity(documents(texts), model).collect()}
    for i, t in enumerate(texts):
        z = 0.0
        words = re.findall(r"[^\W\d_]+", (t or "").lower())
        for key, k in model.place.items():
            n = sum(w == key[:-1] if key.endswith("$") else len(w) >= len(key) and w.startswith(key) and len(key) in (4, 5, 6) for w in words)
            z += model.weights[k] * math.log1p(n)
        p = [1 / (1 + math.exp(-max(-50, min(50, z - c)))) for c in model.thresholds]
        assert abs(rows[i].severity - sum(p)) < 1e-6 and abs(rows[i].p_toxic - p[0]) < 1e-6 and rows[i].toxic == (p[0] >= 0.5)
    assert rows[len(texts) - 1].toxic and not rows[0].toxic
