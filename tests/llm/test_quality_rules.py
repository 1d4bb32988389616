import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.llm import quality_rules
from tessera.llm.quality_rules import base_failed, estimate, fitted, measured, op4_quality_rules, posterior
from tests.llm.conftest import ODD


def brute(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def measures(df):
    m = F.col("_quality")
    return {r[0]: tuple(r)[1:] for r in measured(df).select("doc_id", *(m[c] for c in COLUMNS)).collect()}


@pytest.mark.parametrize("bits", [20, 6])
def test_measures_equal_brute_force(spark, documents, monkeypatch, bits):
    monkeypatch.setattr(quality_rules, "BITS", bits)
    r = random.Random(2)
    texts = [*ODD, *("".join(r.choice("ab \n\t|#") for _ in range(r.randrange(200))) for _ in range(200))]
    assert measures(documents(texts)) == {i: brute(t) for i, t in enumerate(texts)}


def test_whole_table(spark):
    import pyarrow.parquet as pq

    t = pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pylist()
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table("/root/testdata/sf0.01/labels.parquet").to_pylist()}
    rows = {r.doc_id: r for r in op4_quality_rules(spark, "/root/testdata/sf0.01").collect()}
    assert len(rows) == len(t)
    hits = []
    for d in t:
        r, want = rows[d["doc_id"]], brute(d["text"])
        assert tuple(r[c] for c in COLUMNS) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.kept and r.base_failed)
        if d["doc_id"] in labels and not r.base_failed:
            hits.append(r.kept == labels[d["doc_id"]])
    assert sum(hits) > 0.99 * len(hits)


def test_empty_table_and_clashing_columns(spark, documents):
    empty = measured(documents([]))
    assert empty.collect() == []
    prior, ratios = fitted(empty, F.col("_quality"))
    assert prior > 0 and len(ratios) == len(quality_rules.RULES)
    df = documents([None, "x"]).withColumn("_quality", F.lit(1)).withColumn("n_words", F.lit("clash"))
    rows = measured(df).select("n_words", base_failed(F.col("_quality")).alias("f"), posterior(F.col("_quality"), (prior, ratios)).alias("p")).collect()
    assert [r.n_words for r in rows] == ["clash"] * 2 and all(r.f and 0 <= r.p <= 1 for r in rows)


def brute_votes(t):
    """Votes of the rules, from plain counts, in their order."""
    n, chars, symbols, dup, repeated = brute(t)
    upper, shouts = sum(c.isupper() for c in t), t.count("!")
    lines = len([x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)])
    stops = len(re.findall(r"[.?!:](?=[\x20\x09-\x0D]|\Z)", t))
    bare = sum(not any(c.isalpha() or c.isnumeric() for c in w) for w in re.findall(r"[^\x20\x09-\x0D]+", t))
    vote = lambda bad, good: -1 if bad else int(good)
    return (
        vote(symbols > 0.04 * chars, symbols <= 0.002 * chars),
        vote(upper > 0.3 * chars, 3 * chars <= 1000 * upper <= 80 * chars),
        vote(shouts > 0.04 * chars, 200 * shouts <= chars),
        vote(dup >= 2 and 5 * dup > lines, lines >= 4 and not dup),
        vote(5 * repeated > n, 20 * repeated <= n),
        vote(chars > 7 * n or chars < 3 * n, 40 * n <= 10 * chars <= 62 * n),
        vote(200 * stops < n or 4 * stops > n, 40 * stops >= n and 6 * stops <= n),
        vote(100 * bare > 8 * n, 100 * bare <= n),
    )


def brute_posteriors(votes, rounds=100):
    """Text by text in numpy, from the assumed accuracies."""
    import numpy as np

    v = np.array(votes) + 1
    hot = np.eye(3)[v]  # text, rule, vote
    assumed = {True: np.array([0.05, 0.35, 0.6]), False: np.array([0.4, 0.3, 0.3])}
    like = {k: np.tile(a, (v.shape[1], 1)) for k, a in assumed.items()}
    odds = 0.85 / 0.15

    def posterior():
        ratio = (np.log(like[True]) - np.log(like[False]))[None] * hot
        return 1 / (1 + np.exp(-(np.log(odds) + ratio.sum(axis=(1, 2)))))

    for _ in range(rounds):
        p = posterior()
        odds = (p.sum() + 1) / ((1 - p).sum() + 1)
        for k, w in ((True, p), (False, 1 - p)):
            mass = (hot * w[:, None, None]).sum(axis=0) + 2 * assumed[k][None]
            like[k] = mass / mass.sum(axis=1, keepdims=True)
    return posterior()


def test_verdict_equals_brute_force_and_overrules_votes(spark):
    import pyarrow.parquet as pq

    t = {r["doc_id"]: r["text"] or "" for r in pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pylist()}
    rows = {r.doc_id: r for r in op4_quality_rules(spark, "/root/testdata/sf0.01").collect()}
    voters = [i for i in t if not rows[i].base_failed]
    votes = {i: brute_votes(t[i]) for i in voters}
    want = dict(zip(voters, brute_posteriors([votes[i] for i in voters])))
    for i in voters:
        assert abs(rows[i].good - want[i]) < 1e-6 and rows[i].kept == (want[i] >= 0.5)
    outvoted = [i for i in voters if min(votes[i]) < 0 and rows[i].kept]
    against = [i for i in voters if min(votes[i]) < 0 and not rows[i].kept]
    assert len(outvoted) >= 3 and len(against) > 20
    assert all({r: x for r, x in zip(quality_rules.RULES, votes[i]) if x < 0}.keys() <= {"repeated_words", "repeated_lines"} for i in outvoted)


def test_estimate_weighs_rules_by_agreement():
    n = len(quality_rules.RULES)
    vote = lambda **at: tuple(at.get(f"r{i}", 1) for i in range(n))
    # rules 0, 5 and 7 agree on what is bad; rule 4 speaks against texts that all others call good
    counts = [(vote(), 800), (vote(r0=-1, r5=-1), 60), (vote(r0=-1, r7=-1), 60), (vote(r4=-1), 40), (vote(r3=0), 100)]
    prior, ratios = estimate(counts)
    odds = lambda v: prior + sum(ratios[r][x] for r, x in enumerate(v))
    assert ratios[0][-1] < -3 and ratios[5][-1] < -3 and ratios[4][-1] > -1
    assert odds(vote()) > 0 and odds(vote(r4=-1)) > 0  # outvoted
    assert odds(vote(r0=-1, r5=-1)) < 0 and odds(vote(r0=-1, r7=-1)) < 0
