import random

import pytest
from pyspark.sql import functions as F

from tessera.operators.datasets import category_of_class, class_of_category, numbered
from tessera.operators.running import running


@pytest.mark.parametrize("n", [0, 1, 500])
def test_running_equals_a_loop(spark, n):
    r = random.Random(n)
    rows = [(r.choice([None, 0, 0, 0, 1, 2]), i, r.randrange(50)) for i in range(n)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "g int, at long, v long").repartition(5)
    got = {x.at: (x.total, x.top) for x in running(df, ["g"], [F.desc("at")], sums={"total": F.col("v")}, tops={"top": F.struct("v", "at")}).collect()}
    want, held = {}, {}
    for g, at, v in sorted(rows, key=lambda x: -x[1]):
        total, top = held.get(g, (0, (-1, -1)))
        held[g] = (total + v, max(top, (v, at)))
        want[at] = held[g]
    assert {k: (a, tuple(b)) for k, (a, b) in got.items()} == want


def test_numbers_of_an_order(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1009).alias("k"))
    assert sorted((x["rank"], x.k) for x in numbered(df, ["k"]).collect()) == list(enumerate(sorted(i * 7919 % 1009 for i in range(1000))))


def test_categories_and_classes(spark):
    df = spark.range(0, 95).select(F.col("id").cast("int").alias("id"))
    got = {r.id: r.c for r in df.select("id", class_of_category(F.col("id")).alias("c")).collect()}
    assert sorted(c for c in got.values() if c is not None) == list(range(80))
    assert (got[0], got[1], got[11], got[12], got[13], got[25], got[27], got[90], got[91]) == (None, 0, 10, None, 11, 23, 24, 79, None)
    back = {r.id: r.c for r in df.select("id", category_of_class(F.col("id")).alias("c")).collect()}
    assert all(back[c] == i for i, c in got.items() if c is not None)
