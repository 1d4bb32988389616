"""Queries of the dataset explorer, and the SQL breadth that it hands on."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import explorer as X
from tessera.plans._register import query
from tessera.plans.fixtures import cte, table, view

L2 = "power(list_distance(CAST({0} AS DOUBLE[]), CAST({1} AS DOUBLE[])), 2)"
DOT = "list_inner_product(CAST({0} AS DOUBLE[]), CAST({1} AS DOUBLE[]))"


def vectors(spark, sf):
    return table(spark, sf, "embeddings")


def one(spark, sf, vec_id):
    return vectors(spark, sf).filter(F.col("vec_id") == vec_id).select("embedding").first()[0]


@query("knn_l2", f"SELECT vec_id, label, round({L2.format('embedding', '(SELECT embedding FROM embeddings WHERE vec_id = 0)')}, 6) AS _distance FROM embeddings ORDER BY {L2.format('embedding', '(SELECT embedding FROM embeddings WHERE vec_id = 0)')}, vec_id LIMIT 25")
def knn_l2(spark, sf):
    """VEC1, VEC3, ORD9: the 25 nearest rows of a row's stored vector."""
    return X.nearest(vectors(spark, sf), one(spark, sf, 0)).select("vec_id", "label", F.round("_distance", 6).alias("_distance"))


@query("knn_mean_query", f"""WITH m AS (SELECT list(x ORDER BY i) v FROM (SELECT i, avg(CAST(embedding[i] AS DOUBLE)) x FROM embeddings, (SELECT unnest(range(1, 65)) i) t WHERE vec_id IN (1, 2, 3) GROUP BY i) s)
SELECT vec_id, round({L2.format('embedding', 'v')}, 6) AS _distance FROM embeddings, m ORDER BY {L2.format('embedding', 'v')}, vec_id LIMIT 10""")
def knn_mean_query(spark, sf):
    """VEC2: neighbours of the mean of several rows."""
    mean = X.mean_vector(vectors(spark, sf).filter(F.col("vec_id").isin(1, 2, 3))).first()[0]
    return X.nearest(vectors(spark, sf), mean, 10).select("vec_id", F.round("_distance", 6).alias("_distance"))


_SIM = f"SELECT a.vec_id, b.vec_id id, {L2.format('a.embedding', 'b.embedding')} d FROM embeddings a, embeddings b"


@query("similarity_index", f"SELECT vec_id, count(*) AS count, string_agg(CAST(id AS VARCHAR), ',' ORDER BY d, id) AS similar FROM ({_SIM}) s WHERE d <= 1.4 GROUP BY vec_id")
def similarity_index(spark, sf):
    """VEC4, VEC7, SNK9: neighbours within a distance of every row."""
    s = X.similarity_index(vectors(spark, sf), 1.4)
    return s.select("vec_id", "count", F.array_join(F.transform("similar", lambda x: x.cast("string")), ",").alias("similar"))


@query("similarity_top_share", f"WITH n AS (SELECT greatest(CAST(floor(count(*)*0.01) AS BIGINT), 1) k FROM embeddings) SELECT vec_id, count(*) AS count, string_agg(CAST(id AS VARCHAR), ',' ORDER BY d, id) AS similar FROM (SELECT * FROM ({_SIM}) s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, id) <= (SELECT k FROM n)) t WHERE d <= 1.6 GROUP BY vec_id")
def similarity_top_share(spark, sf):
    """VEC5: the same among each row's nearest hundredth."""
    s = X.similarity_index(vectors(spark, sf), 1.6, 0.01)
    return s.select("vec_id", "count", F.array_join(F.transform("similar", lambda x: x.cast("string")), ",").alias("similar"))


@query("cosine_distances", f"SELECT a.vec_id a, b.vec_id b, round(greatest(1 - {DOT.format('a.embedding', 'b.embedding')}/sqrt({DOT.format('a.embedding', 'a.embedding')}*{DOT.format('b.embedding', 'b.embedding')}), 0), 6) AS distance FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0")
def cosine_distances(spark, sf):
    """VEC10: the rows of the matrix whose id is divisible by 50, against all rows."""
    v = vectors(spark, sf)
    d = X.cosine_rows(v.filter("vec_id % 50 = 0"), v)
    return d.select("a", "b", F.round("distance", 6).alias("distance"))


@query("softmax_retrieval", f"WITH s AS (SELECT vec_id, 100*{DOT.format('embedding', '(SELECT embedding FROM embeddings WHERE vec_id = 5)')} z FROM embeddings WHERE label = 3), e AS (SELECT vec_id, exp(z - max(z) OVER ()) x FROM s) SELECT vec_id, round(x/sum(x) OVER (), 8) AS probability FROM e")
def softmax_retrieval(spark, sf):
    """VEC9: softmax of scaled cosines over candidates; the sums are aggregates, not one window over all rows."""
    q = F.array(*(F.lit(float(x)) for x in one(spark, sf, 5)))
    s = vectors(spark, sf).filter("label = 3").select("vec_id", (100 * X.dot(F.col("embedding"), q)).alias("z"))
    top = s.agg(F.max("z").alias("top"))
    e = s.join(F.broadcast(top), F.lit(True)).select("vec_id", F.exp(F.col("z") - F.col("top")).alias("x"))  # one row
    return e.join(F.broadcast(e.agg(F.sum("x").alias("total"))), F.lit(True)).select("vec_id", F.round(F.col("x") / F.col("total"), 8).alias("probability"))


@query("moving_vectors")
def moving_vectors(spark, sf):
    """VEC11: unit vectors averaged with factor 0.9 in order, renormalised at each step, per label."""
    out = X.moving_vectors(vectors(spark, sf), 0.9)
    return out.select("label", F.transform("vector", lambda x: F.round(x, 6)).alias("vector"))


def images(spark, sf):
    """An explorer table: images of nine objects with labels, classes and boxes."""
    names = {0: "person", 1: "dog", 2: "cat", 3: "car", 4: "bus"}
    g = view(spark, sf, "gt").groupBy(F.floor(F.col("gt_id") / 9).alias("image_id")).agg(F.array_sort(F.collect_list(F.struct("gt_id", "cls", "x1", "y1", "x2", "y2"))).alias("l"))
    s = X.sorted_labels(F.transform("l", lambda x: F.array(x["x1"], x["y1"], x["x2"], x["y2"])), F.transform("l", lambda x: x["cls"].cast("int")), names)
    return g.select(F.format_string("images/%06d.jpg", "image_id").alias("im_file"), s.alias("s")).select("im_file", "s.*")


IMAGES = cte("gt") + """, n AS (SELECT * FROM (VALUES (0,'person'),(1,'dog'),(2,'cat'),(3,'car'),(4,'bus')) v(cls,name)),
images AS (SELECT printf('images/%06d.jpg', CAST(floor(gt_id/9e0) AS BIGINT)) im_file, list(cls ORDER BY cls, gt_id) cls, list(name ORDER BY cls, gt_id) labels FROM gt JOIN n USING (cls) GROUP BY CAST(floor(gt_id/9e0) AS BIGINT))"""


@query("sorted_rows", f"{IMAGES} SELECT im_file, array_to_string(labels, ',') labels, array_to_string(cls, ',') cls FROM images")
def sorted_rows(spark, sf):
    """VEC8, JN22: boxes by class, with class names."""
    return images(spark, sf).select("im_file", F.array_join("labels", ",").alias("labels"), F.array_join(F.transform("cls", lambda c: c.cast("string")), ",").alias("cls"))


@query("sql_where_like", f"{IMAGES} SELECT im_file FROM images WHERE CAST(labels AS VARCHAR) LIKE '%person%' AND CAST(labels AS VARCHAR) LIKE '%dog%'")
def sql_where_like(spark, sf):
    """SQL2, SQL4, SQL7: WHERE alone, LIKE on a list."""
    return X.sql_query(spark, images(spark, sf), "WHERE labels LIKE '%person%' AND labels LIKE '%dog%'").select("im_file")


@query("sql_list_filter", f"{IMAGES} SELECT im_file, len(list_filter(labels, lambda x: x = 'cat')) cats FROM images WHERE len(list_filter(labels, lambda x: x = 'cat')) > 1")
def sql_list_filter(spark, sf):
    """SQL1, SQL5, SQL6."""
    return X.sql_query(spark, images(spark, sf), "SELECT im_file, CAST(ARRAY_LENGTH(FILTER(labels, x -> x = 'cat')) AS BIGINT) AS cats FROM 'table' WHERE ARRAY_LENGTH(FILTER(labels, x -> x = 'cat')) > 1")


@query("sql_in_words", f"{IMAGES} SELECT im_file FROM images WHERE len(list_filter(labels, lambda x: x = 'person')) >= 2 AND len(list_filter(labels, lambda x: x = 'dog')) = 0")
def sql_in_words(spark, sf):
    """SQL9: a request in plain words by rule."""
    return X.ask(spark, images(spark, sf), "images with 2 persons and no dogs").select("im_file")


@query("explorer_page", f"{IMAGES} SELECT im_file FROM images ORDER BY im_file LIMIT 5 OFFSET 4")
def explorer_page(spark, sf):
    """SQL10."""
    return images(spark, sf).select("im_file").orderBy("im_file").offset(4).limit(5)


def breadth(name, spark_sql, duck_sql=None, *names):
    """SQL8: one construct over tables, the same text in both engines where they agree."""

    def run(spark, sf):
        return spark.sql(spark_sql, **{n: table(spark, sf, n) for n in names})

    run.__doc__ = "SQL8."
    text = duck_sql or spark_sql
    for n in names:
        text = text.replace(f"{{{n}}}", n)
    query(name, text)(run)


breadth("sql_semi_join", "SELECT c_custkey, c_name FROM {customer} c WHERE EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000)", None, "customer", "orders")
breadth("sql_anti_join", "SELECT c_custkey FROM {customer} c WHERE NOT EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)", None, "customer", "orders")
breadth("sql_full_join", "SELECT coalesce(a.k, b.k) k, a.n orders, b.n events FROM (SELECT o_custkey k, count(*) n FROM {orders} WHERE o_custkey % 2 = 0 GROUP BY 1) a FULL OUTER JOIN (SELECT user_id k, count(*) n FROM {events} GROUP BY 1) b ON a.k = b.k", None, "orders", "events")
breadth("sql_theta_join", "SELECT a.n_nationkey a, b.n_nationkey b FROM {nation} a JOIN {nation} b ON a.n_regionkey < b.n_regionkey AND a.n_nationkey > b.n_nationkey", None, "nation")
breadth("sql_cube", "SELECT l_returnflag, l_linestatus, count(*) n, round(sum(l_quantity), 2) q FROM {lineitem} GROUP BY CUBE (l_returnflag, l_linestatus)", None, "lineitem")
breadth("sql_rollup", "SELECT n_regionkey, n_name, count(*) n FROM {nation} GROUP BY ROLLUP (n_regionkey, n_name)", None, "nation")
breadth("sql_grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) n FROM {orders} GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())", None, "orders")
breadth("sql_frames", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) s, CAST(rank() OVER (PARTITION BY user_id ORDER BY event_type) AS BIGINT) r, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) p FROM {events}", None, "events")
breadth("sql_intersect", "SELECT o_custkey k FROM {orders} INTERSECT SELECT user_id FROM {events}", None, "orders", "events")
breadth("sql_except", "SELECT c_custkey k FROM {customer} EXCEPT SELECT user_id FROM {events}", None, "customer", "events")
breadth("sql_union_distinct", "SELECT n_name x FROM {nation} UNION SELECT r_name FROM {region}", None, "nation", "region")
breadth("sql_percentiles", "SELECT l_returnflag, round(percentile(l_quantity, 0.5), 6) m, round(percentile(l_extendedprice, 0.95), 4) p FROM {lineitem} GROUP BY 1", "SELECT l_returnflag, round(quantile_cont(l_quantity, 0.5), 6) m, round(quantile_cont(l_extendedprice, 0.95), 4) p FROM {lineitem} GROUP BY 1", "lineitem")
breadth("sql_strings", "SELECT c_custkey, upper(substring(c_name, 1, 8)) u, length(c_name) n, replace(c_name, '0', 'o') r, concat_ws('-', c_name, 'x') w, lpad(CAST(c_custkey AS STRING), 6, '0') p FROM {customer}", "SELECT c_custkey, upper(substring(c_name, 1, 8)) u, CAST(length(c_name) AS INT) n, replace(c_name, '0', 'o') r, concat_ws('-', c_name, 'x') w, lpad(CAST(c_custkey AS VARCHAR), 6, '0') p FROM {customer}", "customer")
breadth("sql_json", "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) k FROM {events} WHERE CAST(get_json_object(props, '$.k') AS BIGINT) % 2 = 1", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) k FROM {events} WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) % 2 = 1", "events")
breadth("sql_arrays", "SELECT vec_id, array_max(embedding) m, round(CAST(embedding[3] AS DOUBLE), 6) e, array_contains(transform(slice(embedding, 1, 4), x -> x > 0), true) p FROM {embeddings}", "SELECT vec_id, list_max(embedding) m, round(CAST(embedding[4] AS DOUBLE), 6) e, list_contains(list_transform(embedding[1:4], lambda x: x > 0), true) p FROM {embeddings}", "embeddings")
breadth("sql_unnest", "SELECT vec_id, i, round(CAST(x AS DOUBLE), 6) x FROM (SELECT vec_id, posexplode(slice(embedding, 1, 3)) AS (i, x) FROM {embeddings}) t", "SELECT vec_id, CAST(i - 1 AS INT) i, round(CAST(embedding[i] AS DOUBLE), 6) x FROM {embeddings}, (SELECT unnest(range(1, 4)) i) t", "embeddings")
breadth("sql_dates", "SELECT date_trunc('month', o_orderdate) m, count(DISTINCT o_custkey) n, max(year(o_orderdate)) y FROM {orders} GROUP BY 1", "SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) m, count(DISTINCT o_custkey) n, CAST(max(year(o_orderdate)) AS INT) y FROM {orders} GROUP BY 1", "orders")
breadth("sql_correlated", "SELECT s_suppkey, (SELECT max(l_quantity) FROM {lineitem} l WHERE l.l_suppkey = s.s_suppkey) q FROM {supplier} s", None, "supplier", "lineitem")
breadth("sql_cte_join", "WITH r AS (SELECT c_nationkey k, count(*) n FROM {customer} GROUP BY 1) SELECT n_name, r_name, n FROM r JOIN {nation} ON k = n_nationkey JOIN {region} ON n_regionkey = r_regionkey WHERE n > 2", None, "customer", "nation", "region")


@query("tumbling_counts", "SELECT CAST(time_bucket(INTERVAL 6 HOUR, ts) AS TIMESTAMP) start, event_type, count(*) n, round(sum(value), 4) total FROM events GROUP BY ALL")
def tumbling_counts(spark, sf):
    """STR11: event-time windows."""
    e = table(spark, sf, "events")
    return e.groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


@query("session_counts", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 4 HOUR THEN 0 ELSE 1 END s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
i AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) k FROM g) SELECT user_id, min(ts) AS start, count(*) n FROM i GROUP BY user_id, k""")
def session_counts(spark, sf):
    """STR11: sessions with a gap of four hours."""
    e = table(spark, sf, "events")
    return e.groupBy(F.session_window("ts", "4 hours").alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


