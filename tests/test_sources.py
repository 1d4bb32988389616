import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import datasets as D
from tessera.operators import explorer as X
from tessera.operators import raster as R
from tessera.sources import labels as S
from tessera.sources import sinks as K


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_listings(spark, tmp_path):
    for p in ("train/cat/a.JPG", "train/dog/b.png", "val/cat/c.jpg", "train/dog/d.txt", "train/dog/e.mp4"):
        put(tmp_path / "d" / p, "x")
    files = S.listing(spark, str(tmp_path / "d"))
    assert sorted(r.path.rsplit("/", 1)[1] for r in S.images(files).collect()) == ["a.JPG", "b.png", "c.jpg"]
    assert S.images(files, 0.5).count() == 2
    assert {r.kind for r in S.images_then_videos(files).collect()} == {0, 1}
    got = {(r.split, r.name): (r.cls, r.n) for r in S.folder_classes(S.images(files)).collect()}
    assert got == {("train", "cat"): (0, 1), ("train", "dog"): (1, 1), ("val", "cat"): (0, 1)}
    one = S.fingerprint(files).first()[0]
    put(tmp_path / "d/train/dog/d.txt", "longer")
    assert S.fingerprint(S.listing(spark, str(tmp_path / "d"))).first()[0] != one
    listed = S.listed(spark, put(tmp_path / "list.txt", "./x/images/1.jpg\n/abs/2.png\n\n"))
    assert sorted(r.path for r in listed.collect()) == sorted([f"{tmp_path}/x/images/1.jpg", "/abs/2.png"])
    with pytest.raises(FileNotFoundError):
        S.present(listed, files)


def test_label_text_files(spark, tmp_path):
    put(tmp_path / "l/a.txt", "0 0.5 0.5 0.2 0.2\n0 0.5 0.5 0.2 0.2\n1 0.1 0.1 0.05 0.05\n")
    put(tmp_path / "l/b.txt", "2 0.1 0.1 0.3 0.1 0.3 0.4 0.1 0.4\n")
    put(tmp_path / "l/c.txt", "1 0.5 1.5 0.2 0.2\n")
    put(tmp_path / "l/d.txt", "9 0.5 x 0.2 0.2\n")
    parsed = S.parse_labels(S.read_label_lines(spark, str(tmp_path / "l/*.txt")))
    rows = {r.file[-5:]: r for r in parsed.filter("line_no = 0").collect()}
    assert rows["b.txt"].box[:] == pytest.approx((0.2, 0.25, 0.2, 0.3)) and len(rows["b.txt"].segment) == 4
    v = {r.file[-5:]: (r.status, r.n_duplicates) for r in S.verify_labels(parsed, 3).collect()}
    assert v == {"a.txt": ("found", 1), "b.txt": ("found", 0), "c.txt": ("corrupt", 0), "d.txt": ("corrupt", 0)}


def test_annotation_files(spark, tmp_path):
    coco = {"images": [{"id": 1, "file_name": "a.jpg", "width": 100, "height": 50}], "annotations": [{"image_id": 1, "category_id": 3, "bbox": [10, 10, 20, 10], "iscrowd": 0}, {"image_id": 1, "category_id": 3, "bbox": [10, 10, 20, 10], "iscrowd": 0}, {"image_id": 1, "category_id": 3, "bbox": [1, 1, 0, 5], "iscrowd": 0}, {"image_id": 1, "category_id": 3, "bbox": [1, 1, 5, 5], "iscrowd": 1}]}
    got = D.convert_coco(*S.read_coco(spark, put(tmp_path / "c.json", json.dumps(coco, indent=1)))).collect()
    assert [tuple(r) for r in got] == [("a.jpg", 2, 0.2, 0.3, 0.2, 0.2)]
    voc = "<annotation><size><width>100</width><height>50</height></size><object><name>cat</name><difficult>0</difficult><bndbox><xmin>11</xmin><ymin>11</ymin><xmax>31</xmax><ymax>21</ymax></bndbox></object><object><name>cow</name><difficult>0</difficult><bndbox><xmin>1</xmin><ymin>1</ymin><xmax>3</xmax><ymax>2</ymax></bndbox></object></annotation>"
    (r,) = D.convert_voc(S.read_voc(spark, put(tmp_path / "v/a.xml", voc)), ["cat"]).collect()
    assert (r.cls, r.cx, r.cy) == (0, 0.2, 0.3)
    rows = S.read_comma_boxes(spark, put(tmp_path / "k.txt", "10,10,20,10,1,4,0,0\n1,1,2,2,0,4,0,0\n"))
    sizes = rows.select("file").distinct().withColumn("width", F.lit(100.0)).withColumn("height", F.lit(50.0))
    (r,) = D.convert_comma_boxes(rows, sizes).collect()
    assert (r.cls, r.cx, r.h) == (3, 0.2, 0.2)
    geo = {"features": [{"properties": {"image_id": "a", "type_id": 7, "bounds_imcoords": "10,10,30,20"}}, {"properties": {"image_id": "a", "type_id": 7, "bounds_imcoords": "1,2,3"}}, {"properties": {"image_id": "a", "type_id": 9, "bounds_imcoords": "1,1,2,2"}}]}
    bounds = S.read_geojson(spark, put(tmp_path / "g.geojson", json.dumps(geo)))
    sizes = spark.createDataFrame([("a", 100.0, 50.0)], "image string, width double, height double")
    assert [tuple(r) for r in D.convert_bounds(bounds, sizes, {7: 0}).collect()] == [("a", 0, 0.2, 0.3, 0.2, 0.2)]
    (r,) = D.convert_box_csv(S.read_box_csv(spark, put(tmp_path / "s.csv", "a.jpg,10,10,30,20,object,100,50\n"))).collect()
    assert (r.cls, r.cx, r.cy) == (0, 0.2, 0.3)
    frames = {"sequences": ["s0"], "images": [{"id": 5, "sid": 0, "name": "a.jpg"}], "annotations": [{"image_id": 5, "category_id": 2, "bbox": [1, 2, 3, 4]}]}
    assert tuple(S.read_frames(spark, put(tmp_path / "f.json", json.dumps(frames))).first()) == ("s0/a.jpg", 2, 1.0, 2.0, 3.0, 4.0)
    assert S.read_series(spark, put(tmp_path / "r.csv", " epoch,  loss \n 1, 0.5\n")).columns == ["epoch", "loss"]


def test_descriptor():
    d = S.check_descriptor({"train": "a", "validation": "b", "names": ["x", "y"], "download": "rm -rf /"})
    assert d["val"] == "b" and d["names"] == {0: "x", 1: "y"} and d["nc"] == 2
    assert S.check_descriptor({"train": 1, "val": 1, "nc": 2})["names"] == {0: "class_0", 1: "class_1"}
    for bad in ({"train": 1, "names": []}, {"train": 1, "val": 1}, {"train": 1, "val": 1, "names": ["a"], "nc": 2}):
        with pytest.raises(ValueError):
            S.check_descriptor(bad)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 7, 0, 0.875, 10.0, 20.0, 30.0, 60.0), (1, 8, 1, 0.95, 0.0, 0.0, 64.0, 64.0)], "image_id long, det_id long, cls long, conf double, x1 double, y1 double, x2 double, y2 double")
    K.write_label_text(K.label_lines(df, 640, 640), str(tmp_path / "t"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "t")).collect()) == ["0 0.03125 0.0625 0.03125 0.0625", "1 0.05 0.05 0.1 0.1"]
    names = F.create_map(F.lit(0), F.lit("a"), F.lit(1), F.lit("b"))
    got = json.loads(K.detections_json(df, names).first().json)
    assert [x["name"] for x in got] == ["b", "a"] and got[1]["box"] == {"x1": 10.0, "y1": 20.0, "x2": 30.0, "y2": 60.0}
    K.write_manifests(spark.createDataFrame([("a", "train"), ("b", "val")], "path string, split string"), str(tmp_path / "m"))
    assert spark.read.text(str(tmp_path / "m/split=val")).first().value == "b"
    for _ in range(2):
        K.append_metrics(spark.createDataFrame([(1, 0.5)], "epoch int, loss double"), str(tmp_path / "log"))
    assert spark.read.csv(str(tmp_path / "log"), header=True).count() == 2


@pytest.mark.parametrize("x", [0.0, 1.0, 0.5, 0.03125, 0.1234567, 123.456789, 0.00012345678, 2 / 3])
def test_general_numbers(spark, x):
    assert spark.range(1).select(K.general(F.lit(x))).first()[0] == f"{x:g}"


def test_masks_and_ages(spark, tmp_path):
    K.write_mask(spark.createDataFrame([(0, 1), (2000, 5)], "row long, col long"), str(tmp_path / "mask"))
    assert spark.read.parquet(str(tmp_path / "mask")).select("block").distinct().count() == 2
    from tessera.sources.vector import file_ages

    put(tmp_path / "z/a.txt", "x" * 2**20)
    (r,) = file_ages(S.listing(spark, str(tmp_path / "z"))).collect()
    assert (r.mib, r.days, r.latest) == (1.0, 0, True)


def test_splits():
    folds = D.kfold(list("abcdefghijk"), 5, 3)
    assert [len(f) for f in folds] == [3, 2, 2, 2, 2] and sorted(sum(folds, [])) == list("abcdefghijk")
    assert D.autosplit(["b", "a"])[0][0] == "a" and {s for _, s in D.autosplit([str(i) for i in range(200)])} == {"train", "val"}
    crops = D.random_crops(0, 400, 1000, 800, 336)
    assert len(crops) == 400 and max(x for x, _ in crops) <= 664 and max(y for _, y in crops) <= 464


def test_split_at_its_bounds(spark, tmp_path):
    import duckdb

    from tessera.plans.registry import QUERIES, SQL

    # keys by the last six digits of their digest
    digits = {0: 1107945, 299999: 736954, 300000: 739784, 799999: 1191621, 800000: 1257784, 949999: 1097708, 950000: 155294, 999999: 381565}
    df = spark.createDataFrame([(i,) for i in [*digits.values(), *range(-50, 50), None]], "p_partkey long")
    assert {r.p_partkey: r.h for r in df.select("p_partkey", (D.hashed("p_partkey", 0) % 10**6).alias("h")).collect()}.items() >= {i: h for h, i in digits.items()}.items()
    df.write.parquet(str(tmp_path / "part.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    got = {r.p_partkey: r.split for r in QUERIES["autosplit"](spark, str(tmp_path)).collect()}
    assert len(got) == 109 and got == dict(con.sql(SQL["autosplit"]).fetchall())
    assert [got[i] for i in digits.values()] == ["train"] * 4 + ["val"] * 2 + ["test"] * 2
    for weights, want in (((0.1, 0.2, 0.7), "val test"), ((0.3, 0.6, 0.1), "train val"), ((0.0, 1 / 3, 2 / 3), "val val"), ((0.0, 0.0, 1.0), "test test")):
        got = {r.p_partkey: r.split for r in D.autosplit_by_hash(df, "p_partkey", weights).collect()}
        assert [got[digits[299999]], got[digits[300000]]] == want.split()


def test_explorer_dialect(spark):
    df = spark.createDataFrame([(1, ["person", "dog"]), (2, ["cat"])], "id long, labels array<string>")
    run = lambda q: [r.id for r in X.sql_query(spark, df, q).collect()]
    assert run("WHERE labels LIKE '%person%'") == [1]
    assert run("SELECT * FROM 'table' WHERE ARRAY_LENGTH(labels) = 1 AND 'from table; labels LIKE' <> ''") == [2]
    assert run('SELECT id FROM "table" WHERE labels NOT LIKE \'%dog%\'') == [2]
    for bad in (" SELECT 1", "select 1", "WITH a AS (SELECT 1) SELECT 1", "SELECT 1; SELECT 2"):
        with pytest.raises(ValueError):
            X.rewrite(bad)
    with pytest.raises(AssertionError):
        X.sql_query(spark, df, "WHERE id = 1", "rows")
    assert len(X.sql_query(spark, df, "WHERE id = 1", "pandas")) == 1
    assert [r.id for r in X.ask(spark, df, "images with 1 person and no cats").collect()] == [1]
    assert X.ask(spark, df, "hello") is None and X.ask(spark, df, "x", lambda _: "SELECT nothing FROM 'table'") is None


def test_index_validation_and_blocks(spark, monkeypatch):
    r = random.Random(0)
    rows = [(i, [r.random() for _ in range(4)]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = {i: sorted((sum((a - b) ** 2 for a, b in zip(u, v, strict=True)), j) for j, v in rows) for i, u in rows}
    for size in (4096, 3):
        monkeypatch.setattr(X, "BLOCK", size)
        got = {x.vec_id: x.similar for x in X.similarity_index(df, 0.2).collect()}
        assert got == {i: [j for d, j in w if d <= 0.2] for i, w in want.items()}
    assert all(x["count"] <= 4 for x in X.similarity_index(df, 9.0, 0.1).collect())
    for bad in ({"max_dist": -1}, {"top_k": 2}):
        with pytest.raises(ValueError):
            X.similarity_index(df, **bad)


def test_regions(spark):
    on = [(0, 0), (0, 1), (1, 2), (5, 5), (9, 0), (8, 0)]
    df = spark.createDataFrame([(7, y, x) for y, x in on], "k long, row long, col long")
    assert sorted(r.n for r in R.connected_regions(df, ["k"]).collect()) == [1, 2, 3]
    assert sorted(r.n for r in R.connected_regions(df, ["k"], diagonal=False).collect()) == [1, 1, 2, 2]


def test_every_raster_is_cropped(spark):
    from tessera.plans.fixtures import view
    from tessera.plans.registry import QUERIES

    sf = "/root/testdata/sf0.001"
    rasters = {r.raster_id: r for r in view(spark, sf, "raster").collect()}
    got: dict = {}
    for r in QUERIES["random_crops"](spark, sf).collect():
        got.setdefault(r.raster_id, []).append((r.x, r.y))
    assert len(rasters) > 20 and got.keys() == rasters.keys()
    for i, r in rasters.items():
        assert sorted(got[i]) == sorted(D.random_crops(i, 400, r.width, r.height, 336))
