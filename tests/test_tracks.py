import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import tracks as T
from tessera.streaming import tracks as ST


def scene(frames=12):
    """Two boxes that cross a frame, one unseen for three frames, and a weak one."""
    rows = []
    for f in range(1, frames + 1):
        a, b = 10 + 4 * f, 200 - 3 * f
        rows.append((0, f, 1, 0, 0.9, a, 10.0, a + 30.0, 50.0))
        if not 5 <= f <= 7:
            rows.append((0, f, 2, 0, 0.8 if f % 4 else 0.3, b, 100.0, b + 30.0, 140.0))
        rows.append((0, f, 3, 0, 0.05, 300.0, 300.0, 320.0, 320.0))
    return [(s, f, d, c, float(p), *map(float, x)) for s, f, d, c, p, *x in rows]


SCHEMA = "stream_id long, frame long, det_id long, cls long, conf double, x1 double, y1 double, x2 double, y2 double"


@pytest.mark.parametrize("by_width", [False, True])
def test_tracks_keep_their_ids(spark, by_width):
    got = T.track(spark.createDataFrame(scene(), SCHEMA), by_width).collect()
    ids = {d: {r.track_id for r in got if r.det_id == d} for d in (1, 2, 3)}
    assert len(ids[1]) == len(ids[2]) == 1 and ids[1] != ids[2] and ids[3] == set()
    assert {r.frame for r in got if r.det_id == 2} == {1, 2, 3, 4, 9, 10, 11, 12}  # a weak box (frame 8) does not bring back a lost track


def test_lost_tracks_are_removed_after_the_buffer():
    t = T.Tracker(buffer=3)
    box, score, cls = np.array([[0, 0, 10, 10.0]]), np.array([0.9]), np.array([0])
    none = (np.zeros((0, 4)), np.zeros(0), np.zeros(0))
    first = t.step(box, score, cls)[0][0]
    for _ in range(5):
        t.step(*none)
    t.step(box, score, cls)
    assert [x for x, _ in t.step(box, score, cls)] != [first]


def test_filter_follows_constant_velocity():
    m = T.Motion()
    mean, cov = m.start(np.array([0, 0, 0.5, 40.0]))
    for k in range(1, 30):
        mean, cov = m.predict(mean, cov)
        mean, cov = m.update(mean, cov, np.array([2.0 * k, -k, 0.5, 40.0]))
    assert mean[4] == pytest.approx(2, abs=0.1) and mean[5] == pytest.approx(-1, abs=0.1)
    assert m.gating(mean, cov, np.array([mean[:4], mean[:4] + 50]))[0] < 1e-9


def stream(spark, df, path, parts=3):
    for i in range(parts):
        df.filter((F.col("frame") - 1) * parts / 12 >= i).filter((F.col("frame") - 1) * parts / 12 < i + 1).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(path)


def drained(out, name):
    q = out.writeStream.outputMode("append").format("memory").queryName(name).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return out.sparkSession.table(name).collect()


def test_streaming_tracker_equals_batch(spark, tmp_path):
    df = spark.createDataFrame(scene(), SCHEMA)
    got = drained(ST.track(stream(spark, df, str(tmp_path / "d"))), "stream_tracks")
    assert sorted(map(tuple, got)) == sorted(map(tuple, T.track(df).collect()))


def test_streaming_crossings_equal_batch(spark, tmp_path):
    rows = [(0, t, f, float((t * 13 + f * 7) % 40), 0.0) for t in range(6) for f in range(1, 13)]
    df = spark.createDataFrame(rows, "stream_id long, track_id long, frame long, x double, y double")
    got = drained(ST.crossings(stream(spark, df, str(tmp_path / "t")), 10, 25), "stream_crossings")
    want = T.first_crossings(df, (F.col("x") >= 10) & (F.col("x") < 25)).withColumn("way", F.when(F.col("x") > F.col("prev_x"), "in").otherwise("out"))
    assert sorted(map(tuple, got)) == sorted(map(tuple, want.select("stream_id", "track_id", "frame", "way").collect()))


def test_streaming_windows_drop_late_rows(spark, tmp_path):
    path = str(tmp_path / "e")
    make = lambda hours: spark.sql(f"SELECT timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,h,0,0) ts, 'a' event_type, 1.0D value FROM (SELECT explode(array({hours})) h)")
    df = make("1, 2, 20")
    df.coalesce(1).write.parquet(path)
    q = ST.windowed_counts(spark.readStream.schema(df.schema).parquet(path)).writeStream.outputMode("append").format("memory").queryName("stream_windows").start()
    try:
        q.processAllAvailable()
        make("3, 40").coalesce(1).write.mode("append").parquet(path)
        q.processAllAvailable()
    finally:
        q.stop()
    rows = {str(r.start): r.n for r in spark.table("stream_windows").collect()}
    assert rows["2024-01-01 00:00:00"] == 2  # the row at 03:00 came after the watermark had passed its window


def test_repetitions(spark):
    x = [150, 80, 120, 150, 100, 85, 160, 70]
    df = spark.createDataFrame([(0, 1, i, float(v)) for i, v in enumerate(x)], "stream_id long, track_id long, frame long, x double")
    assert T.count_repetitions(df, F.col("x")).first().reps == 3


class Replay:
    """The two-stage tracker once more, plainly: lists of tracks by state, dense matrices, assignment by trying all."""

    def __init__(self, wide):
        self.wide, self.n, self.tracked, self.lost, self.ids = wide, 0, [], [], 0

    def spread(self, m, p, v, shape, turn):
        w, h = (m[2], m[3]) if self.wide else (m[3], m[3])
        a = [w * p, h * p, w * p, h * p]
        b = [w * v, h * v, w * v, h * v]
        if not self.wide:
            a[2], b[2] = shape, turn
        return np.diag(np.square(a + b))

    def seen_as(self, box):
        x1, y1, x2, y2 = box
        return np.array([(x1 + x2) / 2, (y1 + y2) / 2, x2 - x1 if self.wide else (x2 - x1) / (y2 - y1), y2 - y1])

    def update(self, t, box):
        h = np.eye(4, 8)
        noise = self.spread(t["m"], 1 / 20, 0, 1e-1, 0)[:4, :4]
        s = h @ t["c"] @ h.T + noise
        k = t["c"] @ h.T @ np.linalg.inv(s)
        t["m"], t["c"] = t["m"] + k @ (self.seen_as(box) - h @ t["m"]), t["c"] - k @ s @ k.T
        t.update(on=True, seen=self.n)

    def box(self, t):
        x, y, w, h = t["m"][:4]
        w = w if self.wide else w * h
        return x - w / 2, y - h / 2, x + w / 2, y + h / 2

    def far(self, t, box):
        a, b = self.box(t), box
        i = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
        return 1 - i / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - i + 1e-7)

    def pairs(self, tracks, dets, limit, cost):
        """Each pair saves limit - cost; all ways of pairing are tried."""

        def best(i, free):
            if i == len(tracks):
                return 0.0, []
            out = best(i + 1, free)
            for d in free:
                c = cost(tracks[i], d)
                if c <= limit:
                    gain, rest = best(i + 1, [x for x in free if x is not d])
                    if gain + limit - c > out[0] + 1e-12:
                        out = gain + limit - c, [(tracks[i], d), *rest]
            return out

        found = best(0, dets)[1]
        used = [id(x) for p in found for x in p]
        return found, [t for t in tracks if id(t) not in used], [d for d in dets if id(d) not in used]

    def step(self, dets, warp=None):
        self.n += 1
        high, low = [d for d in dets if d["p"] > 0.5], [d for d in dets if 0.1 < d["p"] < 0.5]
        fresh, known = [t for t in self.tracked if not t["ok"]], [t for t in self.tracked if t["ok"]]
        was_lost = {id(t) for t in self.lost}
        move = np.eye(8) + np.eye(8, k=4)
        for t in [*known, *self.lost]:
            if id(t) in was_lost:
                t["m"][7] = 0
                if self.wide:
                    t["m"][6] = 0
            t["c"] = move @ t["c"] @ move.T + self.spread(t["m"], 1 / 20, 1 / 160, 1e-2, 1e-5)
            t["m"] = move @ t["m"]
        if warp is not None:
            for t in [*known, *self.lost, *fresh]:
                for part in range(4):
                    t["m"][2 * part : 2 * part + 2] = warp[:, :2] @ t["m"][2 * part : 2 * part + 2]
                t["m"][:2] += warp[:, 2]
                turn = np.zeros((8, 8))
                for part in range(4):
                    turn[2 * part : 2 * part + 2, 2 * part : 2 * part + 2] = warp[:, :2]
                t["c"] = turn @ t["c"] @ turn.T
        fused = lambda t, d: 1 - (1 - self.far(t, d["b"])) * d["p"]
        out = []
        hit, left, high = self.pairs([*known, *self.lost], high, 0.8, fused)
        weak, gone, _ = self.pairs([t for t in left if id(t) not in was_lost], low, 0.5, lambda t, d: self.far(t, d["b"]))
        for t, d in [*hit, *weak]:
            self.update(t, d["b"])
            out.append((t, d))
        lost = [t for t in left if id(t) in was_lost] + gone
        hit, _, high = self.pairs(fresh, high, 0.7, fused)
        for t, d in hit:
            self.update(t, d["b"])
            t["ok"] = True
            out.append((t, d))
        tracked = [t for t, _ in out]
        for d in high:
            if d["p"] >= 0.6:
                self.ids += 1
                m = np.concatenate([self.seen_as(d["b"]), np.zeros(4)])
                t = {"m": m, "c": self.spread(m, 2 / 20, 10 / 160, 1e-2, 1e-5), "ok": self.n == 1, "id": self.ids, "from": self.n, "seen": self.n}
                tracked.append(t)
                if t["ok"]:
                    out.append((t, d))
        lost = [t for t in lost if self.n - t["seen"] <= 30]
        drop = set()
        for t in tracked:
            for o in lost:
                if self.far(t, self.box(o)) < 0.15:
                    drop.add(id(o) if t["seen"] - t["from"] > o["seen"] - o["from"] else id(t))
        self.tracked, self.lost = [t for t in tracked if id(t) not in drop], [t for t in lost if id(t) not in drop]
        return sorted((t["id"], d["d"]) for t, d in out if id(t) not in drop)


@pytest.mark.parametrize("wide", [False, True])
@pytest.mark.parametrize("moving", [False, True])
def test_tracker_equals_a_plain_replay(wide, moving):
    import random

    r = random.Random(5)
    kept = 0
    for _ in range(25):
        things = [[r.uniform(0, 200), r.uniform(0, 200), r.uniform(-6, 6), r.uniform(-6, 6), r.uniform(15, 40), r.uniform(15, 40)] for _ in range(4)]
        tracker, replay = T.Tracker(motion=T.Motion(by_width=wide)), Replay(wide)
        for frame in range(1, 25):
            dets = []
            for k, (x, y, vx, vy, w, h) in enumerate(things):
                if r.random() < 0.8:
                    cx, cy = x + vx * frame + r.gauss(0, 1), y + vy * frame + r.gauss(0, 1)
                    dets.append({"d": k, "p": round(r.choice([0.05, 0.3, 0.55, 0.7, 0.9]) + r.random() / 50, 4), "b": (cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2)})
            angle = r.uniform(-0.02, 0.02)
            warp = np.array([[np.cos(angle), -np.sin(angle), r.uniform(-2, 2)], [np.sin(angle), np.cos(angle), r.uniform(-2, 2)]]) if moving and frame > 1 else None
            boxes, scores = np.array([d["b"] for d in dets]).reshape(-1, 4), np.array([d["p"] for d in dets])
            got = [(t, dets[i]["d"]) for t, i in tracker.step(boxes, scores, np.zeros(len(dets), int), warp)]
            assert sorted(got) == replay.step(dets, warp), frame
            kept += len(got)
    assert kept > 500


def test_camera_motion_reaches_the_tracker(spark):
    """A box at rest under a camera that moves far each frame is lost without the camera's motion."""
    rows = [(0, f, 1, 0, 0.9, 500.0 - 25 * f, 100.0, 530.0 - 25 * f, 140.0) for f in range(1, 9)] + [(7, 1, 1, 0, 0.9, 0.0, 0.0, 9.0, 9.0)]
    camera = spark.createDataFrame([(0, f, 1.0, 0.0, -25.0, 0.0, 1.0, 0.0) for f in range(2, 9)] + [(9, 1, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0)], "stream_id long, frame long, a double, b double, x double, c double, d double, y double")
    df = spark.createDataFrame(rows, SCHEMA)
    seen = lambda out: [r.track_id for r in sorted(out.collect(), key=lambda r: r.frame) if r.stream_id == 0]
    assert seen(T.track(df, True, camera)) == [1] * 8 and len(seen(T.track(df, True))) < 8


def test_moving_camera_query(spark):
    from tessera.plans.q_tracks import _detections
    from tessera.plans.registry import QUERIES

    sf = "/root/testdata/sf0.001"
    got: dict = {}
    for r in QUERIES["two_stage_tracks_moving"](spark, sf).collect():
        got.setdefault(r.stream_id, []).append((r.frame, r.track_id, r.det_id))
    rows = _detections(spark, sf).filter("stream_id < 2").toPandas().sort_values(["frame", "det_id"])
    for image in (0, 1):
        tracker, want = T.Tracker(motion=T.Motion(by_width=True)), []
        for frame, d in rows[rows["stream_id"] == image].groupby("frame"):
            boxes = d[["x1", "y1", "x2", "y2"]].to_numpy(float) - np.array([3.0, 1.0, 3.0, 1.0]) * (frame - 1)
            warp = np.array([[1.0, 0.0, -3.0], [0.0, 1.0, -1.0]]) if frame > 1 else None
            want += [(frame, t, int(d["det_id"].iloc[i])) for t, i in tracker.step(boxes, d["conf"].to_numpy(float), d["cls"].to_numpy(), warp)]
        assert sorted(got[image]) == sorted(want)


@pytest.mark.parametrize("name", ["two_stage_tracks", "two_stage_tracks_by_width"])
def test_every_image_is_a_stream(spark, name):
    from tessera.plans.fixtures import view
    from tessera.plans.q_tracks import _detections
    from tessera.plans.registry import QUERIES

    sf = "/root/testdata/sf0.001"
    images = {r.image_id for r in view(spark, sf, "pred").select("image_id").distinct().collect()}
    got: dict = {}
    for r in QUERIES[name](spark, sf).collect():
        got.setdefault(r.stream_id, []).append((r.frame, r.track_id, r.det_id))
    assert len(images) > 3 and set(got) == images
    rows = _detections(spark, sf).toPandas().sort_values(["frame", "det_id"])
    for image in (min(images), max(images)):
        tracker, want = T.Tracker(motion=T.Motion(by_width=name.endswith("width"))), []
        for frame, d in rows[rows["stream_id"] == image].groupby("frame"):
            seen = tracker.step(d[["x1", "y1", "x2", "y2"]].to_numpy(float), d["conf"].to_numpy(float), d["cls"].to_numpy())
            want += [(frame, t, int(d["det_id"].iloc[i])) for t, i in seen]
        assert sorted(got[image]) == sorted(want)
