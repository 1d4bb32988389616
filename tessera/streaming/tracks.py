"""Streaming twins of the batch track operators: state per stream or track, event time, watermarks."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.operators.tracks import TRACK_SCHEMA, Tracker


def windowed_counts(events: DataFrame, length: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Tumbling counts per type; rows later than the watermark are dropped."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def crossings(tracks: DataFrame, low: float, high: float) -> DataFrame:
    """(stream_id, track_id, frame, way): the first time that a track with a previous place is at low <= x < high."""

    def run(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values("frame")
        prev, done = state.get if state.exists else (None, False)
        out = []
        for r in rows.itertuples():
            if prev is not None and not done and low <= r.x < high:
                out.append((*key, r.frame, "in" if r.x > prev else "out"))
                done = True
            prev = float(r.x)
        state.update((prev, done))
        yield pd.DataFrame(out, columns=["stream_id", "track_id", "frame", "way"])

    return tracks.groupBy("stream_id", "track_id").applyInPandasWithState(run, "stream_id long, track_id long, frame long, way string", "prev double, done boolean", "append", GroupStateTimeout.NoTimeout)


def track(detections: DataFrame) -> DataFrame:
    """The two-stage tracker with its tracks as state of each stream; frames of a trigger go in order."""

    def run(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tracker = pickle.loads(state.get[0]) if state.exists else Tracker()  # state that this operator wrote itself
        rows, out = pd.concat(list(parts)).sort_values(["frame", "det_id"]), []
        for frame, d in rows.groupby("frame", sort=True):
            got = tracker.step(d[["x1", "y1", "x2", "y2"]].to_numpy(np.float64), d["conf"].to_numpy(np.float64), d["cls"].to_numpy())
            out += [(key[0], frame, t, d["det_id"].iloc[i]) for t, i in got]
        state.update((pickle.dumps(tracker),))
        yield pd.DataFrame(out, columns=["stream_id", "frame", "track_id", "det_id"])

    return detections.groupBy("stream_id").applyInPandasWithState(run, TRACK_SCHEMA, "tracker binary", "append", GroupStateTimeout.NoTimeout)
