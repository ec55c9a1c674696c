"""Structured Streaming: the tracker with typed state and timers, its snapshots, running metrics, event-time windows, finalising batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..operators.detection import NAMES, TRACKED, Track, Tracker, TrackerParameters, run_frames


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: A live track as state; matrices row by row, history and filled boxes flat.
TRACK_STATE = (
    "track_id long, class_id int, confidence double, mean array<float>, spread array<float>, box array<double>, seen long, status int, "
    "streak int, silent int, age int, hits int, filled array<double>, history array<double>"
)
WAITING = "frame long, detection_id long, x1 double, y1 double, x2 double, y2 double, confidence double, class_id int"
WAITING_NAMES = [c.split()[0] for c in WAITING.split(", ")]
#: created: ids given so far; last: the newest frame tracked; due: when the timer is; quiet: whether it is the one that
#: forgets the video, the tracks being gone already; reset_at: the reset that was done.
VIDEO_STATE = "created long, last long, due long, quiet boolean, reset_at long"


def as_state(t: Track) -> tuple:
    flat = lambda rows: [float(x) for row in rows for x in row]
    return (
        t.track_id, t.class_id, t.confidence, t.mean.tolist(), t.spread.ravel().tolist(), t.box.tolist(), t.seen, t.status,
        t.streak, t.silent, t.age, t.hits, flat((f, *box) for f, box in t.filled.items()), flat(t.history),
    )


def from_state(s: tuple) -> Track:
    filled, history = s[12] or [], s[13] or []
    return Track(
        s[0], s[1], s[2], np.array(s[3], np.float32), np.array(s[4], np.float32).reshape(8, 8), np.array(s[5], float), s[6], s[7], s[8], s[9], s[10], s[11],
        {int(filled[i]): list(filled[i + 1 : i + 5]) for i in range(0, len(filled), 5)}, [list(history[i : i + 2]) for i in range(0, len(history), 2)],
    )


class VideoTracker(StatefulProcessor):
    """The tracker of one video over micro-batches.

    State: a value (VIDEO_STATE), a list with one row for each live track, and a list of the detections that wait
    for late frames. With event time, a timer follows the newest detection: when a video has been quiet for as
    long as the tracker keeps a lost track, what waits is tracked and put out, and all tracks go; when it has
    been quiet for `forget` times as long, the video's id counter goes too and nothing of it is left.
    """

    def __init__(self, p: TrackerParameters | None, lateness_frames: int, time: str | None, fps: float, forget: int, resets: dict[int, int]):
        self.p, self.lateness, self.time = p or TrackerParameters(), lateness_frames, time
        self.quiet_ms = int((self.p.buffer + 1) / fps * 1000)
        self.forget_ms, self.resets = self.quiet_ms * max(0, forget - 1), resets

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.video = handle.getValueState("video", VIDEO_STATE)
        self.tracks = handle.getListState("tracks", TRACK_STATE)
        self.waiting = handle.getListState("waiting", WAITING)

    def _tracker(self, video: int) -> tuple[Tracker, int | None, bool, int | None]:
        """The tracker as the state has it, its timer and whether it is the last one, and the reset that was done; a new reset is done here."""
        created, last, due, quiet, reset_at = self.video.get() if self.video.exists() else (0, None, None, False, None)
        tracker = Tracker(self.p)
        asked = self.resets.get(video)
        if asked is not None and asked != reset_at:
            self.tracks.clear()
            self.waiting.clear()
            return tracker, due, quiet, asked
        tracker.created, tracker.last = created, last
        tracker.tracks = [from_state(s) for s in self.tracks.get()] if self.tracks.exists() else []
        return tracker, due, quiet, reset_at

    def _keep(self, tracker: Tracker, due: int | None, reset_at: int | None) -> None:
        self.video.update((tracker.created, tracker.last, due, False, reset_at))
        if tracker.tracks:
            self.tracks.put([as_state(t) for t in tracker.tracks])
        elif self.tracks.exists():
            self.tracks.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        video = int(key[0])
        tracker, due, quiet, reset_at = self._tracker(video)
        parts = [part for part in rows if len(part)]
        newest = max((int(part[self.time].max().value // 1_000_000) for part in parts), default=None) if self.time else None
        if self.waiting.exists():
            parts.append(pd.DataFrame(list(self.waiting.get()), columns=WAITING_NAMES))
        held = pd.concat([part[WAITING_NAMES] for part in parts], ignore_index=True)
        if tracker.last is not None:
            held = held[held["frame"] > tracker.last]
        ready = held["frame"].max() - self.lateness if len(held) else -1
        now, later = held[held["frame"] <= ready], held[held["frame"] > ready]
        out = run_frames(tracker, video, now)
        if len(later):
            self.waiting.put([tuple(x.item() if hasattr(x, "item") else x for x in r) for r in later.itertuples(index=False)])
        elif self.waiting.exists():
            self.waiting.clear()
        if newest is not None and (due is None or quiet or newest + self.quiet_ms > due):
            if due is not None:
                self.handle.deleteTimer(due)
            due = newest + self.quiet_ms
            self.handle.registerTimer(due)
        self._keep(tracker, due, reset_at)
        yield pd.DataFrame(out, columns=NAMES)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        video = int(key[0])
        tracker, _, quiet, reset_at = self._tracker(video)
        left = pd.DataFrame(list(self.waiting.get()), columns=WAITING_NAMES) if self.waiting.exists() else None
        out = run_frames(tracker, video, left) if left is not None else []
        self.waiting.clear()
        self.tracks.clear()
        if quiet or not self.forget_ms:
            self.video.clear()
        else:
            due = expiredTimerInfo.getExpiryTimeInMs() + self.forget_ms
            self.handle.registerTimer(due)
            self.video.update((tracker.created, tracker.last, due, True, reset_at))
        yield pd.DataFrame(out, columns=NAMES)

    def close(self) -> None:
        pass


def tracked(
    detections: DataFrame, p: TrackerParameters | None = None, lateness_frames: int = 0, time: str | None = None, lateness: str = "10 seconds",
    fps: float = 30.0, forget: int = 10, resets: dict[int, int] | None = None,
) -> DataFrame:
    """The tracker over a stream of detections (as operators.detection.track), state kept by video.

    Frames may come late by up to lateness_frames: rows wait in state until a frame so far ahead is seen,
    then go through the tracker in frame order. A frame older than one already tracked is dropped.
    With lateness_frames 0 a frame must arrive whole in one micro-batch.

    time names a timestamp column: then rows may be late by `lateness`, and the state of a quiet video goes (see
    VideoTracker; forget=1 drops the id counter with the tracks). Without it nothing expires. resets maps a video
    to any number: a query started again from its checkpoint with a number not given before forgets the
    video's tracks and counts ids from 1. The session's state store is set to RocksDB, which timers and typed state need.
    """
    detections.sparkSession.conf.set(PROVIDER, ROCKS)
    columns = ["video_id", *WAITING_NAMES, *([time] if time else [])]
    rows = (detections.withWatermark(time, lateness) if time else detections).select(*columns)
    processor = VideoTracker(p, lateness_frames, time, fps, forget, resets or {})
    return rows.groupBy("video_id").transformWithStateInPandas(processor, TRACKED, "append", "eventTime" if time else "none")


def live_tracks(spark: SparkSession, checkpoint: str, batch: int | None = None) -> DataFrame:
    """The live tracks of every video as a running or stopped query of tracked() has them in its state.

    It reads the state's own files, so the query isn't held up; batch chooses an older micro-batch. A row
    carries the video's id counter and the newest frame tracked; a video without live tracks has none.
    """

    def state(name: str) -> DataFrame:
        reader = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", name)
        return (reader if batch is None else reader.option("batchId", batch)).load()

    value = state("video").select(F.col("key.video_id").alias("video_id"), F.col("value.created").alias("created"), F.col("value.last").alias("frame"))
    own = state("tracks").select(F.col("key.video_id").alias("video_id"), "list_element.*")
    status = F.element_at(F.array(*[F.lit(s) for s in ("tentative", "confirmed", "lost")]), F.col("status") + 1)
    return own.join(value, "video_id").select(
        "video_id", "frame", "created", "track_id", "class_id", "confidence", *[F.get("box", i).alias(k) for i, k in enumerate(("x1", "y1", "x2", "y2"))],
        status.alias("status"), "silent", "age", "hits", (F.size("history") / 2).cast("int").alias("history"),
    )


RUNNING = "video_id long, track_id long, frame_id long, speed double, cumulative_distance double"
RUNNING_STATE = "t double, x double, y double, total double, due long"


class RunningTrack(StatefulProcessor):
    """Last place and distance so far of one track; with event time they go when the track has been quiet for long enough."""

    def __init__(self, time: str | None, quiet_seconds: float):
        self.time, self.quiet_ms = time, int(quiet_seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.track = handle.getValueState("track", RUNNING_STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True).sort_values(["t", "frame_id"], kind="stable")
        t, x, y = (new[c].to_numpy(float) for c in ("t", "cx", "cy"))
        t0, x0, y0, total, due = self.track.get() if self.track.exists() else (t[0], x[0], y[0], 0.0, None)
        # Each row beside the one before it, the first beside what the state holds.
        dt, dx, dy = (np.diff(c, prepend=c0) for c, c0 in ((t, t0), (x, x0), (y, y0)))
        hop = np.sqrt(dx**2 + dy**2)
        speed = np.divide(hop, dt, out=np.zeros(len(hop)), where=dt > 0)
        so_far = np.cumsum(np.concatenate([[total], hop]))[1:]
        if self.time:
            quiet = int(new[self.time].max().value // 1_000_000) + self.quiet_ms
            if due is None or quiet > due:
                if due is not None:
                    self.handle.deleteTimer(due)
                due = quiet
                self.handle.registerTimer(due)
        self.track.update((float(t[-1]), float(x[-1]), float(y[-1]), float(so_far[-1]), due))
        yield pd.DataFrame({"video_id": int(key[0]), "track_id": int(key[1]), "frame_id": new["frame_id"].to_numpy(), "speed": speed, "cumulative_distance": so_far})

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.track.clear()
        return iter(())

    def close(self) -> None:
        pass


def running_metrics(obs: DataFrame, time: str | None = None, lateness: str = "10 seconds", quiet_seconds: float = 2.0) -> DataFrame:
    """Backward speed and running distance of each observation as it arrives, state kept by track.

    time names a timestamp column: then a track's state goes once it has been quiet for quiet_seconds beyond the
    watermark (a track that comes back begins anew, as the tracker gives it a new id). Without it nothing expires.
    """
    obs.sparkSession.conf.set(PROVIDER, ROCKS)
    columns = ["video_id", "track_id", "frame_id", "t", "cx", "cy", *([time] if time else [])]
    rows = (obs.withWatermark(time, lateness) if time else obs).select(*columns)
    return rows.groupBy("video_id", "track_id").transformWithStateInPandas(RunningTrack(time, quiet_seconds), RUNNING, "append", "eventTime" if time else "none")


def windowed_counts(events: DataFrame, time: str, keys: list[str], width: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Rows of each tumbling window and key; rows later than the watermark are dropped."""
    return events.withWatermark(time, lateness).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"))


def sessions(events: DataFrame, time: str, key: str, gap: str = "30 minutes", lateness: str = "10 minutes") -> DataFrame:
    """Stays of a key: sessions end after a gap, as a track ends when it is lost for long enough."""
    return events.withWatermark(time, lateness).groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n"))


def finalised(stream: DataFrame, finish: Callable[[DataFrame, int], None], checkpoint: str):
    """Append each micro-batch and finalise it with a batch query."""
    return stream.writeStream.foreachBatch(finish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
