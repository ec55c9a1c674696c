"""Live progress of a stream of frames: counters gathered by Spark with each micro-batch, no state of our own."""

from __future__ import annotations

import threading
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import QueryProgressEvent, QueryStartedEvent, QueryTerminatedEvent, StreamingQueryListener

FRAMES, TRACKS = "frames_in", "tracks_out"


def detections_of(frames: DataFrame, boxes: str = "boxes") -> DataFrame:
    """The detections of a stream with one row a frame (video_id, frame, an array of boxes), frames and boxes counted on the way.

    Boxes are structs with x1, y1, x2, y2, confidence and class_id; their places are the detection ids.
    """
    counted = frames.observe(FRAMES, F.count("*").alias("frames"), F.coalesce(F.sum(F.greatest(F.size(boxes), F.lit(0))), F.lit(0)).alias("detections"), F.max("frame").alias("last_frame"))
    others = [c for c in frames.columns if c != boxes]
    return counted.select(*others, F.posexplode(boxes).alias("detection_id", "_box")).select(*others, F.col("detection_id").cast("long").alias("detection_id"), "_box.*")


def counted_tracks(tracked: DataFrame) -> DataFrame:
    """The tracker's rows, counted on the way: rows, and the rows in which a track is first seen (hits of a confirmed one begin with min_hits + 1 at least)."""
    return tracked.observe(TRACKS, F.count("*").alias("rows"), F.coalesce(F.max("track_id"), F.lit(0)).alias("greatest_id"))


@dataclass
class Counters:
    """What a query has done so far."""

    batches: int = 0
    frames: int = 0
    detections: int = 0
    rows: int = 0
    greatest_id: int = 0
    last_frame: int | None = None
    seconds: float = 0.0
    running: bool = True

    def share(self, total_frames: int) -> float:
        """Progress from 0 to 1 of a known number of frames; 0 where it is not known."""
        return min(self.frames / total_frames, 1.0) if total_frames > 0 else 0.0

    def frames_per_second(self) -> float:
        return self.frames / self.seconds if self.seconds > 0 else 0.0

    def seconds_left(self, total_frames: int) -> float | None:
        rate = self.frames_per_second()
        return max(0, total_frames - self.frames) / rate if rate else None


class LiveProgress(StreamingQueryListener):
    """Counters of every named query whose frames go through detections_of() and counted_tracks().

    Register with spark.streams.addListener(); of() may be asked while the query runs, from any thread.
    history has a copy for each micro-batch with data.
    """

    def __init__(self) -> None:
        self._lock = threading.Lock()
        self._of: dict[str, Counters] = {}
        self._names: dict[str, str] = {}
        self._began: dict[str, float] = {}
        self.history: dict[str, list[dict]] = {}

    def of(self, name: str) -> Counters:
        with self._lock:
            return Counters(**vars(self._of.get(name, Counters())))

    def onQueryStarted(self, event: QueryStartedEvent) -> None:
        with self._lock:
            name = event.name or str(event.id)
            self._names[str(event.runId)] = name
            self._of[name], self._began[name], self.history[name] = Counters(), time.monotonic(), []

    def onQueryProgress(self, event: QueryProgressEvent) -> None:
        seen = event.progress.observedMetrics
        with self._lock:
            name = event.progress.name or str(event.progress.id)
            now = self._of.setdefault(name, Counters())
            frames, tracks = seen.get(FRAMES), seen.get(TRACKS)
            if frames is not None and frames["frames"]:
                now.batches += 1
                now.frames += frames["frames"]
                now.detections += frames["detections"]
                now.last_frame = max(x for x in (now.last_frame, frames["last_frame"]) if x is not None)
            if tracks is not None:
                now.rows += tracks["rows"]
                now.greatest_id = max(now.greatest_id, tracks["greatest_id"])
            now.seconds = time.monotonic() - self._began.get(name, time.monotonic())
            if frames is not None and frames["frames"]:
                self.history.setdefault(name, []).append(dict(vars(now)))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:
        with self._lock:
            name = self._names.get(str(event.runId))
            if name in self._of:
                self._of[name].running = False
