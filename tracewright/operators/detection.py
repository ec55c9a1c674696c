"""Detections of a frame: filters, pairs by overlap, and the tracker that turns them into tracks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr as E


def banded(detections: DataFrame, high: float = 0.6, low: float = 0.1) -> DataFrame:
    return detections.withColumn("band", E.confidence_band("confidence", high, low))


def inside_polygon(detections: DataFrame, polygon: list[tuple[float, float]]) -> DataFrame:
    """The detections whose truncated centre lies in the region of interest."""
    x, y = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    return detections.where(E.in_polygon(x, y, polygon))


def clamped_to(detections: DataFrame, roi: tuple[float, float, float, float]) -> DataFrame:
    """Boxes cut to a rectangle (x, y, width, height) and moved to its origin; what lies outside goes."""
    x, y, w, h = roi
    cut = {"x1": E.clamp(F.col("x1") - x, 0, w), "x2": E.clamp(F.col("x2") - x, 0, w), "y1": E.clamp(F.col("y1") - y, 0, h), "y2": E.clamp(F.col("y2") - y, 0, h)}
    return detections.withColumns(cut).where("x2 > x1 and y2 > y1")


def suppressed(detections: DataFrame, confidence: float = 0.25, overlap: float = 0.45, across_classes: bool = False) -> DataFrame:
    """What a detector passes on: boxes of at least this confidence, less those that overlap a better one of their frame and class by more than `overlap`.

    Greedy: boxes are taken in order of confidence (ties by detection_id), each is kept unless a kept one
    overlaps it. A frame's boxes of a class come together as one array, folded in column functions: what a
    camera's frame holds bounds it. Other columns are kept. Null confidences are below any threshold.
    """
    key = ["video_id", "frame", *([] if across_classes else ["class_id"])]
    others = [c for c in detections.columns if c not in key]
    box = ("x1", "y1", "x2", "y2")
    area = lambda a: (a["x2"] - a["x1"]) * (a["y2"] - a["y1"])

    def meets(a: F.Column, b: F.Column) -> F.Column:
        zero = F.lit(0.0)
        inter = F.greatest(zero, F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])) * F.greatest(zero, F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
        union = area(a) + area(b) - inter
        return F.coalesce((union > 0) & (inter / union > overlap), F.lit(False))

    ranked = F.struct((-F.col("confidence")).alias("_rank"), F.col("detection_id").alias("_id"), *box, F.struct(*others).alias("_row"))
    grouped = detections.where(F.col("confidence") >= confidence).groupBy(*key).agg(F.array_sort(F.collect_list(ranked), lambda a, b: F.when(a["_rank"] != b["_rank"], F.signum(a["_rank"] - b["_rank"])).otherwise(F.signum((a["_id"] - b["_id"]).cast("double"))).cast("int")).alias("boxes"))
    kept = F.aggregate("boxes", F.slice("boxes", 1, 0), lambda held, b: F.when(F.exists(held, lambda a: meets(a, b)), held).otherwise(F.concat(held, F.array(b))))
    rows = grouped.select(*key, F.explode(kept).alias("b")).select(*key, "b._row.*")
    return rows.select(*detections.columns)


def overlap_pairs(detections: DataFrame, tracks: DataFrame, least: float = 0.0) -> DataFrame:
    """Overlap of each detection with each track of the same frame; an equi-join on (video, frame)."""
    d = detections.select("video_id", "frame", F.col("detection_id"), *[F.col(k).alias(f"d_{k}") for k in ("x1", "y1", "x2", "y2")])
    t = tracks.select("video_id", "frame", F.col("track_id"), *[F.col(k).alias(f"t_{k}") for k in ("x1", "y1", "x2", "y2")])
    return d.join(t, ["video_id", "frame"]).withColumn("iou", E.iou("d_", "t_")).where(F.col("iou") > least).select("video_id", "frame", "detection_id", "track_id", "iou")


def iou_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = a.reshape(-1, 4), b.reshape(-1, 4)
    low, high = np.maximum(a[:, None, :2], b[None, :, :2]), np.minimum(a[:, None, 2:], b[None, :, 2:])
    inter = np.prod(np.maximum(0.0, high - low), axis=2)
    area = lambda x: np.prod(x[:, 2:] - x[:, :2], axis=1)
    union = area(a)[:, None] + area(b)[None] - inter
    return np.where(union > 0, inter / np.where(union > 0, union, 1), 0.0)


def assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of a least-cost matching of the smaller side, by shortest augmenting paths."""
    if not cost.size:
        return []
    if cost.shape[0] > cost.shape[1]:
        return sorted((r, c) for c, r in assignment(cost.T))
    n, m = cost.shape
    row_price, col_price = np.zeros(n), np.zeros(m)
    row_of = np.full(m, -1)
    for start in range(n):
        reach, via = np.full(m, np.inf), np.full(m, -1)
        done = np.zeros(m, bool)
        row, column, so_far = start, -1, 0.0
        tree = [start]
        while row >= 0:
            through = so_far + cost[row] - row_price[row] - col_price
            better = ~done & (through < reach)
            reach[better], via[better] = through[better], column
            column = int(np.argmin(np.where(done, np.inf, reach)))
            so_far, done[column] = reach[column], True
            row = int(row_of[column])
            if row >= 0:
                tree.append(row)
        for c in np.flatnonzero(done):
            col_price[c] += reach[c] - so_far
        for r in tree:
            at = np.flatnonzero(row_of == r)
            row_price[r] += so_far - (reach[at[0]] if len(at) else 0.0)
        while column >= 0:
            before = int(via[column])
            row_of[column] = row_of[before] if before >= 0 else start
            column = before
    return sorted((int(r), c) for c, r in enumerate(row_of) if r >= 0)


def meeting(overlap: np.ndarray) -> list[tuple[list[int], list[int]]]:
    """Rows and columns that overlap, directly or through others: groups that nothing ties to each other."""
    rows, columns = np.nonzero(overlap > 0)
    beside: dict[int, list[int]] = {}
    for r, c in zip(rows.tolist(), columns.tolist(), strict=True):
        beside.setdefault(r, []).append(~c)
        beside.setdefault(~c, []).append(r)
    out, seen = [], set()
    for start in beside:
        if start in seen:
            continue
        seen.add(start)
        group = [start]
        for x in group:
            new = [y for y in beside[x] if y not in seen]
            seen.update(new)
            group += new
        out.append((sorted(x for x in group if x >= 0), sorted(~x for x in group if x < 0)))
    return out


def associate(overlap: np.ndarray, least: float) -> tuple[list[tuple[int, int]], list[int], list[int]]:
    """Optimal pairs whose overlap reaches `least` (asked after solving), and what is left on both sides.

    Pairs without overlap add nothing to the sum, so the best matching is that of each group of boxes that
    meet; most groups are a detection and its track.
    """
    found: list[tuple[int, int]] = []
    if least <= 0:
        found = assignment(1.0 - overlap)
    else:
        for rows, columns in meeting(overlap):
            if len(rows) == 1:
                found.append((rows[0], columns[int(np.argmax(overlap[rows[0], columns]))]))
            elif len(columns) == 1:
                found.append((rows[int(np.argmax(overlap[rows, columns[0]]))], columns[0]))
            else:
                found += [(rows[r], columns[c]) for r, c in assignment(1.0 - overlap[np.ix_(rows, columns)])]
    pairs = sorted((r, c) for r, c in found if overlap[r, c] >= least)
    left = lambda n, k: sorted(set(range(n)) - {p[k] for p in pairs})
    return pairs, left(overlap.shape[0], 0), left(overlap.shape[1], 1)


#: Frames of a video that one call of the solver gets.
FRAMES = 64


def assigned(detections: DataFrame, tracks: DataFrame, least: float = 0.2) -> DataFrame:
    """The optimal one-to-one pairs of each frame's detections and tracks, by summed overlap; pairs below `least` are left out after solving.

    Only pairs that overlap are gathered, a stretch of FRAMES frames at a time (a call for each frame costs more
    than its solution): what a camera's frames hold bounds them.
    """
    pairs = overlap_pairs(detections, tracks).withColumn("stretch", F.floor(F.col("frame") / FRAMES).cast("long"))

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("frame", kind="stable")
        frame, detection, track, iou = (part[k].to_numpy() for k in ("frame", "detection_id", "track_id", "iou"))
        ends = [*(np.flatnonzero(frame[1:] != frame[:-1]) + 1).tolist(), len(frame)]
        out = []
        for start, end in zip([0, *ends[:-1]], ends, strict=True):
            rows, row = np.unique(detection[start:end], return_inverse=True)
            columns, column = np.unique(track[start:end], return_inverse=True)
            overlap = np.zeros((len(rows), len(columns)))
            overlap[row, column] = iou[start:end]
            found, _, _ = associate(overlap, least)
            out += [(frame[start], rows[r], columns[c], overlap[r, c]) for r, c in found]
        return pd.DataFrame(out, columns=["frame", "detection_id", "track_id", "iou"]).assign(video_id=part["video_id"].iloc[0])

    return pairs.groupBy("video_id", "stretch").applyInPandas(solve, "video_id long, frame long, detection_id long, track_id long, iou double")


@dataclass(frozen=True)
class TrackerParameters:
    # The defaults of the tracker.
    high: float = 0.6
    low: float = 0.1
    new: float = 0.7
    match: float = 0.8
    buffer: int = 60
    min_hits: int = 3
    alpha: float = 0.7
    max_gap: int = 10
    history: int = 120


# Noise of a constant-velocity model of (centre, width, height).
PROCESS_NOISE = np.diag([1e-2, 1e-2, 1e-2, 1e-2, 5e-2, 5e-2, 1e-2, 1e-2]).astype(np.float32)
MEASUREMENT_NOISE = (np.eye(4) * 1e-1).astype(np.float32)
FIRST_SPREAD = np.diag([1, 1, 1, 1, 10, 10, 10, 10]).astype(np.float32)
MOVE = (np.eye(8) + np.eye(8, k=4)).astype(np.float32)
TENTATIVE, CONFIRMED, LOST = 0, 1, 2


@dataclass
class Track:
    track_id: int
    class_id: int
    confidence: float
    mean: np.ndarray
    spread: np.ndarray
    box: np.ndarray
    seen: int
    status: int = TENTATIVE
    streak: int = 0
    silent: int = 0
    age: int = 0
    hits: int = 1
    filled: dict[int, list[float]] = field(default_factory=dict)
    history: list[list[float]] = field(default_factory=list)

    def meet(self, box: np.ndarray, confidence: float, class_id: int, frame: int, p: TrackerParameters) -> None:
        """Correct the state with a matched box; fill a short gap; smooth; confirm."""
        gap = frame - self.seen
        if 1 < gap <= p.max_gap:
            for i in range(1, gap):
                between = self.box + (box - self.box) * (i / gap)
                self.filled[self.seen + i] = between.tolist()
                self.history.append([(between[0] + between[2]) / 2, (between[1] + between[3]) / 2])
        self.silent = 0
        self.streak += 1
        self.hits += 1
        seen = measured(box)
        gain = np.linalg.solve((self.spread[:4, :4] + MEASUREMENT_NOISE).T, self.spread[:, :4].T).T
        self.mean = self.mean + gain @ (seen - self.mean[:4])
        self.spread = self.spread - gain @ self.spread[:4]
        self.box = p.alpha * box + (1 - p.alpha) * self.box
        self.confidence, self.class_id, self.seen = confidence, class_id, frame
        self.history.append([(self.box[0] + self.box[2]) / 2, (self.box[1] + self.box[3]) / 2])
        del self.history[: -p.history]
        if self.status == LOST or self.status == TENTATIVE and self.streak >= p.min_hits:
            self.status = CONFIRMED


def move_all(tracks: list[Track]) -> None:
    """All tracks one frame on: their states move together, as stacked matrices."""
    if not tracks:
        return
    means = np.stack([t.mean for t in tracks]) @ MOVE.T
    spreads = MOVE @ np.stack([t.spread for t in tracks]) @ MOVE.T + PROCESS_NOISE
    for t, mean, spread in zip(tracks, means, spreads, strict=True):
        t.mean, t.spread = mean, spread
        t.age += 1
        if t.silent:
            t.streak = 0
        t.silent += 1


def expected_boxes(tracks: list[Track]) -> np.ndarray:
    """Where the tracks are expected; a box has a pixel a side at least."""
    state = np.stack([t.mean for t in tracks]).astype(float)
    centre, half = state[:, :2], np.maximum(state[:, 2:4], 1.0) / 2
    return np.concatenate([centre - half, centre + half], axis=1)


def measured(box: np.ndarray) -> np.ndarray:
    w, h = box[2] - box[0], box[3] - box[1]
    return np.array([box[0] + w / 2, box[1] + h / 2, w, h], np.float32)


class Tracker:
    """The tracker's state for one video; step() takes the frames in order."""

    def __init__(self, p: TrackerParameters | None = None):
        self.p = p or TrackerParameters()
        self.tracks: list[Track] = []
        self.created = 0
        self.last: int | None = None

    def _round(self, boxes: np.ndarray, chosen: list[int], tracks: list[Track], confidence: np.ndarray, classes: np.ndarray, frame: int) -> tuple[list[int], list[Track]]:
        """One association round; what stays unmatched of both."""
        if not chosen or not tracks:
            return chosen, tracks
        overlap = iou_matrix(boxes[chosen], expected_boxes(tracks))
        pairs, free, alone = associate(overlap, 1 - self.p.match)
        for d, t in pairs:
            i = chosen[d]
            tracks[t].meet(boxes[i], float(confidence[i]), int(classes[i]), frame, self.p)
        return [chosen[i] for i in free], [tracks[i] for i in alone]

    def step(self, frame: int, boxes: np.ndarray, confidence: np.ndarray, classes: np.ndarray) -> list[Track]:
        """Take one frame's detections; the confirmed tracks that were seen in it.

        Frames left out since the last one had no detections: the tracks move and age through them.
        """
        if self.last is not None:
            self.pass_by(frame - self.last - 1)
        self.last = frame
        return self._take(frame, boxes, confidence, classes)

    def pass_by(self, frames: int) -> None:
        """So many frames without detections; after `buffer` of them no track is left."""
        for k in range(min(frames, self.p.buffer + 1)):
            if not self.tracks:
                break
            self._take(self.last + 1 + k, np.zeros((0, 4)), np.zeros(0), np.zeros(0, int))

    def _take(self, frame: int, boxes: np.ndarray, confidence: np.ndarray, classes: np.ndarray) -> list[Track]:
        p, boxes = self.p, np.asarray(boxes, float).reshape(-1, 4)
        high = [i for i in range(len(boxes)) if confidence[i] >= p.high]
        low = [i for i in range(len(boxes)) if p.low <= confidence[i] < p.high]
        move_all(self.tracks)
        active, lost = [t for t in self.tracks if t.status != LOST], [t for t in self.tracks if t.status == LOST]
        high, alone = self._round(boxes, high, active, confidence, classes, frame)
        _, alone = self._round(boxes, low, alone, confidence, classes, frame)
        high, _ = self._round(boxes, high, lost, confidence, classes, frame)
        gone = {id(t) for t in (*alone, *lost) if t.silent > p.buffer}
        for t in alone:
            if t.status == CONFIRMED and id(t) not in gone:
                t.status = LOST
        self.tracks = [t for t in self.tracks if id(t) not in gone]
        for i in high:
            if confidence[i] >= p.new:
                self.created += 1
                box = boxes[i].copy()
                mean = np.concatenate([measured(box), np.zeros(4, np.float32)])
                centre = [(box[0] + box[2]) / 2, (box[1] + box[3]) / 2]
                self.tracks.append(Track(self.created, int(classes[i]), float(confidence[i]), mean, FIRST_SPREAD.copy(), box, frame, history=[centre]))
        return [t for t in self.tracks if t.status == CONFIRMED and t.silent == 0]


TRACKED = "video_id long, frame long, track_id long, class_id int, confidence double, x1 double, y1 double, x2 double, y2 double, cx double, cy double, age int, hits int"
NAMES = [k.split()[0] for k in TRACKED.split(", ")]


def tracked_rows(video: int, frame: int, tracks: list[Track]) -> list[tuple]:
    return [(video, frame, t.track_id, t.class_id, t.confidence, *t.box.tolist(), float(t.box[0] + t.box[2]) / 2, float(t.box[1] + t.box[3]) / 2, t.age, t.hits) for t in tracks]


def frames_in(rows: pd.DataFrame) -> Iterator[tuple[int, np.ndarray]]:
    """(frame, [x1, y1, x2, y2, confidence, class]) of rows in frame order; boxes that are not finite are left out."""
    values = rows[["x1", "y1", "x2", "y2", "confidence", "class_id"]].to_numpy(float)
    frames = rows["frame"].to_numpy()
    edges = np.flatnonzero(np.r_[True, frames[1:] != frames[:-1]]) if len(frames) else np.zeros(0, int)
    for lo, hi in zip(edges, [*edges[1:], len(frames)], strict=False):
        own = values[lo:hi]
        yield int(frames[lo]), own[np.isfinite(own).all(axis=1)]


def run_frames(tracker: Tracker, video: int, rows: pd.DataFrame) -> list[tuple]:
    """Step through the rows' frames in order."""
    out = []
    for frame, own in frames_in(rows.sort_values(["frame", "detection_id"], kind="stable")):
        out += tracked_rows(video, frame, tracker.step(frame, own[:, :4], own[:, 4], own[:, 5].astype(int)))
    return out


def track(detections: DataFrame, p: TrackerParameters | None = None) -> DataFrame:
    """Tracks of every video: detections (video_id, frame, detection_id, x1..y2, confidence, class_id) in frame order.

    Association is sequential within a video, so a video is the unit of work; ids count from 1 in each. A
    partition's videos stream through in order: a worker holds the tracker and a batch, never a whole video.
    """
    rows = detections.select("video_id", "frame", "detection_id", "x1", "y1", "x2", "y2", "confidence", "class_id")
    rows = rows.repartition("video_id").sortWithinPartitions("video_id", "frame", "detection_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        video, tracker, rest = None, None, None
        for batch in batches:
            if not len(batch):
                continue
            batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            # The last frame may go on in the next batch.
            last = (batch["video_id"] == batch["video_id"].iloc[-1]) & (batch["frame"] == batch["frame"].iloc[-1])
            rest, out = batch[last], []
            for name, own in batch[~last].groupby("video_id", sort=False):
                if name != video:
                    video, tracker = name, Tracker(p)
                out += run_frames(tracker, int(video), own)
            yield pd.DataFrame(out, columns=NAMES)
        if rest is not None and len(rest):
            name = rest["video_id"].iloc[0]
            yield pd.DataFrame(run_frames(tracker if name == video else Tracker(p), int(name), rest), columns=NAMES)

    return rows.where("video_id is not null").mapInPandas(run, TRACKED)
