"""The observations fact table, and the view of the driver's event stream that has its shape."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = (
    "video_id long, track_id long, frame_id long, t double, class_id int, confidence double, "
    "x1 double, y1 double, x2 double, y2 double, cx double, cy double"
)
TRACKS_PER_VIDEO = 15
EVENT_CLASS = {"click": 0, "view": 1, "purchase": 2, "signup": 3, "error": 4}


def from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users are tracks, their events are frames; a unit of time is half a day."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)")
    kinds = F.create_map(*[F.lit(v) for pair in EVENT_CLASS.items() for v in pair])
    cx = F.get_json_object("props", "$.k").cast("double") * 19.2
    half_w, half_h = (40 + 10 * (F.col("event_id") % 5)) / 2, (30 + 10 * (F.col("event_id") % 3)) / 2
    base = e.select(
        F.floor(F.col("user_id") / TRACKS_PER_VIDEO).cast("long").alias("video_id"),
        F.col("user_id").alias("track_id"),
        F.col("event_id").alias("frame_id"),
        (micros / F.lit(43200000000.0)).alias("t"),
        F.try_element_at(kinds, F.col("event_type")).cast("int").alias("class_id"),
        (F.col("event_id") * 37 % 101 / F.lit(100.0)).alias("confidence"),
        cx.alias("cx"), F.col("value").alias("cy"), half_w.alias("hw"), half_h.alias("hh"),
    )
    return base.select(
        "video_id", "track_id", "frame_id", "t", "class_id", "confidence",
        (F.col("cx") - F.col("hw")).alias("x1"), (F.col("cy") - F.col("hh")).alias("y1"),
        (F.col("cx") + F.col("hw")).alias("x2"), (F.col("cy") + F.col("hh")).alias("y2"), "cx", "cy",
    )


#: The same view for an SQL engine: a list of common table expressions.
SQL = """obs AS (
    SELECT user_id // 15 AS video_id, user_id AS track_id, event_id AS frame_id,
           (epoch_us(ts) - 1704067200000000) / 43200000000.0 AS t,
           CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 WHEN 'error' THEN 4 END AS class_id,
           (event_id * 37 % 101) / 100.0 AS confidence,
           CAST(json_extract_string(props, '$.k') AS DOUBLE) * 19.2 AS cx, value AS cy,
           CAST(json_extract_string(props, '$.k') AS DOUBLE) * 19.2 - (40 + 10 * (event_id % 5)) / 2.0 AS x1,
           value - (30 + 10 * (event_id % 3)) / 2.0 AS y1,
           CAST(json_extract_string(props, '$.k') AS DOUBLE) * 19.2 + (40 + 10 * (event_id % 5)) / 2.0 AS x2,
           value + (30 + 10 * (event_id % 3)) / 2.0 AS y2
    FROM events
)"""


def frames(total_frames: int, interval: int, fps: float, spark: SparkSession) -> DataFrame:
    """Index of the sampled frames of a video: source index, dense index, time to four places."""
    n = F.col("frame_index")
    return spark.range(0, total_frames, max(1, interval)).select(F.col("id").alias("frame_index")).select(
        n, F.floor(n / max(1, interval)).cast("long").alias("sampled_index"), (F.floor(n / F.lit(float(fps)) * 10000 + 0.5) / 10000).alias("timestamp_sec")
    )


def every_nth(frames: DataFrame, interval: int, fps: float, most: int | None = None) -> DataFrame:
    """The frames (video_id, frame_index) of a table whose index the interval divides, counted densely in each video; the first `most` of each, if told."""
    n, w = F.col("frame_index"), Window.partitionBy("video_id").orderBy("frame_index")
    out = frames.where(n % max(1, interval) == 0).withColumns({
        "sampled_index": (F.row_number().over(w) - 1).cast("long"), "timestamp_sec": F.floor(n / F.lit(float(fps)) * 10000 + 0.5) / 10000,
    })
    return out if most is None else out.where(F.col("sampled_index") < most)


def parsed_detections(rows: DataFrame, raw: str = "raw") -> DataFrame:
    """[x1, y1, x2, y2, confidence, class, ...] as strings or numbers; malformed rows go, what is beyond is ignored."""
    names = ("x1", "y1", "x2", "y2", "confidence", "class_id")
    cells = {k: F.get(F.col(raw), i).try_cast("double") for i, k in enumerate(names)}
    out = rows.where(F.size(raw) >= 6).withColumns(cells)
    whole = F.lit(True)
    for k in names:
        whole = whole & F.col(k).isNotNull()
    return out.where(whole).withColumn("class_id", F.col("class_id").cast("int")).drop(raw)


VIDEOS = "video_id long, file string, width int, height int, fps double, total_frames long"


def video_info(videos: DataFrame, interval: int = 3) -> DataFrame:
    """What is told of each video of a table (VIDEOS): duration, and what sampling every interval-th frame gives of it.

    Without a frame rate the duration is 0 and no frames come in a second.
    """
    step, fps = max(1, interval), F.coalesce("fps", F.lit(0.0))
    two = lambda x: F.floor(x * 100 + 0.5) / 100
    return videos.select(
        "video_id", "file", "width", "height", "fps", "total_frames",
        two(F.when(fps > 0, F.col("total_frames") / fps).otherwise(F.lit(0.0))).alias("duration_sec"),
        F.lit(step).alias("sample_interval"), two(fps / step).alias("effective_fps"),
        F.floor(F.col("total_frames") / step).cast("long").alias("expected_sampled_frames"),
    )
