"""Resampling on whole seconds by linear interpolation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import expr as E
from .kinematics import TRACK, in_time

MEASURES = ("cx", "cy", "x1", "y1", "x2", "y2", "confidence")


def whole_seconds(obs: DataFrame, interval: float = 1.0, ppm: float | None = None) -> DataFrame:
    """A row for every whole second of a track's life; a track that holds none gets one at its rounded start.

    Every observation unfolds the seconds between itself and the next one, so no join is needed.
    """
    whole = W.partitionBy(*TRACK).orderBy("t", "frame_id").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    o = obs.withColumns({f"n_{k}": F.lead(k).over(in_time()) for k in ("t", *MEASURES)})
    o = o.withColumns({"first_t": F.first("t").over(whole), "last_t": F.last("t").over(whole), "first_class": F.first("class_id").over(whole)})
    low, high = F.ceil("t"), F.floor(F.coalesce("n_t", "t"))
    seconds = o.withColumn("sec", F.explode(F.when(high >= low, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))))
    seconds = seconds.where(F.col("n_t").isNull() | (F.col("sec") < F.col("n_t")))
    # A track between two whole seconds: clamped to its nearer end.
    short = o.where(F.ceil("first_t") > F.floor("last_t"))
    sec = F.rint("first_t").cast("long")
    at_end = F.when(sec > F.col("first_t"), F.col("n_t").isNull()).otherwise(F.lag("t").over(in_time()).isNull())
    short = short.withColumns({"sec": sec, "pick": at_end}).where("pick").drop("pick").withColumns({f"n_{k}": F.lit(None).cast("double") for k in ("t", *MEASURES)})
    rows = seconds.unionByName(short)
    ratio = F.when(F.col("n_t") > F.col("t"), (F.col("sec") - F.col("t")) / (F.col("n_t") - F.col("t"))).otherwise(F.lit(0.0))
    rows = rows.select(*TRACK, F.col("first_class").alias("class_id"), "sec", *[F.coalesce(E.lerp(F.col(k), F.col(f"n_{k}"), ratio), F.col(k)).alias(k) for k in MEASURES])
    w = W.partitionBy(*TRACK).orderBy("sec")
    rows = rows.withColumn("hop", F.coalesce(E.hop(F.col("cx") - F.lag("cx").over(w), F.col("cy") - F.lag("cy").over(w)), F.lit(0.0)))
    all_rows = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ends = lambda k: F.last(k).over(all_rows) - F.first(k).over(all_rows)
    rows = rows.withColumns({
        "speed": F.col("hop") / interval,
        "cumulative_distance": F.sum("hop").over(w.rowsBetween(W.unboundedPreceding, 0)),
        "direction": E.direction_of_resampled(ends("cx"), ends("cy"), F.count("*").over(W.partitionBy(*TRACK))),
        "class_name": E.class_name("class_id"),
    })
    metric = lambda x: x / ppm if ppm else F.lit(None).cast("double")
    return rows.withColumns({"speed_m": metric(F.col("speed")), "speed_kmph": metric(F.col("speed")) * 3.6, "cumulative_m": metric(F.col("cumulative_distance"))}).drop("hop")


def summary(resampled: DataFrame) -> DataFrame:
    """One row a track: life, distance, speeds (the leading 0 included), mean confidence."""
    return resampled.groupBy(*TRACK).agg(
        F.min_by("class_name", "sec").alias("class_name"), F.min_by("direction", "sec").alias("direction"),
        F.min("sec").alias("first_sec"), F.max("sec").alias("last_sec"), (F.max("sec") - F.min("sec")).alias("duration"),
        F.max_by("cumulative_distance", "sec").alias("distance"), F.avg("speed").alias("avg_speed"), F.max("speed").alias("max_speed"),
        F.count("*").alias("n_rows"), F.avg("confidence").alias("avg_confidence"),
    )
