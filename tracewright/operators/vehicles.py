"""One row for each valid track: the vehicle table, and the samples below it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import expr as E
from ..storage import durable
from .kinematics import TRACK, grid_samples, neighbours_in_time, valid_tracks
from .neighbours import with_headway
from .selection import at_places


def track_summary(obs: DataFrame, p: E.Parameters) -> DataFrame:
    """First sight, class, mean confidence, median segment speed (capped) and direction of each valid track."""
    o = neighbours_in_time(valid_tracks(obs, p.min_observations))
    dt = F.col("t") - F.col("p_t")
    segment = F.when(dt > 0, E.hop(F.col("cx") - F.col("p_cx"), F.col("cy") - F.col("p_cy")) / dt)
    order = F.struct("t", "frame_id")
    s = o.withColumn("segment", segment).groupBy(*TRACK).agg(
        F.min_by(F.struct("t", "frame_id", "class_id", "cx", "cy"), order).alias("a"),
        F.max_by(F.struct("t", "cx", "cy"), order).alias("z"),
        F.avg("confidence").alias("avg_confidence"), F.percentile("segment", 0.5).alias("median_speed"), F.count("*").alias("n_obs"),
    )
    dx, dy = F.col("z.cx") - F.col("a.cx"), F.col("z.cy") - F.col("a.cy")
    life = F.col("z.t") - F.col("a.t")
    speed = F.least(F.coalesce(F.col("median_speed"), E.rate(E.hop(dx, dy), life)), F.lit(p.speed_cap))
    return s.select(
        *TRACK, F.col("a.t").alias("first_t"), F.col("a.frame_id").alias("first_frame"), F.col("a.class_id").alias("class_id"),
        E.class_name("a.class_id").alias("class_name"), "avg_confidence", speed.alias("avg_speed"),
        E.direction_of_displacement(dx, dy).alias("direction"), "n_obs", F.col("z.t").alias("last_t"),
    )


def ranked(df: DataFrame, keys: tuple[str, ...], value: str) -> DataFrame:
    """df with each row's place (from 0) by value within its group, and the group's size."""
    w = W.partitionBy(*keys)
    return df.withColumns({"place": F.row_number().over(w.orderBy(value)) - 1, "size": F.count("*").over(w)})


def at_place(value: str, place: F.Column) -> F.Column:
    return F.max(F.when(F.col("place") == place, F.col(value)))


def speed_quartiles(summaries: DataFrame) -> DataFrame:
    """Positional quartiles of the vehicles' speeds in a video: element n div 4 and so on, upper-biased."""
    places = {name: lambda n, share=share: F.floor(n * share) for name, share in (("a", 0.25), ("b", 0.5), ("d", 0.75))}
    q = at_places(summaries, ["video_id"], "avg_speed", places).join(
        summaries.groupBy(F.col("video_id").alias("of")).agg(F.min("avg_speed").alias("low"), F.max("avg_speed").alias("high"), F.avg("avg_speed").alias("mean")),
        F.col("video_id").eqNullSafe(F.col("of")),
    )
    few = F.col("size") < 4
    pick = lambda small, big: F.when(few, F.col(small)).otherwise(F.col(big))
    return q.select("video_id", pick("low", "a").alias("q1"), pick("mean", "b").alias("median"), pick("high", "d").alias("q3"))


def sample_indicators(samples: DataFrame) -> DataFrame:
    """Per track: speed variation, mean lateral and low-tail linear acceleration, distance, samples; mean headway if the samples have it."""
    r = ranked(samples, TRACK, "accel_linear")
    n = F.col("size")
    tail = F.when(n >= 3, F.floor(n * 0.05)).otherwise(F.lit(0))
    moving = F.when(F.col("speed") > 0, F.col("speed"))
    way = [F.coalesce(F.avg(F.when(F.col("time_headway") > 0, F.col("time_headway"))), F.lit(999.0)).alias("headway")] if "time_headway" in samples.columns else []
    return r.groupBy(*TRACK).agg(
        F.when(F.count(moving) >= 2, F.stddev_pop(moving) / F.avg(moving)).otherwise(F.lit(0.0)).alias("speed_cv"),
        F.avg(F.abs("accel_lateral")).alias("sway"), F.coalesce(at_place("accel_linear", tail), F.lit(0.0)).alias("braking"),
        *way, F.sum("moved").alias("total_distance"), F.count("*").alias("n_samples"),
    )


def samples(obs: DataFrame, p: E.Parameters) -> DataFrame:
    return with_headway(grid_samples(obs, p), valid_tracks(obs, p.min_observations), p)


def measured(obs: DataFrame, p: E.Parameters, of_samples: DataFrame, summary: DataFrame | None = None) -> DataFrame:
    """Summary and indicators, without behaviour: what needs no headway asks for samples without it."""
    return (summary if summary is not None else track_summary(obs, p)).join(sample_indicators(of_samples), list(TRACK))


def vehicles(obs: DataFrame, p: E.Parameters, of_samples: DataFrame | None = None) -> DataFrame:
    """The vehicle table: summary, indicators and behaviour."""
    summary = durable(track_summary(obs, p), "summary")
    s = measured(obs, p, of_samples if of_samples is not None else samples(obs, p), summary)
    # A row for each video: joined by key, Spark broadcasts it where it is small. Every valid track has a sample,
    # so the summary alone gives the quartiles; they don't wait for the indicators.
    s = s.join(speed_quartiles(summary), "video_id")
    metric = lambda k: F.col(k) / p.ppm if p.ppm else F.lit(0.0)
    kind = E.behaviour(p, F.col("avg_speed"), F.col("speed_cv"), F.col("median"), F.col("q1"), F.col("q3"), metric("sway"), metric("braking"), F.col("headway"))
    return s.withColumn("behaviour", kind).drop("median", "q1", "q3")


def formatted_vehicles(v: DataFrame, p: E.Parameters) -> DataFrame:
    """The table as analytics read it: measures in the active unit, at two places."""
    per = p.ppm or 1.0
    return v.withColumns({
        "first_t": E.rounded("first_t"), "avg_speed": E.rounded(F.col("avg_speed") / per), "total_distance": E.rounded(F.col("total_distance") / per), "avg_confidence": E.rounded("avg_confidence"),
    })


def formatted_samples(s: DataFrame, p: E.Parameters) -> DataFrame:
    per = p.ppm or 1.0
    scaled = ("x", "y", "speed", "moved", "accel_linear", "accel_lateral", "dist_headway")
    held = lambda names: [k for k in names if k in s.columns]
    return s.withColumns({k: E.rounded(F.col(k) / per) for k in held(scaled)} | {k: E.rounded(k) for k in held(("heading", "time_headway"))})

