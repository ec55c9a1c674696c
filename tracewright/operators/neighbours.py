"""Headway: for an observation, the nearest object ahead among the other tracks of its video."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr as E

KEY = ("video_id", "track_id", "frame_id")


#: Tolerances that a bucket of time spans.
SPAN = 4


def nearest_in_time(probe: DataFrame, obs: DataFrame, tolerance: float) -> DataFrame:
    """Each probe beside every other track's observation nearest in time, if it is within the tolerance.

    A band join as an equi-join: time is cut into buckets of SPAN tolerances. A track's observations of a
    bucket, and those within the tolerance about it, come together as one array; a probe meets one array of
    each other track and takes the nearest out of it. So pairs of observations are never rows that a sort or a
    shuffle sees: a row is a probe and a track. An array holds what one camera sees of one object in SPAN + 2
    tolerances. Ties go to the earlier observation.
    """
    bucket = lambda t: F.floor(t / (SPAN * tolerance)).cast("long")
    # A little more than the tolerance, so that no rounding at a bucket's edge loses a pair.
    reach, t = 1.001 * tolerance, F.col("t")
    p = probe.select(*KEY, "t", "cx", "cy", "heading", "speed", bucket(t).alias("bucket"))
    place = F.struct(t.alias("o_t"), F.col("frame_id").alias("o_frame"), F.col("cx").alias("o_cx"), F.col("cy").alias("o_cy"))
    o = obs.where(t.isNotNull()).select("video_id", F.col("track_id").alias("o_track"), place.alias("place"), F.explode(F.sequence(bucket(t - reach), bucket(t + reach))).alias("bucket"))
    # Grouped where the join needs them: one shuffle.
    o = o.repartition("video_id", "bucket").groupBy("video_id", "bucket", "o_track").agg(F.collect_list("place").alias("others"))
    pairs = p.join(o, ["video_id", "bucket"]).where(F.col("track_id") != F.col("o_track"))
    best = F.array_min(F.transform("others", lambda x: F.struct(F.abs(x["o_t"] - t).alias("dt"), x["o_t"].alias("o_t"), x["o_frame"].alias("o_frame"), x["o_cx"].alias("o_cx"), x["o_cy"].alias("o_cy"))))
    # Exploded, so that what asks for it below does not work it out again.
    found = pairs.select(*KEY, "t", "cx", "cy", "heading", "speed", "o_track", F.explode(F.array(best)).alias("o"))
    return found.where(F.col("o.dt") <= tolerance)


def headways(probe: DataFrame, obs: DataFrame, p: E.Parameters) -> DataFrame:
    """KEY, dist_headway and time_headway of the probes that have somebody ahead of them.

    Who is ahead is asked after the nearest observation in time is chosen, never before.
    """
    near = nearest_in_time(probe, obs, p.neighbour_seconds)
    dx, dy = F.col("o.o_cx") - F.col("cx"), F.col("o.o_cy") - F.col("cy")
    angle = F.radians("heading")
    ahead = near.where(dx * F.cos(angle) - dy * F.sin(angle) > 0)
    found = ahead.groupBy(*KEY, "speed").agg(F.min(E.hop(dx, dy)).alias("dist_headway"))
    seconds = F.when(F.col("speed") > 0.5, F.least(F.lit(p.headway_cap), F.col("dist_headway") / F.col("speed"))).otherwise(F.lit(0.0))
    return found.select(*KEY, "dist_headway", seconds.alias("time_headway"))


def with_headway(samples: DataFrame, obs: DataFrame, p: E.Parameters) -> DataFrame:
    """Samples with dist_headway and time_headway, 0 where nobody is ahead.

    Several samples may stand on one observation; headway is computed once for each observation.
    """
    probe = samples.select(*KEY, "t", "cx", "cy", "heading", "speed").distinct()
    found = headways(probe, obs, p)
    out = samples.join(found, list(KEY), "left")
    return out.withColumns({k: F.coalesce(k, F.lit(0.0)) for k in ("dist_headway", "time_headway")})
