"""Per-track series: speeds, distances, smoothing, and the regular 0.5 s grid of samples.

Everything is a window over (video_id, track_id) ordered by time, so one exchange serves the whole chain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec

from ..functions import expr as E
from ..storage import durable
from .ranks import positions

TRACK = ("video_id", "track_id")


def in_time() -> WindowSpec:
    """A track's rows in time order (windows need a running session, so they are made when asked for)."""
    return W.partitionBy(*TRACK).orderBy("t", "frame_id")


def valid_tracks(obs: DataFrame, least: int) -> DataFrame:
    return obs.withColumn("n_obs", F.count("*").over(W.partitionBy(*TRACK))).where(F.col("n_obs") >= least)


def neighbours_in_time(obs: DataFrame) -> DataFrame:
    cols = {}
    for k in ("t", "cx", "cy"):
        cols[f"p_{k}"] = F.lag(k).over(in_time())
        cols[f"n_{k}"] = F.lead(k).over(in_time())
    return obs.withColumns(cols)


def frame_kinematics(obs: DataFrame) -> DataFrame:
    """Backward speed and running distance of every observation; both 0 for a track's first."""
    o = neighbours_in_time(obs)
    step = F.coalesce(E.hop(F.col("cx") - F.col("p_cx"), F.col("cy") - F.col("p_cy")), F.lit(0.0))
    speed = F.coalesce(E.rate(step, F.col("t") - F.col("p_t")), F.lit(0.0))
    o = o.withColumns({"hop": step, "speed": speed})
    return o.withColumn("cumulative_distance", F.sum("hop").over(in_time().rowsBetween(W.unboundedPreceding, 0)))


def observation_speeds(obs: DataFrame, cap: float) -> DataFrame:
    """raw_speed (forward for a track's first), speed (median of three, capped) and heading."""
    o = neighbours_in_time(obs)
    first = F.col("p_t").isNull()
    ahead = E.rate(E.hop(F.col("n_cx") - F.col("cx"), F.col("n_cy") - F.col("cy")), F.col("n_t") - F.col("t"))
    behind = E.rate(E.hop(F.col("cx") - F.col("p_cx"), F.col("cy") - F.col("p_cy")), F.col("t") - F.col("p_t"))
    turn = F.when(~first, E.degrees_of(-(F.col("cy") - F.col("p_cy")), F.col("cx") - F.col("p_cx"))).when(
        F.col("n_t").isNotNull(), E.degrees_of(-(F.col("n_cy") - F.col("cy")), F.col("n_cx") - F.col("cx"))
    )
    o = o.withColumns({"raw_speed": F.coalesce(F.when(first, ahead).otherwise(behind), F.lit(0.0)), "heading": F.coalesce(turn, F.lit(0.0))})
    a, b = F.lag("raw_speed").over(in_time()), F.lead("raw_speed").over(in_time())
    smooth = F.when(a.isNotNull() & b.isNotNull(), E.middle_of_three(a, F.col("raw_speed"), b)).otherwise(F.col("raw_speed"))
    return o.withColumn("speed", F.least(smooth, F.lit(cap)))


def nearest_grid(o: DataFrame, step: float) -> DataFrame:
    """For each grid instant of a track the observation nearest in time, ties to the earlier one.

    No join: every observation unfolds the grid points about it, padded by one at either side, and keeps
    those that it is nearest to. o must have p_t and n_t.
    """
    t, st = F.col("t"), F.col("st")
    o = o.withColumn("t0", F.first("t").over(in_time().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    low = F.coalesce((F.col("p_t") + t) / 2, t) - F.col("t0")
    high = F.coalesce((F.col("n_t") + t) / 2, t) - F.col("t0")
    k_low = F.greatest(F.lit(0), F.floor(low / step).cast("int") - 1)
    k_high = F.greatest(k_low, F.floor(high / step).cast("int") + 1)
    grid = o.withColumn("sample_idx", F.explode(F.sequence(k_low, k_high))).withColumn("st", F.col("t0") + F.col("sample_idx") * F.lit(step))
    gap = F.abs(t - st)
    not_before = F.col("p_t").isNull() | (gap < F.abs(F.col("p_t") - st))
    not_after = F.col("n_t").isNull() & (st <= t + 1e-6) | F.col("n_t").isNotNull() & (gap <= F.abs(F.col("n_t") - st))
    return grid.where(not_before & not_after)


def grid_samples(obs: DataFrame, p: E.Parameters) -> DataFrame:
    """Samples every p.step: position (origin at the bottom left), heading, speed, distance, accelerations."""
    s = nearest_grid(observation_speeds(valid_tracks(obs, p.min_observations), p.speed_cap), p.step)
    w = W.partitionBy(*TRACK).orderBy("sample_idx")
    lag = lambda k: F.lag(k).over(w)
    s = s.withColumns({"x": F.col("cx"), "y": F.lit(p.frame_height) - F.col("cy")})
    moved = E.hop(F.col("x") - lag("x"), F.col("y") - lag("y"))
    linear = (F.col("speed") - lag("speed")) / p.step
    turned = E.wrapped(F.col("heading") - lag("heading"))
    lateral = F.when(F.col("speed") > 0, -F.col("speed") * (F.radians(turned) / p.step)).otherwise(F.lit(0.0))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return s.withColumns({"moved": zero(moved), "accel_linear": zero(linear), "accel_lateral": zero(F.when(lag("speed").isNotNull(), lateral))})


CORNERS = ("x1", "y1", "x2", "y2")
#: Rows that one array of the scan holds.
SCAN = 64


def composed(steps: Column) -> Column:
    """The steps of a chunk as one: what it leaves of a box that comes in (kept), and what it adds to it (b1..b4)."""
    names = ["kept", *(f"b{i}" for i in range(len(CORNERS)))]
    zero = F.struct(F.lit(1.0).alias("kept"), *(F.lit(0.0).alias(n) for n in names[1:]))
    return F.aggregate(steps, zero, lambda s, x: F.struct((s["kept"] * x["kept"]).alias("kept"), *((x[n] + x["kept"] * s[n]).alias(n) for n in names[1:])))


def after_each(steps: Column, box: Column) -> Column:
    """The boxes after each step, from a box that comes in."""
    names = [f"b{i}" for i in range(len(CORNERS))]
    moved = lambda b, x: F.struct(*((x[n] + x["kept"] * b[n]).alias(n) for n in names))
    state = F.struct(box.alias("box"), F.array().cast("array<struct<" + ",".join(f"{n}:double" for n in names) + ">>").alias("all"))
    step = lambda s, x: F.struct(moved(s["box"], x).alias("box"), F.concat(s["all"], F.array(moved(s["box"], x))).alias("all"))
    return F.aggregate(steps, state, step, lambda s: s["all"])


def scanned(chunks: DataFrame, longest: int) -> DataFrame:
    """Chunks (track, chunk, own: the chunk as one step) with the box that comes into each.

    Chunks of a track are themselves chunked until one array holds those of the longest track.
    """
    zero = F.struct(*(F.lit(0.0).alias(f"b{i}") for i in range(len(CORNERS))))
    upper = (F.col("chunk") / SCAN).cast("long")
    grouped = chunks.groupBy(*TRACK, upper.alias("group")).agg(F.array_sort(F.collect_list(F.struct("chunk", "own"))).alias("held"))
    steps = F.transform("held", lambda x: x["own"])
    if longest <= SCAN:
        coming = grouped.withColumn("box", zero)
    else:
        above = grouped.select(*TRACK, F.col("group").alias("chunk"), composed(steps).alias("own"))
        coming = grouped.join(scanned(above, -(-longest // SCAN)).select(*TRACK, F.col("chunk").alias("group"), "box"), [*TRACK, "group"])
    boxes = F.concat(F.array("box"), after_each(steps, F.col("box")))
    zipped = F.arrays_zip(F.transform("held", lambda x: x["chunk"]).alias("chunk"), F.slice(boxes, F.lit(1), F.size("held")).alias("box"))
    return coming.select(*TRACK, F.explode(zipped).alias("z")).select(*TRACK, "z.chunk", "z.box")


def smoothed_boxes(obs: DataFrame, alpha: float = 0.7) -> DataFrame:
    """Exponentially smoothed corners in time order: alpha of the new box, the rest of the old one.

    A step is an affine map of the box before it, and such maps compose: a track is cut into chunks of SCAN
    rows, each chunk is composed to one map, the maps are scanned (in chunks again, for long tracks), and every
    chunk starts from the box that comes into it. Places in a track come from sorted partitions, so a long
    track lies over many tasks throughout, and all of it is column functions. Null track keys are a track.
    """
    rows = obs.select(*TRACK, "frame_id", "t", *CORNERS)
    keyed = rows.withColumns({"_video": F.coalesce("video_id", F.lit(0)), "_track": F.coalesce("track_id", F.lit(0)), "_null": F.col("video_id").isNull().cast("int") + 2 * F.col("track_id").isNull().cast("int")})
    placed = durable(positions(keyed, ["_video", "_track", "_null"], [F.col("t").asc(), F.col("frame_id").asc()], "_place"), "places")
    longest = placed.agg(F.max("_place")).first()[0] or 0
    # Within the scan a track is named by never-null keys, so that plain equi-joins serve.
    named = placed.select(F.struct("_video", "_null").alias("video_id"), F.col("_track").alias("track_id"), ((F.col("_place") - 1) / SCAN).cast("long").alias("chunk"), F.struct("_place", "video_id", "track_id", "frame_id", "t", *CORNERS).alias("row"))
    first = lambda x: x["_place"] == 1
    step = lambda x: F.struct(
        F.when(first(x), F.lit(0.0)).otherwise(F.lit(1 - alpha)).alias("kept"), *(F.when(first(x), x[k]).otherwise(F.lit(alpha) * x[k]).alias(f"b{i}") for i, k in enumerate(CORNERS))
    )
    chunks = durable(named.groupBy(*TRACK, "chunk").agg(F.array_sort(F.collect_list("row")).alias("rows")).withColumn("steps", F.transform("rows", step)), "chunks")
    coming = scanned(chunks.select(*TRACK, "chunk", composed(F.col("steps")).alias("own")), -(-longest // SCAN))
    out = chunks.join(coming, [*TRACK, "chunk"])
    smooth = F.arrays_zip(F.col("rows").alias("row"), after_each(F.col("steps"), F.col("box")).alias("box"))
    each = out.select(F.explode(smooth).alias("z")).select("z.row.*", "z.box.*")
    return each.select(*(F.col(f"b{CORNERS.index(c)}").alias(c) if c in CORNERS else F.col(c) for c in rows.columns))


def filled_gaps(obs: DataFrame, most: int = 10) -> DataFrame:
    """Boxes of the frames missing between two observations at most `most` frames apart, on the line between them."""
    w = W.partitionBy(*TRACK).orderBy("frame_id")
    names = ("x1", "y1", "x2", "y2")
    o = obs.withColumns({f"n_{k}": F.lead(k).over(w) for k in ("frame_id", *names)})
    gap = F.col("n_frame_id") - F.col("frame_id")
    o = o.where((gap > 1) & (gap <= most)).withColumns({"gap": gap, "i": F.explode(F.sequence(F.lit(1), (gap - 1).cast("int")))})
    ratio = F.col("i") / F.col("gap")
    return o.select(*TRACK, (F.col("frame_id") + F.col("i")).alias("frame_id"), *[(F.col(k) + (F.col(f"n_{k}") - F.col(k)) * ratio).alias(k) for k in names])


def recent_history(obs: DataFrame, length: int = 120) -> DataFrame:
    """The last `length` centroids up to each observation."""
    w = in_time().rowsBetween(-(length - 1), 0)
    return obs.withColumn("history", F.collect_list(F.struct("cx", "cy")).over(w))


#: Side of the square that a region is rectified to.
RECTIFIED = 1000.0


def rectified(obs: DataFrame, regions: DataFrame, side: float = RECTIFIED) -> DataFrame:
    """Observations with the place (rx, ry) of their centre seen from above: the video's region becomes a square.

    regions has one row a video: video_id and points, an array of [x, y] in any order, of which the first four
    count. Where these make no quadrilateral, or a video has no region, centres stay as they are. A region's map
    is solved once for each video, then joined to the observations (Spark broadcasts the regions where they are few).
    """
    square = [(0.0, 0.0), (side, 0.0), (side, side), (0.0, side)]
    ordered = regions.select(F.col("video_id").alias("_of"), E.ordered_quad(F.col("points")).alias("quad"))
    maps = ordered.select("_of", F.when(F.col("quad").isNotNull(), E.homography(F.col("quad"), square)).alias("_map"))
    out = obs.join(maps, F.col("video_id") == F.col("_of"), "left")
    rx, ry = E.perspective(F.col("cx"), F.col("cy"), F.col("_map"))
    return out.withColumns({"rx": F.coalesce(rx, F.col("cx")), "ry": F.coalesce(ry, F.col("cy"))}).drop("_of", "_map")


def rectified_scale(regions: DataFrame, side: float = RECTIFIED) -> DataFrame:
    """Pixels per metre of each video's rectified square: video_id, ppm.

    regions has, besides points, two calibration points (calibration, an array of two [x, y]) and metres, the
    distance between them on the road. The rectified distance of the two points is what a metre is measured by.
    """
    square = [(0.0, 0.0), (side, 0.0), (side, side), (0.0, side)]
    mapped = regions.withColumn("_map", E.homography(E.ordered_quad(F.col("points")), square))
    (ax, ay), (bx, by) = (E.perspective(F.col("calibration")[i][0], F.col("calibration")[i][1], F.col("_map")) for i in (0, 1))
    return mapped.select("video_id", F.when(F.col("metres") > 0, E.hop(ax - bx, ay - by) / F.col("metres")).alias("ppm"))
