"""Analytics over the vehicle and sample tables. Every figure is per video; inputs are the formatted tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec

from ..functions import expr as E
from ..storage import durable
from .kinematics import TRACK
from .ranks import positions
from .selection import at_places


def of_video() -> WindowSpec:
    return W.partitionBy("video_id")


def mix(vehicles: DataFrame, label: str) -> DataFrame:
    """Counts and percentages of a label, with a TOTAL row."""
    n = vehicles.groupBy("video_id", F.col(label).alias("label")).agg(F.count("*").alias("n"))
    n = n.withColumn("percent", E.rounded(F.col("n") * 100.0 / F.sum("n").over(of_video()), 1))
    total = n.groupBy("video_id").agg(F.lit("TOTAL").alias("label"), F.sum("n").alias("n"), F.lit(100.0).alias("percent"))
    return n.unionByName(total)


def fewest_first(counts: DataFrame) -> DataFrame:
    """Labels by their counts, ascending, ties by label; the TOTAL row of a mix is left out."""
    return counts.where("label <> 'TOTAL'").orderBy("video_id", "n", "label")


def histogram(values: DataFrame, value: str) -> DataFrame:
    """Bins of width 1 from 0 to the ceiling of the greatest value, the last one closed, empty ones kept.

    Values are counted by whole number before anything else, so what windows see is a row for each bin. The counts
    are written once: bins and their counts both rest on them, and values may be dear.
    """
    v = values.where(F.col(value) > 0).select("video_id", F.col(value).alias("v"))
    counted = v.groupBy("video_id", F.floor("v").cast("long").alias("whole")).agg(F.count("*").alias("n"), F.max("v").alias("top"))
    counted = counted.withColumn("bins", F.greatest(F.lit(1), F.ceil(F.max("top").over(of_video()))).cast("long"))
    counted = durable(counted, "counted")
    counts = counted.groupBy("video_id", "bins", F.least(F.col("whole"), F.col("bins") - 1).alias("bin")).agg(F.sum("n").alias("n"))
    spine = counted.select("video_id", "bins").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bins") - 1)))
    out = spine.join(counts, ["video_id", "bins", "bin"], "left")
    label = F.concat(F.col("bin").cast("string"), F.lit(".0-"), (F.col("bin") + 1).cast("string"), F.lit(".0"))
    return out.select("video_id", "bin", label.alias("label"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def lifetimes(vehicles: DataFrame, step: float = 0.5) -> DataFrame:
    """First and last instant of a vehicle, from its first sight and its number of samples."""
    return vehicles.select(*TRACK, F.col("first_t").alias("ts"), (F.col("first_t") + F.greatest(F.lit(0), F.col("n_samples") - 1) * F.lit(step)).alias("te"))


def density(vehicles: DataFrame) -> DataFrame:
    """Vehicles present in each whole second (closed at both ends), with the congestion index (share of the peak).

    Each lifetime unfolds the seconds it touches; they are counted and laid on the spine of all seconds, which
    the video's first and last instant bound. No window sees the vehicles of a video.
    """
    life = lifetimes(vehicles)
    ends = life.groupBy("video_id").agg(F.min("ts").cast("long").alias("lo"), (F.max("te").cast("long") + 1).alias("hi"))
    first, last = F.ceil(F.col("ts") - 1), F.floor("te")
    touched = life.select("video_id", F.explode(F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))).alias("second"))
    counts = touched.groupBy("video_id", "second").agg(F.count("*").alias("n"))
    spine = ends.select("video_id", F.explode(F.sequence("lo", "hi")).alias("second"))
    out = spine.join(counts, ["video_id", "second"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    return out.withColumn("congestion", E.rounded(F.col("n") * 100.0 / F.greatest(F.max("n").over(of_video()), F.lit(1)), 1))


def acceleration_by_class(samples: DataFrame, vehicles: DataFrame, bound: float | None = 50.0) -> DataFrame:
    """Mean and greatest absolute acceleration of each class, zeros left out, values clamped to the bound."""
    s = samples.join(vehicles.select(*TRACK, "class_name"), list(TRACK))
    clamp = (lambda x: E.clamp(x, -bound, bound)) if bound else (lambda x: x)
    lin, lat = (F.when(F.col(k) != 0, F.abs(clamp(F.col(k)))) for k in ("accel_linear", "accel_lateral"))
    out = s.groupBy("video_id", "class_name").agg(F.avg(lin).alias("avg_linear"), F.max(lin).alias("max_linear"), F.avg(lat).alias("avg_lateral"), F.max(lat).alias("max_lateral"))
    out = out.where(F.col("avg_linear").isNotNull() | F.col("avg_lateral").isNotNull())
    return out.withColumns({k: E.rounded(F.coalesce(k, F.lit(0.0)), 3) for k in ("avg_linear", "max_linear", "avg_lateral", "max_lateral")})


def speed_by_class(vehicles: DataFrame) -> DataFrame:
    return vehicles.where("avg_speed > 0").groupBy("video_id", "class_name").agg(
        E.rounded(F.avg("avg_speed")).alias("avg_speed"), F.min("avg_speed").alias("min_speed"), F.max("avg_speed").alias("max_speed"), F.count("*").alias("n")
    )


def distance_by_class(vehicles: DataFrame) -> DataFrame:
    """Mean, total and greatest distance of the classes' moving vehicles, and of ALL (whose count is of all vehicles)."""
    d = F.when(F.col("total_distance") > 0, F.col("total_distance"))
    measures = [E.rounded(F.avg(d)).alias("avg_distance"), E.rounded(F.sum(d)).alias("sum_distance"), F.max(d).alias("max_distance")]
    classes = vehicles.where("total_distance > 0").groupBy("video_id", F.col("class_name").alias("label")).agg(*measures, F.count("*").alias("n"))
    return classes.unionByName(vehicles.groupBy("video_id").agg(F.lit("ALL").alias("label"), *measures, F.count("*").alias("n")))


def acceleration_profile(samples: DataFrame) -> DataFrame:
    """Mean, extremes and positional 5th and 95th percentiles (extremes up to 20 values) of non-zero accelerations."""
    long = samples.select("video_id", F.explode(F.create_map(F.lit("linear"), F.col("accel_linear"), F.lit("lateral"), F.col("accel_lateral"))).alias("kind", "a")).where("a <> 0")
    place = lambda q, few: lambda n: F.when(n > 20, F.floor(n * F.lit(q))).otherwise(few(n))
    long = durable(long, "accelerations")
    tails = at_places(long, ["video_id", "kind"], "a", {"p5": place(0.05, lambda n: F.lit(0)), "p95": place(0.95, lambda n: n - 1)})
    means = long.groupBy("video_id", "kind").agg(E.rounded(F.avg("a")).alias("mean"), F.min("a").alias("low"), F.max("a").alias("high"), F.count("*").alias("n"))
    return means.join(tails.drop("size"), ["video_id", "kind"]).select("video_id", "kind", "mean", "low", "high", "p5", "p95", "n")


def headway_safety(samples: DataFrame) -> DataFrame:
    """Time headways below 1.2 s, up to 2 s and above, with percentages; only those in (0, 120) count."""
    h = F.col("time_headway")
    out = samples.where((h > 0) & (h < 120)).groupBy("video_id").agg(
        F.count_if(h < 1.2).alias("unsafe"), F.count_if((h >= 1.2) & (h < 2)).alias("marginal"), F.count_if(h >= 2).alias("safe"),
        F.count("*").alias("n"), E.rounded(F.avg(h)).alias("mean_headway"), F.min(h).alias("min_headway"),
    )
    return out.withColumns({f"{k}_percent": E.rounded(F.col(k) * 100.0 / F.col("n"), 1) for k in ("unsafe", "marginal", "safe")})


def kpis(vehicles: DataFrame, samples: DataFrame) -> DataFrame:
    """Fleet figures of a video. The vehicle table, which four of them read, is written once."""
    vehicles = durable(vehicles, "vehicles")
    life = lifetimes(vehicles)
    lives = life.groupBy("video_id").agg(F.avg(F.when(F.col("te") > F.col("ts"), F.col("te") - F.col("ts"))).alias("duration"), (F.max("te") - F.min("ts")).alias("span"))
    v = vehicles.groupBy("video_id").agg(F.count("*").alias("vehicles"), F.avg(F.when(F.col("avg_speed") > 0, F.col("avg_speed"))).alias("speed"), F.max(F.when(F.col("avg_speed") > 0, F.col("avg_speed"))).alias("peak"), F.countDistinct("class_name").alias("classes"))
    busy = density(vehicles).groupBy("video_id").agg(F.avg("congestion").alias("c"), F.max("congestion").alias("peak_c"))
    h = F.col("time_headway")
    way = samples.where((h > 0) & (h < 120)).groupBy("video_id").agg(F.avg(h).alias("h"))
    out = v.join(lives, "video_id").join(busy, "video_id").join(way, "video_id", "left")
    one = lambda x: E.rounded(F.coalesce(F.col(x), F.lit(0.0)), 1)
    per_minute = F.when(F.col("span") > 0, E.rounded(F.col("vehicles") / (F.col("span") / 60), 1)).otherwise(F.lit(0.0))
    return out.select(
        "video_id", "vehicles", "classes", one("speed").alias("avg_speed"), F.coalesce("peak", F.lit(0.0)).alias("peak_speed"), one("duration").alias("avg_duration"),
        per_minute.alias("vehicles_per_minute"), one("c").alias("avg_congestion"), one("peak_c").alias("peak_congestion"), one("h").alias("avg_headway"),
    )


def top(vehicles: DataFrame, by: str, k: int) -> DataFrame:
    """The k vehicles of a video with the greatest positive value, ties by track.

    Spark keeps k rows of each video in every task before the shuffle (window group limit), so the window
    sorts k rows for each task, never a whole video.
    """
    w = of_video().orderBy(F.col(by).desc(), "track_id")
    rows = vehicles.where(F.col(by) > 0).withColumn("place", F.row_number().over(w).cast("int")).where(F.col("place") <= k)
    return rows.select("video_id", "place", "track_id", "class_name", F.col(by))


def longest(vehicles: DataFrame, k: int = 15) -> DataFrame:
    return top(vehicles.withColumn("duration", F.greatest(F.lit(0), F.col("n_samples") - 1) * 0.5), "duration", k)


def scatter(samples: DataFrame, vehicles: DataFrame) -> DataFrame:
    """Speed against headway of the samples with both, headway below a minute."""
    s = samples.where("speed > 0 and time_headway > 0 and time_headway < 60")
    return s.join(vehicles.select(*TRACK, "class_name"), list(TRACK)).select(*TRACK, "sample_idx", "class_name", "speed", "time_headway")


def thinned(points: DataFrame, order: list[str], most: int = 200, ceiling: bool = False) -> DataFrame:
    """Every len//most-th point (or its ceiling) of a video that has more than `most`; places come from sorted partitions, not from a window over the video."""
    placed = durable(positions(points, ["video_id"], [F.col(c).asc() for c in order], "_at"), "placed")
    sizes = placed.groupBy(F.col("video_id").alias("_of")).agg(F.count("*").alias("_n"))
    n, at = F.col("_n"), F.col("_at") - 1
    step = F.greatest(F.lit(1), F.ceil(n / most) if ceiling else F.floor(n / most))
    rows = placed.join(sizes, F.col("video_id").eqNullSafe(F.col("_of")))
    return rows.where(at % F.when(n > most, step).otherwise(F.lit(1)) == 0).drop("_at", "_of", "_n")


def axis_limit(points: DataFrame, value: str, least: float = 2.0) -> DataFrame:
    """1.3 times the positional 95th percentile (the maximum up to 5 values), at least `least`."""
    r = at_places(points, ["video_id"], value, {"_tail": lambda n: F.when(n > 5, F.floor(n * 0.95)).otherwise(n - 1)})
    return r.select("video_id", E.rounded(F.greatest(F.lit(least), F.col("_tail") * 1.3)).alias("limit"))
