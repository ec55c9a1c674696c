"""The trajectory queries over the driver's event stream, each with its SQL in brute-force form."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr as E
from ..operators import analytics as A
from ..operators import detection as D
from ..operators import kinematics as K
from ..operators import neighbours as N
from ..operators import resample as R
from ..operators import reshape as S
from ..operators import vehicles as V
from ..sources import observations as O
from ..storage import durable
from .registry import ORACLE, QUERIES

P = E.Parameters()
#: Other thresholds: with the defaults nearly every vehicle of this data tailgates.
P_MIXED = E.Parameters(tailgating=0.35, erratic=0.7)
P_METRIC = E.Parameters(ppm=10.0, tailgating=0.35)
NAMES_SQL = "CASE class_id " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in E.CLASS_NAMES.items()) + " ELSE 'cls' || class_id END"


def r(x: str, digits: int = 2) -> str:
    return f"(floor(({x}) * {10.0**digits} + 0.5) / {10.0**digits})"


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def rounded_columns(df: DataFrame, *names: str, digits: int = 2) -> DataFrame:
    return df.withColumns({n: E.rounded(n, digits) for n in names})


# SQL building blocks -----------------------------------------------------------------------------------------

KIN = "WITH " + O.SQL + """, kin AS (
    SELECT *, lag(t) OVER w AS pt, lead(t) OVER w AS nt, lag(cx) OVER w AS px, lag(cy) OVER w AS py, lead(cx) OVER w AS nx, lead(cy) OVER w AS ny,
           row_number() OVER w AS rn, count(*) OVER (PARTITION BY video_id, track_id) AS n_obs
    FROM obs WINDOW w AS (PARTITION BY video_id, track_id ORDER BY t, frame_id)
)"""  # fmt: skip


def valid_sql(p: E.Parameters) -> str:
    """Smoothed speed and heading of the valid tracks' observations."""
    return KIN + f""", raw AS (
    SELECT *, CASE WHEN rn > 1 AND t > pt THEN sqrt((cx-px)*(cx-px) + (cy-py)*(cy-py)) / (t - pt)
                   WHEN rn = 1 AND nt > t THEN sqrt((nx-cx)*(nx-cx) + (ny-cy)*(ny-cy)) / (nt - t) ELSE 0.0 END AS raw_speed,
           CASE WHEN rn > 1 THEN degrees(atan2(-(cy-py)+0.0, (cx-px)+0.0)) WHEN nt IS NOT NULL THEN degrees(atan2(-(ny-cy)+0.0, (nx-cx)+0.0)) ELSE 0.0 END AS heading
    FROM kin WHERE n_obs >= {p.min_observations}
), val AS (
    SELECT *, least(CASE WHEN rn > 1 AND rn < n_obs THEN list_sort([lag(raw_speed) OVER w, raw_speed, lead(raw_speed) OVER w])[2] ELSE raw_speed END, {p.speed_cap}) AS speed
    FROM raw WINDOW w AS (PARTITION BY video_id, track_id ORDER BY t, frame_id)
)"""  # fmt: skip


def samples_sql(p: E.Parameters) -> str:
    """Every grid instant against every observation of its track, and every observation against all others."""
    return valid_sql(p) + f""", grid AS (
    SELECT video_id, track_id, t0, unnest(range(0, CAST(floor((t1 + 1e-6 - t0) / {p.step}) AS BIGINT) + 1)) AS sample_idx
    FROM (SELECT video_id, track_id, min(t) AS t0, max(t) AS t1 FROM val GROUP BY ALL)
), picked AS (
    SELECT g.video_id, g.track_id, g.sample_idx, arg_min(struct_pack(t := v.t, frame_id := v.frame_id, cx := v.cx, cy := v.cy, heading := v.heading, speed := v.speed),
           struct_pack(d := abs(v.t - (g.t0 + g.sample_idx * {p.step})), t := v.t, f := v.frame_id)) AS o
    FROM grid g JOIN val v ON g.video_id = v.video_id AND g.track_id = v.track_id GROUP BY ALL
), placed AS (
    SELECT video_id, track_id, sample_idx, o.t AS t, o.frame_id AS frame_id, o.cx AS cx, o.cy AS cy, o.heading AS heading, o.speed AS speed, o.cx AS x, {p.frame_height} - o.cy AS y FROM picked
), turned AS (
    SELECT *, coalesce(sqrt((x - lag(x) OVER w)*(x - lag(x) OVER w) + (y - lag(y) OVER w)*(y - lag(y) OVER w)), 0.0) AS moved,
           coalesce((speed - lag(speed) OVER w) / {p.step}, 0.0) AS accel_linear, heading - lag(heading) OVER w AS dh
    FROM placed WINDOW w AS (PARTITION BY video_id, track_id ORDER BY sample_idx)
), near AS (
    SELECT a.video_id, a.track_id, a.frame_id, a.t, a.cx, a.cy, a.heading, a.speed,
           arg_min(struct_pack(cx := b.cx, cy := b.cy, dt := abs(b.t - a.t)), struct_pack(d := abs(b.t - a.t), t := b.t, f := b.frame_id)) AS o
    FROM (SELECT DISTINCT video_id, track_id, frame_id, t, cx, cy, heading, speed FROM placed) a JOIN val b ON a.video_id = b.video_id AND a.track_id <> b.track_id
    GROUP BY a.video_id, a.track_id, a.frame_id, a.t, a.cx, a.cy, a.heading, a.speed, b.track_id
), headway AS (
    SELECT video_id, track_id, frame_id, min(sqrt((o.cx-cx)*(o.cx-cx) + (o.cy-cy)*(o.cy-cy))) AS dist_headway
    FROM near WHERE o.dt <= {p.neighbour_seconds} AND (o.cx-cx)*cos(radians(heading)) - (o.cy-cy)*sin(radians(heading)) > 0
    GROUP BY ALL
), samples AS (
    SELECT s.*, CASE WHEN dh IS NULL OR speed <= 0 THEN 0.0
                ELSE -speed * (radians(CASE WHEN dh > 180 THEN dh - 360 WHEN dh < -180 THEN dh + 360 ELSE dh END) / {p.step}) END AS accel_lateral,
           coalesce(h.dist_headway, 0.0) AS dist_headway,
           CASE WHEN h.dist_headway IS NULL OR speed <= 0.5 THEN 0.0 ELSE least({p.headway_cap}, h.dist_headway / speed) END AS time_headway
    FROM turned s LEFT JOIN headway h USING (video_id, track_id, frame_id)
)"""  # fmt: skip


def vehicles_sql(p: E.Parameters) -> str:
    scale = f"/ {p.ppm}" if p.ppm else "* 0.0"
    return samples_sql(p) + f""", track AS (
    SELECT video_id, track_id, arg_min(t, rn) AS first_t, arg_min(frame_id, rn) AS first_frame, arg_min(class_id, rn) AS class_id, avg(confidence) AS avg_confidence,
           least(median(CASE WHEN t > pt THEN sqrt((cx-px)*(cx-px) + (cy-py)*(cy-py)) / (t - pt) END), {p.speed_cap}) AS avg_speed,
           arg_max(cx, rn) - arg_min(cx, rn) AS dx, arg_max(cy, rn) - arg_min(cy, rn) AS dy
    FROM val GROUP BY ALL
), facing AS (
    SELECT *, CASE WHEN abs(dx) < 1 AND abs(dy) < 1 THEN 'Stationary'
                   WHEN degrees(atan2(-dy+0.0, dx+0.0)) >= -45 AND degrees(atan2(-dy+0.0, dx+0.0)) < 45 THEN 'Eastbound'
                   WHEN degrees(atan2(-dy+0.0, dx+0.0)) >= 45 AND degrees(atan2(-dy+0.0, dx+0.0)) < 135 THEN 'Northbound'
                   WHEN degrees(atan2(-dy+0.0, dx+0.0)) >= -135 AND degrees(atan2(-dy+0.0, dx+0.0)) < -45 THEN 'Southbound' ELSE 'Westbound' END AS direction,
           {NAMES_SQL} AS class_name
    FROM track
), indicators AS (
    SELECT video_id, track_id, count(*) AS n_samples, sum(moved) AS total_distance,
           CASE WHEN count(*) FILTER (speed > 0) >= 2 THEN stddev_pop(speed) FILTER (speed > 0) / avg(speed) FILTER (speed > 0) ELSE 0.0 END AS speed_cv,
           avg(abs(accel_lateral)) AS sway,
           CASE WHEN count(*) >= 3 THEN list_sort(list(accel_linear))[CAST(floor(count(*) * 0.05) AS BIGINT) + 1] ELSE min(accel_linear) END AS braking,
           coalesce(avg(time_headway) FILTER (time_headway > 0), 999.0) AS headway
    FROM samples GROUP BY ALL
), fences AS (
    SELECT video_id, CASE WHEN n < 4 THEN l[1] ELSE l[n // 4 + 1] END AS q1, CASE WHEN n < 4 THEN m ELSE l[n // 2 + 1] END AS med, CASE WHEN n < 4 THEN l[n] ELSE l[3 * n // 4 + 1] END AS q3
    FROM (SELECT video_id, list_sort(list(avg_speed)) AS l, count(*) AS n, avg(avg_speed) AS m FROM track GROUP BY ALL)
), vehicles AS (
    SELECT f.*, i.* EXCLUDE (video_id, track_id), CASE
        WHEN avg_speed < {p.stopped} AND med > 0 THEN 'Stopped/Idling' WHEN med <= 0 THEN 'Disciplined'
        WHEN avg_speed > q3 + 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) > 0 THEN 'Speeding'
        WHEN braking {scale} < {p.braking} THEN 'Aggressive Braking'
        WHEN headway > 0 AND headway < {p.tailgating} THEN 'Tailgating'
        WHEN abs(sway {scale}) > {p.weaving} THEN 'Lane Weaving'
        WHEN avg_speed < q1 - 1.5 * (q3 - q1) AND q1 - 1.5 * (q3 - q1) > 0 THEN 'Slow'
        WHEN speed_cv > {p.erratic} THEN 'Erratic' ELSE 'Disciplined' END AS behaviour
    FROM facing f JOIN indicators i USING (video_id, track_id) JOIN fences USING (video_id)
)"""  # fmt: skip


def analytics_sql(p: E.Parameters) -> str:
    """The formatted tables that analytics read: fv and fs."""
    per = p.ppm or 1.0
    return vehicles_sql(p) + f""", fv AS (
    SELECT video_id, track_id, class_name, direction, behaviour, n_samples, {r('first_t')} AS first_t, {r(f'avg_speed / {per}')} AS avg_speed, {r(f'total_distance / {per}')} AS total_distance FROM vehicles
), fs AS (
    SELECT s.video_id, s.track_id, sample_idx, class_name, {r(f'x / {per}')} AS x, {r(f'y / {per}')} AS y, {r('heading')} AS heading, {r(f'speed / {per}')} AS speed, {r(f'moved / {per}')} AS moved,
           {r(f'accel_linear / {per}')} AS accel_linear, {r(f'accel_lateral / {per}')} AS accel_lateral, {r(f'dist_headway / {per}')} AS dist_headway, {r('time_headway')} AS time_headway
    FROM samples s JOIN vehicles v ON s.video_id = v.video_id AND s.track_id = v.track_id
), life AS (
    SELECT video_id, track_id, first_t AS ts, first_t + greatest(0, n_samples - 1) * 0.5 AS te FROM fv
)"""  # fmt: skip


AN = analytics_sql(P)
DENSITY = """, spine AS (
    SELECT video_id, unnest(range(CAST(trunc(min(ts)) AS BIGINT), CAST(trunc(max(te)) AS BIGINT) + 2)) AS second FROM life GROUP BY video_id
), dens AS (
    SELECT s.video_id, s.second, count(l.track_id) AS n FROM spine s LEFT JOIN life l ON l.video_id = s.video_id AND l.ts <= s.second + 1 AND l.te >= s.second GROUP BY ALL
), busy AS (
    SELECT *, floor(n * 100.0 / greatest(max(n) OVER (PARTITION BY video_id), 1) * 10.0 + 0.5) / 10.0 AS congestion FROM dens
)"""  # fmt: skip


# Queries -----------------------------------------------------------------------------------------------------

def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.from_events(spark, sf_dir)


def sample_table(spark: SparkSession, sf_dir: str, p: E.Parameters = P, headway: bool = True) -> DataFrame:
    """The formatted sample table; without headway where nobody asks for it."""
    obs = observations(spark, sf_dir)
    return V.formatted_samples(V.samples(obs, p) if headway else K.grid_samples(obs, p), p)


def tables(spark: SparkSession, sf_dir: str, p: E.Parameters = P, headway: bool = True, behaviour: bool | None = None) -> tuple[DataFrame, DataFrame]:
    """The formatted vehicle and sample tables; headway, and the behaviour that rests on it, only where they are asked for.

    Headway is dear and both tables rest on it: the samples are then written once, with their measures only.
    """
    obs = observations(spark, sf_dir)
    s = durable(V.samples(obs, p).select(*K.TRACK, "sample_idx", *S.WIDE), "samples") if headway else K.grid_samples(obs, p)
    v = V.vehicles(obs, p, s) if (headway if behaviour is None else behaviour) else V.measured(obs, p, s)
    return V.formatted_vehicles(v, p), V.formatted_samples(s, p)


@query(valid_sql(P) + f"""
SELECT video_id, track_id, first_frame, class_name, direction, n_obs, {r('first_t')} AS first_t, {r('avg_confidence')} AS avg_confidence, {r('avg_speed')} AS avg_speed FROM (
    SELECT *, {NAMES_SQL} AS class_name, CASE WHEN abs(dx) < 1 AND abs(dy) < 1 THEN 'Stationary' WHEN a >= -45 AND a < 45 THEN 'Eastbound' WHEN a >= 45 AND a < 135 THEN 'Northbound' WHEN a >= -135 AND a < -45 THEN 'Southbound' ELSE 'Westbound' END AS direction
    FROM (SELECT *, degrees(atan2(-dy + 0.0, dx + 0.0)) AS a FROM (
        SELECT video_id, track_id, arg_min(t, rn) AS first_t, arg_min(frame_id, rn) AS first_frame, arg_min(class_id, rn) AS class_id, count(*) AS n_obs, avg(confidence) AS avg_confidence,
               least(median(CASE WHEN t > pt THEN sqrt((cx-px)*(cx-px) + (cy-py)*(cy-py)) / (t - pt) END), {P.speed_cap}) AS avg_speed,
               arg_max(cx, rn) - arg_min(cx, rn) AS dx, arg_max(cy, rn) - arg_min(cy, rn) AS dy
        FROM val GROUP BY ALL)))""")  # fmt: skip
def q_vehicle_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = V.track_summary(observations(spark, sf_dir), P)
    return rounded_columns(s.select("video_id", "track_id", "first_frame", "class_name", "direction", "n_obs", "first_t", "avg_confidence", "avg_speed"), "first_t", "avg_confidence", "avg_speed")


@query(KIN + f""", k AS (SELECT *, coalesce(sqrt((cx-px)*(cx-px) + (cy-py)*(cy-py)), 0.0) AS hop FROM kin)
SELECT video_id, track_id, frame_id, {r('hop')} AS hop, {r('CASE WHEN t > pt THEN hop / (t - pt) ELSE 0.0 END')} AS speed,
       {r('(SELECT sum(b.hop) FROM k b WHERE b.track_id = k.track_id AND b.rn <= k.rn)', 1)} AS cumulative_distance FROM k""")  # fmt: skip
def q_frame_kinematics(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = K.frame_kinematics(observations(spark, sf_dir)).select("video_id", "track_id", "frame_id", "hop", "speed", "cumulative_distance")
    return rounded_columns(rounded_columns(k, "hop", "speed"), "cumulative_distance", digits=1)


@query(valid_sql(P) + f"SELECT video_id, track_id, frame_id, {r('raw_speed')} AS raw_speed, {r('speed')} AS speed, {r('heading')} AS heading FROM val")
def q_speed_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = K.observation_speeds(K.valid_tracks(observations(spark, sf_dir), P.min_observations), P.speed_cap)
    return rounded_columns(s.select("video_id", "track_id", "frame_id", "raw_speed", "speed", "heading"), "raw_speed", "speed", "heading")


@query("WITH " + O.SQL + " SELECT video_id, CASE WHEN confidence >= 0.6 THEN 'high' WHEN confidence >= 0.1 THEN 'low' ELSE 'discarded' END AS band, count(*) AS n FROM obs GROUP BY ALL")
def q_conf_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.banded(observations(spark, sf_dir)).groupBy("video_id", "band").agg(F.count("*").alias("n"))


@query("WITH " + O.SQL + " SELECT video_id, track_id, count(*) AS n_obs FROM obs GROUP BY ALL HAVING count(*) >= 68")
def q_min_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.valid_tracks(observations(spark, sf_dir), 68).groupBy("video_id", "track_id").agg(F.count("*").alias("n_obs"))


POLYGON = [(100.0, 50.5), (1500.0, 20.5), (1800.0, 400.5), (900.0, 250.5), (200.0, 500.5)]
CROSS = " + ".join(
    f"CAST(((py < {y1}) <> (py < {y2})) AND px < {x1} + (py - {y1}) * {x2 - x1} / {y2 - y1} AS INTEGER)" for (x1, y1), (x2, y2) in zip(POLYGON, [*POLYGON[1:], POLYGON[0]], strict=True)
)


@query("WITH " + O.SQL + f", p AS (SELECT *, floor((x1 + x2) / 2) AS px, floor((y1 + y2) / 2) AS py FROM obs) SELECT video_id, track_id, frame_id FROM p WHERE ({CROSS}) % 2 = 1")
def q_roi_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.inside_polygon(observations(spark, sf_dir), POLYGON).select("video_id", "track_id", "frame_id")


@query("WITH " + O.SQL + f""", c AS (SELECT video_id, frame_id, greatest(0.0, least(1000.0, x1 - 300.0)) AS x1, greatest(0.0, least(1000.0, x2 - 300.0)) AS x2, greatest(0.0, least(300.0, y1 - 100.0)) AS y1, greatest(0.0, least(300.0, y2 - 100.0)) AS y2 FROM obs)
SELECT video_id, frame_id, {r('x1')} AS x1, {r('y1')} AS y1, {r('x2')} AS x2, {r('y2')} AS y2 FROM c WHERE x2 > x1 AND y2 > y1""")  # fmt: skip
def q_roi_rectangle(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = D.clamped_to(observations(spark, sf_dir), (300, 100, 1000, 300))
    return rounded_columns(d.select("video_id", "frame_id", "x1", "y1", "x2", "y2"), "x1", "y1", "x2", "y2")


SAMPLE_COLUMNS = ("x", "y", "heading", "speed", "moved", "accel_linear", "accel_lateral")


@query(samples_sql(P) + "SELECT video_id, track_id, sample_idx, frame_id, " + ", ".join(f"{r(k)} AS {k}" for k in SAMPLE_COLUMNS) + " FROM samples")
def q_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = K.grid_samples(observations(spark, sf_dir), P)
    return rounded_columns(s.select("video_id", "track_id", F.col("sample_idx").cast("long").alias("sample_idx"), "frame_id", *SAMPLE_COLUMNS), *SAMPLE_COLUMNS)


@query(samples_sql(P) + f"SELECT video_id, track_id, sample_idx, {r('dist_headway')} AS dist_headway, {r('time_headway')} AS time_headway FROM samples WHERE dist_headway > 0")
def q_headway(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = V.samples(observations(spark, sf_dir), P).where("dist_headway > 0")
    return rounded_columns(s.select("video_id", "track_id", F.col("sample_idx").cast("long").alias("sample_idx"), "dist_headway", "time_headway"), "dist_headway", "time_headway")


VEHICLE = ("first_t", "avg_confidence", "avg_speed", "speed_cv", "sway", "braking", "headway")


def vehicle_query(p: E.Parameters, spark: SparkSession, sf_dir: str) -> DataFrame:
    v = V.vehicles(observations(spark, sf_dir), p).select("video_id", "track_id", "class_name", "direction", "behaviour", "n_samples", *VEHICLE, E.rounded("total_distance", 1).alias("total_distance"))
    return rounded_columns(v, *VEHICLE)


for _name, _p in (("q_behaviour", P), ("q_behaviour_mixed", P_MIXED), ("q_behaviour_metric", P_METRIC)):
    QUERIES[_name] = functools.partial(vehicle_query, _p)
    ORACLE[_name] = vehicles_sql(_p) + "SELECT video_id, track_id, class_name, direction, behaviour, n_samples, " + ", ".join(f"{r(k)} AS {k}" for k in VEHICLE) + f", {r('total_distance', 1)} AS total_distance FROM vehicles"


RESAMPLED = "WITH " + O.SQL + """, life AS (
    SELECT video_id, track_id, min(t) AS t0, max(t) AS t1, arg_min(class_id, struct_pack(t := t, f := frame_id)) AS class_id FROM obs GROUP BY ALL
), secs AS (
    SELECT *, unnest(CASE WHEN ceil(t0) <= floor(t1) THEN range(CAST(ceil(t0) AS BIGINT), CAST(floor(t1) AS BIGINT) + 1) ELSE [CAST(round_even(t0, 0) AS BIGINT)] END) AS sec FROM life
), around AS (
    SELECT s.video_id, s.track_id, s.class_id, s.sec,
           arg_max(struct_pack(t := o.t, cx := o.cx, cy := o.cy, c := o.confidence), struct_pack(t := o.t, f := o.frame_id)) FILTER (o.t <= s.sec) AS a,
           arg_min(struct_pack(t := o.t, cx := o.cx, cy := o.cy, c := o.confidence), struct_pack(t := o.t, f := o.frame_id)) FILTER (o.t > s.sec) AS b
    FROM secs s JOIN obs o ON s.video_id = o.video_id AND s.track_id = o.track_id GROUP BY ALL
), lerped AS (
    SELECT video_id, track_id, class_id, sec, coalesce(a.cx + (b.cx - a.cx) * f, a.cx, b.cx) AS cx, coalesce(a.cy + (b.cy - a.cy) * f, a.cy, b.cy) AS cy, coalesce(a.c + (b.c - a.c) * f, a.c, b.c) AS confidence
    FROM (SELECT *, (sec - a.t) / (b.t - a.t) AS f FROM around)
), hops AS (
    SELECT *, coalesce(sqrt((cx - lag(cx) OVER w)*(cx - lag(cx) OVER w) + (cy - lag(cy) OVER w)*(cy - lag(cy) OVER w)), 0.0) AS speed FROM lerped WINDOW w AS (PARTITION BY video_id, track_id ORDER BY sec)
), ends AS (
    SELECT video_id, track_id, count(*) AS n, degrees(atan2(arg_max(cy, sec) - arg_min(cy, sec) + 0.0, arg_max(cx, sec) - arg_min(cx, sec) + 0.0)) AS a FROM lerped GROUP BY ALL
), res AS (
    SELECT h.*, sum(speed) OVER (PARTITION BY h.video_id, h.track_id ORDER BY sec) AS cumulative_distance,
           CASE WHEN n < 2 THEN 'Stationary' WHEN a >= -45 AND a < 45 THEN 'Eastbound' WHEN a >= 45 AND a < 135 THEN 'Southbound' WHEN a >= -135 AND a < -45 THEN 'Northbound' ELSE 'Westbound' END AS direction
    FROM hops h JOIN ends USING (video_id, track_id)
)"""  # fmt: skip


@query(RESAMPLED + f"SELECT video_id, track_id, sec, direction, {r('cx')} AS cx, {r('cy')} AS cy, {r('confidence')} AS confidence, {r('speed')} AS speed, {r('cumulative_distance', 1)} AS cumulative_distance FROM res")
def q_resampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = R.whole_seconds(observations(spark, sf_dir)).select("video_id", "track_id", "sec", "direction", "cx", "cy", "confidence", "speed", "cumulative_distance")
    return rounded_columns(rounded_columns(s, "cx", "cy", "confidence", "speed"), "cumulative_distance", digits=1)


@query(RESAMPLED + f"""SELECT video_id, track_id, any_value(direction) AS direction, min(sec) AS first_sec, max(sec) AS last_sec, max(sec) - min(sec) AS duration, {r('arg_max(cumulative_distance, sec)', 1)} AS distance,
    {r('avg(speed)')} AS avg_speed, {r('max(speed)')} AS max_speed, count(*) AS n_rows, {r('avg(confidence)')} AS avg_confidence FROM res GROUP BY video_id, track_id""")  # fmt: skip
def q_resampled_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = R.summary(R.whole_seconds(observations(spark, sf_dir))).drop("class_name")
    return rounded_columns(rounded_columns(s, "avg_speed", "max_speed", "avg_confidence"), "distance", digits=1)


for _name, _label in (("q_class_mix", "class_name"), ("q_direction_mix", "direction"), ("q_behaviour_mix", "behaviour")):
    QUERIES[_name] = functools.partial(lambda label, spark, sf_dir: A.mix(tables(spark, sf_dir, headway=label == "behaviour")[0], label), _label)
    ORACLE[_name] = AN + f""" SELECT video_id, {_label} AS label, count(*) AS n, floor(count(*) * 100.0 / (SELECT count(*) FROM fv b WHERE b.video_id = fv.video_id) * 10.0 + 0.5) / 10.0 AS percent FROM fv GROUP BY video_id, {_label}
        UNION ALL SELECT video_id, 'TOTAL', count(*), 100.0 FROM fv GROUP BY video_id"""  # fmt: skip


def histogram_sql(source: str, value: str) -> str:
    return AN + f""", v AS (SELECT video_id, {value} AS v FROM {source} WHERE {value} > 0), b AS (SELECT video_id, CAST(greatest(1, ceil(max(v))) AS BIGINT) AS bins FROM v GROUP BY ALL),
    s AS (SELECT video_id, bins, unnest(range(bins)) AS bin FROM b)
    SELECT s.video_id, s.bin, s.bin || '.0-' || (s.bin + 1) || '.0' AS label, count(v.v) AS n FROM s LEFT JOIN v ON v.video_id = s.video_id AND v.v >= s.bin AND (v.v < s.bin + 1 OR s.bin = s.bins - 1 AND v.v <= s.bin + 1) GROUP BY ALL"""  # fmt: skip


@query(histogram_sql("fv", "avg_speed"))
def q_speed_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.histogram(tables(spark, sf_dir, headway=False)[0], "avg_speed")


@query(histogram_sql("(SELECT * FROM fs WHERE time_headway < 60)", "time_headway"))
def q_headway_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.histogram(sample_table(spark, sf_dir).where("time_headway < 60"), "time_headway")


@query(AN + DENSITY + "SELECT video_id, second, n FROM busy")
def q_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.density(tables(spark, sf_dir, headway=False)[0]).select("video_id", "second", "n")


@query(AN + DENSITY + "SELECT video_id, second, congestion FROM busy")
def q_congestion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.density(tables(spark, sf_dir, headway=False)[0]).select("video_id", "second", "congestion")


@query(analytics_sql(P_METRIC) + """, v AS (SELECT video_id, class_name, CASE WHEN accel_linear <> 0 THEN abs(greatest(-50.0, least(50.0, accel_linear))) END AS lin, CASE WHEN accel_lateral <> 0 THEN abs(greatest(-50.0, least(50.0, accel_lateral))) END AS lat FROM fs)
SELECT video_id, class_name, """ + ", ".join(f"{r(f'coalesce({f}({k}), 0.0)', 3)} AS {f}_{n}" for k, n in (("lin", "linear"), ("lat", "lateral")) for f in ("avg", "max")) + " FROM v GROUP BY video_id, class_name HAVING count(lin) + count(lat) > 0")  # fmt: skip
def q_accel_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, s = tables(spark, sf_dir, P_METRIC, headway=False)
    return A.acceleration_by_class(s, v)


@query(AN + f" SELECT video_id, class_name, {r('avg(avg_speed)')} AS avg_speed, min(avg_speed) AS min_speed, max(avg_speed) AS max_speed, count(*) AS n FROM fv WHERE fv.avg_speed > 0 GROUP BY video_id, class_name".replace("avg(avg_speed)", "avg(fv.avg_speed)").replace("min(avg_speed)", "min(fv.avg_speed)").replace("max(avg_speed)", "max(fv.avg_speed)"))
def q_speed_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.speed_by_class(tables(spark, sf_dir, headway=False)[0])


@query(AN + f""" SELECT video_id, class_name AS label, {r('avg(total_distance)')} AS avg_distance, {r('sum(total_distance)')} AS sum_distance, max(total_distance) AS max_distance, count(*) AS n FROM fv WHERE total_distance > 0 GROUP BY video_id, class_name
UNION ALL SELECT video_id, 'ALL', {r('avg(total_distance) FILTER (total_distance > 0)')}, {r('sum(total_distance) FILTER (total_distance > 0)')}, max(total_distance) FILTER (total_distance > 0), count(*) FROM fv GROUP BY video_id""")  # fmt: skip
def q_dist_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.distance_by_class(tables(spark, sf_dir, headway=False)[0])


@query(AN + f""", l AS (SELECT video_id, 'linear' AS kind, accel_linear AS a FROM fs WHERE accel_linear <> 0 UNION ALL SELECT video_id, 'lateral', accel_lateral FROM fs WHERE accel_lateral <> 0)
SELECT video_id, kind, {r('avg(a)')} AS mean, min(a) AS low, max(a) AS high, CASE WHEN count(*) > 20 THEN list_sort(list(a))[CAST(floor(count(*) * 0.05) AS BIGINT) + 1] ELSE min(a) END AS p5,
       CASE WHEN count(*) > 20 THEN list_sort(list(a))[CAST(floor(count(*) * 0.95) AS BIGINT) + 1] ELSE max(a) END AS p95, count(*) AS n FROM l GROUP BY video_id, kind""")  # fmt: skip
def q_accel_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.acceleration_profile(sample_table(spark, sf_dir, headway=False))


@query(AN + f""", h AS (SELECT video_id, count(*) FILTER (time_headway < 1.2) AS unsafe, count(*) FILTER (time_headway >= 1.2 AND time_headway < 2) AS marginal, count(*) FILTER (time_headway >= 2) AS safe, count(*) AS n,
       {r('avg(time_headway)')} AS mean_headway, min(time_headway) AS min_headway FROM fs WHERE time_headway > 0 AND time_headway < 120 GROUP BY video_id)
SELECT *, {r('unsafe * 100.0 / n', 1)} AS unsafe_percent, {r('marginal * 100.0 / n', 1)} AS marginal_percent, {r('safe * 100.0 / n', 1)} AS safe_percent FROM h""")  # fmt: skip
def q_headway_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.headway_safety(sample_table(spark, sf_dir))


@query(AN + DENSITY + f"""SELECT v.video_id, vehicles, classes, {r('speed', 1)} AS avg_speed, peak AS peak_speed, {r('coalesce(duration, 0.0)', 1)} AS avg_duration, CASE WHEN span > 0 THEN {r('vehicles / (span / 60)', 1)} ELSE 0.0 END AS vehicles_per_minute,
       {r('c', 1)} AS avg_congestion, {r('pc', 1)} AS peak_congestion, {r('coalesce(h, 0.0)', 1)} AS avg_headway
FROM (SELECT video_id, count(*) AS vehicles, count(DISTINCT class_name) AS classes, coalesce(avg(avg_speed) FILTER (avg_speed > 0), 0.0) AS speed, coalesce(max(avg_speed) FILTER (avg_speed > 0), 0.0) AS peak FROM fv GROUP BY video_id) v
JOIN (SELECT video_id, avg(te - ts) FILTER (te > ts) AS duration, max(te) - min(ts) AS span FROM life GROUP BY video_id) l USING (video_id)
JOIN (SELECT video_id, avg(congestion) AS c, max(congestion) AS pc FROM busy GROUP BY video_id) b USING (video_id)
LEFT JOIN (SELECT video_id, avg(time_headway) AS h FROM fs WHERE time_headway > 0 AND time_headway < 120 GROUP BY video_id) w USING (video_id)""")  # fmt: skip
def q_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.kpis(*tables(spark, sf_dir, behaviour=False))


def top_sql(value: str, k: int, name: str) -> str:
    return AN + f" SELECT * FROM (SELECT video_id, CAST(row_number() OVER (PARTITION BY video_id ORDER BY {value} DESC, track_id) AS INTEGER) AS place, track_id, class_name, {value} AS {name} FROM fv WHERE {value} > 0) x WHERE place <= {k}"


@query(top_sql("(greatest(0, n_samples - 1) * 0.5::DOUBLE)", 15, "duration"))
def q_top_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.longest(tables(spark, sf_dir, headway=False)[0])


@query(top_sql("avg_speed", 10, "avg_speed"))
def q_top_fastest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.top(tables(spark, sf_dir, headway=False)[0], "avg_speed", 10)


@query(AN + """, p AS (SELECT video_id, track_id, sample_idx, class_name, speed, time_headway, row_number() OVER (PARTITION BY video_id ORDER BY track_id, sample_idx) - 1 AS spot, count(*) OVER (PARTITION BY video_id) AS n
    FROM fs WHERE speed > 0 AND time_headway > 0 AND time_headway < 60)
SELECT video_id, track_id, sample_idx, class_name, speed, time_headway FROM p WHERE n <= 200 OR spot % greatest(1, n // 200) = 0""")  # fmt: skip
def q_stride(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, s = tables(spark, sf_dir, behaviour=False)
    return A.thinned(A.scatter(s, v), ["track_id", "sample_idx"]).withColumn("sample_idx", F.col("sample_idx").cast("long"))


@query(AN + f""" SELECT video_id, {r('greatest(2.0, 1.3 * CASE WHEN count(*) > 5 THEN list_sort(list(time_headway))[CAST(floor(count(*) * 0.95) AS BIGINT) + 1] ELSE max(time_headway) END)')} AS "limit"
FROM fs WHERE speed > 0 AND time_headway > 0 AND time_headway < 60 GROUP BY video_id""")  # fmt: skip
def q_axis_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, s = tables(spark, sf_dir, behaviour=False)
    return A.axis_limit(A.scatter(s, v), "time_headway")


@query("WITH " + O.SQL + " SELECT track_id, frame_id, video_id FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY frame_id DESC) AS k FROM obs) WHERE k = 1")
def q_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.keep_last(observations(spark, sf_dir), "track_id", "frame_id").select("track_id", "frame_id", "video_id")


@query("""WITH a AS (SELECT o_custkey AS k, 'orders' AS source FROM orders GROUP BY o_custkey), b AS (SELECT c_custkey AS k, 'customer' AS source FROM customer)
SELECT k, CASE WHEN k IN (SELECT k FROM a) THEN 'orders' ELSE 'customer' END AS source, count(*) AS linked FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY k""")  # fmt: skip
def q_first_wins_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("k")).distinct().withColumn("source", F.lit("orders"))
    b = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("k"), F.lit("customer").alias("source"))
    return S.first_wins([a, b], "k").select("k", "source", "linked")


@query("""SELECT c_name, CASE WHEN row_number() OVER (ORDER BY md5('42:' || c_name), c_name) <= greatest(1, floor(count(*) OVER () * 0.15)) THEN 'val' ELSE 'train' END AS split FROM customer""")
def q_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_name")
    return S.exact_split(names, "c_name", 0.15)


def cells(df: DataFrame, names: list[str]) -> Column:
    """The named columns as one comma-separated line, in hundredths; an empty place where there is nothing."""
    return F.concat_ws(",", *[F.coalesce(F.floor(F.col(k) * 100 + 0.5).cast("long").cast("string"), F.lit("")) for k in names])


def line_sql(source: str, key: str, keys: str, measures: tuple[str, ...]) -> str:
    """The wide row as a line: every track beside every key, the cells in order."""
    cell = " || ',' || ".join(f"coalesce(CAST(CAST(floor({m} * 100 + 0.5) AS BIGINT) AS VARCHAR), '')" for m in measures)
    return f""", src AS MATERIALIZED ({source}), ks AS ({keys}), tr AS (SELECT DISTINCT video_id, track_id FROM src)
SELECT video_id, track_id, count(*) * {len(measures)} AS n_cells, string_agg({cell}, ',' ORDER BY k) AS cells FROM (SELECT tr.video_id, tr.track_id, ks.k, src.* EXCLUDE (video_id, track_id) FROM tr CROSS JOIN ks LEFT JOIN src ON src.video_id = tr.video_id AND src.track_id = tr.track_id AND src.{key} = ks.k) GROUP BY video_id, track_id"""


def with_cells(rows: DataFrame, measures: tuple[str, ...]) -> DataFrame:
    """The rows with their measures as one text: then the pivot has a column a sample, not a column a cell."""
    return rows.withColumn("cell", cells(rows, list(measures)))


def as_line(wide: DataFrame, measures: tuple[str, ...]) -> DataFrame:
    names = [c for c in wide.columns if c not in K.TRACK]
    nothing = F.lit("," * (len(measures) - 1))
    line = F.concat_ws(",", *[F.coalesce(F.col(k), nothing) for k in names])
    return wide.select(*K.TRACK, F.lit(len(names) * len(measures)).cast("long").alias("n_cells"), line.alias("cells"))


@query(AN + line_sql("SELECT * FROM fs", "sample_idx", "SELECT unnest(range(max(sample_idx) + 1)) AS k FROM src", S.WIDE))
def q_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_line(S.widened(durable(with_cells(sample_table(spark, sf_dir), S.WIDE).select(*K.TRACK, "sample_idx", "cell"), "samples"), measures=("cell",)), S.WIDE)


@query(AN + f" SELECT video_id, track_id, CAST(sample_idx AS INTEGER) AS sample_idx, {', '.join(S.WIDE)} FROM fs")
def q_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = durable(sample_table(spark, sf_dir).select(*K.TRACK, "sample_idx", *S.WIDE), "samples")
    count = S.sample_count(s)
    return S.unpivoted(S.widened(s, count), count)


@query(RESAMPLED + line_sql(f"SELECT video_id, track_id, sec, {', '.join(f'{r(m)} AS {m}' for m in S.PER_SECOND)} FROM res", "sec", "SELECT DISTINCT sec AS k FROM src", S.PER_SECOND))
def q_by_second(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = with_cells(rounded_columns(R.whole_seconds(observations(spark, sf_dir)), *S.PER_SECOND), S.PER_SECOND)
    return as_line(S.by_second(durable(seconds.select(*K.TRACK, "sec", "cell"), "seconds"), measures=("cell",)), S.PER_SECOND)


def frames_of(obs: DataFrame) -> DataFrame:
    """Observations bucketed so that a frame holds several: a frame is one unit of time."""
    return obs.withColumn("frame", F.floor("t").cast("long"))


@query("WITH " + O.SQL + f""", d AS (SELECT *, CAST(floor(t) AS BIGINT) AS frame FROM obs), p AS (
    SELECT a.video_id, a.frame, a.frame_id AS detection_id, b.frame_id AS track_id, greatest(0.0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0.0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS i,
           (a.x2-a.x1)*(a.y2-a.y1) AS sa, (b.x2-b.x1)*(b.y2-b.y1) AS sb
    FROM d a JOIN d b ON a.video_id = b.video_id AND b.frame = a.frame - 1)
SELECT video_id, frame, detection_id, track_id, {r('i / (sa + sb - i)', 4)} AS iou FROM p WHERE sa + sb - i > 0 AND i / (sa + sb - i) > 0""")  # fmt: skip
def q_iou_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = frames_of(observations(spark, sf_dir))
    before = d.select("video_id", (F.col("frame") + 1).alias("frame"), F.col("frame_id").alias("track_id"), "x1", "y1", "x2", "y2")
    return rounded_columns(D.overlap_pairs(d.withColumnRenamed("frame_id", "detection_id").drop("track_id"), before), "iou", digits=4)


@query("WITH RECURSIVE " + O.SQL + f""", d AS (SELECT *, CAST(floor(t) AS BIGINT) AS frame FROM obs), o AS (
    SELECT a.video_id, a.frame, a.frame_id AS det, b.frame_id AS trk, greatest(0.0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0.0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS i,
           (a.x2-a.x1)*(a.y2-a.y1) AS sa, (b.x2-b.x1)*(b.y2-b.y1) AS sb FROM d a JOIN d b ON a.video_id = b.video_id AND b.frame = a.frame - 1
), p AS (SELECT video_id, frame, det, trk, i / (sa + sb - i) AS iou FROM o WHERE sa + sb - i > 0 AND i > 0
), g AS (SELECT video_id, frame, det, row_number() OVER (PARTITION BY video_id, frame ORDER BY det) AS k, count(*) OVER (PARTITION BY video_id, frame) AS n FROM (SELECT DISTINCT video_id, frame, det FROM p)
), choices AS (SELECT video_id, frame, det, trk, iou FROM p UNION ALL SELECT video_id, frame, det, NULL, 0.0 FROM g
), walk AS (
    -- Every way of giving each detection one of its tracks, or none, no track twice.
    SELECT DISTINCT video_id, frame, CAST(0 AS BIGINT) AS k, n, []::BIGINT[] AS dets, []::BIGINT[] AS trks, []::DOUBLE[] AS ious FROM g
    UNION ALL
    SELECT w.video_id, w.frame, g.k, w.n, CASE WHEN c.trk IS NULL THEN dets ELSE list_append(dets, c.det) END, CASE WHEN c.trk IS NULL THEN trks ELSE list_append(trks, c.trk) END, CASE WHEN c.trk IS NULL THEN ious ELSE list_append(ious, c.iou) END
    FROM walk w JOIN g ON g.video_id = w.video_id AND g.frame = w.frame AND g.k = w.k + 1 JOIN choices c ON c.video_id = g.video_id AND c.frame = g.frame AND c.det = g.det AND (c.trk IS NULL OR NOT list_contains(trks, c.trk))
), best AS (SELECT video_id, frame, unnest(pairs) AS pair FROM (SELECT video_id, frame, arg_max(list_zip(dets, trks, ious), coalesce(list_sum(ious), 0.0)) AS pairs FROM walk WHERE k = n GROUP BY video_id, frame))
SELECT video_id, frame, pair[1] AS detection_id, pair[2] AS track_id, {r('pair[3]', 4)} AS iou FROM best WHERE pair[3] >= 0.1""")  # fmt: skip
def q_assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = frames_of(observations(spark, sf_dir))
    before = d.select("video_id", (F.col("frame") + 1).alias("frame"), F.col("frame_id").alias("track_id"), "x1", "y1", "x2", "y2")
    return rounded_columns(D.assigned(d.withColumnRenamed("frame_id", "detection_id").drop("track_id"), before, 0.1), "iou", digits=4)


@query("WITH " + O.SQL + f""", n AS (SELECT *, lead(frame_id) OVER w AS nf, lead(x1) OVER w AS nx1, lead(y2) OVER w AS ny2 FROM obs WINDOW w AS (PARTITION BY video_id, track_id ORDER BY frame_id)),
g AS (SELECT *, unnest(range(1, nf - frame_id)) AS i FROM n WHERE nf - frame_id > 1 AND nf - frame_id <= 10)
SELECT video_id, track_id, frame_id + i AS frame_id, {r('x1 + (nx1 - x1) * (i / (nf - frame_id))')} AS x1, {r('y2 + (ny2 - y2) * (i / (nf - frame_id))')} AS y2 FROM g""")  # fmt: skip
def q_gap_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_columns(K.filled_gaps(observations(spark, sf_dir)).select("video_id", "track_id", "frame_id", "x1", "y2"), "x1", "y2")


@query("WITH RECURSIVE " + O.SQL + f""", o AS (SELECT *, row_number() OVER (PARTITION BY video_id, track_id ORDER BY t, frame_id) AS k FROM obs),
e AS (SELECT video_id, track_id, frame_id, k, x1, y1 FROM o WHERE k = 1 UNION ALL
      SELECT o.video_id, o.track_id, o.frame_id, o.k, 0.7 * o.x1 + (1 - 0.7::DOUBLE) * e.x1, 0.7 * o.y1 + (1 - 0.7::DOUBLE) * e.y1 FROM e JOIN o ON o.video_id = e.video_id AND o.track_id = e.track_id AND o.k = e.k + 1)
SELECT video_id, track_id, frame_id, {r('x1', 1)} AS x1, {r('y1', 1)} AS y1 FROM e""")  # fmt: skip
def q_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_columns(K.smoothed_boxes(observations(spark, sf_dir)).select("video_id", "track_id", "frame_id", "x1", "y1"), "x1", "y1", digits=1)


@query("WITH " + O.SQL + """, c AS (SELECT video_id, frame_id, CAST(list(CAST(floor(cx * 100 + 0.5) AS BIGINT) || ':' || CAST(floor(cy * 100 + 0.5) AS BIGINT)) OVER (PARTITION BY video_id, track_id ORDER BY t, frame_id ROWS BETWEEN 119 PRECEDING AND CURRENT ROW) AS VARCHAR[]) AS h FROM obs)
SELECT video_id, frame_id, CAST(len(h) AS BIGINT) AS kept, array_to_string(h, ' ') AS centroids FROM c""")  # fmt: skip
def q_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    hundredths = lambda x: F.floor(x * 100 + 0.5).cast("long").cast("string")
    points = F.transform("history", lambda p: F.concat(hundredths(p["cx"]), F.lit(":"), hundredths(p["cy"])))
    return K.recent_history(observations(spark, sf_dir)).select("video_id", "frame_id", F.size("history").cast("long").alias("kept"), F.array_join(points, " ").alias("centroids"))


@query()
def q_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = frames_of(observations(spark, sf_dir)).withColumnRenamed("frame_id", "detection_id").drop("track_id")
    return D.track(d.select("video_id", "frame", "detection_id", "x1", "y1", "x2", "y2", "confidence", "class_id"), D.TrackerParameters(match=0.95, new=0.3, high=0.3, min_hits=1))


NMS_FRAME = "WITH RECURSIVE " + O.SQL + """, d AS (
    SELECT video_id, CAST(floor(t / 2) AS BIGINT) AS frame, class_id, frame_id AS detection_id, confidence, x1, y1, x2, y2,
           row_number() OVER (PARTITION BY video_id, CAST(floor(t / 2) AS BIGINT), class_id ORDER BY confidence DESC, frame_id) AS k
    FROM obs WHERE confidence >= 0.25
), step AS (
    SELECT video_id, frame, class_id, k, [detection_id] AS kept, [[x1, y1, x2, y2]] AS boxes FROM d WHERE k = 1
    UNION ALL
    SELECT d.video_id, d.frame, d.class_id, d.k, CASE WHEN hit THEN kept ELSE list_append(kept, d.detection_id) END, CASE WHEN hit THEN boxes ELSE list_append(boxes, [d.x1, d.y1, d.x2, d.y2]) END
    FROM (SELECT d.*, step.kept, step.boxes, len(list_filter(step.boxes, lambda b: (
              greatest(0.0, least(d.x2, b[3]) - greatest(d.x1, b[1])) * greatest(0.0, least(d.y2, b[4]) - greatest(d.y1, b[2]))
          ) / ((b[3] - b[1]) * (b[4] - b[2]) + (d.x2 - d.x1) * (d.y2 - d.y1) - greatest(0.0, least(d.x2, b[3]) - greatest(d.x1, b[1])) * greatest(0.0, least(d.y2, b[4]) - greatest(d.y1, b[2]))) > 0.05)) > 0 AS hit
          FROM step JOIN d ON d.video_id = step.video_id AND d.frame = step.frame AND d.class_id = step.class_id AND d.k = step.k + 1) d
)"""


@query(NMS_FRAME + " SELECT video_id, frame, class_id, unnest(kept) AS detection_id FROM (SELECT *, max(k) OVER (PARTITION BY video_id, frame, class_id) AS last FROM step) WHERE k = last")
def q_suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = observations(spark, sf_dir).withColumn("frame", F.floor(F.col("t") / 2).cast("long")).withColumnRenamed("frame_id", "detection_id").drop("track_id")
    return D.suppressed(d, confidence=0.25, overlap=0.05).select("video_id", "frame", "class_id", "detection_id")


#: A video's region: its outermost points by sum and difference of coordinates, widened so that they make a quadrilateral.
QUAD_SQL = "WITH " + O.SQL + """, e AS (
    SELECT video_id, min(cx) - 40.0 AS x0, max(cx) + 60.0 AS x1, min(cy) - 30.0 AS y0, max(cy) + 50.0 AS y1, min(cx + cy) AS s0 FROM obs GROUP BY video_id
), q AS (
    SELECT video_id, x0 + 0.05 * (x1 - x0) AS ax, y0 AS ay, x1 - 0.05 * (x1 - x0) AS bx, y0 + 0.02 * (y1 - y0) AS by_, x1 AS cx_, y1 AS cy_, x0 AS dx, y1 - 0.05 * (y1 - y0) AS dy FROM e
), u AS (
    -- The map of the unit square onto a quadrilateral (closed form), and its adjugate: the map back.
    SELECT *, ax - bx + cx_ - dx AS px, ay - by_ + cy_ - dy AS py, bx - cx_ AS d1x, by_ - cy_ AS d1y, dx - cx_ AS d2x, dy - cy_ AS d2y FROM q
), g AS (
    SELECT *, (px * d2y - d2x * py) / (d1x * d2y - d2x * d1y) AS g, (d1x * py - px * d1y) / (d1x * d2y - d2x * d1y) AS h FROM u
), m AS (
    SELECT *, bx - ax + g * bx AS a, dx - ax + h * dx AS b, ax AS c, by_ - ay + g * by_ AS d, dy - ay + h * dy AS e, ay AS f FROM g
), i AS (
    SELECT video_id, e - f * h AS i0, c * h - b AS i1, b * f - c * e AS i2, f * g - d AS i3, a - c * g AS i4, c * d - a * f AS i5, d * h - e * g AS i6, b * g - a * h AS i7, a * e - b * d AS i8 FROM m
)"""


def quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = observations(spark, sf_dir).groupBy("video_id").agg((F.min("cx") - 40).alias("x0"), (F.max("cx") + 60).alias("x1"), (F.min("cy") - 30).alias("y0"), (F.max("cy") + 50).alias("y1"))
    x0, x1, y0, y1 = (F.col(k) for k in ("x0", "x1", "y0", "y1"))
    corner = lambda x, y: F.array(x, y)
    # The corners come in no order, as people click them.
    return e.select("video_id", F.array(
        corner(x1, y1), corner(x0 + 0.05 * (x1 - x0), y0), corner(x0, y1 - 0.05 * (y1 - y0)), corner(x1 - 0.05 * (x1 - x0), y0 + 0.02 * (y1 - y0)),
    ).alias("points"))


@query(QUAD_SQL + f" SELECT obs.video_id, frame_id, {r('(i0 * cx + i1 * cy + i2) / (i6 * cx + i7 * cy + i8) * 1000', 1)} AS rx, {r('(i3 * cx + i4 * cy + i5) / (i6 * cx + i7 * cy + i8) * 1000', 1)} AS ry FROM obs JOIN i ON i.video_id = obs.video_id")
def q_rectified(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = K.rectified(observations(spark, sf_dir), quads(spark, sf_dir))
    return rounded_columns(out.select("video_id", "frame_id", "rx", "ry"), "rx", "ry", digits=1)


def hue_sql(shift: int) -> str:
    wave = f"(hue + {shift} - 6 * floor((hue + {shift}) / 6))"
    return f"CAST(floor(230 - 230 * 220 / 255.0 * greatest(0.0, least(least({wave}, 4 - {wave}), 1.0)) + 0.5) AS INTEGER)"


@query("WITH " + O.SQL + f", h AS (SELECT DISTINCT video_id, track_id, floor((track_id * 0.618033988749895::DOUBLE - floor(track_id * 0.618033988749895::DOUBLE)) * 180) / 30 AS hue FROM obs) SELECT video_id, track_id, {hue_sql(1)} AS blue, {hue_sql(3)} AS green, {hue_sql(5)} AS red FROM h")
def q_track_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = observations(spark, sf_dir).select("video_id", "track_id").distinct().withColumn("bgr", E.track_colour("track_id"))
    return own.select("video_id", "track_id", *[F.get("bgr", i).alias(k) for i, k in enumerate(("blue", "green", "red"))])
