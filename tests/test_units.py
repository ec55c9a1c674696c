"""Unit facts, traps and properties of the trajectory operators."""

import hashlib
import itertools
import json
import math
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.functions import expr as E
from tracewright.operators import analytics as A
from tracewright.operators import annotations as AN
from tracewright.operators import detection as D
from tracewright.operators import kinematics as K
from tracewright.operators import neighbours as N
from tracewright.operators import resample as R
from tracewright.operators import reshape as S
from tracewright.operators import vehicles as V
from tracewright.plans import trajectory as T
from tracewright.sources import annotations as files
from tracewright.sources import observations as O
from tracewright.sources import sinks


def obs(spark, rows):
    """rows: (video, track, frame, t, class, cx, cy)"""
    full = [(v, k, f, float(t), c, 0.9, cx - 5.0, cy - 5.0, cx + 5.0, cy + 5.0, float(cx), float(cy)) for v, k, f, t, c, cx, cy in rows]
    return spark.createDataFrame(full, O.SCHEMA)


def one(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_class_names(spark):
    df = spark.createDataFrame([(0,), (4,), (7,), (99,)], "k int")
    assert one(df, E.class_name("k")) == [("Car",), ("2W",), ("Pedestrian",), ("cls99",)]
    assert len(E.CLASS_NAMES) == 8


def test_iou():
    box = lambda *b: np.array([b], float)
    assert D.iou_matrix(box(0, 0, 10, 10), box(0, 0, 10, 10))[0, 0] == 1
    assert D.iou_matrix(box(0, 0, 10, 10), box(20, 20, 30, 30))[0, 0] == 0
    assert D.iou_matrix(box(0, 0, 10, 10), box(5, 5, 15, 15))[0, 0] == pytest.approx(25 / 175)
    assert D.iou_matrix(np.zeros((0, 4)), box(0, 0, 1, 1)).shape == (0, 1)
    assert D.iou_matrix(box(1, 1, 1, 1), box(1, 1, 1, 1))[0, 0] == 0


def test_iou_expression(spark):
    df = spark.createDataFrame([(0.0, 0.0, 10.0, 10.0, 5.0, 5.0, 15.0, 15.0), (1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0)], "ax1 double, ay1 double, ax2 double, ay2 double, bx1 double, by1 double, bx2 double, by2 double")
    assert [r[0] for r in df.select(E.iou("a", "b")).collect()] == [pytest.approx(25 / 175), 0.0]


def test_association():
    assert D.associate(np.array([[1.0]]), 0.3) == ([(0, 0)], [], [])
    assert D.associate(np.array([[0.1]]), 0.3) == ([], [0], [0])
    assert D.associate(np.zeros((0, 0)), 0.3) == ([], [], [])
    # Solved first, asked after: the cheap total wins though one of its pairs is then dropped.
    assert D.associate(np.array([[0.9, 0.8], [0.8, 0.0]]), 0.3)[0] == [(0, 1), (1, 0)]


def test_assignment_is_optimal():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n, m = map(int, rng.integers(1, 6, 2))
        cost = np.round(rng.random((n, m)), int(rng.integers(1, 5)))
        found = D.assignment(cost)
        small, big = min(n, m), max(n, m)
        total = lambda p: sum(cost[(i, j) if n <= m else (j, i)] for i, j in zip(range(small), p, strict=True))
        assert len(found) == small
        assert sum(cost[i, j] for i, j in found) == pytest.approx(min(map(total, itertools.permutations(range(big), small))))


def test_rounding_ties(spark):
    df = spark.createDataFrame([(0.125,), (1.005,), (2.675,), (-0.125,)], "x double")
    assert [r[0] for r in df.select(E.rounded("x")).collect()] == [0.13, 1.0, 2.68, -0.12]


def test_distances_and_speeds(spark):
    k = K.frame_kinematics(obs(spark, [(0, 1, 0, 0, 0, 0, 0), (0, 1, 1, 1, 0, 3, 4), (0, 1, 2, 2, 0, 6, 8), (0, 1, 3, 2, 0, 30, 40)]))
    rows = one(k.orderBy("frame_id"), "speed", "cumulative_distance")
    assert rows == [(0, 0), (5, 5), (5, 10), (0, pytest.approx(50))]


def test_median_filter_and_cap(spark):
    rows = [(0, 1, i, i, 0, x, 0) for i, x in enumerate((0, 1, 2, 500, 501, 5001))]
    s = K.observation_speeds(obs(spark, rows), 2000.0)
    assert [r[0] for r in one(s.orderBy("t"), "speed")] == [1, 1, 1, 1, 498, 2000]


def test_ema_and_gap(spark):
    o = obs(spark, [(0, 1, 0, 0, 0, 5, 5), (0, 1, 2, 2, 0, 15, 15)])
    assert one(K.filled_gaps(o), "frame_id", "x1", "y2") == [(1, 5.0, 15.0)]
    assert [r[0] for r in one(K.smoothed_boxes(o, 1.0).orderBy("t"), "x1")] == [0, 10]
    assert [r[0] for r in one(K.smoothed_boxes(o, 0.0).orderBy("t"), "x1")] == [0, 0]
    assert K.filled_gaps(obs(spark, [(0, 1, 0, 0, 0, 5, 5), (0, 1, 1, 1, 0, 15, 15)])).count() == 0


def test_kalman_track():
    t = D.Tracker()
    seen = [t.step(f, np.array([[100, 200, 150, 250]]), np.array([0.9]), np.array([3])) for f in range(6)]
    # Created in frame 0, confirmed after three matches: first emitted in the fourth frame.
    assert [len(s) for s in seen] == [0, 0, 0, 1, 1, 1]
    assert seen[3][0].track_id == 1 and seen[3][0].hits == 6  # the track itself, as it is after the last frame
    assert seen[5][0].box == pytest.approx([100, 200, 150, 250], abs=1e-3)


def test_tracker_loses_and_recovers():
    t, box = D.Tracker(), np.array([[0, 0, 50, 50]])
    for f in range(5):
        t.step(f, box, np.array([0.9]), np.array([0]))
    for f in range(5, 8):
        assert t.step(f, np.zeros((0, 4)), np.zeros(0), np.zeros(0)) == []
    assert t.step(8, box, np.array([0.2]), np.array([0])) == []  # a lost track needs high confidence
    back = t.step(9, box, np.array([0.9]), np.array([0]))
    assert [x.track_id for x in back] == [1] and set(back[0].filled) == {5, 6, 7, 8}
    for f in range(10, 75):
        t.step(f, np.zeros((0, 4)), np.zeros(0), np.zeros(0))
    assert t.tracks == []


def test_tracker_over_videos(spark):
    rows = [(v, f, 0, 10.0 + f, 10.0, 60.0 + f, 60.0, 0.9, 0) for v in (0, 1) for f in range(6)]
    d = spark.createDataFrame(rows, "video_id long, frame long, detection_id long, x1 double, y1 double, x2 double, y2 double, confidence double, class_id int")
    assert sorted(one(D.track(d), "video_id", "track_id", "frame")) == [(v, 1, f) for v in (0, 1) for f in (3, 4, 5)]


def test_resampler(spark):
    rows = [(0, 1, i, i / 30, 0, i, i) for i in range(90)] + [(0, 2, i, i / 30, 3, 7, 7) for i in range(60)]
    s = R.whole_seconds(obs(spark, rows))
    assert one(s.where("track_id = 1").orderBy("sec"), "sec") == [(0,), (1,), (2,)]
    assert {r[0] for r in one(s, "track_id")} == {1, 2}
    assert one(s.where("track_id = 2 and sec = 1"), "class_name", "direction") == [("Auto", "Eastbound")]  # motionless, two rows
    x = R.whole_seconds(obs(spark, [(0, 1, i, i / 30, 0, i, 0) for i in range(90)]))
    assert one(x.where("sec = 1"), "speed")[0][0] == pytest.approx(30, abs=0.5)


def test_resampler_short_track(spark):
    s = R.whole_seconds(obs(spark, [(0, 1, 0, 0.6, 0, 1, 1), (0, 1, 1, 0.8, 0, 2, 2), (0, 2, 0, 0.2, 0, 5, 5), (0, 2, 1, 0.4, 0, 6, 6)]))
    assert one(s.orderBy("track_id"), "track_id", "sec", "cx", "direction") == [(1, 1, 2.0, "Stationary"), (2, 0, 5.0, "Stationary")]


def test_grid_covers_every_instant_once(spark):
    rng = np.random.default_rng(3)
    t = np.sort(rng.random(60) * 20)
    t[10] = t[11]
    o = obs(spark, [(0, 1, i, float(x), 0, i, 2 * i) for i, x in enumerate(t)])
    s = one(K.nearest_grid(K.neighbours_in_time(o), 0.5).orderBy("sample_idx"), "sample_idx", "frame_id")
    wanted = [(k, int(np.argmin(np.abs(t - (t[0] + 0.5 * k))))) for k in range(int((t[-1] + 1e-6 - t[0]) / 0.5) + 1)]
    assert s == wanted


def headway(spark, others, speed=10.0):
    o = obs(spark, [(0, 1, 0, 5.0, 0, 0, 0), *others])
    probe = o.where("track_id = 1").withColumns({"heading": F.lit(0.0), "speed": F.lit(speed)})
    return one(N.headways(probe, o, E.Parameters()), "dist_headway", "time_headway")


def test_headway_edges(spark):
    assert headway(spark, [(0, 2, 1, 6.0, 0, 30, 0)]) == [(30.0, 3.0)]  # exactly one second away in time
    assert headway(spark, [(0, 2, 1, 6.001, 0, 30, 0)]) == []
    assert headway(spark, [(0, 2, 1, 5.0, 0, 0, 30)]) == []  # abreast
    assert headway(spark, [(0, 2, 1, 5.0, 0, 30, 0)], 0.5) == [(30.0, 0.0)]
    assert headway(spark, [(0, 2, 1, 5.0, 0, 3000, 0)]) == [(3000.0, 120.0)]
    assert headway(spark, [(1, 2, 1, 5.0, 0, 30, 0)]) == []  # another video
    # Nearest in time first (ties to the earlier), then who is ahead: the earlier one is behind.
    assert headway(spark, [(0, 2, 1, 4.5, 0, -30, 0), (0, 2, 2, 5.5, 0, 30, 0)]) == []


def test_directions(spark):
    df = spark.createDataFrame([(10.0, 0.0), (0.0, -10.0), (0.0, 10.0), (-10.0, 0.0), (0.5, 0.5), (-10.0, -0.0)], "dx double, dy double")
    assert [r[0] for r in df.select(E.direction_of_displacement(F.col("dx"), F.col("dy"))).collect()] == ["Eastbound", "Northbound", "Southbound", "Westbound", "Stationary", "Westbound"]
    assert one(spark.range(1), E.direction_of_resampled(F.lit(0.0), F.lit(0.0), F.lit(2)))[0] == ("Eastbound",)


def test_heading_wraps(spark):
    df = spark.createDataFrame([(350.0,), (-350.0,), (180.0,), (-180.0,)], "a double")
    assert [r[0] for r in df.select(E.wrapped(F.col("a"))).collect()] == [-10, 10, 180, -180]


@pytest.mark.parametrize(
    ("speed", "cv", "q", "sway", "braking", "headway", "wanted"),
    [
        (0.4, 0, (1, 5, 9), 0, 0, 999, "Stopped/Idling"), (3, 0, (0, 0, 0), 0, 0, 999, "Disciplined"), (50, 0, (4, 5, 6), 0, 0, 999, "Speeding"),
        (5, 0, (4, 5, 6), 0, -9, 1, "Aggressive Braking"), (5, 0, (4, 5, 6), 3, 0, 1, "Tailgating"), (5, 0, (4, 5, 6), 3, 0, 0, "Lane Weaving"),
        (0.6, 0, (4, 5, 6), 0, 0, 999, "Slow"), (5, 1.1, (4, 5, 6), 0, 0, 999, "Erratic"), (5, 1.0, (4, 5, 6), 0, 0, 999, "Disciplined"),
    ],
)
def test_behaviour_cascade(spark, speed, cv, q, sway, braking, headway, wanted):
    c = lambda x: F.lit(float(x))
    kind = E.behaviour(E.Parameters(), c(speed), c(cv), c(q[1]), c(q[0]), c(q[2]), c(sway), c(braking), c(headway))
    assert one(spark.range(1), kind) == [(wanted,)]


@pytest.mark.parametrize(("n", "wanted"), [(3, (1, 2, 3)), (4, (2, 3, 4)), (5, (2, 3, 4)), (8, (3, 5, 7))])
def test_positional_quartiles(spark, n, wanted):
    df = spark.createDataFrame([(0, float(i + 1)) for i in range(n)], "video_id long, avg_speed double")
    assert one(V.speed_quartiles(df), "q1", "median", "q3") == [wanted]


@pytest.mark.parametrize(("n", "wanted"), [(2, 0), (19, 0), (20, 1), (40, 2)])
def test_low_tail(spark, n, wanted):
    rows = [(0, 1, float(i), 1.0, 0.0, 0.0, 0.0) for i in range(n)]
    df = spark.createDataFrame(rows, "video_id long, track_id long, accel_linear double, speed double, accel_lateral double, time_headway double, moved double")
    assert one(V.sample_indicators(df), "braking", "headway", "speed_cv") == [(wanted, 999.0, 0.0)]


def test_short_tracks_are_left_out(spark):
    rows = [(0, 1, i, i, 0, i, 0) for i in range(4)] + [(0, 2, i, i, 0, i, 0) for i in range(5)]
    assert one(V.vehicles(obs(spark, rows), E.Parameters()), "track_id") == [(2,)]


def test_empty_input(spark):
    none = obs(spark, [(0, 1, 0, 0, 0, 0, 0)]).where("false")
    assert V.vehicles(none, E.Parameters()).count() == 0
    assert R.whole_seconds(none).count() == 0
    assert A.density(spark.createDataFrame([], "video_id long, track_id long, first_t double, n_samples long")).count() == 0


def test_density_is_closed_at_both_ends(spark):
    v = spark.createDataFrame([(0, 1, 0.5, 4), (0, 2, 3.0, 1)], "video_id long, track_id long, first_t double, n_samples long")
    # Lives [0.5, 2.0] and [3.0, 3.0]; second s counts what touches [s, s + 1].
    assert one(A.density(v).orderBy("second"), "second", "n") == [(0, 1), (1, 1), (2, 2), (3, 1), (4, 0)]


def test_histogram_last_bin_is_closed(spark):
    df = spark.createDataFrame([(0, x) for x in (0.0, 0.5, 2.2, 3.0)], "video_id long, v double")
    assert one(A.histogram(df, "v").orderBy("bin"), "label", "n") == [("0.0-1.0", 1), ("1.0-2.0", 0), ("2.0-3.0", 2)]


def test_polygon(spark):
    df = spark.createDataFrame([(5.9, 5.9), (15.0, 5.0)], "x double, y double")
    square = [(0, 0), (10, 0), (10, 10), (0, 10)]
    assert [r[0] for r in df.select(E.in_polygon(F.col("x"), F.col("y"), square)).collect()] == [True, False]
    assert [r[0] for r in df.select(E.in_polygon(F.col("x"), F.col("y"), square[:2])).collect()] == [True, True]


def test_unpivot_stops_at_the_first_gap(spark):
    wide = spark.createDataFrame([(0, 1, 1.0, None, 3.0)], "video_id long, track_id long, t0_x double, t1_x double, t2_x double")
    assert one(S.unpivoted(wide, 3, ("x",)), "sample_idx", "x") == [(0, 1.0)]


def test_pivots_hold_every_sample_second_and_measure(spark, tmp_path, monkeypatch):
    o = obs(spark, [(0, 1, i, i / 2, 2, 3 * i, i * i) for i in range(41)] + [(0, 2, i, i / 2, 2, i, 0) for i in range(8)])
    monkeypatch.setattr(T, "observations", lambda *_: o)
    queries, nowhere = T.QUERIES, str(tmp_path)
    s = {(r["track_id"], r["sample_idx"]): r for r in T.tables(spark, nowhere)[1].collect()}
    assert len(s) == 41 + 8
    wide = {r["track_id"]: r for r in S.widened(T.sample_table(spark, nowhere)).collect()}
    assert set(wide) == {1, 2} and all(len(r) == 2 + 41 * len(S.WIDE) for r in wide.values())
    for k, r in wide.items():
        assert all(r[f"t{i}_{m}"] == (s[k, i][m] if (k, i) in s else None) for i in range(41) for m in S.WIDE)
    # The query gives the same cells as a line, in hundredths.
    lines = {r["track_id"]: r for r in queries["q_wide"](spark, nowhere).collect()}
    cell = lambda v: "" if v is None else str(math.floor(v * 100 + 0.5))
    assert set(lines) == {1, 2} and all(r["n_cells"] == 41 * len(S.WIDE) for r in lines.values())
    for k, r in lines.items():
        assert r["cells"].split(",") == [cell(wide[k][f"t{i}_{m}"]) for i in range(41) for m in S.WIDE]
    long = queries["q_unpivot"](spark, nowhere).collect()
    assert len(long) == len(s) and all(r[m] == s[r["track_id"], r["sample_idx"]][m] for r in long for m in S.WIDE)
    line = queries["q_by_second"](spark, nowhere).where("track_id = 1").first()
    sec = S.by_second(T.rounded_columns(R.whole_seconds(o), *S.PER_SECOND)).where("track_id = 1").first()
    assert line["n_cells"] == 21 * 4 and line["cells"].split(",") == [cell(x) for x in sec[2:]]
    assert len(sec) == 2 + 21 * 4 and [sec[f"s{i}_cx"] for i in range(21)] == [6.0 * i for i in range(21)]
    assert sec["s20_cy"] == 1600 and sec["s20_speed"] > 0 and sec["s20_cumulative_distance"] > 1600
    none = o.where("false").withColumns({"sec": F.col("frame_id"), "sample_idx": F.col("frame_id")})
    assert S.widened(none).count() == S.by_second(none).count() == 0


def test_split_is_exact_and_stable(spark):
    df = spark.createDataFrame([(f"n{i}",) for i in range(11)], "name string")
    a, b = (sorted(one(S.exact_split(df, "name", 0.2), "name", "split")) for _ in range(2))
    assert a == b and sum(s == "val" for _, s in a) == 2
    assert sum(s == "val" for _, s in one(S.exact_split(df.limit(1), "name", 0.2), "name", "split")) == 1


def test_detections_are_guarded(spark):
    df = spark.createDataFrame([(["1", "2", "3", "4", "0.5", "2", "x"],), (["1", "2"],), (["a", "2", "3", "4", "5", "6"],)], "raw array<string>")
    assert one(O.parsed_detections(df), "x1", "class_id") == [(1.0, 2)]


def test_frames(spark):
    assert one(O.frames(10, 3, 30.0, spark), "frame_index", "sampled_index") == [(0, 0), (3, 1), (6, 2), (9, 3)]


def test_every_nth_frame(spark):
    table = spark.createDataFrame([(v, i) for v in (1, 2) for i in (0, 3, 4, 6, 9, 12)], "video_id long, frame_index long")
    rows = [tuple(r) for r in O.every_nth(table, 3, 30.0, 3).orderBy("video_id", "frame_index").collect()]
    assert rows == [(v, i, k, t) for v in (1, 2) for i, k, t in ((0, 0, 0.0), (3, 1, 0.1), (6, 2, 0.2))]
    assert O.every_nth(table, 0, 30.0).count() == 12 and O.every_nth(table.where("false"), 3, 30.0).count() == 0


def test_labels_and_progress(spark):
    counts = spark.createDataFrame([(1, "b", 2), (1, "a", 2), (1, "c", 1), (1, "TOTAL", 5)], "video_id long, label string, n long")
    assert [r.label for r in A.fewest_first(counts).collect()] == ["c", "a", "b"]
    labels = spark.createDataFrame([("2.0-3.0",), ("x-1",), ("5",), (None,)], "label string")
    assert [r[0] for r in labels.select(E.label_middle("label")).collect()] == [2.5, None, None, None]
    done = spark.createDataFrame([(5, 10), (12, 10), (3, 0)], "done long, total long")
    assert [r[0] for r in done.select(E.share_done("done", "total")).collect()] == [0.5, 1.0, 0.0]


def test_helpers_of_boxes_points_and_names(spark):
    row = spark.createDataFrame([(10.0, 20.0, 30.0, 60.0, "[[1, 2], [3, 4]]", "no list", "a/b")], "x1 double, y1 double, x2 double, y2 double, good string, bad string, entry string")
    assert tuple(row.select(*E.box_to_centre()).first()) == (20.0, 40.0, 20.0, 40.0)
    assert tuple(row.select(*E.box_to_centre()).select(*E.centre_to_box("box_cx", "box_cy", "box_w", "box_h")).first()) == (10.0, 20.0, 30.0, 60.0)
    assert row.select(E.point_list("good")).first()[0] == [[1.0, 2.0], [3.0, 4.0]] and not row.select(E.point_list("bad")).first()[0]
    assert tuple(row.select(*E.perspective(F.col("x1"), F.col("y1"), [[1, 0, 5], [0, 2, 0], [0, 0, 2]])).first()) == (7.5, 20.0)


def test_annotation_files(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"images": [{"id": 1, "file_name": "a.jpg", "width": 100, "height": 50}, {"id": 2, "file_name": "b.jpg", "width": 10, "height": 10}], "annotations": [{"id": 1, "image_id": 1, "category_id": 1, "bbox": [10, 10, 20, 20]}, {"id": 2, "image_id": 1, "category_id": 14, "bbox": [0, 0, 1, 1]}, {"id": 3, "image_id": 1, "category_id": 5, "bbox": [0, 0, 0, 1]}]}))
    images, boxes = files.coco(spark, str(tmp_path / "c.json"))
    kept, skipped = AN.kept_and_skipped(boxes.join(images, "image_id"), "category_id", AN.NUMBERED)
    labels = dict(one(AN.label_files(images, AN.from_sides(kept)), "image_id", "content"))
    assert labels == {1: "0 0.200000 0.400000 0.200000 0.400000", 2: ""}
    assert one(skipped, "category_id", "skipped") == [(14, 1)]
    (tmp_path / "v.xml").write_text("<annotation><size><width>100</width><height>100</height></size><object><name> Car </name><bndbox><xmin>0</xmin><ymin>0</ymin><xmax>50</xmax><ymax>50</ymax></bndbox></object><object><name>animal</name><bndbox><xmin>0</xmin><ymin>0</ymin><xmax>5</xmax><ymax>5</ymax></bndbox></object></annotation>")
    images, boxes = files.voc(spark, str(tmp_path / "v.xml"))
    kept, _ = AN.kept_and_skipped(boxes.join(images, "image_id"), "name", AN.NAMED)
    assert one(AN.from_corners(kept), "image_id", "class_id", "ncx") == [("v", 0, 0.25)]


def test_label_text(spark, tmp_path):
    (tmp_path / "l").mkdir()
    (tmp_path / "l/x y.txt").write_text("0 0.1 0.2 0.3 0.4\n\nbad 1 1 1 1\n 7 0.5 0.5 0.1 0.1 \n")
    got = files.yolo_labels(spark, str(tmp_path / "l"))
    assert one(got.orderBy("line_no"), "image_id", "class_id", "w") == [("x y", 0, 0.3), ("x y", 7, 0.1)]
    (tmp_path / "s.txt").write_text("a/b\n\n c \n")
    assert one(files.split_list(spark, str(tmp_path / "s.txt")), "entry") == [("a/b",), ("c",)]
    (tmp_path / "i/sub").mkdir(parents=True)
    for n in ("i/a.png", "i/sub/a.jpg", "i/b.bmp", "i/c.txt"):
        (tmp_path / n).write_bytes(b"x")
    assert sorted((k, p.rpartition("/")[2]) for k, p in one(files.image_files(spark, str(tmp_path / "i")), "image_id", "path")) == [("a", "a.jpg"), ("b", "b.bmp")]


def test_sinks(spark, tmp_path):
    o = obs(spark, [(0, 1, i, i / 2, 0, 10 * i, 0) for i in range(6)])
    sinks.write_csv(sinks.frame_rows(o, 2.0), str(tmp_path / "f"), ["frame_id"])
    back = files.delimited(spark, str(tmp_path / "f"))
    assert back.count() == 6 and back.where("frame_id = 1").first()["speed_m_per_sec"] == "10.00"
    assert one(files.distinct_ids(back), "n") == [(1,)]
    p = E.Parameters()
    s = V.samples(o, p)
    rows = sinks.vehicle_rows(V.vehicles(o, p, s), S.widened(s, 8), False, 8)
    assert len(rows.columns) == 11 + 8 * 9
    r = rows.first()
    assert r["t0_x_px"] == "0.00" and r["t6_x_px"] is None and r["behavior_class"] == "Disciplined"
    sinks.write_workbook(str(tmp_path / "w.xlsx"), {"summary": o.select("frame_id", "cx"), "metadata": sinks.metadata_rows({"fps": 30})})
    with zipfile.ZipFile(tmp_path / "w.xlsx") as z:
        assert "xl/worksheets/sheet2.xml" in z.namelist() and b"<v>50.0</v>" in z.read("xl/worksheets/sheet1.xml")
    assert sinks.column_letters(27) == "AB"


def test_calibration():
    assert E.pixels_per_metre((0, 0), (30, 40), 5) == 10


def test_split_is_exact_and_needs_no_join(spark):
    names = spark.createDataFrame([(f"n{i}",) for i in range(997)], "name string")
    got = S.exact_split(names, "name", 0.15)
    assert got.where("split = 'val'").count() == int(997 * 0.15) and got.count() == 997
    rank = sorted(hashlib.md5(f"42:n{i}".encode()).hexdigest() + f"n{i}" for i in range(997))
    assert {r.name for r in got.where("split = 'val'").collect()} == {x[32:] for x in rank[: int(997 * 0.15)]}
    assert S.exact_split(names.where("false"), "name", 0.5).count() == 0


def test_smoothing_of_a_long_track(spark):
    n = 30_000
    obs = spark.range(n).selectExpr("1L AS video_id", "7L AS track_id", "id AS frame_id", "CAST(id AS DOUBLE) AS t", "CAST(id % 13 AS DOUBLE) AS x1", "0.0D AS y1", "1.0D AS x2", "1.0D AS y2")
    want, x = [], None
    for i in range(n):
        x = float(i % 13) if x is None else 0.7 * (i % 13) + (1 - 0.7) * x
        want.append(x)
    got = [r.x1 for r in K.smoothed_boxes(obs).orderBy("frame_id").select("x1").collect()]
    assert got == want


def test_tracks_stream_across_batches(spark):
    """A video of many frames, in batches that cut frames apart, gives what its frames give one by one."""
    r = random.Random(2)
    rows = []
    for video in (1, 2):
        for frame in range(60):
            for k in range(3):
                x, y = 100 * k + 2 * frame, 50 * k + frame
                rows.append((video, frame, frame * 10 + k, float(x), float(y), float(x + 40), float(y + 30), r.choice((0.9, 0.8, 0.3)), k))
    df = spark.createDataFrame(rows, "video_id long, frame long, detection_id long, x1 double, y1 double, x2 double, y2 double, confidence double, class_id int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = sorted(map(tuple, D.track(df).collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = []
    for video in (1, 2):
        tracker = D.Tracker(D.TrackerParameters())
        for frame in range(60):
            own = np.array([row[3:9] for row in rows if row[:2] == (video, frame)], float)
            want += D.tracked_rows(video, frame, tracker.step(frame, own[:, :4], own[:, 4], own[:, 5].astype(int)))
    assert got == sorted(want) and len(got) > 200
