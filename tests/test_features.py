"""Order statistics, prefix scans, suppression, rectification, merged listings, label files and workbooks against plain Python."""

import math
import random
import re
import zipfile
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.functions import expr as E
from tracewright.operators import analytics as A
from tracewright.operators import annotations as AN
from tracewright.operators import detection as D
from tracewright.operators import kinematics as K
from tracewright.operators import selection
from tracewright.sources import annotations as files
from tracewright.sources import observations as O
from tracewright.sources import sinks

# Order statistics --------------------------------------------------------------------------------------------


@pytest.mark.parametrize("gathered, bins", [(4096, 1024), (2, 4)])
def test_values_at_places_equal_a_sort(spark, monkeypatch, gathered, bins):
    monkeypatch.setattr(selection, "GATHERED", gathered)
    monkeypatch.setattr(selection, "BINS", bins)
    r = random.Random(gathered)
    pool = [0.0, 1.0, 1.0, -5.5, 1e-300, 1e300, -1e300, float("inf"), float("-inf")]
    rows = [(r.choice([1, 1, 1, 2, None]), r.choice([None, float("nan"), r.random(), r.random() * 1e-9, r.choice(pool)])) for _ in range(400)]
    rows += [(3, 7.0)] * 50 + [(4, None)]
    places = {"first": lambda n: F.lit(0), "half": lambda n: F.floor(n / 2), "last": lambda n: n - 1, "beyond": lambda n: n}
    got = selection.at_places(spark.createDataFrame(rows, "k long, v double"), ["k"], "v", places).collect()
    groups = defaultdict(list)
    for k, v in rows:
        if v is not None and not math.isnan(v):
            groups[k].append(v)
    want = [(k, len(v), *(sorted(v)[i] for i in (0, len(v) // 2, len(v) - 1)), None) for k, v in groups.items()]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_values_at_places_by_join(spark, monkeypatch):
    monkeypatch.setattr(selection, "BROADCAST", 0)
    monkeypatch.setattr(selection, "GATHERED", 10)
    df = spark.range(3000).selectExpr("id % 3 AS k", "CAST(id * 7919 % 3001 AS DOUBLE) AS v")
    got = {r.k: r.m for r in selection.at_places(df, ["k"], "v", {"m": lambda n: F.floor(n / 2)}).collect()}
    assert got == {k: sorted(float(i * 7919 % 3001) for i in range(3000) if i % 3 == k)[500] for k in range(3)}


def test_values_at_places_of_nothing(spark):
    assert selection.at_places(spark.createDataFrame([], "k long, v double"), ["k"], "v", {"m": lambda n: F.lit(0)}).collect() == []


def test_no_task_sorts_a_video(spark):
    """The plans of the positional figures have no window over a video; the top rows are cut in every task first."""
    points = spark.range(1000).selectExpr("id % 2 AS video_id", "id AS track_id", "CAST(id AS DOUBLE) AS speed", "'car' AS class_name", "'linear' AS kind")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan(A.top(points, "speed", 10))
    for df in (A.axis_limit(points, "speed"), A.thinned(points, ["track_id"], most=20)):
        assert not re.search(r"Window \[row_number\(\).*\[video_id#\d+L?\]", plan(df))
    assert {r.video_id: r.limit for r in A.axis_limit(points, "speed").collect()} == {0: round(950 * 1.3, 2), 1: round(951 * 1.3, 2)}
    kept = sorted((r.video_id, r.track_id) for r in A.thinned(points, ["track_id"], most=20).collect())
    assert kept == [(v, 2 * i + v) for v in (0, 1) for i in range(0, 500, 25)]


# Smoothing ---------------------------------------------------------------------------------------------------

def plain_smooth(rows, alpha):
    out, held = {}, {}
    for video, track, frame, t, *box in sorted(rows, key=lambda r: (str(r[:2]), r[3], r[2])):
        old = held.get((video, track))
        held[video, track] = box if old is None else [alpha * b + (1 - alpha) * o for b, o in zip(box, old, strict=True)]
        out[video, track, frame] = held[video, track]
    return out


@pytest.mark.parametrize("chunk, alpha", [(4, 0.7), (64, 0.05)])
def test_scanned_smoothing_equals_the_loop(spark, monkeypatch, chunk, alpha):
    monkeypatch.setattr(K, "SCAN", chunk)
    r = random.Random(chunk)
    rows = [(v, k, f, f / 30, *(r.uniform(0, 500) for _ in range(4))) for v in (0, None) for k, n in ((1, 300), (2, 1), (None, 17)) for f in range(n)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "video_id long, track_id long, frame_id long, t double, x1 double, y1 double, x2 double, y2 double")
    smooth = K.smoothed_boxes(df, alpha)
    assert smooth.columns == df.columns and "Python" not in smooth._jdf.queryExecution().executedPlan().toString()
    got = {(x.video_id, x.track_id, x.frame_id): [x.x1, x.y1, x.x2, x.y2] for x in smooth.collect()}
    want = plain_smooth(rows, alpha)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want)


def test_smoothing_of_nothing(spark):
    assert K.smoothed_boxes(spark.createDataFrame([], O.SCHEMA)).count() == 0


# Suppression -------------------------------------------------------------------------------------------------

BOXES = "video_id long, frame long, detection_id long, x1 double, y1 double, x2 double, y2 double, confidence double, class_id int, note string"


def plain_suppressed(rows, confidence, overlap, across):
    kept, out = defaultdict(list), []
    for row in sorted((r for r in rows if r[7] is not None and r[7] >= confidence), key=lambda r: (-r[7], r[2])):
        group = kept[row[:2] if across else (*row[:2], row[8])]
        if not group or D.iou_matrix(np.array([row[3:7]]), np.array([g[3:7] for g in group])).max() <= overlap:
            group.append(row)
            out.append(row)
    return sorted(out, key=str)


@pytest.mark.parametrize("across", [False, True])
def test_suppression_equals_the_greedy_loop(spark, across):
    r = random.Random(8)
    rows = []
    for i in range(500):
        x, y = r.uniform(0, 60), r.uniform(0, 60)
        rows.append((r.choice([0, 1, None]), r.randrange(4), i, x, y, x + r.choice([0.0, 20.0, 30.0]), y + 25.0, r.choice([None, 0.1, 0.25, 0.5, 0.5, 0.9]), r.choice([1, 2, None]), "n"))
    got = D.suppressed(spark.createDataFrame(rows, BOXES), 0.25, 0.4, across)
    assert sorted(map(tuple, got.collect()), key=str) == plain_suppressed(rows, 0.25, 0.4, across) and 20 < got.count() < 300
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    assert D.suppressed(spark.createDataFrame([], BOXES)).count() == 0


# Rectification -----------------------------------------------------------------------------------------------

def plain_map(source, target):
    """The homography by a library's solver."""
    a, b = [], []
    for (x, y), (u, v) in zip(source, target, strict=True):
        a += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        b += [u, v]
    return [*np.linalg.solve(np.array(a, float), np.array(b, float)), 1.0]


SQUARE = [(0.0, 0.0), (1000.0, 0.0), (1000.0, 1000.0), (0.0, 1000.0)]


def test_homographies_equal_a_solver(spark):
    r = random.Random(9)
    quads = [[[r.uniform(0, 300), r.uniform(0, 200)], [r.uniform(900, 1300), r.uniform(0, 200)], [r.uniform(900, 1900), r.uniform(700, 1000)], [r.uniform(0, 400), r.uniform(700, 1000)]] for _ in range(40)]
    df = spark.createDataFrame([(i, q) for i, q in enumerate(quads)], "i int, q array<array<double>>")
    got = {x.i: x.m for x in df.select("i", E.homography(F.col("q"), SQUARE).alias("m")).collect()}
    for i, q in enumerate(quads):
        assert got[i] == pytest.approx(plain_map(q, SQUARE), rel=1e-7, abs=1e-9)
    # Every corner goes to its corner of the square.
    x, y = E.perspective(F.col("p")[0], F.col("p")[1], F.col("m"))
    corners = df.select("i", E.homography(F.col("q"), SQUARE).alias("m"), F.posexplode("q").alias("k", "p")).select("k", x.alias("x"), y.alias("y")).collect()
    assert all((c.x, c.y) == pytest.approx(SQUARE[c.k], abs=1e-6) for c in corners)


def test_quads_are_ordered_and_flat_ones_refused(spark):
    quad = [[900.0, 700.0], [100.0, 50.0], [50.0, 650.0], [800.0, 100.0], [1.0, 1.0]]
    flat = [[0.0, 0.0], [1.0, 1.0], [2.0, 2.0], [3.0, 3.0]]
    df = spark.createDataFrame([(1, quad), (2, flat), (3, quad[:3]), (4, None)], "i int, q array<array<double>>")
    got = {r.i: r for r in df.select("i", E.ordered_quad(F.col("q")).alias("o"), E.homography(E.ordered_quad(F.col("q")), SQUARE).alias("m")).collect()}
    assert got[1].o == [quad[1], quad[3], quad[0], quad[2]] and got[1].m is not None
    assert got[2].m is None and got[3].o is None and got[4].m is None


def test_rectified_places_and_scale(spark):
    rows = [(v, 1, 0, 0.0, 0, 0.9, 0.0, 0.0, 0.0, 0.0, x, y) for v in (1, 2) for x, y in ((100.0, 50.0), (450.0, 400.0))]
    regions = spark.createDataFrame([(1, [[900.0, 700.0], [100.0, 50.0], [50.0, 650.0], [800.0, 100.0]], [[100.0, 50.0], [50.0, 650.0]], 20.0)], "video_id long, points array<array<double>>, calibration array<array<double>>, metres double")
    out = {(r.video_id, r.cx): (r.rx, r.ry) for r in K.rectified(spark.createDataFrame(rows, O.SCHEMA), regions).collect()}
    assert out[1, 100.0] == pytest.approx((0, 0), abs=1e-6) and out[2, 450.0] == (450.0, 400.0)
    m = np.array(plain_map([[100, 50], [800, 100], [900, 700], [50, 650]], SQUARE)).reshape(3, 3)
    u, v, w = m @ [450, 400, 1]
    assert out[1, 450.0] == pytest.approx((u / w, v / w))
    # The left side of the square is 1000 long and stands for 20 metres.
    assert [r.ppm for r in K.rectified_scale(regions).collect()] == pytest.approx([50.0])


def test_colours(spark):
    import colorsys

    got = {r.id: r.c for r in spark.range(1, 40).select("id", E.track_colour("id").alias("c")).collect()}
    for track, bgr in got.items():
        hue = int((track * 0.618033988749895) % 1.0 * 180)
        rgb = [round(230 * x / 230) for x in (230 * c for c in colorsys.hsv_to_rgb(hue / 180, 220 / 255, 1.0))]
        assert bgr == pytest.approx(rgb[::-1], abs=1)
    assert len({tuple(c) for c in got.values()}) == len(got)


# Datasets ----------------------------------------------------------------------------------------------------

def test_merged_listing_with_clashes(spark):
    listing = lambda rows: spark.createDataFrame(rows, "split string, name string, path string")
    images = [listing([("train", "a.jpg", "A/a.jpg"), ("train", "b.jpg", "A/b.jpg"), ("val", "a.jpg", "A/val/a.jpg")]), listing([("train", "a.jpg", "B/a.jpg"), ("train", "b.png", "B/b.png"), ("train", "c.tar.gz", "B/c")])]
    labels = [listing([("train", "b.txt", "A/b.txt"), ("train", "zzz.txt", "A/zzz.txt")]), listing([("train", "a.txt", "B/a.txt"), ("train", "b.txt", "B/b.txt"), ("train", "c.tar.txt", "B/c.txt"), ("train", "a.json", "B/a.json")])]
    got, linked = AN.merged_listing(images, labels)
    assert sorted(map(tuple, got.select("split", "kind", "name", "path").collect())) == sorted([
        ("train", "image", "a.jpg", "A/a.jpg"), ("train", "image", "b.jpg", "A/b.jpg"), ("val", "image", "a.jpg", "A/val/a.jpg"), ("train", "image", "b.png", "B/b.png"), ("train", "image", "c.tar.gz", "B/c"),
        # a's label is B's although its image is A's; b's is A's.
        ("train", "label", "a.txt", "B/a.txt"), ("train", "label", "b.txt", "A/b.txt"), ("train", "label", "c.tar.txt", "B/c.txt"),
    ])
    assert sorted(map(tuple, linked.collect())) == [(0, "train", 2), (0, "val", 1), (1, "train", 3)]
    nothing, none = AN.merged_listing([listing([])], [listing([])])
    assert nothing.count() == 0 and none.count() == 0


def test_label_files_are_named_after_their_images(spark, tmp_path):
    content = {f"img{i}": "".join(f"{k} 0.5 0.5 0.25 0.125\n" for k in range(i % 4)) for i in range(50)}
    df = spark.createDataFrame([*content.items(), ("a/b", "1 0 0 1 1"), ("none", None)], "image_id string, content string").repartition(5)
    path = str(tmp_path / "labels")
    sinks.write_labels(df, path)
    held = {p.name: p.read_text() for p in (tmp_path / "labels").iterdir() if p.name != "_SUCCESS"}
    assert held == {f"{k}.txt": v for k, v in content.items()} | {"a_b.txt": "1 0 0 1 1", "none.txt": ""}
    back = files.yolo_labels(spark, path + "/*.txt")
    assert back.where("image_id = 'img7'").count() == 3 and back.count() == sum(i % 4 for i in range(50)) + 1
    # Overwriting takes the old files away; appending does not.
    sinks.write_labels(spark.createDataFrame([("new", "0 0 0 1 1")], "image_id string, content string"), path)
    sinks.write_labels(spark.createDataFrame([("more", "0 0 0 1 1")], "image_id string, content string"), path, overwrite=False)
    assert sorted(p.name for p in (tmp_path / "labels").glob("*.txt")) == ["more.txt", "new.txt"]


def test_a_failed_label_job_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "labels")
    sinks.write_labels(spark.createDataFrame([("old", "x")], "image_id string, content string"), path)
    bad = spark.range(20).selectExpr("CASE WHEN id = 13 THEN '' ELSE 'n' || id END AS image_id", "'y' AS content")
    with pytest.raises(Exception, match="cannot name"):
        sinks.write_labels(bad, path)
    assert sorted(p.name for p in (tmp_path / "labels").iterdir()) == ["_SUCCESS", "old.txt"]


def test_video_info(spark):
    rows = [(1, "a.mp4", 1920, 1080, 29.97, 100), (2, "b.mp4", 10, 10, 0.0, 7), (3, "c", None, None, None, 9)]
    got = {r.video_id: r for r in O.video_info(spark.createDataFrame(rows, O.VIDEOS), 3).collect()}
    assert (got[1].duration_sec, got[1].effective_fps, got[1].expected_sampled_frames) == (3.34, 9.99, 33)
    assert (got[2].duration_sec, got[2].expected_sampled_frames) == (0.0, 2) and got[3].effective_fps == 0.0


# Sinks -------------------------------------------------------------------------------------------------------

def sheet_rows(path, sheet=1):
    """The sheet read back by a plain reader: cells without a reference stand one beside the other."""
    import xml.etree.ElementTree as X

    ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(path) as z:
        root = X.fromstring(z.read(f"xl/worksheets/sheet{sheet}.xml"))
    return [["".join(c.itertext()) if len(c) else None for c in row] for row in root.iter(ns + "row")]


def test_workbook_keeps_order_and_all_values(spark, tmp_path):
    rows = [(i, None if i % 3 else i / 4, f"<&> {i} é\x01") for i in range(2500)]
    df = spark.createDataFrame(rows, "n long, x double, s string").repartitionByRange(4, "n").sortWithinPartitions("n")
    path = str(tmp_path / "w.xlsx")
    sinks.write_workbook(path, {"one": df, "two": spark.createDataFrame([], "a long"), "three": [["k", 1], ["m", None]]})
    got = sheet_rows(path)
    assert got[0] == ["n", "x", "s"] and got[1:] == [[str(i), None if x is None else repr(x), f"<&> {i} é"] for i, x, _ in rows]
    assert sheet_rows(path, 2) == [["a"]] and sheet_rows(path, 3) == [["k", "1"], ["m"]]


def test_workbook_of_a_million_rows_in_bounded_memory(spark, tmp_path):
    import tracemalloc

    df = spark.range(0, 1_000_000, 1, 40).selectExpr("id", "id * 0.5 AS half", "'row' || id AS name")
    path = str(tmp_path / "w.xlsx")
    tracemalloc.start()
    sinks.write_workbook(path, {"big": df})
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    with zipfile.ZipFile(path) as z, z.open("xl/worksheets/sheet1.xml") as sheet:
        n, end = 0, b""
        for part in iter(lambda: sheet.read(1 << 20), b""):
            n += (end + part).count(b"<row")
            end = part[-3:]  # a tag may lie across two reads
    assert peak < 40 << 20 and n == 1_000_001


def test_workbook_beyond_the_limit_is_refused(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "SHEET_ROWS", 100)
    path = tmp_path / "w.xlsx"
    sinks.write_workbook(str(path), {"s": spark.range(99)})
    with pytest.raises(ValueError, match="more rows"):
        sinks.write_workbook(str(path), {"s": spark.range(100)})
    assert not path.exists()


def test_small_writers(spark, tmp_path):
    assert [r.value for r in sinks.as_json(spark.createDataFrame([(1, None, "é")], "a int, b string, c string")).collect()] == ['{"a":1,"c":"é"}']
    sinks.data_yaml(str(tmp_path / "d.yaml"), "/data")
    text = (tmp_path / "d.yaml").read_text()
    assert text.startswith("path: /data\n") and f"nc: {len(E.CLASS_NAMES)}" in text and "  0: " in text
    assert files.column_starting(["a", "speed_px", "speed_m"], "speed_") == "speed_px" and files.column_starting([], "x") is None
    assert spark.range(1).select(AN.safe_name("idd", F.lit("a/b\\c"))).first()[0] == "idd_a_b_c"
    x, y = E.perspective(F.lit(2.0), F.lit(4.0), [[1, 0, 1], [0, 1, 0], [0, 0, 2]])
    assert tuple(spark.range(1).select(x, y).first()) == (1.5, 2.0)


def test_key_union(spark):
    from tracewright.operators import reshape as S

    a, b = spark.createDataFrame([(1,), (1,), (None,)], "k long"), spark.createDataFrame([(2,), (1,), (None,)], "k long")
    assert sorted((r.k for r in S.key_union([a, b], "k").collect()), key=str) == [1, 2, None]


FILE_QUERIES = ("q_coco_file", "q_voc_file", "q_label_round_trip")


@pytest.mark.parametrize("name", FILE_QUERIES)
def test_file_queries_equal_their_sql(spark, name):
    """What went through files is what the tables hold, at the smallest size."""
    import glob
    import os

    duckdb = pytest.importorskip("duckdb")
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test data")
    from tracewright.plans import formats, registry  # noqa: F401

    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f).removesuffix('.parquet')} AS FROM '{f}'")
    got = registry.QUERIES[name](spark, folder)
    columns = sorted(got.columns)
    want = con.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({registry.ORACLE[name]})").fetchall()
    assert sorted(map(str, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(str, want)) and want


def test_association_of_groups_equals_the_whole_matrix():
    rng = np.random.default_rng(21)
    for _ in range(300):
        n, m = rng.integers(0, 9, 2)
        overlap = np.where(rng.random((n, m)) < rng.choice([0.1, 0.3, 0.9]), rng.random((n, m)), 0.0)
        pairs, rows, columns = D.associate(overlap, 0.3)
        want = [(r, c) for r, c in D.assignment(1.0 - overlap) if overlap[r, c] >= 0.3]
        assert pairs == sorted(want)
        assert rows == sorted(set(range(n)) - {r for r, _ in want}) and columns == sorted(set(range(m)) - {c for _, c in want})
