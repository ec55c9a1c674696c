"""Faults that show only on more rows than the smallest tables hold: made tables against the SQL, plans, and plain Python."""

import glob
import os
import random
import re
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.functions import expr as E
from tracewright.operators import analytics as A
from tracewright.operators import detection as D
from tracewright.operators import neighbours as N
from tracewright.operators import reshape as S
from tracewright.sources import annotations as files
from tracewright.sources import label_files, sinks

def events(columns: str, n: int) -> str:
    """A folder with n events made by an SQL select list over i."""
    duckdb = pytest.importorskip("duckdb")
    folder = tempfile.mkdtemp(prefix="events-")
    duckdb.connect().execute(f"COPY (SELECT i AS event_id, {columns} FROM range({n}) r(i)) TO '{folder}/events.parquet'")
    return folder


def differing(spark, folder, name):
    """Rows that only the query has, and rows that only its SQL has."""
    import duckdb

    from tracewright.plans import formats, registry  # noqa: F401

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f).removesuffix('.parquet')} AS FROM '{f}'")
    got = registry.QUERIES[name](spark, folder)
    columns = sorted(got.columns)
    want = con.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({registry.ORACLE[name]})").fetchall()
    have = sorted(str(tuple(r[c] for c in columns)) for r in got.collect())
    want = sorted(map(str, want))
    assert want
    return [a for a, b in zip(have, want, strict=True) if a != b], [b for a, b in zip(have, want, strict=True) if a != b]


def test_smoothing_in_sql_leaves_the_rest_of_the_same_alpha(spark):
    """1 - 0.7 is a decimal in SQL, and its double another number than the rest of 0.7: ties fell to the other side."""
    folder = events("TIMESTAMP '2024-01-01' + to_hours(i) AS ts, i // 3 AS user_id, 'view' AS event_type, (i * 7919 % 50000) / 100.0 AS value, '{\"k\": 5}' AS props", 6000)
    assert differing(spark, folder, "q_ema") == ([], [])


@pytest.mark.parametrize("digits", [1, 2, 4])
def test_measures_are_printed_as_python_prints_them(spark, digits):
    r = random.Random(digits)
    values = [0.0, -0.0, 0.125, -0.125, 0.375, 1.005, 2.675, 0.05, 0.25, 0.5, -0.001, 9.9999999, 99.995, 1e-300, 1e15, 1e20, 4503599627370495.5]
    values += [k / 10 ** (digits + 1) for k in range(5, 60_000, 10)] + [r.uniform(-1000, 1000) for _ in range(2000)] + [k / 64 for k in range(-200, 200)]
    got = spark.createDataFrame([(v,) for v in values], "x double").select("x", E.formatted("x", digits).alias("s")).collect()
    assert [(x, s) for x, s in got if s != f"{x:.{digits}f}"] == []
    odd = spark.createDataFrame([(None,), (float("nan"),)], "x double").select(E.formatted("x", digits), F.format_string(f"%.{digits}f", "x")).collect()
    assert all(a == b for a, b in odd)


def test_frame_file_prints_ties_as_its_sql_does(spark):
    folder = events("TIMESTAMP '2024-01-01' + to_microseconds(i * 432000) AS ts, i % 40 AS user_id, 'view' AS event_type, 5.0::DOUBLE AS value, '{\"k\": 5}' AS props", 4000)
    assert differing(spark, folder, "q_frame_file") == ([], [])


def test_headway_sorts_no_pairs_of_observations(spark, monkeypatch):
    """The join's rows are a probe and a track each, whatever the observations of the track; the nearest are those of a plain loop."""
    r = random.Random(5)
    rows = [(v, k, 1000 * k + f, r.choice([r.uniform(-9, 9), r.randrange(-8, 9) / 2.0]), r.uniform(0, 99), r.uniform(0, 99)) for v in (0, 1) for k in range(4) for f in range(60)]
    obs = spark.createDataFrame(rows, "video_id long, track_id long, frame_id long, t double, cx double, cy double")
    probe = obs.where("frame_id % 3 = 0").withColumns({"heading": F.lit(30.0), "speed": F.lit(2.0)})
    near = N.nearest_in_time(probe, obs, 0.5)
    plan = near._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and "Aggregate" not in plan[: plan.index("Join")]
    got = {(x.video_id, x.frame_id, x.o_track): (x.o.o_t, x.o.o_frame) for x in near.collect()}
    want = {}
    for v, k, f, t, _, _ in rows:
        for o in range(4):
            at = [(abs(b[3] - t), b[3], b[2]) for b in rows if b[0] == v and b[1] == o and abs(b[3] - t) <= 0.5]
            if f % 3 == 0 and o != k and at:
                want[v, f, o] = min(at)[1:]
    assert got == want


def test_frames_are_assigned_many_at_a_call(spark):
    r = random.Random(19)
    box = lambda: (lambda x, y: (x, y, x + 20.0, y + 20.0))(r.uniform(0, 60), r.uniform(0, 60))
    rows = [(v, f, 10 * f + k, *box()) for v in (0, 1) for f in range(-70, 70) for k in range(r.randrange(5))]
    names = "x1 double, y1 double, x2 double, y2 double"
    d = spark.createDataFrame(rows, f"video_id long, frame long, detection_id long, {names}")
    seen = [(v, f, 7 * i, *box()) for i, (v, f, *_) in enumerate(rows)]
    t = spark.createDataFrame(seen, f"video_id long, frame long, track_id long, {names}")
    out = D.assigned(d, t, 0.1)
    keys = re.search(r"FlatMapGroupsInPandas \[([^\]]*)\]", out._jdf.queryExecution().analyzed().toString()).group(1)
    assert "stretch" in keys and "frame" not in keys
    want = set()
    for v, f in {x[:2] for x in rows}:
        a, b = ([x[2:] for x in xs if x[:2] == (v, f)] for xs in (rows, seen))
        a, b = sorted(a), sorted(b)
        overlap = D.iou_matrix(np.array([x[1:] for x in a]), np.array([x[1:] for x in b]))
        want |= {(v, f, a[i][0], b[j][0]) for i, j in D.associate(overlap, 0.1)[0]}
    assert {tuple(x)[:4] for x in out.collect()} == want and len(want) > 100


@pytest.mark.parametrize("name, kind", [("q_voc_file", "voc"), ("q_label_round_trip", "label-lines")])
def test_small_files_are_opened_once_and_many_to_a_task(spark, tmp_path, monkeypatch, name, kind):
    """The query's own plan reads what the files held, which one pass over the listed folder brought in few tasks."""
    from tracewright.plans import formats, registry  # noqa: F401

    made, write = {}, files.durable

    def watched(df, what, **options):
        made[what] = (len(df.inputFiles()), options)
        return write(df, what, **options)

    monkeypatch.setattr(files, "durable", watched)
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    folder = events("TIMESTAMP '2024-01-01' + to_hours(i) AS ts, i // 30 AS user_id, 'view' AS event_type, 40.0 + i % 7 AS value, '{\"k\": 5}' AS props", 3200)
    plan = registry.QUERIES[name](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert made[kind][0] == 200 and made[kind][1] == {"small_files": True} and "xml" not in plan and " text" not in plan
    assert spark.conf.get("spark.sql.files.openCostInBytes") == before
    assert differing(spark, folder, name) == ([], [])


def test_a_histogram_works_its_values_out_once(spark):
    values = spark.range(300).select((F.col("id") % 3).alias("video_id"), (F.col("id") / 40).alias("v"))
    got = A.histogram(values, "v")
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Range (") <= 1
    want = {(i, b): sum(j % 3 == i and 0 < j / 40 and b <= j / 40 < b + 1 for j in range(300)) for i in range(3) for b in range(8)}
    assert {(r.video_id, r.bin): r.n for r in got.collect()} == want


def test_a_pivot_shuffles_narrow_rows_only(spark):
    """Rows as wide as the result, one of a track in each partition, went through the shuffle, and their samples through a sort."""
    rows = [(0, k, i, None if (k, i) == (7, 5) else k + i / 8, float(i)) for k in range(30) for i in range(k + 1)]
    samples = spark.createDataFrame(rows, "video_id long, track_id long, sample_idx int, x double, y double").repartition(4)
    wide = S.widened(samples, 30, ("x", "y"))
    long = S.unpivoted(wide, 30, ("x", "y"))
    for out in (wide, long):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Window" not in plan
    assert sorted(map(tuple, long.collect())) == sorted(r for r in rows if r[1] != 7 or r[2] < 5)


def test_samples_are_written_with_their_measures_only(spark):
    """Boxes, neighbours and raw speeds that nothing reads again were written with them."""
    from tracewright.plans import trajectory as T

    folder = events("TIMESTAMP '2024-01-01' + to_hours(i) AS ts, i % 4 AS user_id, 'view' AS event_type, (i * 7919 % 50000) / 100.0 AS value, '{\"k\": 5}' AS props", 200)
    _, samples = T.tables(spark, folder)
    written = spark.read.parquet(*samples.inputFiles()).columns
    assert sorted(written) == sorted(["video_id", "track_id", "sample_idx", *S.WIDE])


@pytest.mark.parametrize("form", ["numbers", "texts"])
def test_the_plan_of_a_wide_file_does_not_print_each_column(spark, form):
    """Each of some thousand columns had the whole printing expression, hundreds of copies of its number, and the driver ran out of memory."""
    rows = [(0, k, i, *(k + i / 8 + m / 1000 if (k + i + m) % 5 else None for m in range(9))) for k in range(3) for i in range(0, 12, k + 1)]
    samples = spark.createDataFrame(rows, "video_id long, track_id long, sample_idx int, " + ", ".join(f"{m} double" for m in S.WIDE))
    v = spark.createDataFrame([(0, k, 0.5, k, 0, "Car", 0.5, 2.5, "Eastbound", "Slow", 10.0) for k in range(4)], "video_id long, track_id long, first_t double, first_frame long, class_id int, class_name string, avg_confidence double, avg_speed double, direction string, behaviour string, total_distance double")
    made = lambda n: sinks.vehicle_rows(v, S.widened(samples, n) if form == "numbers" else S.gathered(sinks.printed_samples(samples)), False, n)
    before = spark.conf.get("spark.sql.debug.maxToStringFields")
    try:
        spark.conf.set("spark.sql.debug.maxToStringFields", "100000")
        printed = [made(n)._jdf.queryExecution().optimizedPlan().toString().count("134217729") for n in (12, 24)]
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", before)
    assert printed[0] == printed[1] < 400
    held = {r[1:3]: r[3:] for r in rows}
    got = {r.track_id: r for r in made(13).collect()}
    assert set(got) == {0, 1, 2, 3} and all(len(r) == 11 + 13 * 9 for r in got.values())
    text = lambda x: None if x is None else f"{x:.2f}"
    for k, r in got.items():
        assert list(r[11:]) == [text(x) for i in range(13) for x in held.get((k, i), (None,) * 9)]


def test_vehicle_file_of_many_samples_equals_its_sql(spark):
    folder = events("TIMESTAMP '2024-01-01' + to_minutes(i * 150) AS ts, i % 4 AS user_id, 'view' AS event_type, (i * 7919 % 50000) / 100.0 AS value, '{\"k\": 5}' AS props", 280)
    assert differing(spark, folder, "q_vehicle_file") == ([], [])


def test_a_file_with_another_header_is_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text("n,x\n1,2\n")
    assert files.delimited(spark, str(tmp_path), ["n", "x"]).collect() == files.delimited(spark, str(tmp_path)).collect()
    with pytest.raises(Exception, match="header"):
        files.delimited(spark, str(tmp_path), ["n", "y"]).collect()


def odd_files(folder, texts):
    folder.mkdir()
    for name, content in texts.items():
        (folder / name).write_bytes(content)
    (folder / "folder.txt").mkdir()
    return str(folder)


ODD_LABELS = {
    "a.txt": b"0 0.1 0.2 0.3 0.4\n1 1 1 1 1\n", "b c.txt": b"\r\n 2 0.5 0.5 0.5 0.5 \r\n\r\nbad 1 1 1 1\r3 1 1 1 1\n\n4 1", "none.txt": b"", "x%20y+z.txt": b"5 0 0 0 0", "two.dots.txt": b"7 0 0 0 0\n\xff 1 1 1 1",
    "mark.txt": b"\xef\xbb\xbf6 0 0 0 0\n", "_hidden.txt": b"8 0 0 0 0", ".hidden.txt": b"8 0 0 0 0", "other.text": b"8 0 0 0 0", "OTHER.TXT": b"8 0 0 0 0", "\u00e9.txt": b"9 0 0 0 0",
}
OBJECT = b"<object><name> %s </name><bndbox><xmin>1</xmin><ymin>2</ymin><xmax>3.5</xmax><ymax>4</ymax></bndbox></object>"
ODD_VOC = {
    "a.txt": b"<annotation><size><width>9</width><height>8</height></size>" + OBJECT % b"Car" + OBJECT % b"bus" + b"</annotation>", "empty.txt": b"", "words.txt": b"no markup", "blank.txt": b" \n", "other.txt": b"<page><size><width>1</width></size></page>", "bare.txt": b"<annotation></annotation>",
    "told.txt": b'<?xml version="1.0"?>\n<!-- by hand -->\n<annotation verified="yes">\n<filename>f.jpg</filename>' + OBJECT % b"a &amp; b" + b"\n</annotation>\n", "half.txt": b"<annotation><size><width>7</width>",
    "in.txt": b"<all>" + 2 * (b"<annotation>" + OBJECT % b"train" + b"</annotation>") + b"</all>", "self.txt": b"<annotation/>", "badnum.txt": b"<annotation><size><width>x</width><height>3</height></size></annotation>",
    "x%20y.txt": b"<annotation><size><width>1</width><height>2</height></size></annotation>",
}


@pytest.mark.parametrize("kind", ["labels", "voc"])
def test_a_large_folder_reads_as_a_small_one_and_its_files_are_not_listed(spark, tmp_path, monkeypatch, kind):
    """The driver listed every file of a folder and held its place: it ran out of memory before the tasks did."""
    path = odd_files(tmp_path / "some", ODD_LABELS if kind == "labels" else ODD_VOC)
    held, write = [], files.durable

    def watched(df, what, **options):
        held.append(len(df.inputFiles()))
        return write(df, what, **options)

    monkeypatch.setattr(files, "durable", watched)

    def rows():
        tables = [files.yolo_labels(spark, path, "txt")] if kind == "labels" else files.voc(spark, path, "txt")
        return [sorted(map(str, t.collect())) for t in tables]

    small = rows()
    monkeypatch.setattr(label_files, "LISTED", 2)
    monkeypatch.setattr(label_files, "FILES_A_TASK", 3)
    assert rows() == small and min(map(len, small)) > 1
    assert held[0] > 5 and held[1] <= 1


def test_label_files_are_moved_a_few_at_a_time(tmp_path, monkeypatch):
    """The driver held the names of all of a task's files, and a future for each, at once."""
    monkeypatch.setattr(label_files, "FOLDER", 10)
    path = str(tmp_path / "labels")
    for rows in (range(95), range(90, 120), range(0)):
        writer = label_files.LabelWriter(path, True)
        wrote = writer.write(iter([{"image_id": f"n{i}", "content": f"{i}"} for i in rows]))
        staged = [len(names) for _, _, names in os.walk(f"{path}/{wrote.folder}") if names]
        assert sum(staged) == len(rows) and max(staged, default=0) <= 10
        writer.commit([wrote, None])
        assert {p.name: p.read_text() for p in (tmp_path / "labels").iterdir()} == {f"n{i}.txt": f"{i}" for i in rows} | {"_SUCCESS": ""}
