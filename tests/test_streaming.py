"""Streaming operators against their batch twins."""

import pytest
from pyspark.sql import functions as F

from tracewright.operators import detection as D
from tracewright.operators.kinematics import frame_kinematics
from tracewright.sources import observations as O
from tracewright.streaming import live

DETECTIONS = "video_id long, frame long, detection_id long, x1 double, y1 double, x2 double, y2 double, confidence double, class_id int"


def stream_of(spark, batches, schema, tmp_path):
    """A stream that delivers the batches one by one."""
    path = str(tmp_path / "in")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/b{i:03}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)


def collected(stream, name, tmp_path, spark):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    return spark.sql(f"SELECT * FROM {name}")


@pytest.fixture
def few(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_tracker_stream_equals_batch(spark, tmp_path, few):
    rows = [(v, f, i, 10.0 + 3 * f + 200 * i, 10.0, 60.0 + 3 * f + 200 * i, 60.0, 0.9 if f % 4 else 0.3, i) for v in (0, 1) for f in range(12) for i in (0, 1)]
    batches = [[x for x in rows if x[1] // 4 == k] for k in range(3)]
    got = collected(live.tracked(stream_of(spark, batches, DETECTIONS, tmp_path)), "tracked", tmp_path, spark)
    want = D.track(spark.createDataFrame(rows, DETECTIONS))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 20


def test_tracker_stream_waits_for_late_frames(spark, tmp_path, few):
    rows = [(0, f, 0, 10.0 + f, 10.0, 60.0 + f, 60.0, 0.9, 0) for f in range(12)]
    batches = [[rows[f] for f in fs] for fs in ((0, 2, 3, 5), (1, 4, 7, 6), (8, 9, 10, 11))]
    got = collected(live.tracked(stream_of(spark, batches, DETECTIONS, tmp_path), lateness_frames=4), "late", tmp_path, spark)
    want = D.track(spark.createDataFrame(rows, DETECTIONS)).where("frame <= 7")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_running_metrics_equal_batch(spark, tmp_path, few):
    rows = [(0, k, f, float(f), 0, 0.9, 0.0, 0.0, 1.0, 1.0, float(f * k), float(f * f)) for k in (1, 2) for f in range(9)]
    got = collected(live.running_metrics(stream_of(spark, [[x for x in rows if x[2] // 3 == i] for i in range(3)], O.SCHEMA, tmp_path)), "running", tmp_path, spark)
    want = frame_kinematics(spark.createDataFrame(rows, O.SCHEMA))
    cols = ("track_id", "frame_id", "speed", "cumulative_distance")
    a, b = (sorted(map(tuple, x.select(*cols).collect())) for x in (got, want))
    assert [x[:2] for x in a] == [x[:2] for x in b] and all(x == pytest.approx(y) for x, y in zip(a, b, strict=True))


def test_windows_and_sessions(spark, tmp_path, few):
    times = ["2024-01-01 00:10:00", "2024-01-01 00:50:00", "2024-01-01 01:10:00", "2024-01-01 09:00:00"]
    stream = stream_of(spark, [[(t, "a")] for t in times], "at string, k string", tmp_path).select(F.to_timestamp("at").alias("at"), "k")
    got = collected(live.windowed_counts(stream, "at", ["k"]), "windows", tmp_path, spark)
    assert sorted(r.n for r in got.collect()) == [1, 2]
    (tmp_path / "s").mkdir()
    s = collected(live.sessions(stream, "at", "k"), "sessions", tmp_path / "s", spark)
    assert sorted(r.n for r in s.collect()) == [1, 2]


def test_finalising_batches(spark, tmp_path, few):
    seen = []
    stream = stream_of(spark, [[(1,)], [(2,), (3,)]], "x long", tmp_path)
    live.finalised(stream, lambda df, i: seen.append((i, df.count())), str(tmp_path / "c")).awaitTermination(120)
    assert [n for _, n in seen] == [1, 2]


def timed(rows, start=0):
    """Detections with an event time: 30 frames a second."""
    from datetime import datetime, timedelta, timezone

    return [(*r, datetime(2024, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=start + r[1] / 30)) for r in rows]


TIMED = DETECTIONS + ", at timestamp"


def boxes_of(video, frames, k=1):
    return [(video, f, i, 10.0 + 3 * f + 300 * i, 10.0, 60.0 + 3 * f + 300 * i, 60.0, 0.9, i) for f in frames for i in range(k)]


def state_rows(query):
    return sum(op["numRowsTotal"] for op in query.recentProgress[-1]["stateOperators"])


def run_timed(spark, tmp_path, batches, name, **options):
    stream = live.tracked(stream_of(spark, batches, TIMED, tmp_path), time="at", lateness="0 seconds", **options)
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    return q, sorted(map(tuple, spark.sql(f"SELECT * FROM {name}").collect()))


def test_a_quiet_video_leaves_no_state(spark, tmp_path, few):
    """Video 0 ends after 12 frames with two of them waiting; video 1 goes on. What waits comes out, and the state goes."""
    zero, one = boxes_of(0, range(12), 2), boxes_of(1, range(12))
    later = [boxes_of(1, range(f, f + 3)) for f in (12, 90, 200, 400)]
    batches = [timed(b) for b in (zero + one, *later)]
    q, got = run_timed(spark, tmp_path, batches, "quiet", lateness_frames=2, forget=1)
    want = D.track(spark.createDataFrame(zero, DETECTIONS))
    assert [r for r in got if r[0] == 0] == sorted(map(tuple, want.collect())) and len({r[1] for r in got if r[0] == 0}) == 9
    videos = spark.read.format("statestore").option("path", str(tmp_path / "c")).option("stateVarName", "video").load()
    assert [r.key.video_id for r in videos.collect()] == [1]
    assert {r.video_id for r in live.live_tracks(spark, str(tmp_path / "c")).collect()} <= {1}


def test_a_video_that_resumes_keeps_its_ids(spark, tmp_path, few):
    """Tracks go while a video is quiet, its id counter stays for longer: ids go on as in the batch."""
    zero = boxes_of(0, range(6))
    clock = boxes_of(1, range(0, 160, 40))
    again = boxes_of(0, range(150, 156))
    batches = [timed(zero), *[timed([c]) for c in clock], timed(again)]
    _, got = run_timed(spark, tmp_path, batches, "resumed", forget=10)
    want = D.track(spark.createDataFrame(zero + again, DETECTIONS))
    assert [r for r in got if r[0] == 0] == sorted(map(tuple, want.collect()))
    assert {r[2] for r in got if r[0] == 0} == {1, 2}


def test_the_last_timer_does_not_end_a_video_that_resumed(spark, tmp_path, few):
    """A video comes back between the end of its tracks and its being forgotten, and goes on beyond that time."""
    zero = boxes_of(0, range(6))
    again = [boxes_of(0, range(f, f + 10)) for f in range(100, 200, 10)]
    batches = [timed(zero), *[timed(boxes_of(1, [f])) for f in (40, 90)], *map(timed, again)]
    _, got = run_timed(spark, tmp_path, batches, "resumed_on", forget=2)
    want = D.track(spark.createDataFrame(zero + [r for b in again for r in b], DETECTIONS))
    assert [r for r in got if r[0] == 0] == sorted(map(tuple, want.collect()))
    assert {r[2] for r in got if r[0] == 0} == {1, 2} and max(r[1] for r in got) == 199


def test_no_state_is_left_at_last(spark, tmp_path, few):
    """A last row far ahead and dropped by the tracker (its confidence is too low to begin a track) moves the clock past all timers."""
    rows = boxes_of(0, range(8), 2) + boxes_of(1, range(8))
    ends = [timed([(9, 0, 0, 0.0, 0.0, 1.0, 1.0, 0.0, 0)], start=s) for s in (60, 120, 180)]
    q, _ = run_timed(spark, tmp_path, [timed(rows), *ends], "ended", forget=2)
    left = spark.read.format("statestore").option("path", str(tmp_path / "c")).option("stateVarName", "video").load()
    assert {r.key.video_id for r in left.collect()} <= {9}
    assert live.live_tracks(spark, str(tmp_path / "c")).count() == 0


def test_snapshot_equals_the_batch_twin(spark, tmp_path, few):
    import numpy as np

    rows = [(v, f, i, 10.0 + 3 * f + 200 * i, 10.0, 60.0 + 3 * f + 200 * i, 60.0, 0.9 if (f + i) % 4 else 0.3, i) for v in (0, 1) for f in range(12) for i in (0, 1)]
    batches = [[x for x in rows if x[1] // 4 == k] for k in range(3)]
    collected(live.tracked(stream_of(spark, batches, DETECTIONS, tmp_path)), "snap", tmp_path, spark)
    for batch, upto in ((None, 12), (1, 8)):
        got = sorted(map(tuple, live.live_tracks(spark, str(tmp_path / "c"), batch).select("video_id", "frame", "created", "track_id", "x1", "y1", "x2", "y2", "silent", "age", "hits", "history").collect()))
        want = []
        for v in (0, 1):
            t = D.Tracker()
            for f in range(upto):
                own = np.array([r[3:9] for r in rows if r[:2] == (v, f)], float)
                t.step(f, own[:, :4], own[:, 4], own[:, 5].astype(int))
            want += [(v, upto - 1, t.created, k.track_id, *k.box.tolist(), k.silent, k.age, k.hits, len(k.history)) for k in t.tracks]
        assert got == sorted(want) and len(got) >= 4


def test_a_restart_resets_a_video(spark, tmp_path, few):
    """Stopped and started again with a reset for video 0: its ids count from 1, those of video 1 go on; the same reset isn't done twice."""
    path, checkpoint = str(tmp_path / "in"), str(tmp_path / "c")
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(DETECTIONS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)
    got = []
    for i, resets in enumerate((None, {0: 7}, {0: 7})):
        # In each run the box is elsewhere, so that a new track begins.
        rows = [(v, f, 0, 1000.0 * i + f, 10.0, 1000.0 * i + 50 + f, 60.0, 0.9, 0) for v in (0, 1) for f in range(10 * i, 10 * i + 6)]
        spark.createDataFrame(rows, DETECTIONS).coalesce(1).write.parquet(f"{path}/b{i}")
        q = live.tracked(stream, resets=resets).writeStream.foreachBatch(lambda df, _: got.extend(map(tuple, df.collect()))).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination(240)
    ids = lambda v: [sorted({r[2] for r in got if r[0] == v and r[1] // 10 == i}) for i in range(3)]
    assert ids(1) == [[1], [2], [3]] and ids(0) == [[1], [1], [2]]


def test_live_progress_counts_every_batch(spark, tmp_path, few):
    import time

    from tracewright.streaming import progress

    schema = "video_id long, frame long, boxes array<struct<x1:double,y1:double,x2:double,y2:double,confidence:double,class_id:int>>"
    frames = [(0, f, [(10.0 + f + 200 * i, 10.0, 60.0 + f + 200 * i, 60.0, 0.9, 1) for i in range(0 if f == 5 else 2)]) for f in range(12)]
    listener = progress.LiveProgress()
    spark.streams.addListener(listener)
    try:
        stream = stream_of(spark, [frames[:4], frames[4:8], frames[8:]], schema, tmp_path)
        got = collected(progress.counted_tracks(live.tracked(progress.detections_of(stream))), "counted", tmp_path, spark)
        rows = got.count()
        until = time.monotonic() + 30
        while (listener.of("counted").running or listener.of("counted").batches < 3) and time.monotonic() < until:
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    end = listener.of("counted")
    assert [(h["frames"], h["detections"], h["last_frame"]) for h in listener.history["counted"]] == [(4, 8, 3), (8, 14, 7), (12, 22, 11)]
    assert end.rows == rows > 0 and end.greatest_id == 2 and end.share(24) == 0.5 and end.frames_per_second() > 0 and not end.running
    assert end.seconds_left(12) == 0 and progress.Counters().share(0) == 0


def test_running_state_of_quiet_tracks_goes(spark, tmp_path, few):
    """Track 1 ends early, track 2 goes on: the figures are the batch's, and only track 2 is left in the state."""
    from datetime import datetime, timedelta, timezone

    at = lambda t: datetime(2024, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=t)
    row = lambda k, f: (0, k, f, float(f), 0, 0.9, 0.0, 0.0, 1.0, 1.0, float(f * k), float(f * f), at(f))
    batches = [[row(k, f) for k in (1, 2) for f in range(3)], [row(2, f) for f in range(3, 9)], [row(2, f) for f in range(9, 30)], [row(2, 30)]]
    stream = stream_of(spark, batches, O.SCHEMA + ", at timestamp", tmp_path)
    got = collected(live.running_metrics(stream, time="at", lateness="0 seconds"), "running_timed", tmp_path, spark)
    want = frame_kinematics(spark.createDataFrame([r[:-1] for b in batches for r in b], O.SCHEMA))
    cols = ("track_id", "frame_id", "speed", "cumulative_distance")
    a, b = (sorted(map(tuple, x.select(*cols).collect())) for x in (got, want))
    assert [x[:2] for x in a] == [x[:2] for x in b] and all(x == pytest.approx(y) for x, y in zip(a, b, strict=True))
    left = spark.read.format("statestore").option("path", str(tmp_path / "c")).option("stateVarName", "track").load()
    assert [r.key.track_id for r in left.collect()] == [2]
