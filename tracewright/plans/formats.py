"""Queries that go through files: what the writers write is read back by the readers, and compared with the tables.

Each writes what it makes of the given tables into a fresh folder of the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr as E
from ..operators import analytics as A
from ..operators import annotations as AN
from ..operators import kinematics as K
from ..operators import reshape as S
from ..sources import annotations as files
from ..sources import observations as O
from ..sources import sinks
from ..storage import durable, fresh_path
from .datasets import BOXES_SQL, boxes
from .trajectory import AN as ANALYTICS_SQL
from .trajectory import KIN, NAMES_SQL, QUAD_SQL, observations, query, quads, r, rounded_columns, tables


def frame_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "frames-csv")
    sinks.write_csv(sinks.frame_rows(observations(spark, sf_dir)), path, ["frame_id"])
    return files.delimited(spark, path)


@query(KIN + f""", k AS (SELECT *, coalesce(sqrt((cx-px)*(cx-px) + (cy-py)*(cy-py)), 0.0) AS hop FROM kin)
SELECT video_id, CAST(frame_id AS VARCHAR) AS frame_id, CAST(track_id AS VARCHAR) AS track_id, printf('%.4f', t) AS timestamp, {NAMES_SQL} AS class_name, printf('%.4f', confidence) AS confidence,
       printf('%.1f', x1) AS x1, printf('%.1f', cx) AS cx, printf('%.2f', CASE WHEN t > pt THEN hop / (t - pt) ELSE 0.0 END) AS speed_px_per_sec FROM k""")  # fmt: skip
def q_frame_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = frame_file(spark, sf_dir).withColumn("video_id", F.col("video_id").cast("long"))
    return back.select("video_id", "frame_id", "track_id", "timestamp", "class_name", "confidence", "x1", "cx", "speed_px_per_sec")


@query("WITH " + O.SQL + " SELECT count(DISTINCT track_id) AS n FROM obs")
def q_distinct_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.distinct_ids(frame_file(spark, sf_dir))


STATIC = ("timestamp_first_seen", "frame_id_first_seen", "class_name", "confidence", "avg_speed_px_per_s", "direction", "behavior_class", "total_distance_px")


@query(ANALYTICS_SQL + """, ks AS (SELECT unnest(range(max(sample_idx) + 1)) AS k FROM fs), c AS (
    SELECT v.video_id, v.track_id, string_agg(""" + " || ',' || ".join(f"coalesce(printf('%.2f', {m}), '')" for m in S.WIDE) + """, ',' ORDER BY k) AS cells
    FROM fv v CROSS JOIN ks LEFT JOIN fs ON fs.video_id = v.video_id AND fs.track_id = v.track_id AND fs.sample_idx = ks.k GROUP BY v.video_id, v.track_id
)
SELECT c.video_id, CAST(c.track_id AS VARCHAR) AS track_id, printf('%.2f', fv.first_t) AS timestamp_first_seen, CAST(v.first_frame AS VARCHAR) AS frame_id_first_seen, fv.class_name, printf('%.2f', floor(v.avg_confidence * 100 + 0.5) / 100) AS confidence,
       printf('%.2f', fv.avg_speed) AS avg_speed_px_per_s, fv.direction, fv.behaviour AS behavior_class, printf('%.2f', fv.total_distance) AS total_distance_px, cells
FROM c JOIN fv ON fv.video_id = c.video_id AND fv.track_id = c.track_id JOIN vehicles v ON v.video_id = c.video_id AND v.track_id = c.track_id""")  # fmt: skip
def q_vehicle_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, s = tables(spark, sf_dir)
    s = durable(sinks.printed_samples(s), "samples")
    count = S.sample_count(s)
    path = fresh_path(spark, "vehicles-csv")
    rows = sinks.vehicle_rows(v, S.gathered(s), False, count)
    sinks.write_csv(rows, path, ["track_id"])
    back = files.delimited(spark, path, rows.columns)
    cells = F.array_join(F.array(*[name for _, name in sinks.vehicle_columns(False, count)]), ",", "")
    return back.select(F.col("video_id").cast("long").alias("video_id"), "track_id", *STATIC, cells.alias("cells"))


@query(ANALYTICS_SQL + """ SELECT '{"video_id":' || video_id || ',"label":"' || class_name || '","n":' || count(*) || '}' AS value FROM fv GROUP BY video_id, class_name""")
def q_json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = A.mix(tables(spark, sf_dir, headway=False)[0], "class_name").where("label <> 'TOTAL'").select("video_id", "label", "n")
    path = fresh_path(spark, "mix-json")
    sinks.as_json(counts).write.text(path)
    return spark.read.text(path)


@query(ANALYTICS_SQL + " SELECT video_id, class_name AS label, count(*) AS n FROM fv GROUP BY video_id, class_name")
def q_fewest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.fewest_first(A.mix(tables(spark, sf_dir, headway=False)[0], "class_name")).select("video_id", "label", "n")


#: Frames of an annotation document.
DOCUMENT = 1000


@query(BOXES_SQL + f""" SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id // {DOCUMENT} ORDER BY image_id) - 1 AS INTEGER) AS line_no, category_id, 'f' || image_id || '.jpg' AS file_name, 1920 AS width,
       {r('lx')} AS bx, {r('ty')} AS "by", {r('bw')} AS bw, {r('bh')} AS bh FROM b""")  # fmt: skip
def q_coco_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotation documents of a thousand frames each, written as JSON and read as COCO files."""
    b = boxes(spark, sf_dir)
    image = F.struct(F.col("image_id").alias("id"), F.concat(F.lit("f"), F.col("image_id").cast("string"), F.lit(".jpg")).alias("file_name"), "width", "height")
    box = F.struct(F.col("image_id").alias("id"), "image_id", "category_id", F.array("bx", "by", "bw", "bh").alias("bbox"))
    docs = b.groupBy(F.floor(F.col("image_id") / DOCUMENT).alias("doc")).agg(F.array_sort(F.collect_list(image)).alias("images"), F.array_sort(F.collect_list(box)).alias("annotations"))
    path = fresh_path(spark, "coco")
    docs.select("doc", F.to_json(F.struct("images", "annotations")).alias("value")).repartition("doc").write.partitionBy("doc").text(path)
    images, back = files.coco(spark, path + "/*")
    out = back.join(images.select("image_id", "file_name", "width"), "image_id")
    return rounded_columns(out.select("image_id", "line_no", "category_id", "file_name", "width", "bx", "by", "bw", "bh"), "bx", "by", "bw", "bh")


#: Class names of the other annotation format, by category.
VOC_NAMES = [k for k, v in AN.NAMED.items()]
VOC_SQL = "CASE category_id % " + str(len(VOC_NAMES)) + " " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(VOC_NAMES)) + " END"
VOC_CLASS = "CASE name " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in AN.NAMED.items() if v is not None) + " END"
IMAGE = 16


@query(BOXES_SQL + f""", v AS (
    SELECT CAST(image_id // {IMAGE} AS VARCHAR) AS image_id, CAST(image_id % {IMAGE} AS INTEGER) AS place, {VOC_SQL} AS name, lx, ty, bw, bh FROM b
), n AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY image_id ORDER BY place) - 1 AS INTEGER) AS line_no, {VOC_CLASS} AS class_id, greatest(0.0, least(1.0, (lx + ((lx + bw) - lx) / 2) / 1920)) AS ncx, greatest(0.0, least(1.0, ((lx + bw) - lx) / 1920)) AS nw,
           greatest(0.0, least(1.0, ((ty + bh) - ty) / 560)) AS nh FROM v
)
SELECT image_id, line_no, name, class_id, {r('ncx', 4)} AS ncx, {r('nw', 4)} AS nw FROM n WHERE class_id IS NOT NULL AND bw > 0 AND nw >= 0.001 AND nh >= 0.001""")  # fmt: skip
def q_voc_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One XML file for each image, named after it, read as VOC files."""
    b = boxes(spark, sf_dir)
    names = F.array(*[F.lit(n) for n in VOC_NAMES])
    tag = lambda name, value: F.concat(F.lit(f"<{name}>"), value.cast("string"), F.lit(f"</{name}>"))
    corners = F.concat(tag("xmin", F.col("bx")), tag("ymin", F.col("by")), tag("xmax", F.col("bx") + F.col("bw")), tag("ymax", F.col("by") + F.col("bh")))
    name = F.element_at(names, F.col("category_id") % len(VOC_NAMES) + 1)
    thing = F.concat(F.lit("<object>"), tag("name", F.concat(F.lit(" "), F.upper(name))), F.lit("<bndbox>"), corners, F.lit("</bndbox></object>"))
    things = b.groupBy(F.floor(F.col("image_id") / IMAGE).alias("image")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("image_id"), thing.alias("xml")))), lambda x: x["xml"]), "").alias("xml"))
    text = F.concat(F.lit("<annotation><size><width>1920</width><height>560</height></size>"), F.col("xml"), F.lit("</annotation>"))
    path = fresh_path(spark, "voc")
    sinks.write_labels(things.select(F.col("image").alias("image_id"), text.alias("content")), path)
    images, back = files.voc(spark, path, "txt")
    kept, _ = AN.kept_and_skipped(back.join(images, "image_id"), "name", AN.NAMED)
    return rounded_columns(AN.from_corners(kept).select("image_id", "line_no", "name", "class_id", "ncx", "nw"), "ncx", "nw", digits=4)


@query(BOXES_SQL + f""" SELECT CAST(image_id // {IMAGE} AS VARCHAR) AS image_id, CAST(row_number() OVER (PARTITION BY image_id // {IMAGE} ORDER BY image_id) - 1 AS INTEGER) AS line_no, CAST(class_id AS INTEGER) AS class_id,
       CAST(printf('%.6f', ncx) AS DOUBLE) AS cx, CAST(printf('%.6f', nw) AS DOUBLE) AS w FROM k""")  # fmt: skip
def q_label_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One label file for each image, read back line by line."""
    b = boxes(spark, sf_dir)
    kept, _ = AN.kept_and_skipped(b, "category_id", AN.NUMBERED)
    several = AN.from_sides(kept).withColumns({"line_no": F.col("image_id") % IMAGE, "image_id": F.floor(F.col("image_id") / IMAGE)})
    path = fresh_path(spark, "labels")
    sinks.write_labels(AN.label_files(b.select(F.floor(F.col("image_id") / IMAGE).alias("image_id")).distinct(), several), path)
    return files.yolo_labels(spark, path, "txt").select("image_id", "line_no", "class_id", "cx", "w")


@query("SELECT trim(c_name) AS entry FROM customer WHERE c_custkey % 7 <> 0")
def q_split_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list with blanks about its entries and blank lines between them."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    line = F.when(F.col("c_custkey") % 14 == 0, "").when(F.col("c_custkey") % 7 == 0, "   ").otherwise(F.concat(F.lit("  "), "c_name", F.lit(" ")))
    path = fresh_path(spark, "list")
    c.select(line.alias("value")).write.text(path)
    return files.split_list(spark, path)


@query("WITH " + O.SQL + """ SELECT frame_id, x1, confidence, class_id FROM obs WHERE frame_id % 11 <> 0 AND frame_id % 13 <> 0 AND frame_id % 17 <> 0""")
def q_guarded_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections as arrays of strings: some too short, some with words or nothing for numbers, some with more than is needed."""
    o = observations(spark, sf_dir)
    n = F.col("frame_id")
    text = lambda k: F.col(k).cast("string")
    six = F.array(text("x1"), text("y1"), text("x2"), text("y2"), F.when(n % 13 == 0, "much").when(n % 17 == 0, None).otherwise(text("confidence")), text("class_id"))
    raw = F.when(n % 11 == 0, F.slice(six, 1, 5)).when(n % 3 == 0, F.concat(six, F.array(F.lit("more")))).otherwise(six)
    return O.parsed_detections(o.select("frame_id", raw.alias("raw"))).select("frame_id", "x1", "confidence", "class_id")


@query("WITH " + O.SQL + f""", c AS (SELECT frame_id, x1 + (x2 - x1) / 2 AS box_cx, y1 + (y2 - y1) / 2 AS box_cy, (x2 - x1) * CASE WHEN frame_id % 9 = 0 THEN 0.0 ELSE 1.0 END AS box_w, y2 - y1 AS box_h FROM obs)
SELECT frame_id, {r('box_cx')} AS box_cx, {r('box_h')} AS box_h, {r('box_cx - greatest(box_w, 1.0) / 2')} AS x1, {r('box_cy + greatest(box_h, 1.0) / 2')} AS y2 FROM c""")  # fmt: skip
def q_box_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = observations(spark, sf_dir).select("frame_id", *E.box_to_centre())
    forms = forms.withColumn("box_w", F.col("box_w") * F.when(F.col("frame_id") % 9 == 0, F.lit(0.0)).otherwise(F.lit(1.0)))
    out = forms.select("frame_id", "box_cx", "box_h", *E.centre_to_box("box_cx", "box_cy", "box_w", "box_h"))
    return rounded_columns(out.select("frame_id", "box_cx", "box_h", "x1", "y2"), "box_cx", "box_h", "x1", "y2")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE 3 END AS points, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_custkey AS DOUBLE) END AS second_x FROM orders""")
def q_point_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as JSON text, a fifth of them broken."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    good = F.concat(F.lit("[[0, 1.5], ["), F.col("o_custkey").cast("string"), F.lit(", 2], [3, 4]]"))
    text = F.when(F.col("o_orderkey") % 10 == 0, "[[1, ").when(F.col("o_orderkey") % 5 == 0, None).otherwise(good)
    parsed = o.select("o_orderkey", E.point_list(text).alias("p"))
    return parsed.select("o_orderkey", F.size("p").alias("points"), F.get(F.get("p", 1), 0).alias("second_x"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity + 0.5 END AS middle, least(l_linenumber / 4.0::DOUBLE, 1.0) AS share FROM lineitem""")
def q_label_middles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    q = F.col("l_quantity").cast("double")
    label = F.when(F.col("l_linenumber") == 3, q.cast("string")).otherwise(F.concat(q.cast("string"), F.lit("-"), (q + 1).cast("string")))
    labelled = rows.select("l_orderkey", "l_linenumber", label.alias("label"), F.lit(4).alias("total"))
    return labelled.select("l_orderkey", "l_linenumber", E.label_middle("label").alias("middle"), E.share_done("l_linenumber", "total").alias("share"))


@query("WITH " + O.SQL + " SELECT video_id, frame_id AS frame_index, CAST(k AS BIGINT) AS sampled_index FROM (SELECT video_id, frame_id, row_number() OVER (PARTITION BY video_id ORDER BY frame_id) - 1 AS k FROM obs WHERE frame_id % 5 = 0) WHERE k < 20")
def q_frame_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = observations(spark, sf_dir).select("video_id", F.col("frame_id").alias("frame_index"))
    return O.every_nth(index, 5, 30.0, most=20).select("video_id", "frame_index", "sampled_index")


@query("SELECT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer UNION SELECT s_suppkey FROM supplier")
def q_key_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda t, c: spark.read.parquet(f"{sf_dir}/{t}.parquet").select(F.col(c).alias("k"))
    return S.key_union([read("orders", "o_custkey"), read("customer", "c_custkey"), read("supplier", "s_suppkey")], "k")


@query(f"SELECT l_returnflag, {r('sum(l_extendedprice)')} AS total, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def q_prefixed_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The measure is found by the beginning of its name."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    name = files.column_starting(rows.columns, "l_ext")
    cents = F.sum(F.floor(F.col(name) * 100 + 0.5).cast("long"))
    return rows.groupBy("l_returnflag").agg((cents / F.lit(100.0)).alias("total"), F.count("*").alias("n"))


@query("SELECT p_partkey, 'idd_' || replace(p_name, ' ', '_') AS name, lower(trim(p_name)) AS lowered, lpad(CAST(p_partkey AS VARCHAR), 6, '0') AS padded, p_name AS stem FROM part")
def q_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet").withColumn("path", F.concat(F.lit("/images/train/"), F.replace("p_name", F.lit(" "), F.lit("%20")), F.lit(".jpg")))
    entry = F.replace(F.col("p_name"), F.lit(" "), F.lit("/"))
    return p.select("p_partkey", AN.safe_name("idd", entry).alias("name"), F.lower(F.trim("p_name")).alias("lowered"), F.lpad(F.col("p_partkey").cast("string"), 6, "0").alias("padded"), files.stem("path").alias("stem"))


@query(QUAD_SQL + f""", p AS (
    SELECT q.video_id, ax, ay, dx, dy, i.* EXCLUDE (video_id) FROM q JOIN i ON i.video_id = q.video_id
), z AS (
    SELECT video_id, (i0 * (ax + 30) + i1 * (ay + 20) + i2) / (i6 * (ax + 30) + i7 * (ay + 20) + i8) AS ux, (i3 * (ax + 30) + i4 * (ay + 20) + i5) / (i6 * (ax + 30) + i7 * (ay + 20) + i8) AS uy,
           (i0 * (dx + 90) + i1 * (dy - 10) + i2) / (i6 * (dx + 90) + i7 * (dy - 10) + i8) AS vx, (i3 * (dx + 90) + i4 * (dy - 10) + i5) / (i6 * (dx + 90) + i7 * (dy - 10) + i8) AS vy FROM p
)
SELECT video_id, {r('sqrt((ux - vx) * (ux - vx) + (uy - vy) * (uy - vy)) * 1000 / 25', 4)} AS ppm FROM z""")  # fmt: skip
def q_rectified_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two points near the left side of each region, 25 metres apart on the road."""
    q = quads(spark, sf_dir)
    corner = lambda k, dx, dy: F.array(F.col("points")[k][0] + dx, F.col("points")[k][1] + dy)
    regions = q.withColumns({"calibration": F.array(corner(1, 30, 20), corner(2, 90, -10)), "metres": F.lit(25.0)})
    return rounded_columns(K.rectified_scale(regions), "ppm", digits=4)
