"""Annotation queries: the driver's tables stand for annotation files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr as E
from ..operators import annotations as AN
from ..operators import reshape as S
from ..sources import observations as O
from .trajectory import query, r, rounded_columns

#: An observation's box as a COCO annotation of a 1920 x 560 image; categories 1 to 15, of which some are unknown.
BOXES_SQL = "WITH " + O.SQL + """, b AS (
    SELECT frame_id AS image_id, CAST(frame_id % 15 + 1 AS INTEGER) AS category_id, CASE WHEN frame_id % 5 = 0 THEN 'val' ELSE 'train' END AS split, x1 AS lx, y1 AS ty, (x2 - x1) * (CASE WHEN frame_id % 97 = 0 THEN 0.0 ELSE 1.0 END) AS bw, y2 - y1 AS bh FROM obs
), m AS (
    SELECT *, CASE category_id """ + " ".join(f"WHEN {k} THEN {v}" for k, v in AN.NUMBERED.items() if v is not None) + """ END AS class_id,
           greatest(0.0, least(1.0, (lx + bw / 2) / 1920)) AS ncx, greatest(0.0, least(1.0, (ty + bh / 2) / 560)) AS ncy, greatest(0.0, least(1.0, bw / 1920)) AS nw, greatest(0.0, least(1.0, bh / 560)) AS nh FROM b
), k AS (SELECT * FROM m WHERE class_id IS NOT NULL AND nw >= 0.001 AND nh >= 0.001)"""  # fmt: skip


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = O.from_events(spark, sf_dir)
    n = F.col("frame_id")
    width = (F.col("x2") - F.col("x1")) * F.when(n % 97 == 0, F.lit(0.0)).otherwise(F.lit(1.0))
    return o.select(
        n.alias("image_id"), (n % 15 + 1).cast("int").alias("category_id"), F.when(n % 5 == 0, F.lit("val")).otherwise(F.lit("train")).alias("split"), F.lit(0).alias("line_no"),
        F.col("x1").alias("bx"), F.col("y1").alias("by"), width.alias("bw"), (F.col("y2") - F.col("y1")).alias("bh"), F.lit(1920).alias("width"), F.lit(560).alias("height"),
    )


@query(BOXES_SQL + f"SELECT image_id, class_id, {r('ncx', 4)} AS ncx, {r('ncy', 4)} AS ncy, {r('nw', 4)} AS nw, {r('nh', 4)} AS nh FROM k")
def q_yolo_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, _ = AN.kept_and_skipped(boxes(spark, sf_dir), "category_id", AN.NUMBERED)
    return rounded_columns(AN.from_sides(kept).select("image_id", "class_id", "ncx", "ncy", "nw", "nh"), "ncx", "ncy", "nw", "nh", digits=4)


@query(BOXES_SQL + "SELECT coalesce(split, 'TOTAL') AS split, coalesce(class_id, -1) AS class_id, n FROM (SELECT split, class_id, count(*) AS n FROM k GROUP BY ROLLUP (split, class_id)) x")
def q_label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, _ = AN.kept_and_skipped(boxes(spark, sf_dir), "category_id", AN.NUMBERED)
    return AN.counts(AN.from_sides(kept))


@query(BOXES_SQL + "SELECT category_id, count(*) AS skipped FROM m WHERE class_id IS NULL GROUP BY ALL")
def q_skipped_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return AN.kept_and_skipped(boxes(spark, sf_dir), "category_id", AN.NUMBERED)[1]


@query(BOXES_SQL + """, lines AS (SELECT image_id // 4 AS image_id, string_agg(printf('%d %.6f %.6f %.6f %.6f', class_id, ncx, ncy, nw, nh), chr(10) ORDER BY image_id % 4) AS content FROM k GROUP BY image_id // 4)
SELECT i.image_id, coalesce(content, '') AS content FROM (SELECT DISTINCT frame_id // 4 AS image_id FROM obs) i LEFT JOIN lines l ON l.image_id = i.image_id""")  # fmt: skip
def q_label_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four boxes make an image here."""
    b = boxes(spark, sf_dir)
    kept, _ = AN.kept_and_skipped(b, "category_id", AN.NUMBERED)
    four = AN.from_sides(kept).withColumns({"line_no": F.col("image_id") % 4, "image_id": F.floor(F.col("image_id") / 4)})
    return AN.label_files(b.select(F.floor(F.col("image_id") / 4).alias("image_id")).distinct(), four)


@query("""WITH a AS (SELECT o_custkey FROM orders WHERE o_totalprice > 400000), i AS (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')
SELECT c_custkey AS image_id, 'annotation' AS lacks FROM customer WHERE c_custkey NOT IN (FROM a) UNION ALL SELECT c_custkey, 'image' FROM customer WHERE c_custkey NOT IN (FROM i)
UNION ALL SELECT c_custkey, 'nothing' FROM customer WHERE c_custkey IN (FROM a) AND c_custkey IN (FROM i)""")
def q_missing_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("image_id"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    annotated = orders.where("o_totalprice > 400000").select(F.col("o_custkey").alias("image_id"))
    images = orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("image_id"))
    found, lacking = AN.listed_with_files(entries, annotated, images)
    return lacking.unionByName(found.withColumn("lacks", F.lit("nothing")))


#: Two datasets with clashing names: customers with orders as labels, parts with line items as labels (and some of other names).
LISTINGS_SQL = """images AS (
    SELECT 0 AS source_no, CASE WHEN c_custkey % 5 = 0 THEN 'val' ELSE 'train' END AS split, 'img' || c_custkey || '.jpg' AS name, '/a/' || c_custkey AS path FROM customer
    UNION ALL SELECT 1, CASE WHEN p_partkey % 5 = 0 THEN 'val' ELSE 'train' END, 'img' || p_partkey || CASE WHEN p_partkey % 7 = 0 THEN '.png' ELSE '.jpg' END, '/b/' || p_partkey FROM part
), labels AS (
    SELECT DISTINCT 0 AS source_no, CASE WHEN o_custkey % 5 = 0 THEN 'val' ELSE 'train' END AS split, 'img' || o_custkey || '.txt' AS name, '/la/' || o_custkey AS path FROM orders WHERE o_totalprice > 300000
    UNION ALL SELECT DISTINCT 1, CASE WHEN l_partkey % 5 = 0 THEN 'val' ELSE 'train' END, 'img' || l_partkey || CASE WHEN l_partkey % 11 = 0 THEN '.json' ELSE '.txt' END, '/lb/' || l_partkey FROM lineitem WHERE l_quantity > 45
)"""


def listings(spark: SparkSession, sf_dir: str) -> tuple[list[DataFrame], list[DataFrame]]:
    def listing(table: str, key: str, path: str, ending: F.Column, where: str = "true") -> DataFrame:
        k = F.col(key)
        rows = spark.read.parquet(f"{sf_dir}/{table}.parquet").where(where).select(key).distinct()
        return rows.select(F.when(k % 5 == 0, "val").otherwise("train").alias("split"), F.concat(F.lit("img"), k.cast("string"), ending).alias("name"), F.concat(F.lit(path), k.cast("string")).alias("path"))

    ending = lambda key, n, odd, usual: F.when(F.col(key) % n == 0, odd).otherwise(usual)
    images = [listing("customer", "c_custkey", "/a/", F.lit(".jpg")), listing("part", "p_partkey", "/b/", ending("p_partkey", 7, ".png", ".jpg"))]
    labels = [listing("orders", "o_custkey", "/la/", F.lit(".txt"), "o_totalprice > 300000"), listing("lineitem", "l_partkey", "/lb/", ending("l_partkey", 11, ".json", ".txt"), "l_quantity > 45")]
    return images, labels


@query("WITH " + LISTINGS_SQL + """, met AS (SELECT * FROM labels l WHERE name LIKE '%.txt' AND EXISTS (FROM images i WHERE i.source_no = l.source_no AND i.split = l.split AND i.name[:-5] = l.name[:-5]))
SELECT split, 'image' AS kind, name, arg_min(path, source_no) AS path, CAST(min(source_no) AS INTEGER) AS source_no FROM images GROUP BY split, name
UNION ALL SELECT split, 'label', name, arg_min(path, source_no), CAST(min(source_no) AS INTEGER) FROM met GROUP BY split, name""")  # fmt: skip
def q_merged_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return AN.merged_listing(*listings(spark, sf_dir))[0]


@query("WITH " + LISTINGS_SQL + " SELECT CAST(source_no AS INTEGER) AS source_no, split, count(*) AS linked FROM images GROUP BY ALL")
def q_merged_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return AN.merged_listing(*listings(spark, sf_dir))[1]


@query("WITH " + O.SQL + " SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), -1) AS k, coalesce(TRY_CAST(event_type AS BIGINT), -1) AS kind FROM events")
def q_safe_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", E.parsed(F.get_json_object("props", "$.k"), "bigint", -1).alias("k"), E.parsed("event_type", "bigint", -1).alias("kind"))


@query("""WITH log AS (SELECT CAST(l_linenumber AS BIGINT) AS epoch, CAST(l_orderkey AS BIGINT) AS line_no, l_quantity AS time FROM lineitem), last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY epoch ORDER BY line_no DESC, time DESC) AS k FROM (SELECT epoch, line_no, max(time) AS time FROM log GROUP BY ALL)) x WHERE k = 1)
SELECT count(*) AS epochs, max(epoch) AS last_epoch, max(time) AS elapsed, """ + r("max(time) / max(epoch)") + " AS seconds_per_epoch, " + r("max(time) / max(epoch) * (50 - max(epoch))") + " AS seconds_left FROM last")  # fmt: skip
def q_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_linenumber").cast("long").alias("epoch"), F.col("l_orderkey").alias("line_no")).agg(F.max("l_quantity").alias("time"))
    return S.progress(log, 50)


@query("SELECT range AS frame_index, range // 7 AS sampled_index, floor(range / 30.0 * 10000 + 0.5) / 10000 AS timestamp_sec FROM range(0, 5000, 7)")
def q_frame_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.frames(5000, 7, 30.0, spark)


@query("WITH " + O.SQL + " SELECT video_id, frame_id AS frame_index, CAST(row_number() OVER (PARTITION BY video_id ORDER BY frame_id) - 1 AS BIGINT) AS sampled_index, floor(frame_id / 30.0 * 10000 + 0.5) / 10000 AS timestamp_sec FROM obs WHERE frame_id % 7 = 0")
def q_every_nth_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.every_nth(O.from_events(spark, sf_dir).select("video_id", F.col("frame_id").alias("frame_index")), 7, 30.0)


#: The table of videos as the observations tell it: extent, frames, and frames in a unit of time.
VIDEOS_SQL = """, videos AS (
    SELECT video_id, 'video' || video_id || '.mp4' AS file, CAST(ceil(max(x2)) AS INTEGER) AS width, CAST(ceil(max(y2)) AS INTEGER) AS height,
           CASE WHEN max(t) > min(t) THEN (count(*) - 1) / (max(t) - min(t)) ELSE 0.0 END AS fps, count(*) AS total_frames FROM obs GROUP BY video_id
)"""


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, life = F.count("*"), F.max("t") - F.min("t")
    return O.from_events(spark, sf_dir).groupBy("video_id").agg(
        F.ceil(F.max("x2")).cast("int").alias("width"), F.ceil(F.max("y2")).cast("int").alias("height"), F.when(life > 0, (n - 1) / life).otherwise(F.lit(0.0)).alias("fps"), n.alias("total_frames")
    ).withColumn("file", F.concat(F.lit("video"), F.col("video_id").cast("string"), F.lit(".mp4")))


@query("WITH " + O.SQL + VIDEOS_SQL + f""" SELECT video_id, file, width, height, {r('fps', 4)} AS fps, total_frames, {r('CASE WHEN fps > 0 THEN total_frames / fps ELSE 0.0 END')} AS duration_sec,
       CAST(3 AS INTEGER) AS sample_interval, {r('fps / 3')} AS effective_fps, total_frames // 3 AS expected_sampled_frames FROM videos""")  # fmt: skip
def q_video_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_columns(O.video_info(videos(spark, sf_dir), 3), "fps", digits=4)
