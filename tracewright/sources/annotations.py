"""Readers of annotation files: COCO JSON, Pascal VOC XML, YOLO label text, split lists, image folders, CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import StringType, StructField, StructType

from ..storage import durable
from .label_files import many_files

COCO = (
    "images array<struct<id:long,file_name:string,width:int,height:int>>, "
    "annotations array<struct<id:long,image_id:long,category_id:int,bbox:array<double>>>"
)
VOC = (
    "filename string, size struct<width:int,height:int>, "
    "object array<struct<name:string,bndbox:struct<xmin:double,ymin:double,xmax:double,ymax:double>>>"
)
IMAGE_ENDINGS = ("jpg", "jpeg", "png", "bmp")


def coco(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(images, boxes) of COCO files."""
    raw = spark.read.schema(COCO).json(path, multiLine=True)
    images = raw.select(F.explode("images").alias("i")).select(F.col("i.id").alias("image_id"), "i.file_name", "i.width", "i.height")
    boxes = raw.select(F.posexplode("annotations").alias("line_no", "a")).select("a.image_id", "line_no", "a.category_id", *[F.get("a.bbox", i).alias(k) for i, k in enumerate(("bx", "by", "bw", "bh"))])
    return images, boxes


def voc(spark: SparkSession, path: str, ending: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(images, boxes) of VOC files; an image is named by its file's stem. path is a pattern, or a folder where an ending is told.

    Every image is a file: they are opened once, many to a task, for both tables. A large folder's are not listed by the driver.
    """
    many = many_files(spark, path, ending) if ending else None
    if many is None:
        reader = spark.read.format("xml").option("rowTag", "annotation").schema(VOC)
        raw = (reader.option("pathGlobFilter", f"*.{ending}") if ending else reader).load(path).select("*", F.col("_metadata.file_path").alias("file"))
    else:
        # As the reader has it: a row for each annotation element, and one without values for what is no XML.
        text = F.col("content").cast("string")
        found = F.regexp_extract_all(text, F.lit(r"(?s)<annotation[\s>].*?</annotation>"), F.lit(0))
        docs = many.select("file", F.explode(F.when(F.size(found) > 0, found).otherwise(F.array(text))).alias("text")).where(F.col("text").rlike(r"\S"))
        docs = docs.withColumn("a", F.from_xml("text", VOC + ", _corrupt_record string", {"rowTag": "annotation"}))
        raw = docs.where(F.col("text").contains("<annotation") | F.col("a._corrupt_record").isNotNull()).select("a.*", "file").drop("_corrupt_record")
    raw = durable(raw.withColumn("image_id", stem("file")), "voc", small_files=True)
    images = raw.select("image_id", F.col("size.width").alias("width"), F.col("size.height").alias("height"))
    boxes = raw.select("image_id", F.posexplode("object").alias("line_no", "o")).select("image_id", "line_no", F.lower(F.trim("o.name")).alias("name"), "o.bndbox.*")
    return images, boxes


def stem(path: str) -> F.Column:
    return F.regexp_extract(F.url_decode(F.replace(F.col(path), F.lit("+"), F.lit("%2B"))), r"([^/\\]+?)(\.[^./\\]*)?$", 1)


def yolo_labels(spark: SparkSession, path: str, ending: str | None = None) -> DataFrame:
    """(image_id, line_no, class_id, cx, cy, w, h) of label files; lines whose first token is no integer are left out.

    path is a pattern, or a folder where an ending is told: a folder is listed as one, a pattern's files each by itself.
    A large folder's files are not listed by the driver.
    """
    many = many_files(spark, path, ending) if ending else None
    if many is None:
        reader = spark.read.option("pathGlobFilter", f"*.{ending}") if ending else spark.read
        lines = reader.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))
    else:
        lines = many.select("file", F.posexplode(F.split(F.col("content").cast("string"), "\r\n|\r|\n")).alias("at", "value"))
    lines = durable(lines.select(F.trim("value").alias("line"), "file", "at").where("line <> ''"), "label-lines", small_files=True)
    parts = F.split("line", r"\s+")
    out = lines.select(stem("file").alias("image_id"), "at", F.get(parts, 0).try_cast("int").alias("class_id"), *[F.get(parts, i + 1).try_cast("double").alias(k) for i, k in enumerate(("cx", "cy", "w", "h"))])
    return out.where("class_id is not null").withColumn("line_no", F.row_number().over(W.partitionBy("image_id").orderBy("at")) - 1).drop("at")


def split_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("entry")).where("entry <> ''")


def image_files(spark: SparkSession, path: str) -> DataFrame:
    """One file for each stem, the first of the known endings; only the listing is read, never the pixels."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    ending = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    rank = F.array_position(F.array(*[F.lit(e) for e in IMAGE_ENDINGS]), ending)
    return files.select(stem("path").alias("image_id"), "path", rank.alias("rank")).where("rank > 0").groupBy("image_id").agg(F.min_by("path", F.struct("rank", "path")).alias("path"))


def delimited(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A CSV file with a header, every column a string; parse with functions.expr.parsed.

    Where the columns are told, no pass over the files finds them, and a file with another header is refused.
    """
    if columns is None:
        return spark.read.csv(path, header=True)
    return spark.read.schema(StructType([StructField(c, StringType()) for c in columns])).csv(path, header=True, enforceSchema=False)


def distinct_ids(rows: DataFrame, column: str = "track_id") -> DataFrame:
    return rows.where(F.col(column).isNotNull() & (F.col(column) != "")).agg(F.countDistinct(column).alias("n"))


def column_starting(columns: list[str], prefix: str) -> str | None:
    """The first column whose name begins so; units in the names differ between files."""
    return next((c for c in columns if c.startswith(prefix)), None)
