"""Annotation datasets: classes mapped, boxes normalised, sources merged, counts and label files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as E

# The classes of two public datasets; what maps to nothing is skipped and counted.
NAMED = {
    "car": 0, "bus": 1, "truck": 2, "autorickshaw": 3, "motorcycle": 4, "bicycle": 6, "person": 7, "rider": 7,
    "vehicle fallback": 0, "animal": None, "traffic sign": None, "train": None,
}
NUMBERED = {1: 0, 2: 0, 3: 0, 4: 0, 5: 1, 6: 2, 7: 3, 8: 4, 9: 5, 10: 1, 11: 5, 12: 6, 13: 5, 14: None}
LEAST_SIDE = 0.001


def mapped(rows: DataFrame, column: str, table: dict) -> DataFrame:
    """rows with class_id, null where the table has nothing (a literal map: no join)."""
    known = [F.lit(v) for k, v in table.items() if v is not None for v in (k, v)]
    return rows.withColumn("class_id", F.try_element_at(F.create_map(*known), F.col(column)))


def kept_and_skipped(rows: DataFrame, column: str, table: dict) -> tuple[DataFrame, DataFrame]:
    """The rows with a class, and how many of each name went."""
    out = mapped(rows, column, table)
    return out.where("class_id is not null"), out.where("class_id is null").groupBy(column).agg(F.count("*").alias("skipped"))


def normalised(left: Column, top: Column, width: Column, height: Column, image_w: Column, image_h: Column) -> dict[str, Column]:
    """Centre and size as shares of the image, clamped to it."""
    return {
        "ncx": E.unit((left + width / 2) / image_w), "ncy": E.unit((top + height / 2) / image_h),
        "nw": E.unit(width / image_w), "nh": E.unit(height / image_h),
    }


def from_corners(boxes: DataFrame) -> DataFrame:
    """Boxes with xmin..ymax and the image's width and height, degenerate ones left out."""
    c = F.col
    ok = boxes.where("xmax > xmin and ymax > ymin")
    out = ok.withColumns(normalised(c("xmin"), c("ymin"), c("xmax") - c("xmin"), c("ymax") - c("ymin"), c("width"), c("height")))
    return out.where((c("nw") >= LEAST_SIDE) & (c("nh") >= LEAST_SIDE))


def from_sides(boxes: DataFrame) -> DataFrame:
    """Boxes with a top-left corner and sides (bx, by, bw, bh), degenerate ones left out."""
    c = F.col
    out = boxes.withColumns(normalised(c("bx"), c("by"), c("bw"), c("bh"), c("width"), c("height")))
    return out.where((c("nw") >= LEAST_SIDE) & (c("nh") >= LEAST_SIDE))


def label_line() -> Column:
    return F.format_string("%d %.6f %.6f %.6f %.6f", "class_id", "ncx", "ncy", "nw", "nh")


def label_files(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """(image_id, content) of every image, in line order; an image without boxes has an empty file."""
    lines = boxes.select("image_id", "line_no", label_line().alias("line")).groupBy("image_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda s: s["line"]), "\n").alias("content"))
    return images.select("image_id").join(lines, "image_id", "left").withColumn("content", F.coalesce("content", F.lit("")))


def listed_with_files(entries: DataFrame, annotated: DataFrame, images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries that have both annotation and image, what the others lack): semi- and anti-joins by image_id."""
    found = entries.join(annotated.select("image_id"), "image_id", "left_semi").join(images.select("image_id"), "image_id", "left_semi")
    lacks = lambda other, what: entries.join(other.select("image_id"), "image_id", "left_anti").withColumn("lacks", F.lit(what))
    return found, lacks(annotated, "annotation").unionByName(lacks(images, "image"))


def safe_name(prefix: str, entry: str | Column) -> Column:
    return F.concat(F.lit(f"{prefix}_"), F.translate(E.c(entry), "/\\", "__"))


def counts(boxes: DataFrame, by: str = "split") -> DataFrame:
    """Boxes of each class and split, with totals (split TOTAL, class -1)."""
    return boxes.rollup(by, "class_id").agg(F.count("*").alias("n")).select(F.coalesce(by, F.lit("TOTAL")).alias(by), F.coalesce("class_id", F.lit(-1)).alias("class_id"), "n")


def merged_listing(images: list[DataFrame], labels: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(files of a merged dataset, images linked by source and split) from the listings of several datasets.

    A listing has split, name (a file's name) and path; images and labels are given source by source. Where a
    name is in several sources the first one's file stays, for images and for labels separately: an image's
    label is that of the first source that has both an image of the stem in the split and a label file for it,
    which may be another source than the image's. Every image of a source counts as linked, taken or not.
    The files are (split, kind, name, path, source_no); an image without any label has no label row.
    """

    def listed(frames: list[DataFrame]) -> DataFrame:
        out = [f.select("split", "name", "path", F.lit(i).alias("source_no")) for i, f in enumerate(frames)]
        rows = out[0]
        for f in out[1:]:
            rows = rows.unionByName(f)
        return rows.withColumn("stem", F.regexp_replace("name", r"(?<=.)\.[^.]*$", ""))

    pictures, texts = listed(images), listed(labels).where(F.col("name").endswith(".txt"))
    # An image asks its own source for a label of its stem: an equi-join on source, split and stem.
    asked = pictures.select("split", "stem", "source_no").distinct()
    met = texts.join(asked, ["split", "stem", "source_no"], "left_semi")
    first = lambda rows, kind: rows.groupBy("split", "name").agg(F.min(F.struct("source_no", "path")).alias("first")).select("split", F.lit(kind).alias("kind"), "name", "first.path", "first.source_no")
    linked = pictures.groupBy("source_no", "split").agg(F.count("*").alias("linked"))
    return first(pictures, "image").unionByName(first(met, "label")), linked
