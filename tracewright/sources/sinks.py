"""Writers: per-frame and per-vehicle CSV, JSON documents, YOLO labels, and a workbook of three sheets."""

from __future__ import annotations

import contextlib
import json
import math
import re
import zipfile
from collections.abc import Iterable, Iterator, Sequence
from pathlib import Path
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr as E
from ..operators.kinematics import TRACK, frame_kinematics
from ..operators.reshape import WIDE
from .label_files import LabelFiles

#: Rows that a sheet may hold; a workbook is a report, not a store.
SHEET_ROWS = 1_048_576


def frame_rows(obs: DataFrame, ppm: float | None = None) -> DataFrame:
    """The per-frame table with its presentation formats."""
    k = frame_kinematics(obs)
    two = lambda c: E.formatted(c, 2)
    cols = [
        "frame_id", E.formatted("t", 4).alias("timestamp"), "track_id", "class_id", E.class_name("class_id").alias("class_name"), E.formatted("confidence", 4).alias("confidence"),
        *[E.formatted(c, 1).alias(c) for c in ("x1", "y1", "x2", "y2", "cx", "cy")], two("speed").alias("speed_px_per_sec"), two("cumulative_distance").alias("cumulative_distance_px"),
    ]
    if ppm:
        metres = F.col("speed") / ppm
        cols += [two(metres).alias("speed_m_per_sec"), two(metres * 3.6).alias("speed_kmph"), two(F.col("cumulative_distance") / ppm).alias("cumulative_distance_m")]
    return k.select("video_id", *cols)


def write_csv(df: DataFrame, path: str, order: Sequence[str] = (), by: str | None = "video_id") -> None:
    """CSV with a header, one folder a video, rows in order within each file."""
    w = df.repartition(by).sortWithinPartitions(by, *order) if by else df
    out = w.write.option("header", "true").option("emptyValue", "").mode("overwrite")
    (out.partitionBy(by) if by else out).csv(path)


def vehicle_columns(calibrated: bool, samples: int) -> list[tuple[str, str]]:
    """(measure of the wide table, header with unit) of the dynamic columns."""
    d, u, a = ("m", "m_per_s", "m_per_s2") if calibrated else ("px", "px_per_s", "px_per_s2")
    names = {
        "x": f"x_{d}", "y": f"y_{d}", "heading": "trajectory_deg", "speed": f"inst_speed_{u}", "moved": f"distance_travelled_{d}", "accel_linear": f"accel_linear_{a}",
        "accel_lateral": f"accel_lateral_{a}", "dist_headway": f"dist_headway_{d}", "time_headway": "time_headway_s",
    }
    return [(f"t{i}_{k}", f"t{i}_{v}") for i in range(samples) for k, v in names.items()]


def printed_samples(samples: DataFrame) -> DataFrame:
    """The sample table with its measures as they stand in a wide row, null where there is nothing.

    Printing takes many steps. It is stated once for each measure here, not once for each column of the wide table.
    """
    return samples.select(*TRACK, "sample_idx", *[F.when(F.col(k).isNotNull(), E.formatted(k, 2)).alias(k) for k in WIDE])


def vehicle_rows(vehicles: DataFrame, wide: DataFrame, calibrated: bool, samples: int) -> DataFrame:
    """One row a vehicle: ten static columns and nine for each sample, blanks where a track has ended.

    wide is the widened table of numbers, or the gathered table of printed samples, whose texts are only put in their columns.
    """
    d, u = ("m", "m_per_s") if calibrated else ("px", "px_per_s")
    static = vehicles.select(
        "video_id", "track_id", E.formatted("first_t", 2).alias("timestamp_first_seen"), F.col("first_frame").alias("frame_id_first_seen"), "class_id", "class_name",
        E.formatted("avg_confidence", 2).alias("confidence"), E.formatted("avg_speed", 2).alias(f"avg_speed_{u}"), "direction", F.col("behaviour").alias("behavior_class"),
        E.formatted("total_distance", 2).alias(f"total_distance_{d}"),
    )
    columns = vehicle_columns(calibrated, samples)
    if "cells" not in wide.columns:
        numbers = F.array(*[F.col(k) for k, _ in columns]).cast("array<double>")
        wide = wide.select(*TRACK, F.transform(numbers, lambda x: F.when(x.isNotNull(), E.formatted(x, 2))).alias("cells"))
    rows = static.join(wide.select(*TRACK, "cells"), list(TRACK), "left")
    return rows.selectExpr(*static.columns, *[f"get(cells, {i}) AS `{name}`" for i, (_, name) in enumerate(columns)])


def as_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("value"))


def write_labels(files: DataFrame, path: str, overwrite: bool = True) -> None:
    """Label text of each image as one file named after it, {image_id}.txt, empty ones too; path is a folder that all machines see."""
    files.sparkSession.dataSource.register(LabelFiles)
    named = files.select(F.translate(F.col("image_id").cast("string"), "/\\", "__").alias("image_id"), F.coalesce("content", F.lit("")).alias("content"))
    named.write.format(LabelFiles.name()).mode("overwrite" if overwrite else "append").save(path)


def data_yaml(path: str, root: str) -> None:
    lines = [f"path: {root}", "train: images/train", "val: images/val", f"nc: {len(E.CLASS_NAMES)}", "names:", *[f"  {k}: {v}" for k, v in E.CLASS_NAMES.items()]]
    Path(path).write_text("\n".join(lines) + "\n")


def metadata_rows(values: dict) -> list[tuple[str, str]]:
    return [(str(k), str(v)) for k, v in values.items()]


def metadata_json(path: str, values: dict) -> None:
    Path(path).write_text(json.dumps(values, indent=2, default=str))


def column_letters(n: int) -> str:
    out = ""
    while n >= 0:
        out, n = chr(65 + n % 26) + out, n // 26 - 1
    return out


#: Rows of a sheet that one text holds on its way to the workbook.
SHEET_PACK = 500
SHEET_OPEN = '<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>'
SHEET_CLOSE = "</sheetData></worksheet>"
#: What XML 1.0 cannot hold.
NOT_XML = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]")


def row_xml(row: Sequence, number: int | None = None) -> str:
    """A sheet's row; without a number it stands below the one before, and its cells stand one beside the other."""
    cells = []
    for c, v in enumerate(row):
        ref = f' r="{column_letters(c)}{number}"' if number else ""
        if isinstance(v, float) and not math.isfinite(v):
            v = str(v)
        if v is None:
            cells.append("" if number else "<c/>")
        elif isinstance(v, bool) or not isinstance(v, int | float):
            cells.append(f'<c{ref} t="inlineStr"><is><t xml:space="preserve">{escape(NOT_XML.sub("", str(v)))}</t></is></c>')
        else:
            cells.append(f"<c{ref}><v>{v!r}</v></c>")
    return f'<row{f" r={chr(34)}{number}{chr(34)}" if number else ""}>{"".join(cells)}</row>'


def sheet_parts(df: DataFrame) -> DataFrame:
    """The frame's rows as pieces of a sheet (n rows, xml), made where the rows are, in their order."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), SHEET_PACK):
                part = batch.slice(start, SHEET_PACK)
                rows = zip(*(c.to_pylist() for c in part.columns), strict=True)
                yield pa.RecordBatch.from_pydict({"n": [len(part)], "xml": ["".join(map(row_xml, rows))]})

    # Nested values and the like are written as text; numbers stay numbers.
    plain = [F.col(f"`{c}`") if t in ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean", "string") else F.col(f"`{c}`").cast("string").alias(c) for c, t in df.dtypes]
    return df.select(*plain).mapInArrow(packed, "n long, xml string")


def sheet_xml(held: DataFrame | Iterable[Sequence], name: str) -> Iterator[str]:
    """A sheet's text piece by piece; of a frame no more than one partition's pieces are with the driver."""
    yield SHEET_OPEN
    if isinstance(held, DataFrame):
        yield row_xml(held.columns, 1)
        count = 1
        for part in sheet_parts(held).toLocalIterator():
            count += part.n
            if count > SHEET_ROWS:
                raise ValueError(f"{name} has more rows than a sheet can hold")
            yield part.xml
    else:
        for r, row in enumerate(held, 1):
            yield row_xml(row, r)
    yield SHEET_CLOSE


def write_workbook(path: str, sheets: dict[str, DataFrame | list[Sequence]]) -> None:
    """A workbook of frames and lists of rows: executors write the sheets' pieces, the driver passes them on into the archive.

    The driver holds one partition's pieces at a time, whatever the number of rows. A sheet beyond the format's
    limit is refused, and no workbook is left.
    """
    with contextlib.ExitStack() as undo:
        undo.callback(lambda: Path(path).unlink(missing_ok=True))
        _write_workbook(path, sheets)
        undo.pop_all()


def _write_workbook(path: str, sheets: dict[str, DataFrame | list[Sequence]]) -> None:
    kind = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        names = list(sheets)
        for i, name in enumerate(names, 1):
            with z.open(f"xl/worksheets/sheet{i}.xml", "w", force_zip64=True) as sheet:
                for piece in sheet_xml(sheets[name], name):
                    sheet.write(piece.encode("utf-8", "replace"))
        own = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(names) + 1))
        z.writestr("[Content_Types].xml", f'<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{own}</Types>')
        z.writestr("_rels/.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{kind}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        tabs = "".join(f'<sheet name={quoteattr(n)} sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1))
        z.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="{kind}"><sheets>{tabs}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{i}" Type="{kind}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
