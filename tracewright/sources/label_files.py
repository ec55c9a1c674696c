"""Folders of very many small files: a data source that writes them, and the rows of those that are too many for a driver's listing.

The data source writes one text file for each row: {image_id}.txt with the row's content.

Spark's own writers name files after tasks; training tools look a label up by its image's name. A task writes
into folders of its own below the target; when all tasks are done the files are moved to their names, one folder
after another, so that the driver holds the names of one folder; when the job fails the folders are deleted, so that a reader never sees half a job. A task that runs twice
(a lost executor, speculation) has a folder for each time, and only the one that is committed counts.
"""

from __future__ import annotations

import math
import os
import re
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from fnmatch import fnmatchcase
from itertools import batched, islice
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pa_fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..storage import BATCH_LIMIT, durable

#: Files that the driver moves at a time.
MOVERS = 16
#: Files of a folder in the making: so many names the driver holds when it moves them.
FOLDER = 1000
#: Files that Spark's own readers are left with: their driver holds the place of each. Of more, a task reads up to FILES_A_TASK.
LISTED, FILES_A_TASK = 10_000, 2048


def opened(path: str) -> tuple[pa_fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return pa_fs.FileSystem.from_uri(path if re.match(r"[a-z][a-z0-9+.-]*:/", path) else os.path.abspath(path))


def file_names(fs: pa_fs.FileSystem, root: str) -> Iterator[str]:
    """The names of a folder's files, on a local file system one by one; other ones give their listing whole."""
    if isinstance(fs, pa_fs.LocalFileSystem):
        with os.scandir(root) as entries:
            yield from (e.name for e in entries if e.is_file())
    else:
        yield from (f.base_name for f in fs.get_file_info(pa_fs.FileSelector(root)) if f.type == pa_fs.FileType.File)


@dataclass
class Written(WriterCommitMessage):
    folder: str
    files: int


class LabelWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path.rstrip("/"), overwrite
        self.staging = f"_writing-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Written:
        fs, root = opened(self.path)
        folder, files = f"{self.staging}/{uuid.uuid4().hex}", 0
        for row in iterator:
            if files % FOLDER == 0:
                fs.create_dir(f"{root}/{folder}/{files // FOLDER}", recursive=True)
            name = str(row["image_id"])
            if not name or "/" in name or name.startswith("_"):
                raise ValueError(f"{name!r} cannot name a label file")
            with fs.open_output_stream(f"{root}/{folder}/{files // FOLDER}/{name}.txt") as out:
                out.write((row["content"] or "").encode())
            files += 1
        return Written(folder, files)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = opened(self.path)
        fs.create_dir(root, recursive=True)
        with ThreadPoolExecutor(MOVERS) as pool:
            while self.overwrite and (old := list(islice((n for n in file_names(fs, root) if n.endswith(".txt")), FOLDER))):
                list(pool.map(lambda n: fs.delete_file(f"{root}/{n}"), old))
            for m in messages:
                for k in range(math.ceil(m.files / FOLDER) if m is not None else 0):
                    own = f"{root}/{m.folder}/{k}"
                    list(pool.map(lambda n, own=own: fs.move(f"{own}/{n}", f"{root}/{n}"), list(file_names(fs, own))))
        self._clear(fs, root)
        with fs.open_output_stream(f"{root}/_SUCCESS") as out:
            out.write(b"")

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*opened(self.path))

    def _clear(self, fs: pa_fs.FileSystem, root: str) -> None:
        if fs.get_file_info(f"{root}/{self.staging}").type != pa_fs.FileType.NotFound:
            fs.delete_dir(f"{root}/{self.staging}")


class LabelFiles(DataSource):
    """Rows (image_id string, content string) as {image_id}.txt below the path; of rows with one name, one stays."""

    @classmethod
    def name(cls) -> str:
        return "label_files"

    def schema(self) -> str:
        return "image_id string, content string"

    def writer(self, schema: StructType, overwrite: bool) -> LabelWriter:
        return LabelWriter(self.options["path"], overwrite)


def many_files(spark: SparkSession, path: str, ending: str) -> DataFrame | None:
    """(file, content binary) of a folder's files of an ending, or None if there are LISTED at most or Spark alone can open the folder.

    A task lists the names, which are dealt out, and each is opened where it came to: no driver holds a file's place.
    file is the name as it stands in a URL. As for Spark's readers, names that begin with _ or . don't count.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    uri = folder.getFileSystem(conf).makeQualified(folder).toUri().toString()
    try:
        fs, root = opened(uri)
        if fs.get_file_info(root).type != pa_fs.FileType.Directory:
            return None
    except (pa.ArrowInvalid, OSError):
        return None

    def listed(_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = (n for n in file_names(*opened(uri)) if n[0] not in "_." and fnmatchcase(n, f"*.{ending}"))
        for some in batched(names, LISTED):
            yield pa.RecordBatch.from_pydict({"name": some})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = opened(uri)
        held, size = {"file": [], "content": []}, 0
        for name in (n for b in batches for n in b.column(0).to_pylist()):
            with fs.open_input_stream(f"{root}/{name}") as f:
                content = f.read().removeprefix(b"\xef\xbb\xbf")
            held["file"].append(quote(name))
            held["content"].append(content)
            size += len(content)
            if size > BATCH_LIMIT:
                yield pa.RecordBatch.from_pydict(held)
                held, size = {"file": [], "content": []}, 0
        if held["file"]:
            yield pa.RecordBatch.from_pydict(held)

    names = durable(spark.range(0, 1, 1, 1).mapInArrow(listed, "name string"), "file-names")
    count = names.count()
    if count <= LISTED:
        return None
    return names.repartition(math.ceil(count / FILES_A_TASK)).mapInArrow(read, "file string, content binary")
