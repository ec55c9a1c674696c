"""What the training-data operators share: table access, what workers keep, keys that may be null or hot."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import bound_batches, discard, durable, fresh_path, shared_dir  # noqa: F401  (operators take them from here)

#: What a Python worker keeps from one task to the next: tables and caches of one operator.
_kept: dict[str, object] = {}


def kept(name: str, make: Callable[[], object]) -> object:
    """What this worker keeps under the name, made where it is not there; workers outlive stages, so what another operator left goes."""
    if name not in _kept:
        let_go()
        _kept[name] = make()
    return _kept[name]


def let_go() -> None:
    """Forget what an operator of an earlier stage left in this worker, and give its memory back to the system."""
    _kept.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the queries; reading one also bounds what the session sends to Python workers."""
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def null_safe_key(column: str | Column) -> Column:
    """A never-null struct standing for a nullable id, so that an equi-join also pairs nulls."""
    c = F.col(column) if isinstance(column, str) else column
    return F.struct(c.isNull().alias("none"), F.coalesce(c, F.lit(0).cast("long")).alias("id"))


def spare_name(df: DataFrame, wanted: str) -> str:
    """wanted, or wanted with underscores before it until df has no such column (names differ beyond case)."""
    held = {c.lower() for c in df.columns}
    while wanted.lower() in held:
        wanted = "_" + wanted
    return wanted
