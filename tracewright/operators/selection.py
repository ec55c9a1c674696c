"""Exact order statistics of groups of any size, by repeated range counts: no task sorts or holds a group.

To find the value at a place of a group, its range is cut into BINS parts and the values of each part are
counted (combined before the shuffle). The part that holds the place becomes the new range, and so on until
few enough values are left to be gathered, or all that are left are equal. A round narrows a range about
BINS-fold; what is left of a hot group after a round is a small share of its rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import durable

#: Parts a range is cut into; values of a group that one task may gather; groups whose ranges are broadcast.
BINS, GATHERED, BROADCAST = 1024, 4096, 50_000


def beside(rows: DataFrame, ranges: DataFrame, n_ranges: int, keys: Sequence[str]) -> DataFrame:
    """Rows with the ranges of their group; the ranges are broadcast where they are few, else joined."""
    renamed = ranges.select(*(F.col(k).alias(f"_of{i}") for i, k in enumerate(keys)), *(c for c in ranges.columns if c not in keys))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_of{i}"))
    return rows.join(F.broadcast(renamed) if n_ranges <= BROADCAST else renamed, same).drop(*(f"_of{i}" for i in range(len(keys))))


def at_places(rows: DataFrame, keys: Sequence[str], value: str, places: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """One row a group: keys, size, and under each name the value at that place (from 0) of the group's values in order.

    A place is worked out from the size by its function; a place outside the group gives null. Null values and
    NaN are left out and don't count to the size; infinities are values. Null keys are a group.
    """
    v = F.col(value).cast("double")
    held = durable(rows.where(F.col(value).isNotNull() & ~F.isnan(v)).select(*keys, v.alias("_v")), "selection")
    sized = durable(held.groupBy(*keys).agg(F.count("*").alias("size"), F.min("_v").alias("_low"), F.max("_v").alias("_high")), "selection")
    names = list(places)
    wanted = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), places[n](F.col("size")).cast("long").alias("place")) for n in names)))
    targets = sized.withColumn("_w", wanted).select(*keys, F.col("_w.name").alias("_name"), F.col("_w.place").alias("_place"), F.col("size").alias("_n"), "_low", "_high").where("_place >= 0 and _place < _n")
    finished = []
    while True:
        # Equal values need no search; the few of small ranges are gathered; large ranges go on.
        finished.append(targets.where("_low = _high").select(*keys, "_name", F.col("_low").alias("_found")))
        open_ = targets.where("_low < _high")
        counts = open_.agg(F.count("*").alias("n"), F.count_if(F.col("_n") > GATHERED).alias("large")).first()
        if not counts.n:
            break
        small = beside(held, open_.where(F.col("_n") <= GATHERED), counts.n, keys).where("_v between _low and _high")
        place = F.element_at(F.sort_array(F.collect_list("_v")), (F.first("_place") + 1).cast("int"))
        finished.append(small.groupBy(*keys, "_name").agg(place.alias("_found")))
        if not counts.large:
            break
        # Ends that aren't finite, or too far apart for a difference, are cut in the middle of what can be halved.
        low, high = (F.greatest(F.lit(-8e307), F.least(F.lit(8e307), F.col(c))) for c in ("_low", "_high"))
        share = F.floor((F.greatest(low, F.least(high, F.col("_v"))) - low) / (high - low) * BINS)
        part = F.when(F.col("_v") == F.col("_low"), -1).when(F.col("_v") == F.col("_high"), BINS + 1).otherwise(F.coalesce(share.cast("int"), F.lit(0)))
        large = beside(held, open_.where(F.col("_n") > GATHERED), counts.n, keys).where("_v between _low and _high")
        parts = large.groupBy(*keys, "_name", "_place", part.alias("_part")).agg(F.count("*").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
        before = W.partitionBy(*keys, "_name").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
        parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        chosen = parts.where("_before <= _place and _place < _before + _n")
        targets = durable(chosen.select(*keys, "_name", (F.col("_place") - F.col("_before")).alias("_place"), "_n", "_low", "_high"), "selection")
    found = finished[0]
    for f in finished[1:]:
        found = found.unionByName(f)
    wide = found.groupBy(*keys).agg(*(F.max(F.when(F.col("_name") == n, F.col("_found"))).alias(n) for n in names))
    renamed = wide.select(*(F.col(k).alias(f"_of{i}") for i, k in enumerate(keys)), *names)
    same = F.lit(True)
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_of{i}"))
    return sized.join(renamed, same, "left").select(*keys, "size", *names)
