"""Places in groups that lie over many partitions."""

import random

import pytest
from pyspark.sql import functions as F

from tracewright.operators import ranks


@pytest.mark.parametrize("parts", [1, 7])
def test_positions_of_a_hot_group(spark, parts):
    r = random.Random(parts)
    keys = [r.choice([1, 1, 1, 1, 2, None]) for _ in range(600)]
    rows = [(k, r.choice([None, *range(500)]), i) for i, k in enumerate(keys)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        df = spark.createDataFrame(rows, "k long, v long, i long")
        got = ranks.positions(df, ["k"], [F.col("v").desc_nulls_last(), F.col("i").asc()]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = []
    for k in {*keys}:
        own = sorted((x for x in rows if x[0] == k), key=lambda x: (x[1] is None, -(x[1] or 0), x[2]))
        want += [(*x, n) for n, x in enumerate(own, 1)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_positions_of_nothing(spark):
    df = spark.createDataFrame([], "k long, v long")
    assert ranks.positions(df, ["k"], [F.col("v")]).collect() == []
