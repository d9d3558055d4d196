"""Places found by ranges are those of a sort."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from dwellgrid.operators.ranking import ranked


def test_places_are_those_of_a_sort(spark):
    draw = random.Random(5)
    rows = [(draw.choice((None, 1, 2, 2, 3)), n) for n in range(500)]
    df = spark.createDataFrame(rows, "v int, id long").repartition(6)
    got = ranked(df, [F.col("v").desc_nulls_last(), "id"]).orderBy("place").collect()
    expected = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert [(r.v, r.id) for r in got] == expected and [r.place for r in got] == list(range(1, 501))


def test_equal_rows_are_spread(spark):
    df = spark.range(0, 4000, 1, 4).select(F.lit(7).alias("v"))
    got = ranked(df, ["v"])
    assert sorted(r.place for r in got.collect()) == list(range(1, 4001))


def test_no_rows(spark):
    assert ranked(spark.range(0), ["id"]).collect() == []
