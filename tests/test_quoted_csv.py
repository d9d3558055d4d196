"""Files with line breaks inside quotes, cut into byte ranges anywhere."""

from __future__ import annotations

import csv
import random

import pytest

from dwellgrid.sources import readers
from dwellgrid.sources.quoted import records, scan_quoted_csv

HEADER = ["Trip", "Note", "Plate"]


@pytest.fixture
def small_ranges(spark):
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in before.items():
        spark.conf.set(k, v) if v else spark.conf.unset(k)


def rows_of(seed, n):
    draw = random.Random(seed)
    bits = ["a", "lang woord", "\n", "\n\n", '"', '""', ",", "\r\n", "é", '",\n"', " "]
    return [[f"T{i}", "".join(draw.choice(bits) for _ in range(draw.choice((0, 1, 3, 9, 60 if draw.random() < 0.1 else 2)))), f"P{i}"] for i in range(n)]


def written(path, rows, lineterminator="\n"):
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f, lineterminator=lineterminator)
        out.writerow(HEADER)
        out.writerows(rows)


def read_back(df):
    return sorted((r.Trip, r.Note or "", r.Plate) for r in df.collect())


@pytest.mark.parametrize(("seed", "end"), [(1, "\n"), (2, "\r\n"), (3, "\n")])
def test_no_row_is_torn(spark, tmp_path, small_ranges, seed, end):
    rows = rows_of(seed, 300)
    written(tmp_path / "one.csv", rows, end)
    written(tmp_path / "two.csv", rows_of(seed + 10, 40), end)
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 15
    got = readers.scan_trip_csv(spark, [str(tmp_path)])
    assert got.columns == [*HEADER, "filename"]
    assert read_back(got) == sorted(map(tuple, rows + rows_of(seed + 10, 40)))
    assert {r.filename.rsplit("/", 1)[1] for r in got.select("filename").distinct().collect()} == {"one.csv", "two.csv"}


def test_quotes_that_open_nothing(spark, tmp_path, small_ranges):
    lines = ['Trip,Note,Plate', 'T1,5" pipe,P1', 'T2,"a\nb",P2', 'T3,x""y,P3', 'T4,"",P4', 'T5,"c,""d""\n",P5', 'T6,6" and 7",P6']
    (tmp_path / "odd.csv").write_text("\n".join(lines) + "\n")
    expected = [("T1", '5" pipe', "P1"), ("T2", "a\nb", "P2"), ("T3", 'x""y', "P3"), ("T4", "", "P4"), ("T5", 'c,"d"\n', "P5"), ("T6", '6" and 7"', "P6")]
    assert read_back(readers.scan_trip_csv(spark, [str(tmp_path)])) == expected


def test_one_field_over_many_ranges(spark, tmp_path, small_ranges):
    rows = [["T1", "x\n" * 2000, "P1"], ["T2", "plain", "P2"], ["T3", "y\n,\n" * 500, "P3"]]
    written(tmp_path / "long.csv", rows)
    assert read_back(readers.scan_trip_csv(spark, [str(tmp_path)])) == sorted(map(tuple, rows))


def test_a_quote_left_open_is_an_error(spark, tmp_path, small_ranges):
    (tmp_path / "open.csv").write_text('Trip,Note,Plate\nT1,"a,P1\nT2,b,P2\n')
    with pytest.raises(ValueError, match="open.csv: a quote is not closed"):
        readers.scan_trip_csv(spark, [str(tmp_path)])


def test_headers_must_agree(spark, tmp_path):
    written(tmp_path / "a.csv", [["T1", "a\nb", "P1"]])
    (tmp_path / "b.csv").write_text("Trip,Plate,Note\nT2,P2,x\n")
    with pytest.raises(ValueError, match="header differs"):
        scan_quoted_csv(spark, str(tmp_path), HEADER)


def test_files_without_breaks_and_empty_files(spark, tmp_path, small_ranges):
    rows = [[f"T{i}", "plain, quoted", f"P{i}"] for i in range(50)]
    written(tmp_path / "a.csv", rows)
    assert read_back(readers.scan_trip_csv(spark, [str(tmp_path)])) == sorted(map(tuple, rows))
    (tmp_path / "empty.csv").write_text("")
    assert records(spark, str(tmp_path / "empty.csv")).count() == 0
