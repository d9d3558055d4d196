"""Every registered query on the driver's smallest tables against its SQL answer."""

from __future__ import annotations

import math
from datetime import datetime
from pathlib import Path

import duckdb
import pytest

from acceptance.answers import answers
from acceptance.queries import queries

FOLDER = Path("/root/testdata/sf0.001")
# Little data: some filters keep nothing at this scale.
MAY_BE_EMPTY = {"filter_within_radius", "snap_to_road"}

pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no driver tables")
QUERIES, ANSWERS = queries(), answers()


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for path in FOLDER.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9) + 0.0
    if isinstance(value, datetime):
        return value.isoformat()
    return value


def rows_by_name(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(row[i]) for i in order) for row in rows), key=str)


def test_every_answer_has_a_query():
    assert set(ANSWERS) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sql, name):
    df = QUERIES[name](spark, str(FOLDER))
    found = rows_by_name(df.columns, df.collect())
    assert found or name in MAY_BE_EMPTY
    if name in ANSWERS:
        answer = sql.execute(ANSWERS[name])
        columns = [c[0] for c in answer.description]
        assert sorted(columns) == sorted(df.columns)
        assert found == rows_by_name(columns, answer.fetchall())


def test_entry(spark):
    import __spark_entry__ as driver

    assert driver.entry(spark).count() > 0
    assert set(driver.oracle_sql()) <= set(driver.queries())
