"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def quoted(name: str) -> Column:
    """A column by its exact name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def identified(df: DataFrame, key: str, value: str) -> DataFrame:
    """Only the key and the value as ``doc_id`` and ``text``, so that other columns cannot clash.

    A null text is the empty text. A null key stays: it is a row like any other.
    """
    return df.select(quoted(key).cast("long").alias("doc_id"), F.coalesce(quoted(value), F.lit("")).alias("text"))


_resident: list[tuple[Any, Any]] = []


def resident(mark: Any, build: Callable[[], Any]) -> Any:
    """What a worker process keeps between tasks: one model, the one last asked for.

    Workers are used again by later stages, which then do not hold the models and remembered texts of earlier ones.
    """
    if not _resident or _resident[0][0] != mark:
        _resident.clear()
        _resident.append((mark, build()))
    return _resident[0][1]
