"""Exact group statistics whose state does not grow with the largest group."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dwellgrid.functions.geo import column

# Buckets per factor e of (1 + value).
_RESOLUTION = 4096


def quantiles(df: DataFrame, keys: Sequence[str], value, points: Mapping[str, float]) -> DataFrame:
    """Exact linear-interpolation quantiles of ``value`` per group: ``keys`` plus one column per point.

    Equal values are counted first. A monotone bucket of the value then splits every group: ranks
    are found on bucket counts (a group has at most a few million buckets, whatever its size) and
    only the buckets that hold a wanted rank are ordered, each on its own. No group is ever gathered.
    """
    group = list(keys) or ["_all"]
    source = df.select(*keys, column(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    if not keys:
        source = source.withColumn("_all", F.lit(0))

    bucket = F.floor(F.signum("_v") * F.log1p(F.abs("_v")) * _RESOLUTION)
    counted = source.groupBy(*group, "_v").agg(F.count(F.lit(1)).alias("_n")).withColumn("_b", bucket)

    along = W.partitionBy(*group).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    buckets = (
        counted.groupBy(*group, "_b")
        .agg(F.sum("_n").alias("_size"))
        .withColumn("_before", F.coalesce(F.sum("_size").over(along), F.lit(0)))
        .withColumn("_total", F.sum("_size").over(W.partitionBy(*group)))
    )
    wanted = F.array(*[rank for q in points.values() for rank in _ranks(q)])
    start, size = F.col("_before"), F.col("_size")
    holding = buckets.where(F.exists(wanted, lambda r: (r >= start) & (r < start + size)))

    within = W.partitionBy(*group, "_b").orderBy("_v").rowsBetween(W.unboundedPreceding, -1)
    ranked = (
        counted.join(holding.select(*group, "_b", "_before", "_total"), [*group, "_b"])
        .withColumn("_first", F.col("_before") + F.coalesce(F.sum("_n").over(within), F.lit(0)))
    )

    def at(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("_first")) & (rank < F.col("_first") + F.col("_n")), F.col("_v")))

    picks = []
    for name, q in points.items():
        low, high = _ranks(q)
        picks += [at(low).alias(f"_{name}_low"), at(high).alias(f"_{name}_high")]
    picked = ranked.groupBy(*group).agg(F.max("_total").alias("_total"), *picks)
    outputs = []
    for name, q in points.items():
        share = _position(q) - F.floor(_position(q))
        outputs.append((F.col(f"_{name}_low") * (1 - share) + F.col(f"_{name}_high") * share).alias(name))
    return picked.select(*keys, *outputs)


def _position(q: float) -> Column:
    return (F.col("_total") - 1) * F.lit(float(q))


def _ranks(q: float) -> tuple[Column, Column]:
    return F.floor(_position(q)), F.ceil(_position(q))


def mode_value(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Most frequent non-null value per group, smallest on a tie: counts first, then one pick."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    best = F.min_by(F.col(value), F.struct(-F.col("_n"), F.col(value)))
    return counted.groupBy(*keys).agg(best.alias(name))


def mode_text(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Most frequent non-blank text per group ignoring case and outer blanks, smallest on a tie."""
    text = F.trim(F.col(value))
    shown = df.where(text != "").select(*keys, text.alias("_text"), F.upper(text).alias("_fold"))
    # Spellings are counted first: a least text among all rows would sort them.
    spelled = shown.groupBy(*keys, "_fold", "_text").agg(F.count(F.lit(1)).alias("_n"))
    counted = spelled.groupBy(*keys, "_fold").agg(F.sum("_n").alias("_n"), F.min("_text").alias("_text"))
    best = F.min_by("_text", F.struct(-F.col("_n"), F.col("_fold")))
    return counted.groupBy(*keys).agg(best.alias(name))


def distinct_list(value: str | Column, separator: str = ", ") -> Column:
    """The distinct non-blank texts of a group in order, joined: an aggregate with one entry per distinct text.

    Null and blank texts are left out; a group without others gives the empty text. For groups with few
    distinct texts, such as the plates of a trip; ``first_values`` shows the first of many.
    """
    text = F.col(value) if isinstance(value, str) else value
    return F.array_join(F.array_sort(F.collect_set(F.when(F.trim(text) != "", text))), separator)


def first_values(df: DataFrame, keys: Sequence[str], value: str, name: str, visible: int) -> DataFrame:
    """The first ``visible`` distinct non-blank texts per group, ignoring case, and ``<name>_count``."""
    text = F.trim(F.col(value))
    distinct = (
        df.where(text != "").groupBy(*keys, F.upper(text).alias("_fold")).agg(F.min(text).alias("_text"))
    )
    counts = distinct.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"{name}_count"))
    # A rank limit is applied before the shuffle, so a group never moves more than ``visible`` rows per task.
    rank = F.row_number().over(W.partitionBy(*keys).orderBy("_fold"))
    head = (
        distinct.withColumn("_rank", rank)
        .where(F.col("_rank") <= visible)
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("_fold", "_text"))).alias("_head"))
        .select(*keys, F.transform("_head", lambda item: item["_text"]).alias(name))
    )
    return head.join(counts, list(keys))
