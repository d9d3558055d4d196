"""CSV files with line breaks inside quotes, read by many tasks.

A byte range cannot tell whether its first line begins inside quotes. So every line says, for both cases, whether
quotes are open at its end: a line changes the state, keeps it, or fixes it whatever came before. These
changes are added up within each range, then over the ranges of a file, one row each, and what the ranges before
leave behind is joined back. Lines that are records by themselves go on as they are; the few others are joined.

A quote opens a field only where the field begins, and two quotes inside a quoted field are one, as in the reader
for files without such breaks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from dwellgrid.functions.text import quoted as named
from dwellgrid.session import materialize

_INSIDE = r'(?:[^"]++|"")*+'
_FIELDS = rf'(?:(?:"{_INSIDE}"[^,]*+|[^",][^,]*+|),)*+'
_OPENS = rf'(?s)^{_FIELDS}"{_INSIDE}$'
_STAYS = rf'(?s)^{_INSIDE}$|^{_INSIDE}"[^,]*+,{_FIELDS}"{_INSIDE}$'
_RANGE = ["_file", "_range"]


def _lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    read = spark.read.option("lineSep", "\n").text(paths if isinstance(paths, str) else list(paths))
    return read.select(
        F.col("value").alias("_line"), F.input_file_name().alias("_file"), F.col("_metadata.file_block_start").alias("_range"),
        F.monotonically_increasing_id().alias("_at"), (F.contains("value", F.lit('"')) & F.rlike("value", F.lit(_OPENS))).alias("_opens"),
    )


def breaks_inside_quotes(spark: SparkSession, paths: str | Sequence[str]) -> bool:
    """Whether any line ends inside quotes when it begins outside: one pass, which stops at the first."""
    return not _lines(spark, paths).where("_opens").limit(1).isEmpty()


def _state(began: Column, fixed: Column, turns: Column) -> Column:
    """Open or not: what was fixed last or else what it began with, turned over for each turn since."""
    since = F.when(fixed.isNotNull(), turns - fixed["turns"]).otherwise(turns)
    return (F.coalesce(fixed["open"], began).cast("int") + since) % 2 == 1


def _running(rows: DataFrame, keys: list[str], order: str, fixes: Column, turn: Column, until: int) -> DataFrame:
    """``_turns`` and ``_fixed`` through the row at distance ``until``."""
    along = W.partitionBy(*keys).orderBy(order)
    turned = rows.withColumn("_now", F.sum(turn.cast("int")).over(along.rowsBetween(W.unboundedPreceding, W.currentRow)))
    held = F.when(fixes.isNotNull(), F.struct(fixes.alias("open"), F.col("_now").alias("turns")))
    window = along.rowsBetween(W.unboundedPreceding, until)
    return turned.withColumns(
        {"_turns": F.coalesce(F.sum(turn.cast("int")).over(window), F.lit(0)), "_fixed": F.last(held, ignorenulls=True).over(window)}
    ).drop("_now")


def records(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``record, _file, _first`` of every record; ``_first`` marks a file's first. A quote left open is an error."""
    outside = F.lit(False)
    lines = _lines(spark, paths).withColumn("_stays", F.rlike("_line", F.lit(_STAYS)))
    fixes = F.when(F.col("_opens") == F.col("_stays"), F.col("_opens"))
    turn = F.col("_opens") & ~F.col("_stays")
    within = materialize(_running(lines, _RANGE, "_at", fixes, turn, -1), "csv-lines")

    # One row per byte range, and per file as many as it has ranges.
    last = F.max_by(F.struct("_turns", "_fixed", "_opens", "_stays"), "_at").alias("_x")
    ends = within.groupBy(*_RANGE).agg(last).select(*_RANGE, "_x.*")

    def through(began: Column) -> Column:
        before = _state(began, F.col("_fixed"), F.col("_turns"))
        return F.when(before, F.col("_stays")).otherwise(F.col("_opens"))

    both = ends.select(*_RANGE, through(outside).alias("_opens"), through(F.lit(True)).alias("_stays"))
    carried = _running(both, ["_file"], "_range", fixes, turn, -1).withColumn("_began", _state(outside, F.col("_fixed"), F.col("_turns")))
    carried = materialize(carried.select(*_RANGE, "_began", F.when(F.col("_began"), F.col("_stays")).otherwise(F.col("_opens")).alias("_ends")), "csv-ranges")
    open_ = carried.groupBy("_file").agg(F.max_by("_ends", "_range").alias("_open")).where("_open").select("_file").first()
    if open_ is not None:
        raise ValueError(f"{open_[0]}: a quote is not closed")

    known = within.join(carried.select(*_RANGE, "_began"), _RANGE).withColumn("_inside", _state(F.col("_began"), F.col("_fixed"), F.col("_turns")))
    known = known.withColumn("_goes_on", F.when(F.col("_inside"), F.col("_stays")).otherwise(F.col("_opens")))
    known = known.select("_line", *_RANGE, "_at", "_inside", "_goes_on")
    alone = known.where(~F.col("_inside") & ~F.col("_goes_on")).select(
        F.col("_line").alias("record"), "_file", ((F.col("_range") == 0) & (F.col("_at").bitwiseAND((1 << 33) - 1) == 0)).alias("_first")
    )
    # Parts of a record: numbered by the records that began before, in the range and in the ranges before it.
    part = known.where(F.col("_inside") | F.col("_goes_on"))
    starts = F.when(F.col("_inside"), 0).otherwise(1)
    per = part.groupBy(*_RANGE).agg(F.sum(starts).alias("_n"))
    earlier = F.coalesce(F.sum("_n").over(W.partitionBy("_file").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    here = F.sum(starts).over(W.partitionBy(*_RANGE).orderBy("_at"))
    numbered = part.withColumn("_here", here).join(per.select(*_RANGE, earlier.alias("_earlier")), _RANGE)
    joined = numbered.groupBy("_file", (F.col("_here") + F.col("_earlier")).alias("_no")).agg(
        F.array_sort(F.collect_list(F.struct("_range", "_at", "_line"))).alias("_parts")
    )
    first = F.get("_parts", F.lit(0))
    texts = F.transform("_parts", lambda p: p["_line"])
    together = joined.select(
        F.array_join(texts, "\n").alias("record"), "_file", ((first["_range"] == 0) & (first["_at"].bitwiseAND((1 << 33) - 1) == 0)).alias("_first")
    )
    return alone.unionByName(together)


def scan_quoted_csv(spark: SparkSession, paths: str | Sequence[str], names: Sequence[str]) -> DataFrame:
    """All columns as text under ``names``, and ``filename``. The first record of each file must hold these names."""
    schema = StructType([StructField(f"c{i}", StringType()) for i in range(len(names))])
    found = records(spark, paths).withColumn("record", F.regexp_replace("record", "\r$", "")).where(F.length("record") > 0)
    parsed = found.withColumn("_row", F.from_csv("record", schema.simpleString()[7:-1].replace(":", " "), {"escape": '"', "maxCharsPerColumn": "-1"}))
    parsed = materialize(parsed.select("_file", "_first", "_row"), "csv-records")
    cells = [F.regexp_replace(F.coalesce(F.col("_row")[f"c{i}"], F.lit("")), "^﻿", "") for i in range(len(names))]
    odd = [F.lower(F.trim(cell)) != name.strip().lower() for cell, name in zip(cells, names, strict=True)]
    other = parsed.where("_first").where(F.exists(F.array(*odd), lambda x: x)).select("_file").first()
    if other is not None:
        raise ValueError(f"{other[0]}: its header differs from the others in its folder")
    return parsed.where(~F.col("_first")).select(*[F.col("_row")[f"c{i}"].alias(name) for i, name in enumerate(names)], F.col("_file").alias("filename"))
