"""A uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

How many rows of each partition go to each shard is drawn first, so that the counts add up to the partitions'
rows and to the shards' exact sizes: a row of the matrix is multivariate hypergeometric given what the shards have
left. Each partition puts its rows into random order and deals them out by its row of the matrix; each shard
puts what it receives into random order again. Every arrangement of the rows is equally likely, up to
the quality of the hashes and generators.

The matrix is drawn in two levels, which does not change its law: the driver draws for at most ``GROUPS`` groups of
partitions, and each group's row is split among its partitions in a task. A shard beyond ``BLOCK`` rows is several columns
of the matrix, so that no task orders more than a block.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from dwellgrid.session import materialize

#: Groups of partitions that the driver draws for, and rows of a shard that one task orders.
GROUPS, BLOCK = 1024, 250_000
SEED = 13


def hypergeometric(draw: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` rows taken from ``good + bad`` are good; any size.

    Inversion over the values within forty spreads of the mode, from the exact ratios of neighbours; what lies
    beyond has less than 1e-300 of the probability. The library's generator ends at a thousand million rows.
    """
    least, most = max(0, n - bad), min(n, good)
    if least == most:
        return least
    total = good + bad
    mode = min(most, max(least, (n + 1) * (good + 1) // (total + 2)))
    spread = math.sqrt(n * (good / total) * (bad / total) * ((total - n) / max(1, total - 1)))
    reach = 50 + int(40 * spread)
    low, high = max(least, mode - reach), min(most, mode + reach)
    k = np.arange(low, high, dtype=np.float64)
    steps = np.log(good - k) + np.log(n - k) - np.log(k + 1) - np.log(bad - n + k + 1)
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    mass = np.cumsum(np.exp(logs - logs.max()))
    return low + int(np.searchsorted(mass, draw.random() * mass[-1], "right"))


def matrix(draw: np.random.Generator, rows: list[int], columns: list[int]) -> np.ndarray:
    """Whole numbers with the row sums ``rows`` and the column sums ``columns``, as a uniform shuffle has them."""
    left, out = list(columns), np.zeros((len(rows), len(columns)), np.int64)
    for i, count in enumerate(rows):
        after, due = sum(left), count
        for j, good in enumerate(left):
            if not due:
                break
            after -= good
            out[i, j] = taken = hypergeometric(draw, good, after, due)
            left[j] -= taken
            due -= taken
    return out


def cells(total: int, shards: int, block: int) -> list[tuple[int, int, int]]:
    """Shard, first slot and size of each column of the matrix; shards differ by one row at most."""
    out = []
    for shard in range(shards):
        size = total // shards + (shard < total % shards)
        parts = max(1, -(-size // block))
        firsts = [size * p // parts for p in range(parts + 1)]
        out += [(shard, a, b - a) for a, b in zip(firsts, firsts[1:])]
    return out


def communication(counts: DataFrame, columns: list[tuple[int, int, int]], groups: int, seed: int) -> DataFrame:
    """``part, ends``: for each partition, the running sums of its row of the matrix. ``counts`` is ``part, n``."""
    sums = counts.groupBy(F.pmod("part", F.lit(groups)).alias("group")).agg(F.sum("n").alias("n")).orderBy("group").collect()
    drawn = matrix(np.random.default_rng([seed, 0]), [r.n for r in sums], [size for _, _, size in columns])
    shares = {r.group: row.tolist() for r, row in zip(sums, drawn, strict=True)}
    spark = counts.sparkSession
    of = spark.createDataFrame(list(shares.items()), "group long, share array<bigint>")

    def split(key: tuple, one: pd.DataFrame) -> pd.DataFrame:
        one = one.sort_values("part")
        own = matrix(np.random.default_rng([seed, 1, int(key[0])]), one["n"].tolist(), [int(x) for x in one["share"].iloc[0]])
        return pd.DataFrame({"part": one["part"], "ends": list(np.cumsum(own, axis=1))})

    grouped = counts.withColumn("group", F.pmod("part", F.lit(groups))).join(of, "group")
    return grouped.groupBy("group").applyInPandas(split, "part long, ends array<bigint>")


def shuffle(df: DataFrame, shards: int, seed: int = SEED, block: int = BLOCK, groups: int = GROUPS) -> DataFrame:
    """``df`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (from 0 without gaps), a uniform shuffle of its rows.

    Counts of shards differ by one at most; the first ones are the larger. Rows are dealt one by one, whatever
    they hold: equal rows are rows of their own, and nulls and empty texts are values like others. The same table, read in the
    same partitions, gives the same shards. Columns that are named like the new ones are replaced. No
    rows give no rows; with fewer rows than shards the last shards stay empty.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    columns = [c for c in df.columns if c.lower() not in ("shard", "slot", "_at", "_own")]
    kept = F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in columns]).alias("row")
    # Order within a partition: by a hash of the row's place in it, in the same stage as the reading.
    local = df.select(kept, F.monotonically_increasing_id().alias("_own"))
    order = F.xxhash64(F.lit(seed), "_own")
    placed = local.sortWithinPartitions(order, "_own").select("row", F.monotonically_increasing_id().alias("_at"))
    rows = materialize(placed, "shuffled").withColumns({"part": F.shiftright("_at", 33), "within": F.col("_at").bitwiseAND((1 << 33) - 1)})
    counts = materialize(rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")), "counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    columns_ = cells(total, shards, block)
    ends = materialize(communication(counts, columns_, groups, seed), "matrix")
    cell = F.size(F.filter("ends", lambda e: e <= F.col("within"))).alias("cell")
    dealt = rows.join(ends, "part").select("row", "_at", cell)
    spark = df.sparkSession
    named = spark.createDataFrame([(i, s, first) for i, (s, first, _) in enumerate(columns_)], "cell int, shard int, first long")
    again = W.partitionBy("cell").orderBy(F.xxhash64(F.lit(seed + 1), "_at"), "_at")
    out = dealt.withColumn("_slot", F.row_number().over(again) - 1).join(named, "cell")
    return out.select("row.*", "shard", (F.col("first") + F.col("_slot")).alias("slot"))


def write(df: DataFrame, path: str, shards: int, seed: int = SEED) -> None:
    """Write ``df`` as Parquet, one folder per shard, the rows of a file in the order of their slots."""
    dealt = shuffle(df, shards, seed)
    dealt.repartition("shard", F.floor(F.col("slot") / BLOCK)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
