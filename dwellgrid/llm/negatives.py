"""Hard negatives by threshold joins with an inverted index in the manner of L2AP.

Anchors are joined with all rows, in blocks: a task holds a bounded group of anchors and reads the rows as tiles
of a few hundred, each tile an inverted index over the dimensions. Dimensions stand in falling order of their
energy in the block. Of a row, only the dimensions are indexed before which the norm of its suffix times the
largest suffix norm of the anchors is at least the lowest threshold: a pair that meets no indexed dimension
cannot reach it. With the rows sorted by where their index ends, a posting list is the head of a column.
Partial scores are accumulated along the lists; a pair goes as soon as its partial score and the product of
the remaining norms stay below the anchor's threshold, the others are completed from the rest of the row.

A search has windows: the first ``k`` rows with a score between a window's bounds. It begins with high thresholds,
and only windows that have not filled are searched again with lower ones, the last time without any. A window
that has filled within a task raises the threshold there. So few rows leave a task, whatever their number.

Components are whole numbers (``floor(256 * x)``). Norms up to 2^26 keep all sums exact in doubles; blocks with
larger ones are summed as Python integers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dwellgrid.llm.common import quoted
from dwellgrid.session import materialize

SCALE = 256
#: Rows of a tile and anchors of a group (fewer where vectors are long: bytes of each), anchors multiplied at
#: once, dimensions between two looks at the bounds.
TILE, GROUP, SUB, STEP = 512, 16_384, 256, 16
TILE_BYTES, GROUP_BYTES = 1 << 23, 1 << 26
#: First thresholds as parts of the anchor's squared norm, and of a window counted from its upper end.
POSITIVE, NEGATIVE = (0.4, 0.2, 0.1, 0.05), (0.1, 0.4)
EXACT, LARGEST = 2.0**26, 2.0**31
NEVER = (1 << 63) - 1


def vector_rows(vectors: DataFrame, key: str, value: str, label: str) -> DataFrame:
    """``vec_id, label, vector`` of the rows that take part: all of it there, every component finite."""
    v = F.col("vector")
    rows = vectors.select(
        quoted(key).cast("long").alias("vec_id"), quoted(label).cast("long").alias("label"), quoted(value).cast("array<double>").alias("vector")
    )
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & finite)


def whole(x: np.ndarray) -> np.ndarray:
    """Components as whole numbers."""
    ints = np.floor(SCALE * x)
    if np.sqrt((ints * ints).sum(axis=-1)).max(initial=0.0) >= LARGEST:
        raise ValueError(f"vectors longer than {LARGEST / SCALE:.0f} have scores beyond 64 bits")
    return ints.astype(np.int32)


def numbered(rows: DataFrame, parts: int) -> DataFrame:
    """Anchors one by one, numbered in ``parts`` groups of about the same size: ``anchor, part, vec_id, label, size, ints, square``."""

    def batches(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks:
            ints = [whole(np.asarray(v.values, np.float64)) for v in block.column(2)]
            squares = [float((x.astype(np.float64) ** 2).sum()) for x in ints]
            columns = [block.column(0), block.column(1), pa.array([len(x) for x in ints], pa.int32()), pa.array([x.tobytes() for x in ints], pa.binary()), pa.array(squares, pa.float64())]
            yield pa.record_batch(columns, ["vec_id", "label", "size", "ints", "square"])

    out = rows.repartition(parts).mapInArrow(batches, "vec_id long, label long, size int, ints binary, square double")
    return out.withColumn("anchor", F.monotonically_increasing_id()).withColumn("part", F.shiftright("anchor", 33))


def tiles(rows: DataFrame, count: int, most: int = TILE) -> DataFrame:
    """Rows of one length packed into ``size, n, ids, labels, ints``; about ``count`` rows are dealt out evenly."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def packed(size: int) -> pa.RecordBatch:
            ids, labels, x = (np.concatenate(c) for c in zip(*held.pop(size), strict=True))
            values = [[size], [len(ids)], [ids.tobytes()], [labels.tobytes()], [whole(x).tobytes()]]
            types = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            return pa.record_batch([pa.array(v, t) for v, t in zip(values, types, strict=True)], ["size", "n", "ids", "labels", "ints"])

        for part in parts:
            vectors = part.column(2)
            sizes, flat = np.asarray(pc.list_value_length(vectors)), np.asarray(vectors.flatten(), np.float64)
            ids, labels = np.asarray(part.column(0), np.int64), np.asarray(part.column(1), np.int64)
            starts = np.cumsum(sizes) - sizes
            for size in np.unique(sizes).tolist():
                places = np.flatnonzero(sizes == size)
                for at in range(0, len(places), most):
                    some = places[at : at + most]
                    held.setdefault(size, []).append((ids[some], labels[some], flat[starts[some][:, None] + np.arange(size)]))
                    if sum(len(p[0]) for p in held[size]) >= most:
                        yield packed(size)
        for size in list(held):
            yield packed(size)

    spread = rows.repartition(max(1, -(-count // most)))
    return spread.mapInArrow(batches, "size int, n int, ids binary, labels binary, ints binary")


def first_k(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores of each group, smaller ids first among equal ones."""
    order = np.lexsort((ids, -score, group))
    ordered = group[order]
    begins = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if len(order) else np.empty(0, bool)
    within = np.arange(len(order)) - np.maximum.accumulate(np.where(begins, np.arange(len(order)), 0)) if len(order) else order
    return order[within < k]


def reaching(q: np.ndarray, y: np.ndarray, least: np.ndarray, open_: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (anchor, row, exact score) whose score is ``least[anchor]`` or more, of those that are ``open_``."""
    size = q.shape[1]
    energy = np.sqrt((q * q).sum(0) * (y * y).sum(0))
    order = np.argsort(-energy, kind="stable")
    q, y = q[:, order], y[:, order]
    bounds = [*range(0, size, STEP), size] if size else [0, 0]
    left = lambda x: np.sqrt(np.concatenate([np.cumsum((x * x)[:, ::-1], axis=1)[:, ::-1], np.zeros((len(x), 1))], axis=1)[:, bounds])
    q_left, y_left = left(q), left(y)
    low = np.min(least, initial=np.inf)
    # A row's index ends at the first bound whose suffix cannot reach the lowest threshold alone.
    short = y_left * q_left.max(0, initial=0.0) < low
    ends = np.where(short.any(axis=1), short.argmax(axis=1), len(bounds) - 1)
    by_end = np.argsort(-ends, kind="stable")
    y, y_left, ends, open_ = y[by_end], y_left[by_end], ends[by_end], open_[:, by_end]
    partial = np.zeros((len(q), len(y)))
    step = 0
    for step in range(len(bounds) - 1):
        posted = int(np.searchsorted(-ends, -step, "left"))  # rows whose index holds this stretch
        if not posted:
            break
        cut = slice(bounds[step], bounds[step + 1])
        partial[:, :posted] += q[:, cut] @ y[:posted, cut].T
        if step % 2:
            open_[:, :posted] &= partial[:, :posted] + q_left[:, step + 1, None] * y_left[None, :posted, step + 1] >= least[:, None] - 0.5
            if np.count_nonzero(open_) < open_.size // 16:
                step += 1
                break
    else:
        step = len(bounds) - 1
    a, b = np.nonzero(open_)
    score, begin = partial[a, b], np.minimum(ends[b], step)
    for at in range(len(bounds)):
        due = begin <= at
        keep = ~due | (score + q_left[a, at] * y_left[b, at] >= least[a] - 0.5)
        a, b, score, begin, due = a[keep], b[keep], score[keep], begin[keep], due[keep]
        if at < len(bounds) - 1 and due.any():
            cut = slice(bounds[at], bounds[at + 1])
            score[due] += np.einsum("ij,ij->i", q[a[due], cut], y[b[due], cut])
    keep = score >= least[a]
    return a[keep], by_end[b[keep]], score[keep]


def _exact(q: np.ndarray, y: np.ndarray, least: np.ndarray, open_: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``reaching`` for long vectors: whole numbers of any size."""
    a, b = np.nonzero(open_)
    q, y = q.astype(np.int64).astype(object), y.astype(np.int64).astype(object)
    score = np.array([int((q[i] * y[j]).sum()) for i, j in zip(a, b, strict=True)], np.int64)
    keep = score >= least[a]
    return a[keep], b[keep], score[keep]


class _Group:
    """The anchors of one length that a task holds, with what their windows have found so far."""

    def __init__(self, rows: list[tuple], same: bool, k: int) -> None:
        self.same, self.k = same, k
        self.place, self.ids, self.labels = (np.array([r[i] for r in rows], np.int64) for i in range(3))
        self.x = np.frombuffer(b"".join(r[3] for r in rows), np.int32).reshape(len(rows), -1).astype(np.float64)
        self.low, self.high = (np.array([r[i] for r in rows], np.int64) for i in (4, 5))
        self.norm = np.sqrt((self.x * self.x).sum(1))
        self.windows = self.low.shape[1]
        self.found = [np.empty(0, np.int64)] * 3  # anchor * windows + window, score, id

    def meet(self, ids: np.ndarray, labels: np.ndarray, y: np.ndarray) -> None:
        y_norm = np.sqrt((y * y).sum(1)).max(initial=0.0)
        for at in range(0, len(self.ids), SUB):
            own = slice(at, min(at + SUB, len(self.ids)))
            open_ = (self.labels[own, None] == labels[None]) == self.same
            open_ &= self.ids[own, None] != ids[None]
            exact = max(y_norm, self.norm[own].max()) <= EXACT
            least = self.low[own].min(axis=1)
            a, b, score = reaching(self.x[own], y, least.astype(np.float64), open_) if exact else _exact(self.x[own], y, least, open_)
            a, score = a + at, score.astype(np.int64)
            fits = (score[:, None] >= self.low[a]) & (score[:, None] <= self.high[a])
            pair, window = np.nonzero(fits)
            if len(pair):
                self._take(a[pair] * self.windows + window, score[pair], ids[b[pair]])

    def _take(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        touched = np.isin(self.found[0], group)
        merged = [np.concatenate([old[touched], new]) for old, new in zip(self.found, (group, score, ids), strict=True)]
        best = first_k(*merged, self.k)
        merged = [c[best] for c in merged]
        full = np.flatnonzero(np.bincount(merged[0])[merged[0]] == self.k)
        last = full[self.k - 1 :: self.k]  # groups stand together, the lowest of each last
        at = merged[0][last]
        flat = self.low.reshape(-1)
        flat[at] = np.maximum(flat[at], merged[1][last])
        self.found = [np.concatenate([old[~touched], new]) for old, new in zip(self.found, merged, strict=True)]

    def rows(self) -> tuple[np.ndarray, ...]:
        anchor, window = np.divmod(self.found[0], self.windows)
        return self.place[anchor], window, self.found[1], self.found[2]


def search(anchors: DataFrame, rows: DataFrame, n_tiles: int, same: bool, k: int) -> DataFrame:
    """``anchor, window, score, vec_id``: the first ``k`` rows within each window ``lows[i]`` to ``highs[i]``.

    ``anchors`` holds ``anchor`` (numbered, in bounded groups: ``part``), ``vec_id, label, size, ints, lows, highs``.
    """
    parts = [r.part for r in anchors.select("part").distinct().collect()]  # one number per group of anchors
    slices = max(1, min(n_tiles, -(-int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) // max(1, len(parts)))))
    none = F.lit(None)
    held = anchors.select(
        "part", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), F.lit(0).alias("kind"), "size", "anchor", "vec_id", "label", "ints", "lows", "highs",
        none.cast("binary").alias("ids"), none.cast("binary").alias("labels"),
    )
    own = F.monotonically_increasing_id()
    place = F.pmod(F.shiftright(own, 33) + own.bitwiseAND((1 << 33) - 1), F.lit(slices)).cast("int")
    read = rows.select("*", place.alias("slice")).select(
        F.explode(F.array(*[F.lit(p) for p in parts]).cast("array<bigint>")).alias("part"), "slice", F.lit(1).alias("kind"), "size", none.cast("long").alias("anchor"),
        none.cast("long").alias("vec_id"), none.cast("long").alias("label"), "ints", none.cast("array<bigint>").alias("lows"),
        none.cast("array<bigint>").alias("highs"), "ids", "labels",
    )
    both = held.unionByName(read).repartition("part", "slice").sortWithinPartitions("part", "slice", "kind")

    def batches(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark, waiting, groups = None, {}, {}

        def close() -> Iterator[pa.RecordBatch]:
            for group in groups.values():
                columns = group.rows()
                if len(columns[0]):
                    yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], ["anchor", "window", "score", "vec_id"])
            waiting.clear()
            groups.clear()

        for block in blocks:
            columns = [block.column(i) for i in range(block.num_columns)]
            marks = list(zip(columns[0].to_pylist(), columns[1].to_pylist(), columns[2].to_pylist(), columns[3].to_pylist(), strict=True))
            for i, (part, slice_, kind, size) in enumerate(marks):
                if (part, slice_) != mark:
                    yield from close()
                    mark = (part, slice_)
                cell = [c[i].as_py() for c in columns[4:]]
                if kind == 0:
                    waiting.setdefault(size, []).append((cell[0], cell[1], cell[2], cell[3], cell[4], cell[5]))
                    continue
                if size in waiting:
                    groups[size] = _Group(waiting.pop(size), same, k)
                if size in groups:
                    ids, labels = np.frombuffer(cell[6], np.int64), np.frombuffer(cell[7], np.int64)
                    y = np.frombuffer(cell[3], np.int32).reshape(len(ids), size).astype(np.float64)
                    groups[size].meet(ids, labels, y)
        yield from close()

    found = both.mapInArrow(batches, "anchor long, window long, score long, vec_id long")
    best = W.partitionBy("anchor", "window").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _rounds(anchors: DataFrame, rows: DataFrame, n_tiles: int, same: bool, k: int, lows: list[Column]) -> DataFrame:
    """Search ``anchors`` (with ``lows, highs`` as last resort) with falling thresholds until the windows are full."""
    done, pending = None, anchors
    for i, low in enumerate(lows):
        last = i == len(lows) - 1
        found = materialize(search(pending.withColumn("lows", low), rows, n_tiles, same, k), "windows")
        counted = found.groupBy("anchor", "window").agg(F.count(F.lit(1)).alias("n"))
        full = counted if last else counted.where(F.col("n") == k)
        kept = found.join(full.select("anchor", "window"), ["anchor", "window"])
        done = kept if done is None else done.unionByName(kept)
        if last:
            break
        closed = full.groupBy("anchor").agg(F.collect_set("window").alias("closed"))  # at most as many as windows
        left = pending.join(closed, "anchor", "left")
        closed_ = F.coalesce("closed", F.array().cast("array<bigint>"))
        never = F.transform("lows", lambda x, j: F.when(F.array_contains(closed_, j.cast("long")), F.lit(NEVER)).otherwise(x))
        left = left.withColumn("lows", never).drop("closed").where(F.exists("lows", lambda x: x < NEVER))
        pending = materialize(left, "pending")
        if pending.isEmpty():
            break
    return done


def mine(
    vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
    key: str = "vec_id", value: str = "embedding", label: str = "label",
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``anchors`` says of a row (``vec_id, label``) whether it is an anchor; its positives are the first rows of its label, its
    negatives for a positive the first rows of another label whose score is ``low`` to ``high`` hundredths of the
    positive's. Higher scores come first, then smaller keys. Rows with a null key, label, vector or component, or one that
    is not finite, take no part. Vectors of different lengths have no score. A row never meets rows of its own key;
    otherwise rows that repeat a key are rows of their own. Anchors without positives and positives without
    negatives give no rows, nor does an empty table; other columns are ignored. Vectors longer than 8,388,608 raise.
    """
    rows = materialize(vector_rows(vectors, key, value, label), "vectors")
    count, n_anchors, longest = rows.agg(F.count(F.lit(1)), F.count(F.when(anchors, 1)), F.max(F.size("vector"))).first()
    width = 8 * max(1, longest or 0)
    most, group = max(1, min(TILE, TILE_BYTES // width)), max(1, min(GROUP, GROUP_BYTES // width))
    n_tiles = max(1, -(-count // most))
    packed = materialize(tiles(rows, count, most), "tiles")
    chosen = materialize(numbered(rows.where(anchors), max(1, -(-n_anchors // group))), "anchors")

    everything = F.array(F.lit(-NEVER))
    open_ = chosen.withColumns({"lows": everything, "highs": F.array(F.lit(NEVER))})
    falling = [F.array(F.floor(F.col("square") * f).cast("long")) for f in POSITIVE] + [everything]
    near = _rounds(open_, packed, n_tiles, True, positives, falling)
    near = materialize(near.select("anchor", "rank", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    # Bounds in whole numbers: ceil(low * p / 100) to floor(high * p / 100). Negative positives have none.
    p = F.col("positive_score").cast("decimal(20,0)")
    lo, hi = F.floor((p * low + 99) / 100).cast("long"), F.floor(p * high / 100).cast("long")
    bounds = near.where(p >= 0).select("anchor", "rank", lo.alias("lo"), hi.alias("hi"))
    per = bounds.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("rank", F.struct("lo", "hi")))).alias("at"))
    places = F.sequence(F.lit(1), F.lit(positives))
    windowed = chosen.join(per, "anchor").withColumns(
        {
            "lows": F.transform(places, lambda i: F.coalesce(F.col("at")[i]["lo"], F.lit(NEVER))),
            "highs": F.transform(places, lambda i: F.coalesce(F.col("at")[i]["hi"], F.lit(-1))),
        }
    ).drop("at")
    windowed = materialize(windowed, "windows")
    narrowed = [F.zip_with("lows", "highs", _upper(part)) for part in NEGATIVE]
    far = _rounds(windowed, packed, n_tiles, False, negatives, [*narrowed, F.col("lows")])
    far = far.select("anchor", (F.col("window") + 1).alias("of"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    near = near.select("anchor", F.col("rank").alias("of"), "positive_id", "positive_score")
    out = far.join(near, ["anchor", "of"]).join(chosen.select("anchor", F.col("vec_id").alias("anchor_id")), "anchor")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _upper(part: float) -> Callable[[Column, Column], Column]:
    """The bound below which the upper ``part`` of a window ends."""
    return lambda lo, hi: F.when(lo < NEVER, F.greatest(lo, F.floor(hi - part * (hi - lo)).cast("long"))).otherwise(lo)
