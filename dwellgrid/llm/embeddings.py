"""Near-duplicate vectors by cross-polytope hashing.

A table of the hash rotates a vector by three rounds of random signs and a fast Hadamard transform and takes
the axis it lies nearest to, with its side; ``AXES`` such hashes make a bucket. Beside its own bucket a vector
is put into that of the runner-up axis of its least certain hash (multiprobe). Pairs that share a bucket
are compared by cosine in double precision.

Equal vectors are one class. A pair is counted in the first table that brings it together, so nothing is
counted twice and no pairs leave a task: only links per vector, and a star for each joined group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwellgrid.llm.common import quoted
from dwellgrid.llm.components import components
from dwellgrid.session import materialize

COSINE = 0.9
AXES = 3
#: Members of a bucket that are compared at once; larger buckets are compared block by block.
BLOCK = 1500


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast transform along the last axis, whose length is a power of two."""
    n, step = x.shape[-1], 1
    while step < n:
        x = x.reshape(*x.shape[: x.ndim - 1], -1, 2, step) if x.ndim == 2 else x
        a, b = x[..., 0, :], x[..., 1, :]
        x = np.stack([a + b, a - b], axis=-2).reshape(x.shape[0], n)
        step *= 2
    return x / np.sqrt(n)


def width_of(size: int) -> int:
    """The power of two that vectors of ``size`` components are padded to."""
    return 1 << max(1, (size - 1).bit_length())


def tables_of(size: int) -> int:
    """Tables for vectors of ``size`` components: the more axes there are, the less often near vectors take the same one."""
    return max(16, 4 * (width_of(size).bit_length() - 3))


def buckets(vectors: np.ndarray) -> np.ndarray:
    """Keys of unit vectors: one row each, two keys per table (its own and its runner-up)."""
    count, size = vectors.shape
    width, tables = width_of(size), tables_of(size)
    padded = np.zeros((count, width))
    padded[:, :size] = vectors
    signs = np.random.default_rng(9021).choice([-1.0, 1.0], (tables, AXES, 3, width))
    out = np.empty((count, 2 * tables), np.int64)
    rows = np.arange(count)
    for t in range(tables):
        best, second, margin = [], [], []
        for a in range(AXES):
            x = padded
            for r in range(3):
                x = hadamard(x * signs[t, a, r])
            size_ = np.abs(x)
            first = size_.argmax(axis=1)
            top = size_[rows, first]
            size_[rows, first] = -1.0
            runner = size_.argmax(axis=1)
            best.append(2 * first + (x[rows, first] < 0))
            second.append(2 * runner + (x[rows, runner] < 0))
            margin.append(top - size_[rows, runner])
        weakest = np.argmin(np.stack(margin), axis=0)
        own, other = np.full(count, t, np.int64), np.full(count, t, np.int64)
        for a in range(AXES):
            own = own * (2 * width) + best[a]
            other = other * (2 * width) + np.where(weakest == a, second[a], best[a])
        out[:, 2 * t], out[:, 2 * t + 1] = own, other
    return out


def hashed(classes: DataFrame) -> DataFrame:
    """``node, first_id, copies, vector`` with ``size`` and the bucket ``keys`` of each vector."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            vectors = part.column(3)
            sizes, flat = np.asarray(pc.list_value_length(vectors)), np.asarray(vectors.flatten())
            starts = np.cumsum(sizes) - sizes
            numbers = np.array([2 * tables_of(n) for n in sizes.tolist()], np.int64)
            ends = np.concatenate([[0], np.cumsum(numbers)])
            keys = np.empty(ends[-1], np.int64)
            for size in np.unique(sizes):
                places = np.flatnonzero(sizes == size)
                for at in range(0, len(places), 2048):
                    some = places[at : at + 2048]
                    x = flat[starts[some][:, None] + np.arange(size)]
                    keys[ends[some][:, None] + np.arange(numbers[some[0]])] = buckets(x / np.linalg.norm(x, axis=1)[:, None])
            columns = [*part.columns, pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), keys)]
            yield pa.record_batch(columns, ["node", "first_id", "copies", "vector", "size", "keys"])

    rows = classes.select("node", "first_id", "copies", "vector")
    return rows.mapInArrow(batches, "node string, first_id long, copies long, vector array<double>, size int, keys array<bigint>")


def _compare(key: int, own: np.ndarray, nodes: list[str], copies: np.ndarray, x: np.ndarray, keys: np.ndarray, within: bool):
    """Links of one group: for each member the linked rows, and a star over each joined set."""
    x = x / np.linalg.norm(x, axis=1)[:, None]
    near = np.triu(x @ x.T >= COSINE, 1)
    if not within:
        near &= own[:, None] != own[None, :]
    a, b = np.nonzero(near)
    if not len(a):
        return
    tables = np.arange(keys.shape[1]) // 2
    here = int(np.flatnonzero((keys == key).any(axis=0))[0]) // 2
    earliest = np.full(len(a), here)
    lowest = np.full(len(a), np.iinfo(np.int64).max)
    for t in range(here + 1):  # the first table, and the smallest key in it, that hold both
        one, other = keys[a][:, tables == t], keys[b][:, tables == t]
        for i in range(2):
            for j in range(2):
                same = (one[:, i] == other[:, j]) & (earliest >= t)
                lowest = np.where(same & ((earliest > t) | (one[:, i] < lowest)), one[:, i], lowest)
                earliest = np.where(same, t, earliest)
    mine = (earliest == here) & (lowest == key)
    links = np.zeros(len(nodes), np.int64)
    np.add.at(links, a[mine], copies[b[mine]])
    np.add.at(links, b[mine], copies[a[mine]])
    parent = list(range(len(nodes)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        i, j = root(i), root(j)
        if i != j:
            parent[max(i, j)] = min(i, j)
    for i, node in enumerate(nodes):
        if links[i] or root(i) != i:
            yield node, int(links[i]), nodes[root(i)]


def linked(classes: DataFrame) -> DataFrame:
    """``node, links, head`` of ``hashed`` classes: parts of each class's links, and a class it is joined with."""
    keys = classes.select("node", "size", F.explode("keys").alias("key"))
    sizes = keys.groupBy("key", "size").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    shared = keys.join(sizes, ["key", "size"]).withColumn("blocks", blocks).withColumn("own", own)
    shared = shared.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    shared = shared.select("node", "key", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    place = ["key", "size", "low", "high"]
    full = shared.join(classes, "node").select(*place, "own", "node", "copies", "vector", "keys")
    spread = full.repartition(*place).sortWithinPartitions(*place, "node")

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # the pieces of one group, which may run over several batches
        found: list[tuple] = []

        def close() -> None:
            (key, _, low, high), pieces = held[0][0], [piece[1:] for piece in held]
            held.clear()
            own, nodes, copies, x, keys = zip(*pieces, strict=True)
            if sum(map(len, own)) > 1:
                names = [node for some in nodes for node in some]
                found.extend(_compare(key, np.concatenate(own), names, np.concatenate(copies), np.concatenate(x), np.concatenate(keys), low == high))

        def batch() -> pa.RecordBatch:
            node, links, head = zip(*found, strict=True)
            found.clear()
            return pa.record_batch([pa.array(node), pa.array(links, pa.int64()), pa.array(head)], ["node", "links", "head"])

        for part in parts:
            if not part.num_rows:
                continue
            marks = np.stack([np.asarray(part.column(c), dtype=np.int64) for c in range(4)])
            own, nodes, copies = np.asarray(part.column(4)), part.column(5).to_pylist(), np.asarray(part.column(6))
            flat, keys = np.asarray(part.column(7).flatten()), np.asarray(part.column(8).flatten())
            starts = np.concatenate([[0], np.cumsum(marks[1])])
            places = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(part.column(8))))])
            cuts = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1).tolist(), part.num_rows]
            for begin, end in zip(cuts, cuts[1:]):
                mark = tuple(marks[:, begin].tolist())
                if held and held[0][0] != mark:
                    close()
                x = flat[starts[begin] : starts[end]].reshape(end - begin, -1)
                k = keys[places[begin] : places[end]].reshape(end - begin, -1)
                held.append((mark, own[begin:end], nodes[begin:end], copies[begin:end], x, k))
            if found:
                yield batch()
        if held:
            close()
        if found:
            yield batch()

    return spread.mapInArrow(batches, "node string, links long, head string")


def near_copies(vectors: DataFrame, key: str = "vec_id", value: str = "embedding") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row.

    Vectors that are null, zero, or hold null or non-finite components, and rows with a null key, link with
    nothing and are their own component (null for a null key). Vectors of different lengths never link.
    Repeated keys give a row each; other columns are ignored; no rows give no rows.
    """
    v = F.col("vector")
    rows = vectors.select(quoted(key).cast("long").alias("vec_id"), quoted(value).cast("array<double>").alias("vector"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.withColumn("good", F.coalesce(F.col("vec_id").isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False)))
    digest = F.substring(F.sha2(F.array_join(F.transform(v, lambda x: (x + 0.0).cast("string")), ",").cast("binary"), 256), 1, 32)
    rows = rows.withColumn("node", F.when(F.col("good"), digest))
    good = rows.where("good")
    classes = good.groupBy("node").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
    classes = materialize(hashed(classes), "classes")
    found = materialize(linked(classes), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    part = components(found.select(F.col("node").alias("a"), F.col("head").alias("b")))
    labelled = classes.select("node", "first_id", "copies").join(links, "node", "left").join(part, "node", "left")
    labelled = labelled.withColumn("component", F.coalesce("component", "node"))
    heads = labelled.groupBy("component").agg(F.min("first_id").alias("component_id"))
    of = labelled.join(heads, "component").select("node", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = rows.select("vec_id", "node").join(of, "node", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
