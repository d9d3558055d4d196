"""Road network: busiest edges, contracted into named lines."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dwellgrid.functions.geo import (
    KM_PER_DEGREE,
    bankers_round,
    bearing_degrees,
    column,
    compass_direction,
    coordinate_key,
    direction_bucket,
    haversine_km,
    point_segment_km,
)
from dwellgrid.operators.nearest import cell
from dwellgrid.operators.ranking import heaviest
from dwellgrid.params import Filter
from dwellgrid.session import materialize

# Small networks are shown with at least so many lines and so many edges.
LEAST_LINES, LEAST_EDGES = 50, 250
MAX_LINE_KM = 8.0
# Length of a path that one task settles at once; many times what a chain reaches.
STRETCH_KM = 500.0
_ENDS = ("lat1", "lon1", "lat2", "lon2")
NAME_KM = 3.0
SNAP_KM = 2.0
# Cells a little over SNAP_KM high; their width follows from their latitude.
SNAP_CELL = 0.02

# Motorways as (latitude, longitude) points.
CORRIDORS = {
    "A1": ((52.36, 4.95), (52.23, 5.18), (52.20, 5.45), (52.22, 5.96), (52.24, 6.16), (52.26, 6.79)),
    "A2": ((52.37, 4.90), (52.09, 5.04), (52.02, 5.12), (51.69, 5.31), (51.44, 5.47), (51.21, 5.71), (50.85, 5.69)),
    "A4": ((52.39, 4.80), (52.17, 4.46), (52.06, 4.34), (51.91, 4.47), (51.49, 4.28)),
    "A6": ((52.33, 5.15), (52.40, 5.25), (52.52, 5.45), (52.65, 5.73), (52.77, 5.83)),
    "A7": ((52.93, 5.04), (53.04, 5.66), (53.20, 6.57), (53.19, 6.74)),
    "A9": ((52.31, 4.75), (52.29, 4.94), (52.32, 5.10)),
    "A10": ((52.39, 4.78), (52.43, 4.88), (52.39, 4.98), (52.33, 4.89), (52.36, 4.80)),
    "A12": ((52.05, 4.32), (52.07, 4.65), (52.07, 5.12), (52.05, 5.34), (52.03, 5.66), (52.00, 6.00)),
    "A15": ((51.89, 4.34), (51.88, 4.65), (51.89, 5.05), (51.87, 5.46), (51.88, 5.85)),
    "A16": ((51.92, 4.47), (51.81, 4.64), (51.59, 4.78), (51.49, 4.74)),
    "A20": ((51.96, 4.18), (51.92, 4.38), (51.92, 4.54), (51.95, 4.67)),
    "A27": ((51.58, 4.78), (51.70, 4.86), (51.89, 5.00), (52.05, 5.15), (52.22, 5.18), (52.31, 5.24)),
    "A28": ((52.09, 5.12), (52.16, 5.37), (52.35, 5.65), (52.55, 6.09), (52.69, 6.19), (52.79, 6.48)),
    "A50": ((51.66, 5.62), (51.75, 5.73), (51.93, 5.83), (52.12, 5.97), (52.24, 6.00), (52.38, 6.08)),
    "A58": ((51.43, 3.57), (51.50, 4.30), (51.56, 4.77), (51.55, 5.09), (51.44, 5.48)),
    "A67": ((51.37, 5.22), (51.39, 5.48), (51.37, 5.77), (51.34, 6.05), (51.35, 6.17)),
    "A73": ((51.83, 5.86), (51.68, 5.91), (51.44, 6.02), (51.20, 6.02), (50.88, 5.97)),
}


# --- edges -------------------------------------------------------------------------------------


def _busy_edges(edges: DataFrame, flt: Filter) -> DataFrame:
    passes = F.coalesce(F.col("n_passes"), F.col("n_vehicles")).cast("int")
    busy = edges.select("lat1", "lon1", "lat2", "lon2", F.col("n_vehicles").cast("int"), passes.alias("n_passes"))
    return busy.where(F.col("n_passes") >= max(1, flt.road_threshold))


def _target(rows: int, flt: Filter) -> int:
    return max(LEAST_LINES, ceil(rows * flt.normalized().road_top_percent / 100.0))


def top_road_edges(edges: DataFrame, flt: Filter = Filter()) -> DataFrame:
    """The busiest edges: eight times the share asked for."""
    order = [F.desc("n_vehicles"), "lat1", "lon1", "lat2", "lon2"]
    return heaviest(_busy_edges(edges, flt), "n_passes", lambda rows: max(LEAST_EDGES, 8 * _target(rows, flt)), order)


def road_heat(heat: DataFrame, flt: Filter = Filter()) -> DataFrame:
    busy = heat.where(F.col("weight") >= max(1, flt.road_threshold)).select("lat", "lon", "weight")
    share = flt.normalized().road_top_percent
    kept = heaviest(busy, "weight", lambda rows: ceil(rows * share / 100.0), ["lat", "lon"])
    return kept.orderBy(F.desc("weight"), "lat", "lon")


def enrich_road_edges(edges: DataFrame) -> DataFrame:
    """Direction, length and node keys of every edge that has a length."""
    bearing = bearing_degrees(*_ENDS)
    return (
        edges.withColumns({"bearing": bearing, "bucket": direction_bucket(bearing), "length_km": haversine_km(*_ENDS)})
        .withColumns({"start_key": coordinate_key("lat1", "lon1"), "end_key": coordinate_key("lat2", "lon2")})
        .where(F.col("length_km") > 0)
    )


# --- chains ------------------------------------------------------------------------------------


def _linked_edges(edges: DataFrame) -> DataFrame:
    """Edges with an id and the edge before them, where exactly one can be and it continues nowhere else."""
    # Copies of an edge are told apart by a number, so ids do not depend on the order of rows.
    copies = W.partitionBy(*_ENDS).orderBy(F.desc("n_passes"), F.desc("n_vehicles"))
    numbered = edges.withColumn(
        "edge_id",
        F.concat_ws("|", *[F.col(c).cast("string") for c in _ENDS], F.row_number().over(copies).cast("string")),
    ).withColumn("_mm", F.ceil(F.col("length_km") * 1e6))
    numbered = materialize(numbered, "edges")
    incoming = numbered.groupBy("bucket", F.col("end_key").alias("node")).agg(
        F.count(F.lit(1)).alias("_in"), F.min("edge_id").alias("previous_id"), F.min("_mm").alias("_previous_mm")
    )
    outgoing = numbered.groupBy("bucket", F.col("start_key").alias("node")).agg(
        F.count(F.lit(1)).alias("_out"), F.min("edge_id").alias("_next_id")
    )
    through = (
        outgoing.join(incoming, ["bucket", "node"])
        .where((F.col("_out") == 1) & (F.col("_in") == 1) & (F.col("previous_id") != F.col("_next_id")))
        .select("bucket", F.col("node").alias("start_key"), "previous_id", "_previous_mm")
    )
    return numbered.join(through, ["bucket", "start_key"], "left")


def _placed(links: DataFrame) -> DataFrame:
    """``edge_id, path, _steps, _before`` of every edge with a neighbour: place and millimetres from its path's head.

    Pointers to an edge before double their reach each step and add up what they pass, so a path of n edges
    takes about log2(n) equi-joins. While some edge has not come to its head, one comes there in every step,
    so when none does, those left lie on rings, whose smallest edge id is known by then. A ring is a path from that edge on.
    """
    joined = links.where(F.col("previous_id").isNotNull())
    heads = joined.select(F.col("previous_id").alias("edge_id")).join(joined, "edge_id", "left_anti")
    first = heads.select(
        "edge_id", F.col("edge_id").alias("to"), F.lit(0).cast("long").alias("_steps"), F.lit(0).cast("long").alias("_before"),
        F.lit(True).alias("_home"), F.col("edge_id").alias("_least"),
    )
    others = joined.select(
        "edge_id", F.col("previous_id").alias("to"), F.lit(1).cast("long").alias("_steps"), F.col("_previous_mm").alias("_before"),
        F.lit(False).alias("_home"), F.least("edge_id", "previous_id").alias("_least"),
    )
    placed = _doubled(first.unionByName(others))
    ring = placed.where(~F.col("_home"))
    if not ring.isEmpty():
        cut = ring.select("edge_id", F.col("_least").alias("_head"))
        own = joined.join(cut, "edge_id")
        opened = own.select(
            "edge_id", F.when(F.col("edge_id") == F.col("_head"), F.col("edge_id")).otherwise(F.col("previous_id")).alias("to"),
            F.when(F.col("edge_id") == F.col("_head"), 0).otherwise(1).cast("long").alias("_steps"),
            F.when(F.col("edge_id") == F.col("_head"), 0).otherwise(F.col("_previous_mm")).cast("long").alias("_before"),
            (F.col("edge_id") == F.col("_head")).alias("_home"), F.col("_head").alias("_least"),
        )
        round_ = links.join(cut, "edge_id").groupBy("_head").agg(F.sum("_mm").alias("_ring"), F.count(F.lit(1)).alias("_edges"))
        rings = _doubled(opened).join(round_.withColumnRenamed("_head", "to"), "to")
        straight = placed.where("_home").withColumns({"_ring": F.lit(None).cast("long"), "_edges": F.lit(None).cast("long")})
        placed = straight.unionByName(rings.select(*straight.columns))
    else:
        placed = placed.withColumns({"_ring": F.lit(None).cast("long"), "_edges": F.lit(None).cast("long")})
    return placed.select("edge_id", F.col("to").alias("path"), "_steps", "_before", "_ring", "_edges")


def _doubled(state: DataFrame) -> DataFrame:
    columns = state.columns

    def doubled(current: DataFrame) -> DataFrame:
        further = current.select(
            F.col("edge_id").alias("to"), F.col("to").alias("_to"), F.col("_steps").alias("_steps2"),
            F.col("_before").alias("_before2"), F.col("_home").alias("_home2"), F.col("_least").alias("_least2"),
        )
        near = F.col("_home") | F.col("_home2")  # an edge at its head points to it for good
        return current.join(further, "to").select(
            "edge_id", F.col("_to").alias("to"),
            (F.col("_steps") + F.when(F.col("_home"), 0).otherwise(F.col("_steps2"))).alias("_steps"),
            (F.col("_before") + F.when(F.col("_home"), 0).otherwise(F.col("_before2"))).alias("_before"),
            near.alias("_home"), F.least("_least", "_least2").alias("_least"),
            ((near & ~F.col("_home")) | (~near & (F.col("_least2") < F.col("_least")))).alias("_better"),
        )

    improved = True
    while improved:
        # Two steps per stored table; the second tells whether there is more to find.
        step = Observation()
        watched = doubled(doubled(state).drop("_better")).observe(step, F.count_if("_better").alias("better"))
        state = materialize(watched, "reach").drop("_better")
        improved = step.get["better"] > 0
    return state.select(*columns)


def _settle_stretches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``edge_id, chain_id, pos`` from rows in order of path, stretch and place, each stretch when its last row is there.

    A call per stretch costs far more than most stretches do, so all that lie in a batch of rows are settled together.
    What is held is a batch and the one stretch that goes on after it.
    """
    held = None
    for batch in batches:
        rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
        starts = _starts(rows)
        held = rows.iloc[starts[-1] :] if starts else None
        if len(starts) > 1:
            yield _settle_rows(rows.iloc[: starts[-1]], starts)
    if held is not None:
        yield _settle_rows(held, [0, len(held)])


def _starts(rows: pd.DataFrame) -> list[int]:
    """Where stretches begin."""
    path, stretch = rows["path"].to_numpy(), rows["_stretch"].to_numpy()
    changes = (path[1:] != path[:-1]) | (stretch[1:] != stretch[:-1])
    return [0, *(np.flatnonzero(changes) + 1).tolist()] if len(rows) else []


def _settle_rows(rows: pd.DataFrame, bounds: list[int]) -> pd.DataFrame:
    ids = rows["edge_id"].tolist()
    rank = list(zip(-rows["n_passes"], -rows["n_vehicles"], *[rows[c] for c in _ENDS], ids, strict=True))
    names = ("length_km", "_steps", "_closed", "_edges", "_open_before", "_open_after")
    values = [rows[c].tolist() for c in names]
    chains, places = [], []
    for a, b in zip(bounds, bounds[1:], strict=False):
        chain, place = _settle(rank[a:b], *[v[a:b] for v in values])
        chains += [ids[a + c] if c >= 0 else None for c in chain]
        places += [p if c >= 0 else None for c, p in zip(chain, place, strict=True)]
    return pd.DataFrame({"edge_id": ids, "chain_id": chains, "pos": pd.array(places, dtype="Int32")})


def _settle(
    rank: list[tuple], length: list[float], steps: list[int], closed: list[bool], edges: list, open_before: list[bool], open_after: list[bool]
) -> tuple[list[int], list[int]]:
    """What is certain of the chains in one stretch of a path: chain (its first edge) and place of each edge, -1 where open.

    Edges come in falling priority. One that is left grows a chain, first backward, then forward, while it stays
    short. Beyond an open end of the stretch everything is possible: edges that a chain from there could take, and
    all that the chain of such an edge could take in turn, are doubtful. A chain that meets a doubtful edge is so, too.
    """
    n = len(rank)
    around = edges[0] - 1  # the last place of a ring, which the first follows
    before = [i - 1 if i and steps[i] in (steps[i - 1] + 1, steps[i - 1] - around) else -1 for i in range(n)]
    if closed[0]:
        before[0] = n - 1
    after = [-1] * n
    for i, j in enumerate(before):
        if j >= 0:
            after[j] = i
    doubtful, chain, place = [False] * n, [-1] * n, [0] * n

    def full(km: float, i: int) -> bool:
        return km >= 1.0 and km + length[i] > MAX_LINE_KM

    def doubt(i: int, way: list[int], km: float) -> None:
        first = i
        while i >= 0 and chain[i] < 0 and not (km >= 1.0 + 1e-6 and km + length[i] > MAX_LINE_KM + 1e-6):
            doubtful[i] = True
            km += length[i]
            i = way[i]
            if i == first:
                return

    if open_before[0]:
        doubt(0, after, 0.0)
    if open_after[n - 1]:
        doubt(n - 1, before, 0.0)
    for seed in sorted(range(n), key=rank.__getitem__):
        if chain[seed] >= 0:
            continue
        members, km, sure = [seed], length[seed], not doubtful[seed]
        for back in (True, False):
            way = before if back else after
            i = way[seed]
            while sure and i >= 0 and chain[i] < 0 and i not in members and not full(km, i):
                if doubtful[i]:
                    sure = False
                    break
                members = [i, *members] if back else [*members, i]
                km += length[i]
                i = way[i]
        if sure:
            for at, i in enumerate(members):
                chain[i], place[i] = seed, at
        else:
            doubt(seed, before, 0.0)
            doubt(seed, after, 0.0)
    return chain, place


def contract_road_chains(edges: DataFrame, stretch_km: float = STRETCH_KM) -> DataFrame:
    """Edges with the chain they belong to and their place in it.

    Chains run through nodes with one edge in and one out of the same direction; the busiest edge left grows the
    next one. Chains are short, so what is far apart on a path does not matter: each path is cut into stretches, every
    stretch settles by itself what cannot depend on others, and what is still open is tried again with the
    cuts half a stretch further. Paths cost no more than stretches do, and mostly two rounds settle all. An edge without
    a neighbour is a chain by itself.
    """
    links = materialize(_linked_edges(edges), "links")
    placed = materialize(_placed(links), "placed")
    alone = links.join(placed, "edge_id", "left_anti").select("edge_id", F.col("edge_id").alias("chain_id"), F.lit(0).alias("pos"))
    fields = ["edge_id", "length_km", "n_passes", "n_vehicles", *_ENDS, "_mm", "_previous_mm"]
    follows = F.col("_ring").isNotNull() | (F.col("_steps") > 0)
    last = placed.groupBy("path").agg(F.max("_steps").alias("_last"))
    todo = placed.join(links.select(*fields), "edge_id").join(last, "path")
    todo = materialize(todo.withColumns({"_follows": follows, "_goes_on": F.col("_ring").isNotNull() | (F.col("_steps") < F.col("_last"))}), "paths")
    size, shift = int(stretch_km * 1e6), 0
    done = alone
    while True:
        x = F.col("_before") + F.lit(shift)
        x = F.coalesce(F.pmod(x, F.col("_ring")), x)
        at = todo.withColumn("_x", x).withColumn("_stretch", F.floor(F.col("_x") / size))
        closed = F.coalesce(F.col("_ring") <= size, F.lit(False))
        back, on = F.col("_x") - F.coalesce("_previous_mm", F.lit(0)), F.col("_x") + F.col("_mm")
        cut = at.withColumns(
            {
                "_closed": closed,
                "_open_before": F.col("_follows") & ~closed & ((back < 0) | (F.floor(back / size) != F.col("_stretch"))),
                "_open_after": F.col("_goes_on") & ~closed & ((F.floor(on / size) != F.col("_stretch")) | F.coalesce(on >= F.col("_ring"), F.lit(False))),
            }
        )
        cut = cut.withColumn("_stretch", F.when(closed, 0).otherwise(F.col("_stretch")))
        ordered = cut.repartition("path", "_stretch").sortWithinPartitions("path", "_stretch", "_x")
        settled = ordered.mapInPandas(_settle_stretches, "edge_id string, chain_id string, pos int")
        settled = materialize(settled, "settled")
        done = done.unionByName(settled.where("chain_id is not null"))
        open_ = settled.where("chain_id is null").select("edge_id")
        if open_.isEmpty():
            break
        todo = materialize(todo.join(open_, "edge_id", "left_semi"), "paths")
        shift += size // 2
    return links.drop("previous_id", "_previous_mm", "_mm").join(done, "edge_id")


def split_road_chains(chains: DataFrame) -> DataFrame:
    """Number the pieces of chains that grew too long. A chain is at most about 8 km of edges."""
    rows = F.array_sort(F.collect_list(F.struct("pos", F.struct(*chains.columns).alias("edge"))))
    start = F.struct(F.lit(0).alias("number"), F.lit(0.0).alias("km"), F.array().cast("array<int>").alias("numbers"))

    def visit(state: Column, row: Column) -> Column:
        length = row["edge"]["length_km"]
        full = (state["km"] >= 1.0) & (state["km"] + length > MAX_LINE_KM)
        number = F.when(full, state["number"] + 1).otherwise(state["number"])
        km = F.when(full, length).otherwise(state["km"] + length)
        return F.struct(
            number.alias("number"), km.alias("km"), F.concat(state["numbers"], F.array(number)).alias("numbers")
        )

    folded = chains.groupBy("chain_id").agg(rows.alias("_rows")).select(
        "_rows", F.aggregate("_rows", start, visit, lambda state: state["numbers"]).alias("_numbers")
    )
    numbered = F.explode(F.arrays_zip(F.col("_rows"), F.col("_numbers"))).alias("_x")
    return folded.select(numbered).select("_x._rows.edge.*", F.col("_x._numbers").alias("segment_no"))


# --- lines -------------------------------------------------------------------------------------


def simplify_polyline(points: str | Column, most: int = 80, aim: int = 78) -> Column:
    """More than ``most`` points: every n-th and the last."""
    points = F.col(points) if isinstance(points, str) else points

    def thinned(line: Column) -> Column:
        count = F.size(line)
        step = F.ceil(count / float(aim)).cast("int")
        places = F.sequence(F.lit(0), count - 1, step)
        kept = F.transform(F.when((count - 1) % step == 0, places).otherwise(F.concat(places, F.array(count - 1))), lambda i: F.get(line, i))
        return F.when(count <= most, line).otherwise(kept)

    # A lambda evaluates whatever it names for each entry: the line gets a name, so that it is made once.
    return F.get(F.transform(F.array(points), thinned), F.lit(0))


def road_name(lat, lon) -> Column:
    """The motorway within 3 km, else a name from the coordinates. The motorways are constants."""
    lat, lon = column(lat), column(lon)
    pieces = [
        F.struct(
            *[F.lit(v).alias(end) for end, v in zip(_ENDS, (*points[i], *points[i + 1]), strict=True)],
            F.lit(number).alias("number"),
            F.lit(name).alias("name"),
        )
        for number, (name, points) in enumerate(CORRIDORS.items())
        for i in range(len(points) - 1)
    ]
    best = F.array_min(_measured(lat, lon, F.array(*pieces)))
    return F.when(best["km"] <= NAME_KM, best["name"]).otherwise(
        F.format_string("Wegvlak bij %.3f, %.3f", lat, lon)
    )


def _measured(lat: Column, lon: Column, pieces: Column) -> Column:
    """Distance to each constant segment: ``point_segment_km``, one step per transform.

    A lambda evaluates whatever it repeats, so values used more than once get a step of their own.
    """
    scaled = F.transform(
        pieces,
        lambda p: F.struct(
            p.alias("p"), (KM_PER_DEGREE * F.cos(F.radians((lat + p["lat1"] + p["lat2"]) / 3.0))).alias("k")
        ),
    )
    placed = F.transform(
        scaled,
        lambda s: F.struct(
            s["p"].alias("p"),
            ((s["p"]["lon2"] - s["p"]["lon1"]) * s["k"]).alias("dx"),
            ((s["p"]["lat2"] - s["p"]["lat1"]) * KM_PER_DEGREE).alias("dy"),
            ((lon - s["p"]["lon1"]) * s["k"]).alias("x"),
            ((lat - s["p"]["lat1"]) * KM_PER_DEGREE).alias("y"),
        ),
    )
    shared = F.transform(
        placed,
        lambda s: F.struct(
            s.alias("s"),
            F.least(
                F.lit(1.0),
                F.greatest(
                    F.lit(0.0), (s["x"] * s["dx"] + s["y"] * s["dy"]) / (s["dx"] * s["dx"] + s["dy"] * s["dy"])
                ),
            ).alias("t"),
        ),
    )
    return F.transform(
        shared,
        lambda s: F.struct(
            F.hypot(s["s"]["x"] - s["t"] * s["s"]["dx"], s["s"]["y"] - s["t"] * s["s"]["dy"]).alias("km"),
            s["s"]["p"]["number"].alias("number"),
            s["s"]["p"]["name"].alias("name"),
        ),
    )


def infer_road_name(lines: DataFrame) -> DataFrame:
    middle = ((F.col("lat1") + F.col("lat2")) / 2.0, (F.col("lon1") + F.col("lon2")) / 2.0)
    return lines.withColumn("road_name", road_name(*middle))


def road_lines(pieces: DataFrame, limit: int | None = None) -> DataFrame:
    """One line per chain piece, busiest first. A piece is at most about 8 km of edges long."""
    point = F.struct(F.col("pos"), F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
    grouped = pieces.groupBy("chain_id", "segment_no").agg(
        F.array_sort(F.collect_list(point)).alias("_edges"),
        F.max("n_vehicles").alias("unique_vehicles"),
        F.max("n_passes").alias("passes"),
        bankers_round(F.sum("length_km"), 2).alias("length_km"),
        F.count(F.lit(1)).cast("int").alias("raw_segments"),
    )
    start = F.get("_edges", F.lit(0))
    points = F.concat(
        F.array(F.struct(start["lat1"].alias("lat"), start["lon1"].alias("lon"))),
        F.transform("_edges", lambda e: F.struct(e["lat2"].alias("lat"), e["lon2"].alias("lon"))),
    )
    shaped = grouped.withColumn("coordinates", simplify_polyline(points))
    first, last = F.get("coordinates", F.lit(0)), F.element_at("coordinates", -1)
    shaped = shaped.withColumns(
        {"_lat1": first["lat"], "_lon1": first["lon"], "_lat2": last["lat"], "_lon2": last["lon"]}
    )
    bearing = bearing_degrees("_lat1", "_lon1", "_lat2", "_lon2")
    mid_lat, mid_lon = (F.col("_lat1") + F.col("_lat2")) / 2.0, (F.col("_lon1") + F.col("_lon2")) / 2.0
    segment = F.format_string(
        "weg:%d:%.3f:%.3f:%d",
        direction_bucket(bearing), bankers_round(mid_lat, 3), bankers_round(mid_lon, 3), F.col("raw_segments"),
    )
    reach = F.least(F.lit(20.0), F.greatest(F.lit(1.5), F.col("length_km") / 2.0 + 1.5))
    lines = shaped.select(
        segment.alias("segment_id"),
        *[bankers_round(f"_{end}", 6).alias(end) for end in ("lat1", "lon1", "lat2", "lon2")],
        "unique_vehicles",
        "passes",
        road_name(mid_lat, mid_lon).alias("road_name"),
        compass_direction(direction_bucket(bearing)).alias("direction"),
        bankers_round(bearing, 0).alias("bearing"),
        "length_km",
        "raw_segments",
        bankers_round(reach, 2).alias("radius_km"),
        "coordinates",
    )
    return _busiest_lines(lines, limit)


def _busiest_lines(lines: DataFrame, limit: int | None) -> DataFrame:
    """The lines by how busy they are, the first ``limit`` of them or all."""
    order = [F.desc("unique_vehicles"), "segment_id", "lat1", "lon1"]
    kept = lines if limit is None else heaviest(materialize(lines, "lines"), "passes", lambda _: limit, order)
    return kept.orderBy(F.desc("passes"), *order)


def road_map(edges: DataFrame, flt: Filter = Filter()) -> DataFrame:
    """From raw edges of one variant to the busiest lines, which are built from the whole network."""
    busy = materialize(_busy_edges(edges, flt), "edges")
    lines = max(LEAST_LINES, ceil(_target(busy.count(), flt) / 6.0))
    return road_lines(split_road_chains(contract_road_chains(enrich_road_edges(busy))), lines)


def dashboard_roads(lines: DataFrame, limit: int | None = None) -> DataFrame:
    """The lines by how busy they are, the first ``limit`` of them or all."""
    return _busiest_lines(lines, limit)


def corridors(lines: DataFrame) -> DataFrame:
    """Lines by rough place: the upper median and highest passes, and how far they spread."""
    keyed = lines.withColumns(
        {
            "lat": bankers_round((F.col("lat1") + F.col("lat2")) / 2.0, 2),
            "lon": bankers_round((F.col("lon1") + F.col("lon2")) / 2.0, 2),
        }
    )
    # The upper median: the row half-way, counted within its group.
    place = W.partitionBy("lat", "lon")
    position = F.row_number().over(place.orderBy("passes", "segment_id"))
    size = F.count(F.lit(1)).over(place)
    ranked = keyed.withColumn("_middle", F.when(position == F.floor(size / 2) + 1, F.col("passes")))
    grouped = ranked.groupBy("lat", "lon").agg(
        F.max("_middle").alias("median_passes"),
        F.max("passes").alias("max_passes"),
        F.max("unique_vehicles").alias("max_vehicles"),
        F.min(F.least("lat1", "lat2")).alias("_south"),
        F.min(F.least("lon1", "lon2")).alias("_west"),
        F.max(F.greatest("lat1", "lat2")).alias("_north"),
        F.max(F.greatest("lon1", "lon2")).alias("_east"),
        F.count(F.lit(1)).alias("segments"),
    )
    spread = bankers_round(haversine_km("_south", "_west", "_north", "_east"), 1)
    top = grouped.orderBy(F.desc("median_passes"), F.desc("max_vehicles"), "lat", "lon").limit(20)
    # Twenty rows at most.
    rank = F.row_number().over(W.orderBy(F.desc("median_passes"), F.desc("max_vehicles"), "lat", "lon"))
    return top.select(
        rank.alias("rank"), "lat", "lon", "median_passes", "max_passes", "max_vehicles",
        spread.alias("spread_km"), "segments",
    )


def search_road_lines(
    lines: DataFrame, text: str = "", sort: str = "passes", descending: bool = True, limit: int | None = None
) -> DataFrame:
    """Lines whose name, direction or coordinates contain a text, the first ``limit`` of them or all."""
    mid = ((F.col("lat1") + F.col("lat2")) / 2.0, (F.col("lon1") + F.col("lon2")) / 2.0)
    label = F.format_string("%.3f, %.3f", *mid)
    fallback = F.concat(F.lit("Wegvlak bij "), label)
    name = F.coalesce(F.nullif(F.trim("road_name"), F.lit("")), fallback)
    wanted = text.strip().upper()
    if wanted:
        shown = [F.upper(value).contains(wanted) for value in (name, F.col("direction"), label)]
        lines = lines.where(shown[0] | shown[1] | shown[2])

    def way(value: Column) -> Column:
        return value.desc() if descending else value.asc()

    passes, vehicles = F.col("passes"), F.col("unique_vehicles")
    order = {
        "vehicles": [way(vehicles), way(passes)],
        "name": [way(F.upper(name)), passes.desc()],
        "length": [way(F.col("length_km")), passes.desc()],
    }.get(sort, [way(passes), way(vehicles)])
    ranked = lines.orderBy(*order, "segment_id", "lat1", "lon1")
    return ranked if limit is None else ranked.limit(limit)


def _snap_width(row: str) -> Column:
    """Degrees of longitude that SNAP_KM takes at most in a row of cells; near a pole the row is one cell."""
    edge = (F.abs(F.col(row)) + 2) * SNAP_CELL
    return F.when(edge > 89.0, 400.0).otherwise(SNAP_CELL / F.cos(F.radians(edge)))


def segment_cells(segments: DataFrame) -> DataFrame:
    """Each segment ``a``, ``b`` once per cell (``_x``, ``_y``) that it comes near.

    It is clipped to every row of cells and the rows next to it, so a segment enters a few cells per row it
    crosses, however it lies, not all cells of its bounding box.
    """
    low, high = F.least("a.lat", "b.lat"), F.greatest("a.lat", "b.lat")
    rows = segments.withColumn("_x", F.explode(F.sequence(cell(low, SNAP_CELL) - 1, cell(high, SNAP_CELL) + 1)))
    rise = F.col("b.lat") - F.col("a.lat")

    def along(lat: Column, level: float) -> Column:
        """Share of the segment at a latitude, held to the segment; ``level`` where it follows a parallel."""
        share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (lat - F.col("a.lat")) / F.nullif(rise, F.lit(0.0))))
        return F.when(rise == 0, level).otherwise(share)

    # What is near a place in the row lies in it or one row further on.
    south, north = (F.col("_x") - 1) * SNAP_CELL, (F.col("_x") + 2) * SNAP_CELL
    ends = [F.col("a.lon") + along(lat, level) * (F.col("b.lon") - F.col("a.lon")) for lat, level in ((south, 0.0), (north, 1.0))]
    width = _snap_width("_x")
    columns = F.sequence(cell(F.least(*ends), width) - 1, cell(F.greatest(*ends), width) + 1)
    return rows.withColumn("_y", F.explode(columns))


def snap_to_road(lines: DataFrame, roads: DataFrame) -> DataFrame:
    """Draw demand lines along the nearest road within 2 km; lines without one are left out.

    Road segments are entered in every cell they come near, so a line looks in its own cell only. Segments travel with
    the number of their road; its shape is joined to what was chosen.
    """
    centre = ((F.col("lat1") + F.col("lat2")) / 2.0, (F.col("lon1") + F.col("lon2")) / 2.0)
    here = lines.withColumns({"_lat": centre[0], "_lon": centre[1]})
    here = here.withColumn("_x", cell("_lat", SNAP_CELL)).withColumn("_y", cell("_lon", _snap_width("_x")))
    pairs = F.arrays_zip(
        F.slice("coordinates", F.lit(1), F.size("coordinates") - 1).alias("a"),
        F.slice("coordinates", F.lit(2), F.size("coordinates") - 1).alias("b"),
    )
    numbered = roads.select(F.col("segment_id").alias("road_id"), "coordinates", F.monotonically_increasing_id().alias("_road"))
    numbered = materialize(numbered, "roads")
    segments = numbered.select("road_id", "_road", F.posexplode(pairs).alias("_no", "_pair")).select("road_id", "_road", "_no", "_pair.*")
    km = point_segment_km("_lat", "_lon", F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon"))
    best = (
        here.select("segment_id", "_lat", "_lon", "_x", "_y")
        .join(segment_cells(segments), ["_x", "_y"])
        .withColumn("_km", km)
        .where(F.col("_km") <= SNAP_KM)
        .groupBy("segment_id")
        .agg(F.min_by("_road", F.struct("_km", "road_id", "_no", "_road")).alias("_road"))
    )
    return (
        here.drop("_lat", "_lon", "_x", "_y")
        .join(best, "segment_id")
        .join(numbered, "_road")
        .select(*lines.columns, "road_id", "coordinates")
    )
