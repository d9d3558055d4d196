"""Operators against brute force on random data."""

from __future__ import annotations

import random
from math import asin, cos, radians, sin, sqrt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dwellgrid.functions import geo, text
from dwellgrid.operators import aggregates, breaks, nearest, roads
from dwellgrid.operators.ranking import heaviest
from dwellgrid.params import Breaks, Filter, Power
from dwellgrid.session import materialize


def km_between(lat1, lon1, lat2, lon2):
    a, b = sin(radians(lat2 - lat1) / 2) ** 2, sin(radians(lon2 - lon1) / 2) ** 2
    return 2 * 6371 * asin(sqrt(a + cos(radians(lat1)) * cos(radians(lat2)) * b))


def test_quantiles(spark):
    draw = random.Random(5)
    values = {
        "few": [3.0],
        "equal": [7.5] * 20,
        "mixed": [draw.choice((-40.0, -1e-9, 0.0, 1e-12, draw.random(), draw.random() * 1e6)) for _ in range(501)],
        "pairs": [1.0, 2.0] * 10 + [2.0],
    }
    rows = [(k, v) for k, listed in values.items() for v in listed] + [("mixed", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    points = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    for row in aggregates.quantiles(df, ["k"], "v", points).collect():
        for name, q in points.items():
            assert row[name] == pytest.approx(np.quantile(values[row.k], q), abs=1e-9)
    overall = aggregates.quantiles(df, [], "v", {"m": 0.5}).first()
    assert overall.m == pytest.approx(np.quantile([v for listed in values.values() for v in listed], 0.5))


def test_modes_and_lists(spark):
    rows = [("a", " x "), ("a", "X"), ("a", "b"), ("a", "B"), ("a", ""), ("a", None), ("b", "z"), ("b", "q"), ("b", "q")]
    df = spark.createDataFrame(rows, "k string, v string")
    assert {r.k: r.m for r in aggregates.mode_text(df, ["k"], "v", "m").collect()} == {"a": "B", "b": "q"}
    assert {r.k: r.m for r in aggregates.mode_value(df, ["k"], "v", "m").collect()} == {"a": "", "b": "q"}
    many = spark.createDataFrame([("g", f"W{n}") for n in range(9)] + [("g", "w0")], "k string, v string")
    row = aggregates.first_values(many, ["k"], "v", "codes", 3).first()
    assert (row.codes, row.codes_count) == (["W0", "W1", "W2"], 9)
    shown = many.select(text.compact_list(F.lit(row.codes), F.lit(row.codes_count), 3).alias("s")).first().s
    assert shown == "W0, W1, W2 +6"


def test_nearest(spark):
    draw = random.Random(9)
    points = [(f"p{n}", 50 + draw.random() * 4, 3 + draw.random() * 5) for n in range(60)]
    points += [("far", -40.0, 170.0), ("north", 78.0, 15.0), ("line", 10.0, 179.9)]
    targets = [(50 + draw.random() * 4, 3 + draw.random() * 5) for _ in range(25)] + [(77.5, 20.0), (10.0, -179.9)]
    found = nearest.nearest_km(
        spark.createDataFrame(points, "id string, lat double, lon double"),
        "id",
        spark.createDataFrame(targets, "lat double, lon double"),
    )
    result = {r.id: r.km for r in found.collect()}
    assert len(result) == len(points)
    for name, lat, lon in points:
        assert result[name] == pytest.approx(min(km_between(lat, lon, *t) for t in targets), abs=1e-6)


def test_no_charger_at_all(spark):
    depots = spark.createDataFrame([("d", 52.0, 5.0)], "depot_id string, lat double, lon double")
    chargers = spark.createDataFrame([("Privaat", 52.0, 5.0)], "access string, lat double, lon double")
    assert nearest.nearest_charger(depots, chargers).first().nearest_charger_km == -1.0


@pytest.mark.parametrize("radius", [0.1, 0.75, 5.0])
def test_moves_near_a_reset_location(spark, radius):
    draw = random.Random(int(radius * 100))
    resets = [(round(lat + draw.random() * 0.2, 3), round(5 + draw.random() * 0.2, 3)) for lat in (0.0, 52.0, 69.0, 83.0) for _ in range(12)]
    spread = radius / 60
    moves = []
    for lat, lon in resets * 4:
        a, b, c, d = (draw.uniform(-spread, spread) for _ in range(4))
        moves.append((lat + a, lon + b, lat + c, lon + d))
    df = spark.createDataFrame(moves, "prev_lat double, prev_lon double, start_lat double, start_lon double")
    near = breaks._near_resets(df, spark.createDataFrame(resets, "lat double, lon double"), radius)
    expected = [
        m for m in moves if any(km_between(*m[:2], *r) <= radius and km_between(*m[2:], *r) <= radius for r in resets)
    ]
    assert sorted(tuple(r) for r in near.collect()) == sorted(expected)
    assert 0 < len(expected) < len(moves)


def _walk(edges):
    """Chains by following the rule edge by edge: edges are (lat1, lon1, lat2, lon2, vehicles, passes)."""
    def key(lat, lon):
        return f"{lat:.5f}:{lon:.5f}"

    def bucket(e):
        p1, p2, turn = radians(e[0]), radians(e[2]), radians(e[3]) - radians(e[1])
        bearing = (np.degrees(np.arctan2(sin(turn) * cos(p2), cos(p1) * sin(p2) - sin(p1) * cos(p2) * cos(turn))) + 360) % 360
        return int(((bearing + 22.5) % 360) // 45)

    out, into = {}, {}
    for i, e in enumerate(edges):
        out.setdefault((bucket(e), key(e[0], e[1])), []).append(i)
        into.setdefault((bucket(e), key(e[2], e[3])), []).append(i)
    length = [km_between(*e[:4]) for e in edges]
    seen, chains = set(), []
    for seed in sorted(range(len(edges)), key=lambda i: (-edges[i][5], -edges[i][4], edges[i][:4])):
        if seed in seen:
            continue
        chain = [seed]
        seen.add(seed)
        for back in (True, False):
            while True:
                tip = edges[chain[0] if back else chain[-1]]
                node = (bucket(tip), key(*(tip[:2] if back else tip[2:4])))
                if len(into.get(node, [])) != 1 or len(out.get(node, [])) != 1:
                    break
                n = (into if back else out)[node][0]
                total = sum(length[i] for i in chain)
                if n in seen or (total >= 1 and total + length[n] > 8):
                    break
                chain.insert(0, n) if back else chain.append(n)
                seen.add(n)
        chains.append([edges[i][:4] for i in chain])
    return sorted(chains)


def _grid(seed, size):
    """Long straight streets with junctions, gaps and both directions; passes differ everywhere."""
    draw = random.Random(seed)
    passes = draw.sample(range(1, 10_000), 4 * size * size)
    edges = []
    for row in range(size):
        for col in range(size):
            lat, lon = round(52 + row * 0.02, 5), round(5 + col * 0.02, 5)
            for dlat, dlon in ((0, 0.02), (0, -0.02), (0.02, 0), (0.02, 0.02)):
                if draw.random() < 0.6:
                    edges.append((lat, lon, round(lat + dlat, 5), round(lon + dlon, 5), draw.randrange(1, 9), passes.pop()))
    return edges


def _ring(points, start):
    """A closed ring of short edges that all point the same way cannot exist; a two-edge shuttle can repeat."""
    return [(52.0, 5.0 + 0.001 * i, 52.0, 5.0 + 0.001 * (i + 1), 1, start + i) for i in range(points)]


def _chained(spark, edges, **options):
    df = spark.createDataFrame(edges, "lat1 double, lon1 double, lat2 double, lon2 double, n_vehicles int, n_passes int")
    chains = materialize(roads.contract_road_chains(roads.enrich_road_edges(df), **options), "test-chains")
    rows = {}
    for r in chains.collect():
        rows.setdefault(r.chain_id, []).append((r.pos, (r.lat1, r.lon1, r.lat2, r.lon2)))
    assert all(sorted(p for p, _ in chain) == list(range(len(chain))) for chain in rows.values())
    return chains, sorted([e for _, e in sorted(chain)] for chain in rows.values())


@pytest.mark.parametrize("edges", [_grid(1, 6), _grid(2, 9), [tuple(round(v, 5) if i < 4 else v for i, v in enumerate(e)) for e in _ring(150, 5)]])
def test_road_chains(spark, edges):
    chains, found = _chained(spark, edges)
    assert found == _walk(edges)
    pieces = roads.split_road_chains(chains)
    assert pieces.count() == len(edges)
    lines = roads.road_lines(pieces).collect()
    assert sum(line.raw_segments for line in lines) == len(edges)
    assert max(line.passes for line in lines) == max(e[5] for e in edges)


def _roads(seed, passes):
    """Straight roads of uneven edges, each far longer than a stretch; ``passes`` of the n-th edge of a road."""
    draw = random.Random(seed)
    edges = []
    for road in range(3):
        lon = 5.0
        for n in range(260):
            step = draw.choice((0.002, 0.01, 0.03, 0.03, 0.2 if draw.random() < 0.05 else 0.02))
            nxt = round(lon + step, 5)
            edges.append((50.0 + road, lon, 50.0 + road, nxt, 1, passes(draw, n)))
            lon = nxt
    return edges


@pytest.mark.parametrize("passes", [lambda d, n: 7, lambda d, n: 1000 - n, lambda d, n: n, lambda d, n: d.randrange(1, 9), lambda d, n: d.randrange(1, 10_000)])
def test_chains_do_not_depend_on_where_a_path_is_cut(spark, passes):
    edges = _roads(8, passes)
    assert _chained(spark, edges, stretch_km=60.0)[1] == _walk(edges)


def test_a_ring_and_an_edge_onto_itself(spark):
    """Around the globe eastwards, and an edge so short that it begins and ends in one node."""
    around = [(60.0, round(-180 + 0.5 * i, 5), 60.0, round(-179.5 + 0.5 * i, 5) if i < 719 else -180.0, 1, 3 + i * 7 % 11) for i in range(720)]
    small = [(10.0, 10.0, 10.0, 10.000001, 1, 5)]
    assert _chained(spark, around + small)[1] == _walk(around + small)


def test_a_path_of_many_edges_is_many_tasks(spark):
    n = 200_000
    at = (F.col("id") * 0.0015).alias("lon")
    # Sixteen rounds around the globe, each on a latitude of its own; what is passed most is anywhere.
    df = spark.range(0, n, 1, 16).select(
        F.lit(40.0).alias("lat1"), F.round(at, 5).alias("lon1"), F.lit(40.0).alias("lat2"), F.round(at + 0.0015, 5).alias("lon2"),
        F.lit(1).alias("n_vehicles"), (F.pmod(F.xxhash64("id"), F.lit(50)) + 1).cast("int").alias("n_passes"),
    )
    chains = materialize(roads.contract_road_chains(roads.enrich_road_edges(df)), "test-chains")
    sizes = chains.groupBy("chain_id").agg(F.sum("length_km").alias("km"), F.max("pos").alias("last"), F.count(F.lit(1)).alias("n"))
    total, longest, gaps = sizes.agg(F.sum("n"), F.max("km"), F.count_if(F.col("last") != F.col("n") - 1)).first()
    assert total == n and longest <= 8.0 and gaps == 0


@pytest.mark.parametrize("keep", [0, 1, 7, 60, 199, 200, 500])
def test_the_heaviest_rows(spark, keep):
    draw = random.Random(keep)
    rows = [(draw.choice((1.5, 2.0, 2.0, 2.0, 9.25)), n) for n in range(200)]
    df = spark.createDataFrame(rows, "w double, id int").repartition(5)
    got = sorted(tuple(r) for r in heaviest(df, "w", lambda total: keep, ["id"]).collect())
    assert got == sorted(sorted(rows, key=lambda r: (-r[0], r[1]))[:keep])


def test_long_chain_is_cut(spark):
    edges = [(52.0, 5.0 + 0.04 * i, 52.0, 5.04 + 0.04 * i, 1, 1) for i in range(9)]
    df = spark.createDataFrame(edges, "lat1 double, lon1 double, lat2 double, lon2 double, n_vehicles int, n_passes int")
    enriched = roads.enrich_road_edges(df)
    one = enriched.withColumns({"chain_id": F.lit("c"), "pos": F.round((F.col("lon1") - 5.0) / 0.04).cast("int")})
    numbers = [r.segment_no for r in roads.split_road_chains(one).orderBy("pos").collect()]
    assert numbers == [0, 0, 1, 1, 2, 2, 3, 3, 4]


def test_ring_components(spark):
    ids = [f"e{n:03d}" for n in range(37)]
    ring = [(ids[i], ids[i - 1]) for i in range(37)]
    path = [(f"p{n:03d}", f"p{n - 1:03d}" if n else None) for n in range(21)]
    links = spark.createDataFrame(ring + path + [("alone", None)], "edge_id string, previous_id string")
    links = links.withColumns({"_mm": F.lit(10), "_previous_mm": F.when(F.col("previous_id").isNotNull(), 10)})
    found = {r.edge_id: (r.path, r._steps, r._before, r._ring) for r in roads._placed(links).collect()}
    expected = {e: ("e000", i, 10 * i, 370) for i, e in enumerate(ids)} | {e: ("p000", i, 10 * i, None) for i, (e, _) in enumerate(path)}
    assert found == expected


def test_road_names(spark):
    draw = random.Random(4)
    spots = [(51 + draw.random() * 2, 4 + draw.random() * 2.5) for _ in range(60)] + [(52.36, 4.95), (40.0, 5.0)]
    df = spark.createDataFrame(spots, "lat double, lon double").withColumn("name", roads.road_name("lat", "lon"))
    for name, points in roads.CORRIDORS.items():
        near = [
            geo.point_segment_km("lat", "lon", *points[i], *points[i + 1]) for i in range(len(points) - 1)
        ]
        df = df.withColumn(f"km_{name}", F.least(*near))
    for row in df.collect():
        best = min(roads.CORRIDORS, key=lambda n: row[f"km_{n}"])
        expected = best if row[f"km_{best}"] <= 3 else f"Wegvlak bij {row.lat:.3f}, {row.lon:.3f}"
        assert row.name == expected


def test_snap_to_road(spark):
    lines = [("near", 52.0, 5.0, 52.01, 5.0), ("far", 53.0, 5.0, 53.01, 5.0), ("long", 52.5, 5.5, 52.5, 5.5)]
    demand = spark.createDataFrame(lines, "segment_id string, lat1 double, lon1 double, lat2 double, lon2 double")
    shapes = [
        ("road-a", [(52.0, 5.01), (52.02, 5.01)]),
        ("road-b", [(51.9, 5.02), (52.1, 5.02)]),
        ("road-c", [(52.4, 5.0), (52.6, 6.0)]),
    ]
    known = spark.createDataFrame(shapes, "segment_id string, coordinates array<struct<lat:double,lon:double>>")
    snapped = {r.segment_id: r.road_id for r in roads.snap_to_road(demand, known).collect()}
    assert snapped == {"near": "road-a", "long": "road-c"}


def test_search_and_corridors(spark):
    rows = [
        (f"s{n}", 52.0 + n / 1000, 5.0, 52.0, 5.0, 10 - n, n + 1, "A1" if n % 2 else "", "richting oosten", float(n))
        for n in range(6)
    ]
    lines = spark.createDataFrame(
        rows,
        "segment_id string, lat1 double, lon1 double, lat2 double, lon2 double, unique_vehicles int, passes int, "
        "road_name string, direction string, length_km double",
    )
    assert [r.segment_id for r in roads.search_road_lines(lines, "a1").collect()] == ["s5", "s3", "s1"]
    assert [r.segment_id for r in roads.search_road_lines(lines, "WEGVLAK", "length", False).collect()] == ["s0", "s2", "s4"]
    assert roads.search_road_lines(lines, "oosten").count() == 6
    corridor = roads.corridors(lines).first()
    assert (corridor["rank"], corridor.median_passes, corridor.max_passes, corridor.segments) == (1, 4, 6, 6)
    assert corridor.spread_km == round(km_between(52.0, 5.0, 52.005, 5.0), 1)


@pytest.mark.parametrize(
    "wrong",
    [Filter(road_top_percent=0), Filter(road_top_percent=101), Filter(marker_top_n=0), Power(top_locations=0),
     Power(scenario_years=(2025,)), Breaks(top_percent=101), Breaks(min_visits=0)],
)
def test_arguments_out_of_bounds_are_errors(wrong):
    with pytest.raises(ValueError):
        wrong.normalized()


def test_no_limit_gives_all_rows(spark):
    heat = spark.range(301_000).select(F.lit(52.0).alias("lat"), (F.col("id") / 1e5).alias("lon"), F.lit(2.0).alias("weight"))
    assert roads.road_heat(heat, Filter(road_top_percent=100)).count() == 301_000
    assert roads.road_heat(heat, Filter(road_top_percent=50)).count() == 150_500


@pytest.mark.parametrize("lat", [0.0, 52.0, 69.0])
def test_segments_enter_the_cells_they_come_near_and_few_others(spark, lat):
    """A diagonal of n cells is in O(n) of them, and every place within reach of a segment finds it in its own cell."""
    draw = random.Random(int(lat))
    ends = [(lat, 5.0, lat + 2.0, 9.0), (lat, 5.0, lat, 7.0), (lat, 5.0, lat + 1.5, 5.0), (lat + 1, 8.0, lat, 5.0), (lat, 5.0, lat, 5.0), (lat, 5.0, lat + 0.001, 7.0)]
    shape = "no int, a struct<lat:double,lon:double>, b struct<lat:double,lon:double>"
    segments = spark.createDataFrame([(i, (e[0], e[1]), (e[2], e[3])) for i, e in enumerate(ends)], shape)
    entered = materialize(roads.segment_cells(segments).select("no", "a", "b", "_x", "_y"), "cells")
    counts = {r.no: r["count"] for r in entered.groupBy("no").count().collect()}
    assert counts[0] <= 12 * (2.0 + 4.0) / 0.02 and counts[4] == 9
    spots = []
    for la1, lo1, la2, lo2 in ends:
        for _ in range(150):
            t = draw.random()
            spots.append((la1 + t * (la2 - la1) + draw.uniform(-0.03, 0.03), lo1 + t * (lo2 - lo1) + draw.uniform(-0.05, 0.05)))
    df = spark.createDataFrame(spots, "_lat double, _lon double")
    df = df.withColumn("_x", nearest.cell("_lat", roads.SNAP_CELL)).withColumn("_y", nearest.cell("_lon", roads._snap_width("_x")))
    km = geo.point_segment_km("_lat", "_lon", F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon"))
    found = df.join(entered, ["_x", "_y"]).where(km <= roads.SNAP_KM).select("_lat", "_lon", "no")
    every = df.crossJoin(segments).where(km <= roads.SNAP_KM).select("_lat", "_lon", "no")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, every.collect())) != []


def _short_paths(n):
    """Paths of three edges, two stretches each, in the order they are handed to a task."""
    rows = [
        (f"e{p:03d}{i}", f"e{p:03d}0", i // 2, float(i), i, 3.0, (p * 7 + i * 5) % 4 + 1, 1, 52.0, 5.0 + i, 52.0, 6.0 + i, False, None, False, False)
        for p in range(n)
        for i in range(3)
    ]
    names = "edge_id path _stretch _x _steps length_km n_passes n_vehicles lat1 lon1 lat2 lon2 _closed _edges _open_before _open_after"
    return pd.DataFrame(rows, columns=names.split()).astype({"_edges": "float64"})


@pytest.mark.parametrize("size", [1, 2, 7, 1000])
def test_stretches_are_settled_many_at_a_time(spark, size):
    rows = _short_paths(40)
    parts = list(roads._settle_stretches(rows.iloc[i : i + size] for i in range(0, len(rows), size)))
    assert len(parts) <= 2 if size == 1000 else len(parts) > 2
    found = pd.concat(parts, ignore_index=True)
    assert found["edge_id"].tolist() == rows["edge_id"].tolist()
    for _, stretch in found.merge(rows, on="edge_id").groupby(["path", "_stretch"]):
        busiest = stretch.sort_values(["n_passes", "lon1"], ascending=[False, True])["edge_id"].iloc[0]
        assert set(stretch["chain_id"]) == {busiest} and sorted(stretch["pos"]) == list(range(len(stretch)))
    assert list(roads._settle_stretches(iter([]))) == []
