"""One SQL statement per registered query, on the driver's tables.

Written from the rules, not from the Spark code: shared steps are common table expressions, and
``statement`` puts the ones a query needs in front of it.
"""

from __future__ import annotations

import re

from dwellgrid.functions.geo import DIRECTION_LABELS
from dwellgrid.operators.filters import CHARGE_WINDOW_ACTIONS
from dwellgrid.operators.roads import CORRIDORS

HOUR = 3_600_000_000


def even(value: str, digits: int) -> str:
    return f"round_even(round({value}, 9), {digits})"


def hav(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return (
        f"(2.0e0 * 6371.0e0 * asin(sqrt(pow(sin(radians(({lat2}) - ({lat1})) / 2), 2) + cos(radians({lat1})) "
        f"* cos(radians({lat2})) * pow(sin(radians(({lon2}) - ({lon1})) / 2), 2))))"
    )


def bearing(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    turn = f"(radians({lon2}) - radians({lon1}))"
    east = f"sin({turn}) * cos(radians({lat2}))"
    north = f"cos(radians({lat1})) * sin(radians({lat2})) - sin(radians({lat1})) * cos(radians({lat2})) * cos({turn})"
    return f"((degrees(atan2({east}, {north})) + 360.0e0) % 360.0e0)"


def bucket(value: str) -> str:
    return f"CAST(floor((({value}) + 22.5e0) % 360.0e0 / 45.0e0) AS INTEGER)"


def pick(labels, index: str) -> str:
    return "[" + ", ".join(f"'{label}'" for label in labels) + f"][CAST({index} AS INTEGER) + 1]"


def segment_km(lat: str, lon: str, lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    k = f"greatest(1.0e0, 111.32e0 * cos(radians((({lat}) + ({lat1}) + ({lat2})) / 3.0e0)))"
    dx, dy = f"((({lon2}) - ({lon1})) * {k})", f"((({lat2}) - ({lat1})) * 111.32e0)"
    px, py = f"((({lon}) - ({lon1})) * {k})", f"((({lat}) - ({lat1})) * 111.32e0)"
    squared = f"({dx} * {dx} + {dy} * {dy})"
    t = f"least(1.0e0, greatest(0.0e0, ({px} * {dx} + {py} * {dy}) / nullif({squared}, 0)))"
    return (
        f"(CASE WHEN {squared} <= 0 THEN {hav(lat, lon, lat1, lon1)} "
        f"ELSE sqrt(pow({px} - {t} * {dx}, 2) + pow({py} - {t} * {dy}, 2)) END)"
    )


def project(lat: str, lon: str, heading: str, km: float, part: str) -> str:
    a, b = f"({km}e0 / 6371.0e0)", f"radians({heading})"
    lat2 = f"asin(sin(radians({lat})) * cos({a}) + cos(radians({lat})) * sin({a}) * cos({b}))"
    lon2 = (
        f"radians({lon}) + atan2(sin({b}) * sin({a}) * cos(radians({lat})), "
        f"cos({a}) - sin(radians({lat})) * sin({lat2}))"
    )
    return even(f"degrees({lat2 if part == 'lat' else lon2})", 6)


def name_near(lat: str, lon: str) -> str:
    pieces = [
        f"{{'km': {segment_km(lat, lon, *[f'{v}e0' for v in (*p[i], *p[i + 1])])}, 'n': {n}, 'name': '{name}'}}"
        for n, (name, p) in enumerate(CORRIDORS.items())
        for i in range(len(p) - 1)
    ]
    return "list_min([" + ", ".join(pieces) + "])"


def advice(total: str) -> str:
    return (
        f"CASE WHEN {total} <= 0 THEN 'Geen laadvraag in deze selectie.' ELSE 'Publieke laadvraag: ' || "
        f"format('{{:,.1f}}', {even(total, 1)}) || ' MWh in dit scenario.' END"
    )


WINDOWS = ", ".join(f"'{action}'" for action in CHARGE_WINDOW_ACTIONS)
CELL = "printf('auto:%.3f:%.3f', round({0}, 3), round({1}, 3))"
ROAD = (52.1, 5.0, 52.2, 5.1)
MID = (52.15, 5.05)
DEPOT = "auto:52.000:5.000"

CTES: dict[str, str] = {
    "locations": """
        SELECT k, 'Adres ' || k || ' ' || (1000 + k) || ' AB' AS address,
            CAST(520 + k % 4 AS DOUBLE) / 10 AS lat, CAST(50 + k // 4 AS DOUBLE) / 10 AS lon
        FROM range(12) AS r(k)""",
    "trips_raw": """
        SELECT *, coalesce(lag(dst) OVER (PARTITION BY user_id ORDER BY t0, event_id), user_id % 12) AS src,
            30 + event_id % 8 * 30 AS mins, 20 + event_id % 11 * 30 AS wait,
            CAST(40 + event_id % 70 AS DOUBLE) * (30 + event_id % 8 * 30) / 60 AS km
        FROM (SELECT event_id, user_id, event_type, date_trunc('second', ts) AS t0,
                (user_id * 7 + event_id * 3) % 12 AS dst FROM events)""",
    "raw": """
        SELECT event_id, user_id,
            ['Eigen Vervoer', 'Uitbesteed Vervoer', 'Overig'][CAST(user_id % 3 AS INTEGER) + 1] AS carrier,
            'W' || user_id AS vehicle_code, 'Trekker' AS vehicle_type, 'T' || event_id AS trip_id,
            CASE WHEN user_id % 5 = 0 THEN '' ELSE 'NL-' || user_id || '-X' END AS plate,
            CASE WHEN user_id % 5 = 0 THEN '' ELSE 'NL' || user_id || 'X' END AS plate_norm,
            CASE WHEN event_id % 2 = 0 THEN km END AS trip_km, seg AS segment_km, action,
            t0 + to_minutes(CAST(m1 AS BIGINT)) AS planned_start, t0 + to_minutes(CAST(m2 AS BIGINT)) AS planned_end,
            'Depot ' || k AS location_name,
            CASE WHEN step = 3 AND event_id % 40 = 7 THEN 'Onbekend adres'
                ELSE 'Adres ' || k || ' ' || (1000 + k) || ' AB' END AS address
        FROM (
            SELECT *, 1 AS step, 'travel' AS action, src AS k, 0 AS m1, 10 AS m2, 0.0e0 AS seg FROM trips_raw
            UNION ALL SELECT *, 2, 'travel', dst, 10, 10 + mins, km FROM trips_raw
            UNION ALL SELECT *, 3, CASE event_type WHEN 'click' THEN 'wait_after' WHEN 'view' THEN 'pause'
                WHEN 'purchase' THEN 'wait_task_available' WHEN 'signup' THEN 'wait_action' ELSE 'unload' END,
                dst, 10 + mins, 10 + mins + wait, 0.0e0 FROM trips_raw
        )""",
    "typed": """
        SELECT r.* REPLACE (coalesce(trip_km, segment_km) AS trip_km), l.lat, l.lon, CAST(planned_start AS DATE) AS trip_date,
            greatest(coalesce(date_diff('second', planned_start, planned_end), 0) / 60.0e0, 0.0e0) AS dwell_min
        FROM raw r LEFT JOIN locations l ON r.address = l.address""",
    "actions": f"""
        SELECT vehicle_code, carrier, CASE carrier WHEN 'Eigen Vervoer' THEN 'own'
                WHEN 'Uitbesteed Vervoer' THEN 'charter' ELSE 'unknown' END AS vehicle_class,
            trip_date, trip_id, CAST(row_number() OVER (PARTITION BY vehicle_code, trip_date, trip_id
                ORDER BY planned_start, planned_end, address, action) - 1 AS INTEGER) AS action_seq,
            action, location_name, address,
            CASE WHEN lat IS NULL THEN 'unknown_location:' || address ELSE {CELL.format("lat", "lon")} END AS location_id,
            planned_start, planned_end, dwell_min, segment_km, coalesce(trip_km, 0.0e0) AS trip_km,
            lat, lon, plate, plate_norm, vehicle_type
        FROM typed""",
    "stops_numbered": """
        SELECT vehicle_code, carrier, CASE carrier WHEN 'Eigen Vervoer' THEN 'eigen'
                WHEN 'Uitbesteed Vervoer' THEN 'charter' ELSE 'onbekend' END AS carrier_type,
            trip_date, trip_id, CAST(row_number() OVER (PARTITION BY vehicle_code, trip_date, trip_id
                ORDER BY planned_start, planned_end, address) - 1 AS INTEGER) AS stop_seq,
            action, location_name, address, planned_start, planned_end, segment_km,
            coalesce(trip_km, 0.0e0) AS trip_km, dwell_min, lat, lon, plate, plate_norm, vehicle_type
        FROM typed WHERE action = 'travel'""",
    "stops": """
        SELECT s.*, trip_id || '-' || lpad(CAST(stop_seq AS VARCHAR), 2, '0') AS trip_stop_nr,
            regexp_replace(upper(regexp_extract(s.address, '([0-9]{4})\\s*([A-Za-z]{2})', 0)), '\\s', '', 'g') AS pc6,
            CASE WHEN k % 2 = 0 THEN 'Zone ' || k ELSE '' END AS ze_zone,
            CASE WHEN k % 2 = 0 THEN '2025-01-01' ELSE '' END AS ze_start_date, coalesce(k % 2 = 0, false) AS in_zez
        FROM stops_numbered s JOIN locations l ON s.address = l.address""",
    "trips": """
        SELECT vehicle_code, any_value(carrier) AS carrier, any_value(carrier_type) AS carrier_type,
            any_value(plate) AS plate, any_value(plate_norm) AS plate_norm, any_value(plate) AS plates, trip_date, trip_id,
            min(planned_start) AS trip_start, max(planned_end) AS trip_end,
            max(lat) FILTER (rf = 1) AS start_lat, max(lon) FILTER (rf = 1) AS start_lon,
            max(address) FILTER (rf = 1) AS start_address, max(lat) FILTER (rl = 1) AS end_lat,
            max(lon) FILTER (rl = 1) AS end_lon, max(address) FILTER (rl = 1) AS end_address,
            greatest(sum(segment_km), max(trip_km)) AS distance_km, count(*) AS stops
        FROM (SELECT *, row_number() OVER (PARTITION BY vehicle_code, trip_date, trip_id
                    ORDER BY planned_start, planned_end, stop_seq) AS rf,
                row_number() OVER (PARTITION BY vehicle_code, trip_date, trip_id
                    ORDER BY planned_start DESC, planned_end DESC, stop_seq DESC) AS rl FROM stops)
        GROUP BY vehicle_code, trip_date, trip_id""",
    "days": """
        SELECT vehicle_code, any_value(carrier) AS carrier, any_value(carrier_type) AS carrier_type,
            any_value(plate) AS plate, any_value(plate_norm) AS plate_norm, any_value(plates) AS plates, trip_date,
            min(trip_start) AS day_start, max(trip_end) AS day_end,
            max(start_lat) FILTER (rf = 1) AS start_lat, max(start_lon) FILTER (rf = 1) AS start_lon,
            max(start_address) FILTER (rf = 1) AS start_address, max(end_lat) FILTER (rl = 1) AS end_lat,
            max(end_lon) FILTER (rl = 1) AS end_lon, max(end_address) FILTER (rl = 1) AS end_address,
            sum(distance_km) AS day_km, count(*) AS trips
        FROM (SELECT *, row_number() OVER (PARTITION BY vehicle_code, trip_date ORDER BY trip_start, trip_id) AS rf,
                row_number() OVER (PARTITION BY vehicle_code, trip_date ORDER BY trip_end DESC, trip_id DESC) AS rl
            FROM trips)
        GROUP BY vehicle_code, trip_date""",
    "days_before": """
        SELECT *, lag(day_end) OVER w AS prev_end_time, lag(end_lat) OVER w AS prev_end_lat,
            lag(end_lon) OVER w AS prev_end_lon, lag(end_address) OVER w AS prev_end_address
        FROM days WINDOW w AS (PARTITION BY vehicle_code ORDER BY trip_date)""",
    "candidates": f"""
        SELECT * FROM (
            SELECT *, coalesce(nullif(plate_norm, ''), vehicle_code) AS vehicle_key,
                {CELL.format("start_lat", "start_lon")} AS depot_id,
                date_diff('second', prev_end_time, day_start) / 3600.0e0 AS gap_hours,
                {hav("prev_end_lat", "prev_end_lon", "start_lat", "start_lon")} AS end_start_km
            FROM days_before)
        WHERE gap_hours BETWEEN 6 AND 72 AND end_start_km <= 0.5""",
    "home": """
        SELECT *, 1 AS rn FROM (
            SELECT vehicle_key, depot_id, count(*) AS events, max(trip_date) AS last_seen,
                quantile_cont(gap_hours, 0.5) AS median_gap_hours
            FROM candidates GROUP BY vehicle_key, depot_id)
        QUALIFY row_number() OVER (PARTITION BY vehicle_key
            ORDER BY events DESC, last_seen DESC, median_gap_hours DESC, depot_id) = 1""",
    "overnight": """
        SELECT c.* FROM candidates c JOIN home h ON c.vehicle_key = h.vehicle_key AND c.depot_id = h.depot_id""",
    "road_index": """
        SELECT *, (start_lat + end_lat) / 2 AS mid_lat, (start_lon + end_lon) / 2 AS mid_lon
        FROM trips WHERE start_lat <> end_lat OR start_lon <> end_lon""",
    # The selected road: trips whose midpoint lies within 5 km of its midpoint.
    "on_road": f"""
        SELECT * FROM road_index WHERE {hav("mid_lat", "mid_lon", f"{MID[0]}e0", f"{MID[1]}e0")} <= 5""",
    "chargers": """
        SELECT s_suppkey AS id, CAST(5200 + s_suppkey % 9 * 5 AS DOUBLE) / 100 AS lat,
            CAST(500 + s_suppkey % 7 * 5 AS DOUBLE) / 100 AS lon, s_name AS name, 'Operator' AS operator,
            'Straat ' || s_suppkey AS address, 'Utrecht' AS town, '3500AA' AS postcode,
            CAST(50 + s_suppkey % 12 * 50 AS DOUBLE) AS max_power_kw, CAST(s_suppkey % 10 + 1 AS BIGINT) AS connectors,
            ['Publiek', 'Semi-publiek', 'Privaat'][CAST(s_suppkey % 3 AS INTEGER) + 1] AS access, 'Ja' AS open_24_7,
            CASE WHEN s_suppkey % 4 = 0 THEN 'Ja' ELSE 'Nee' END AS dedicated, 'CCS' AS connector_type
        FROM supplier""",
    "edges": """
        SELECT CAST(5200 + r % 50 AS DOUBLE) / 100 AS lat1, CAST(450 + c * 2 + r // 50 * 50 AS DOUBLE) / 100 AS lon1,
            CAST(5200 + r % 50 AS DOUBLE) / 100 AS lat2, CAST(452 + c * 2 + r // 50 * 50 AS DOUBLE) / 100 AS lon2,
            CAST(1 + p_size % 10 AS INTEGER) AS n_vehicles, CAST(p_size AS INTEGER) AS n_passes
        FROM (SELECT p_size, p_partkey // 9 AS r, p_partkey % 9 AS c FROM part)""",
    "heat": "SELECT lat1 AS lat, (lon1 + lon2) / 2 AS lon, CAST(n_passes AS DOUBLE) AS weight FROM edges",
    "busy_edges": """
        SELECT * FROM edges WHERE n_passes >= 1 ORDER BY n_passes DESC, n_vehicles DESC, lat1, lon1, lat2, lon2
        LIMIT (SELECT greatest(250, 8 * greatest(50, CAST(ceil(count(*) / 100.0) AS BIGINT)))
            FROM edges WHERE n_passes >= 1)""",
    # Road chains, grown one edge at a time from the busiest edge left on each path.
    "edge_ranked": f"""
        SELECT *, {bucket(bearing("lat1", "lon1", "lat2", "lon2"))} AS bucket, {hav("lat1", "lon1", "lat2", "lon2")} AS length_km,
            printf('%.5f:%.5f', lat1, lon1) AS start_key, printf('%.5f:%.5f', lat2, lon2) AS end_key,
            lat1 || '|' || lon1 || '|' || lat2 || '|' || lon2 || '|1' AS edge_id,
            CAST(row_number() OVER (ORDER BY n_passes DESC, n_vehicles DESC, lat1, lon1, lat2, lon2) AS INTEGER) AS rk
        FROM edges WHERE n_passes >= 1""",
    "edge_next": """
        SELECT a.rk, b.rk AS nxt FROM edge_ranked a JOIN edge_ranked b ON b.bucket = a.bucket AND b.start_key = a.end_key
        WHERE (SELECT count(*) FROM edge_ranked x WHERE x.bucket = a.bucket AND x.start_key = a.end_key) = 1
            AND (SELECT count(*) FROM edge_ranked y WHERE y.bucket = a.bucket AND y.end_key = a.end_key) = 1""",
    "edge_path": """
        SELECT rk AS head, rk, 1 AS place FROM edge_ranked WHERE rk NOT IN (SELECT nxt FROM edge_next)
        UNION ALL SELECT p.head, n.nxt, p.place + 1 FROM edge_path p JOIN edge_next n ON n.rk = p.rk""",
    "edge_comp": """
        SELECT head, list(p.rk ORDER BY place) AS rks, list(length_km ORDER BY place) AS lens
        FROM edge_path p JOIN edge_ranked e ON e.rk = p.rk GROUP BY head""",
    "greedy": """
        SELECT head, rks, lens, list_transform(rks, lambda x: 0) AS owner, 0 AS lo, 0 AS hi, 0.0e0 AS km, 0 AS seed,
            'f' AS mode, false AS done FROM edge_comp
        UNION ALL
        SELECT head, rks, lens,
            CASE WHEN pos IS NULL THEN owner ELSE list_transform(owner, lambda x, i: CASE WHEN i = pos
                THEN (CASE WHEN act = 'seed' THEN best ELSE seed END) ELSE x END) END,
            CASE WHEN act IN ('seed', 'back') THEN pos ELSE lo END, CASE WHEN act IN ('seed', 'fwd') THEN pos ELSE hi END,
            CASE act WHEN 'seed' THEN lens[pos] WHEN 'turn' THEN km ELSE km + lens[pos] END,
            CASE WHEN act = 'seed' THEN best ELSE seed END,
            CASE act WHEN 'seed' THEN 'b' WHEN 'turn' THEN 'f' ELSE mode END, act = 'seed' AND best IS NULL
        FROM (SELECT *, CAST(CASE act WHEN 'back' THEN lo - 1 WHEN 'fwd' THEN hi + 1
                WHEN 'seed' THEN list_position(rks, best) END AS INTEGER) AS pos
            FROM (SELECT *, list_min(list_filter(rks, lambda x, i: owner[i] = 0)) AS best,
                    CASE WHEN mode = 'b' AND lo > 1 AND owner[lo - 1] = 0 AND NOT (km >= 1 AND km + lens[lo - 1] > 8) THEN 'back'
                        WHEN mode = 'b' THEN 'turn'
                        WHEN seed > 0 AND hi < len(rks) AND owner[hi + 1] = 0 AND NOT (km >= 1 AND km + lens[hi + 1] > 8) THEN 'fwd'
                        ELSE 'seed' END AS act
                FROM greedy WHERE NOT done))""",
    "chained": """
        SELECT e.*, s.edge_id AS chain_id, CAST(row_number() OVER (PARTITION BY own ORDER BY place) - 1 AS INTEGER) AS pos
        FROM (SELECT unnest(rks) AS rk, unnest(owner) AS own, unnest(range(len(rks))) AS place FROM greedy WHERE done) g
        JOIN edge_ranked e ON e.rk = g.rk JOIN edge_ranked s ON s.rk = g.own""",
    "chain_ends": f"""
        SELECT chain_id, arg_min(lat1, pos) AS lat1, arg_min(lon1, pos) AS lon1, arg_max(lat2, pos) AS lat2,
            arg_max(lon2, pos) AS lon2, max(n_vehicles) AS unique_vehicles, max(n_passes) AS passes,
            {even("sum(length_km)", 2)} AS length_km, CAST(count(*) AS INTEGER) AS raw_segments,
            list_prepend({{'lat': arg_min(lat1, pos), 'lon': arg_min(lon1, pos)}}, list({{'lat': lat2, 'lon': lon2}} ORDER BY pos)) AS coordinates
        FROM chained GROUP BY chain_id""",
    "road_map": f"""
        SELECT 'weg:' || b || ':' || printf('%.3f:%.3f', {even("(lat1 + lat2) / 2", 3)}, {even("(lon1 + lon2) / 2", 3)}) || ':' || raw_segments AS segment_id,
            {even("lat1", 6)} AS lat1, {even("lon1", 6)} AS lon1, {even("lat2", 6)} AS lat2, {even("lon2", 6)} AS lon2,
            unique_vehicles, passes, CASE WHEN best.km <= 3 THEN best.name
                ELSE printf('Wegvlak bij %.3f, %.3f', (lat1 + lat2) / 2, (lon1 + lon2) / 2) END AS road_name,
            {pick(DIRECTION_LABELS, "b")} AS direction, {even("turn", 0)} AS bearing, length_km, raw_segments,
            {even("least(20.0e0, greatest(1.5e0, length_km / 2 + 1.5e0))", 2)} AS radius_km, coordinates
        FROM (SELECT *, {bearing("lat1", "lon1", "lat2", "lon2")} AS turn,
                {bucket(bearing("lat1", "lon1", "lat2", "lon2"))} AS b,
                {name_near("(lat1 + lat2) / 2", "(lon1 + lon2) / 2")} AS best FROM chain_ends)
        ORDER BY passes DESC, unique_vehicles DESC, segment_id, lat1, lon1
        LIMIT (SELECT greatest(50, CAST(ceil(greatest(50, ceil(count(*) / 100.0)) / 6.0) AS BIGINT)) FROM edges)""",
    "break_lines": f"""
        SELECT l.segment_id, {project("lat", "lon", "((b * 45 + 180) % 360)", 0.75, "lat")} AS lat1,
            {project("lat", "lon", "((b * 45 + 180) % 360)", 0.75, "lon")} AS lon1,
            {project("lat", "lon", "(b * 45)", 0.75, "lat")} AS lat2, {project("lat", "lon", "(b * 45)", 0.75, "lon")} AS lon2,
            {pick(DIRECTION_LABELS, "b")} AS direction, peak_mw, total_kwh, vehicles, passages, 0.75e0 AS radius_km
        FROM (SELECT 'pauze:' || bearing_bucket || ':' || printf('%.3f:%.3f', {even("break_lat", 3)},
                {even("break_lon", 3)}) AS segment_id, any_value(bearing_bucket) AS b, avg(break_lat) AS lat,
                avg(break_lon) AS lon, {even("sum(demand_kwh)", 1)} AS total_kwh, count(DISTINCT vehicle) AS vehicles,
                count(*) AS passages FROM breaks GROUP BY 1) l
        JOIN (SELECT segment_id, {even("max(s) / 1000", 3)} AS peak_mw FROM (
                SELECT 'pauze:' || bearing_bucket || ':' || printf('%.3f:%.3f', {even("break_lat", 3)},
                    {even("break_lon", 3)}) AS segment_id, sum(required_kw) AS s FROM quarters GROUP BY 1, slot_start)
            GROUP BY 1) p ON p.segment_id = l.segment_id
        ORDER BY passages DESC, peak_mw DESC, total_kwh DESC, l.segment_id""",
    # Demand of overnight standstills: 590 kWh each, over the hours they last.
    "loads": """
        SELECT vehicle_code, plates, trip_date, depot_id, prev_end_time AS start_time, day_start AS end_time,
            start_lat AS lat, start_lon AS lon, start_address AS address, day_km AS distance_km, gap_hours,
            590.0e0 AS demand_kwh, 590.0e0 / gap_hours AS required_kw,
            upper(CASE WHEN plates = '' THEN vehicle_code ELSE plates END) AS vehicle
        FROM overnight""",
    "load_slots": f"""
        SELECT *, make_timestamp(h * {HOUR}) AS slot,
            (least(epoch_us(end_time), (h + 1) * {HOUR}) - greatest(epoch_us(start_time), h * {HOUR})) / {HOUR}.0e0 AS overlap
        FROM (SELECT *, unnest(generate_series(epoch_us(start_time) // {HOUR}, (epoch_us(end_time) - 1) // {HOUR})) AS h
            FROM loads)""",
    "slot_sums": """
        SELECT slot, count(DISTINCT vehicle) AS vehicles, count(*) AS events,
            round(sum(required_kw * overlap), 6) AS demand_kwh, round(sum(required_kw), 6) AS required_kw
        FROM load_slots GROUP BY slot""",
    "road_loads": """
        SELECT vehicle_code, plates, trip_date, trip_id, trip_start AS start_time, trip_end AS end_time, start_lat AS lat,
            start_lon AS lon, distance_km, 0.0e0 AS gap_hours, distance_km * 1.2e0 AS demand_kwh,
            distance_km * 1.2e0 AS required_kw, upper(CASE WHEN plates = '' THEN vehicle_code ELSE plates END) AS vehicle
        FROM on_road""",
    # Presence windows.
    "power_actions": """
        SELECT *, coalesce(nullif(plate_norm, ''), vehicle_code) AS vehicle_key,
            greatest(trip_km, segment_km) AS distance_km
        FROM actions WHERE planned_end > planned_start""",
    "stays": """
        SELECT *, sum(moved) OVER (PARTITION BY vehicle_key, trip_date, trip_id ORDER BY planned_start, action_seq
                ROWS UNBOUNDED PRECEDING) AS stay
        FROM (SELECT *, CASE WHEN lag(lower(location_id)) OVER (PARTITION BY vehicle_key, trip_date, trip_id
                ORDER BY planned_start, action_seq) = lower(location_id) THEN 0 ELSE 1 END AS moved FROM power_actions)""",
    "presence": f"""
        SELECT f.vehicle_code, g.vehicle_key, f.plate, f.vehicle_class, g.trip_date, g.trip_id, f.action_seq, f.action,
            f.location_id, f.location_name, f.address, f.distance_km, g.s AS planned_start, g.e AS planned_end,
            (epoch_us(g.e) - epoch_us(g.s)) / 60000000.0e0 AS dwell_min, coalesce(f.lat, 0.0e0) AS lat,
            coalesce(f.lon, 0.0e0) AS lon
        FROM (SELECT vehicle_key, trip_date, trip_id, stay,
                min(CASE WHEN action = 'travel' THEN planned_end ELSE planned_start END) AS s, max(planned_end) AS e,
                bool_or(action IN ({WINDOWS})) AS charges
            FROM stays GROUP BY ALL) g
        JOIN (SELECT * FROM stays QUALIFY row_number() OVER (PARTITION BY vehicle_key, trip_date, trip_id, stay
                ORDER BY planned_start, action_seq) = 1) f
            ON f.vehicle_key = g.vehicle_key AND f.trip_date = g.trip_date AND f.trip_id = g.trip_id AND f.stay = g.stay
        WHERE charges AND g.e > g.s""",
    "runs": """
        SELECT *, sum(opens) OVER (PARTITION BY vehicle_key, location_id ORDER BY planned_start, planned_end, trip_date,
                trip_id, action_seq ROWS UNBOUNDED PRECEDING) AS run
        FROM (SELECT *, CASE WHEN planned_start <= max(planned_end) OVER (PARTITION BY vehicle_key, location_id
                ORDER BY planned_start, planned_end, trip_date, trip_id, action_seq
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + INTERVAL 5 MINUTE THEN 0 ELSE 1 END AS opens
            FROM presence)""",
    "windows": """
        SELECT f.* EXCLUDE (planned_start, planned_end, dwell_min, opens, run), g.s AS planned_start, g.e AS planned_end,
            (epoch_us(g.e) - epoch_us(g.s)) / 60000000.0e0 AS dwell_min
        FROM (SELECT vehicle_key, location_id, run, min(planned_start) AS s, max(planned_end) AS e FROM runs GROUP BY ALL) g
        JOIN (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY vehicle_key, location_id, run
                ORDER BY planned_start, planned_end, trip_date, trip_id, action_seq) = 1) f
            ON f.vehicle_key = g.vehicle_key AND f.location_id = g.location_id AND f.run = g.run""",
    "window_slots": f"""
        SELECT *, make_timestamp(h * {HOUR}) AS slot, least(400.0e0, 590.0e0 / (dwell_min / 60)) AS kw
        FROM (SELECT *, unnest(generate_series(epoch_us(planned_start) // {HOUR},
                (epoch_us(planned_end) - 1) // {HOUR})) AS h FROM windows)""",
    "place_slots": """
        SELECT location_id, slot, count(DISTINCT vehicle_key) AS vehicles, count(*) AS events, round(sum(kw), 6) AS kw
        FROM window_slots GROUP BY ALL""",
    "place_hours": f"""
        SELECT p.location_id, h.hour, coalesce(vehicles, 0) AS vehicles, coalesce(events, 0) AS events,
            {even("coalesce(kw, 0)", 0)} AS required_kw, {even(even("coalesce(kw, 0)", 0) + " / 1000", 2)} AS required_mw,
            CAST(slot AS DATE) AS date
        FROM (SELECT DISTINCT location_id FROM windows) p
        CROSS JOIN (SELECT CAST(range AS INTEGER) AS hour FROM range(24)) h
        LEFT JOIN (SELECT *, CAST(hour(slot) AS INTEGER) AS hour FROM place_slots
            QUALIFY row_number() OVER (PARTITION BY location_id, hour(slot) ORDER BY kw DESC, vehicles DESC, slot) = 1) b
            ON b.location_id = p.location_id AND b.hour = h.hour""",
    "place_names": """
        SELECT location_id, location_name FROM (SELECT location_id, location_name, count(*) AS n FROM windows GROUP BY ALL)
        QUALIFY row_number() OVER (PARTITION BY location_id ORDER BY n DESC, upper(location_name)) = 1""",
    "places": f"""
        SELECT w.location_id, any_value(n.location_name) AS name, any_value(w.address) AS address,
            {even("coalesce(avg(lat) FILTER (lat <> 0), 0)", 6)} AS lat,
            {even("coalesce(avg(lon) FILTER (lon <> 0), 0)", 6)} AS lon,
            count(DISTINCT vehicle_key) AS vehicles,
            count(DISTINCT vehicle_key) FILTER (vehicle_class = 'own') AS own,
            count(DISTINCT vehicle_key) FILTER (vehicle_class = 'charter') AS charter,
            count(DISTINCT trip_id) AS trips, count(*) AS events, {even("avg(dwell_min)", 1)} AS avg_dwell_min,
            (SELECT {even("max(kw)", 0)} FROM place_slots p WHERE p.location_id = w.location_id) AS peak_kw
        FROM windows w JOIN place_names n ON n.location_id = w.location_id GROUP BY w.location_id""",
    "top_places": "SELECT * FROM places ORDER BY peak_kw DESC, vehicles DESC, upper(name), location_id LIMIT 5",
    "daily_power": f"""
        SELECT trip_date AS date, count(DISTINCT vehicle_key) AS vehicles,
            count(DISTINCT vehicle_key) FILTER (vehicle_class = 'own') AS own,
            count(DISTINCT vehicle_key) FILTER (vehicle_class = 'charter') AS charter,
            count(DISTINCT trip_id) AS trips, count(*) AS events, {even("avg(dwell_min)", 1)} AS avg_dwell_min,
            any_value(peak) AS peak_kw
        FROM windows w JOIN (SELECT trip_date AS d, {even("max(kw)", 0)} AS peak FROM (
                SELECT trip_date, slot, round(sum(kw), 6) AS kw FROM window_slots GROUP BY ALL) GROUP BY trip_date) p
            ON w.trip_date = p.d
        GROUP BY trip_date""",
    # Breaks.
    "resets": f"""
        SELECT avg(lat) AS lat, avg(lon) AS lon FROM (
            SELECT vehicle_code, {even("start_lat", 3)} AS lat, {even("start_lon", 3)} AS lon FROM trips
            UNION ALL SELECT vehicle_code, {even("end_lat", 3)}, {even("end_lon", 3)} FROM trips)
        GROUP BY printf('%.5f:%.5f', lat, lon)
        HAVING count(DISTINCT vehicle_code) >= 5
            OR count(*) >= 20""",
    "moves": """
        SELECT t.*, lag(trip_end) OVER w AS prev_end, lag(end_lat) OVER w AS prev_lat, lag(end_lon) OVER w AS prev_lon,
            epoch_us(trip_end) - epoch_us(trip_start) AS us
        FROM trips t WINDOW w AS (PARTITION BY vehicle_code ORDER BY trip_start, trip_id)""",
    "judged": f"""
        SELECT *, us > 0 AND distance_km > 0 AS usable,
            coalesce(us > 0 AND distance_km > 0 AND distance_km / nullif(us / {HOUR}.0e0, 0) <= 95, false) AS plausible,
            prev_end IS NOT NULL AND (epoch_us(trip_start) - epoch_us(prev_end)) / {HOUR}.0e0 >= 2
                AND EXISTS (SELECT 1 FROM resets r
                    WHERE {hav("m.prev_lat", "m.prev_lon", "r.lat", "r.lon")} <= 0.75
                        AND {hav("m.start_lat", "m.start_lon", "r.lat", "r.lon")} <= 0.75) AS is_reset
        FROM moves m""",
    "shifts": """
        SELECT *, CAST(sum(CASE WHEN is_reset OR prev_end IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY vehicle_code
            ORDER BY trip_start, trip_id ROWS UNBOUNDED PRECEDING) AS INTEGER) AS shift_id
        FROM judged""",
    "progress": f"""
        SELECT *, first_value(trip_start) OVER s AS shift_start, us / {HOUR}.0e0 AS drive_hours,
            coalesce(sum(CASE WHEN plausible THEN us ELSE 0 END) OVER b, 0) / {HOUR}.0e0 AS drive_before,
            coalesce(sum(CASE WHEN plausible THEN distance_km ELSE 0 END) OVER b, 0) AS km_before
        FROM shifts
        WINDOW s AS (PARTITION BY vehicle_code, shift_id ORDER BY trip_start, trip_id),
            b AS (PARTITION BY vehicle_code, shift_id ORDER BY trip_start, trip_id
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "labelled": """
        SELECT *, CASE WHEN NOT usable THEN 'invalid' WHEN NOT plausible THEN 'implausible_speed'
            WHEN drive_before + drive_hours < 3.5 THEN 'before_window' WHEN drive_before > 4.5 THEN 'after_window'
            ELSE 'included' END AS reason
        FROM progress""",
    "breaks": f"""
        SELECT vehicle_code, plate, shift_start,
            make_timestamp(epoch_us(trip_start) + CAST(round(greatest(0.0e0, target - drive_before) * {HOUR}) AS BIGINT)) AS break_start,
            {even("target", 3)} AS drive_hours, km_before + distance_km * p AS km_since_shift_start,
            least((km_before + distance_km * p) * 1.2e0, 590.0e0) AS demand_kwh,
            least((km_before + distance_km * p) * 1.2e0, 590.0e0) / 0.75e0 AS required_kw,
            start_lat + (end_lat - start_lat) * p AS break_lat, start_lon + (end_lon - start_lon) * p AS break_lon,
            start_lat AS trip_start_lat, start_lon AS trip_start_lon, end_lat AS trip_end_lat, end_lon AS trip_end_lon,
            {bucket(bearing("start_lat", "start_lon", "end_lat", "end_lon"))} AS bearing_bucket,
            upper(CASE WHEN plate = '' THEN vehicle_code ELSE plate END) AS vehicle
        FROM (SELECT *, least(1.0e0, greatest(0.0e0, (target - drive_before) / drive_hours)) AS p
            FROM (SELECT *, least(4.5e0, greatest(3.5e0, drive_before)) AS target FROM labelled WHERE reason = 'included'))""",
    "quarters": f"""
        SELECT *, make_timestamp(q * {HOUR // 4}) AS slot_start, (least(epoch_us(break_start) + {HOUR * 3 // 4},
            (q + 1) * {HOUR // 4}) - greatest(epoch_us(break_start), q * {HOUR // 4})) / {HOUR}.0e0 AS overlap_hours
        FROM (SELECT *, unnest(generate_series(epoch_us(break_start) // {HOUR // 4},
            (epoch_us(break_start) + {HOUR * 3 // 4} - 1) // {HOUR // 4})) AS q FROM breaks)""",
    "near_breaks": f"""
        SELECT * FROM breaks WHERE {segment_km("break_lat", "break_lon", *[f"{v}e0" for v in ROAD])} <= 3""",
    "near_quarters": f"""
        SELECT * FROM quarters WHERE {segment_km("break_lat", "break_lon", *[f"{v}e0" for v in ROAD])} <= 3""",
    # Charging along all trips of a vehicle on a day.
    "chain": """
        SELECT vehicle_code, trip_date, vehicle_code || '_' || CAST(trip_date AS VARCHAR) AS trip_id,
            CAST(substr(trip_id, 2) AS INTEGER) * 2 + stop_seq AS stop_seq, lat, lon, address,
            row_number() OVER (PARTITION BY vehicle_code, trip_date
                ORDER BY CAST(substr(trip_id, 2) AS INTEGER) * 2 + stop_seq) AS n
        FROM stops""",
    "legs": f"""
        SELECT c.*, coalesce({hav("p.lat", "p.lon", "c.lat", "c.lon")}, 0.0e0) AS leg
        FROM chain c LEFT JOIN chain p ON p.vehicle_code = c.vehicle_code AND p.trip_date = c.trip_date AND p.n = c.n - 1""",
    "driven": """
        SELECT vehicle_code, trip_date, trip_id, n, stop_seq, lat, lon, address, leg AS km, 100.0e0 AS before,
            100.0e0 AS soc FROM legs WHERE n = 1
        UNION ALL
        SELECT l.vehicle_code, l.trip_date, l.trip_id, l.n, l.stop_seq, l.lat, l.lon, l.address, d.km + l.leg,
            d.soc - l.leg * 3.0e0, CASE WHEN d.soc - l.leg * 3.0e0 < 30 THEN 100.0e0 ELSE d.soc - l.leg * 3.0e0 END
        FROM driven d JOIN legs l ON l.vehicle_code = d.vehicle_code AND l.trip_date = d.trip_date AND l.n = d.n + 1""",
    "charges": """
        SELECT vehicle_code, trip_date, trip_id, stop_seq, lat, lon, address,
            100.0e0 - greatest(before, 0.0e0) AS charge_kwh, (100.0e0 - greatest(before, 0.0e0)) / 350 * 60 AS charge_min
        FROM driven WHERE before < 30""",
    "charged_trips": f"""
        SELECT d.trip_id, count(*) AS stops, {even("max(d.km)", 1)} AS trip_km,
            {even("arg_max(d.soc, d.n) / 100 * 100", 1)} AS end_soc_pct, any_value(coalesce(c.n, 0)) AS charge_events,
            {even("any_value(coalesce(c.kwh, 0.0e0))", 1)} AS charge_kwh,
            {even("any_value(coalesce(c.kwh, 0.0e0)) / 350 * 60", 1)} AS charge_min
        FROM driven d LEFT JOIN (SELECT trip_id, count(*) AS n, sum(charge_kwh) AS kwh FROM charges GROUP BY trip_id) c
            ON c.trip_id = d.trip_id
        GROUP BY d.trip_id""",
    # Fleet.
    "fleet": """
        SELECT 'W' || user_id AS fleet_no, 'NL-' || user_id || '-X' AS plate, 'NL' || user_id || 'X' AS plate_norm,
            user_id % 12 AS k FROM (SELECT DISTINCT user_id FROM events)
        UNION ALL SELECT 'X' || c_custkey, 'XX-' || c_custkey || '-Y', 'XX' || c_custkey || 'Y', c_custkey % 12 FROM customer""",
    "stats": """
        SELECT code, count(*) AS trips, sum(km) AS km FROM (
            SELECT vehicle_code AS code, trip_id,
                CASE WHEN max(trip_km) > 0 THEN max(trip_km) ELSE sum(segment_km) END AS km
            FROM stops GROUP BY ALL) GROUP BY code""",
    "bases": """
        SELECT DISTINCT user_id % 12 AS k, 'Adres ' || (user_id % 12) || ' ' || (1000 + user_id % 12) || ' AB, Plaats '
            || (user_id % 12) || ', Nederland' AS base FROM events""",
}

RECURSIVE = {"driven", "edge_path", "greedy"}
_NAMES = sorted(CTES, key=len, reverse=True)
_TABLES = {name: re.compile(rf"\b(?:FROM|JOIN)\s+{name}\b") for name in _NAMES}


def _needed(sql: str, seen: list[str]) -> list[str]:
    for name in _NAMES:
        if name not in seen and _TABLES[name].search(sql):
            if name in RECURSIVE:
                _needed(re.sub(rf"FROM {name}\b", "", CTES[name]), seen)
            else:
                _needed(CTES[name], seen)
            seen.append(name)
    return seen


def statement(sql: str) -> str:
    """The query with the shared steps it uses in front."""
    ordered = list(dict.fromkeys(_needed(sql, [])))
    if not ordered:
        return sql
    head = ",\n".join(f"{name} AS ({CTES[name]})" for name in ordered)
    own = sql.lstrip()
    joint = ",\n" + own.removeprefix("WITH ") if own.startswith("WITH ") else "\n" + own
    return f"WITH RECURSIVE {head}{joint}"
