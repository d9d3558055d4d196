"""The SQL answer to each registered query. Queries without one are checked by tests only."""

from __future__ import annotations

from acceptance.oracle import (
    CELL,
    DEPOT,
    HOUR,
    WINDOWS,
    advice,
    bearing,
    bucket,
    even,
    hav,
    name_near,
    pick,
    project,
    segment_km,
    statement,
)
from dwellgrid.functions.geo import DIRECTION_LABELS
from dwellgrid.functions.text import WEEKDAY_LABELS
from dwellgrid.params import DEFAULT_INFLOWS

TRIP = "vehicle_code, trip_date, trip_id"
FOCUS = "auto:52.200:5.100"
ENDS = ("start_lat", "start_lon", "end_lat", "end_lon")
SOME = "trip_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' AND carrier_type IN ('eigen', 'charter')"
VEHICLES = "(vehicle_code IN ('W1', 'W30') OR plate IN ('NL-11-X') OR plate_norm IN ('NL7X', 'NL11X'))"


def six(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


def exists(relation: str, condition: str, with_trip: bool = True) -> str:
    trip = f"AND s.trip_id = {relation}.trip_id" if with_trip else ""
    return (
        f"EXISTS (SELECT 1 FROM stops s WHERE s.vehicle_code = {relation}.vehicle_code "
        f"AND s.trip_date = {relation}.trip_date {trip} AND {condition})"
    )


def cells(rows: str, where: str = "true") -> str:
    return f"""
        (SELECT round(lat, 3) AS lat, round(lon, 3) AS lon, any_value(location_name) AS name, any_value(address) AS address,
            count(*) AS stops, count(DISTINCT vehicle_code) AS vehicles, count(DISTINCT trip_id) AS trips,
            sum(dwell_min) AS dwell, avg(dwell_min) AS mean FROM {rows} WHERE {where} GROUP BY 1, 2)"""


def spread(rows: str, value: str, n: str = "n") -> str:
    q = ", ".join(
        f"coalesce({even(f'quantile_cont({value}, {p})', 1)}, 0) AS {name}"
        for name, p in {"p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95}.items()
    )
    return (
        f"SELECT count(*) AS {n}, coalesce({even(f'avg({value})', 1)}, 0) AS avg_km, "
        f"coalesce({even(f'stddev_pop({value})', 1)}, 0) AS stddev_km, {q} FROM {rows}"
    )


def selection(loads: str, days: str, day_km: str, where: str = "true", plug: float = 350.0) -> str:
    """Summary, totals and spread of a selection in one row."""
    slots = f"""
        SELECT sum(required_kw) AS kw FROM (
            SELECT required_kw, unnest(generate_series(epoch_us(start_time) // {HOUR}, (epoch_us(end_time) - 1) // {HOUR})) AS h
            FROM {loads} WHERE {where}) GROUP BY h"""
    return f"""
        SELECT s.*, p.peak_mw, CAST(ceil(round(p.peak_mw * 1000 / {plug}, 9)) AS INTEGER) AS required_plugs_at_peak, d.*
        FROM (SELECT count(*) AS trips, count(DISTINCT vehicle) AS unique_vehicles, {even("sum(distance_km)", 1)} AS total_km,
                {even("sum(demand_kwh) / 1000", 1)} AS total_mwh, {even("avg(gap_hours)", 1)} AS avg_gap_hours,
                count(*) AS events, {even("sum(demand_kwh) / 1000", 1)} AS shortage_mwh FROM {loads} WHERE {where}) s
        CROSS JOIN (SELECT max({even("kw / 1000", 2)}) AS peak_mw FROM ({slots})) p
        CROSS JOIN ({spread(days, day_km, "days")}) d"""


def selection_vehicles(loads: str, places: str) -> str:
    return f"""
        SELECT codes, plates, days, days AS passages, total_km, avg_day_km, p95_km, avg_kwh_per_day, total_mwh,
            avg_standing_hours, required_kw
        FROM (SELECT vehicle, min(vehicle_code) AS codes,
                coalesce(min(nullif(plates, '')), '-') AS plates, count(*) AS days, {even("sum(distance_km)", 1)} AS total_km,
                {even("avg(distance_km)", 1)} AS avg_day_km, {even("quantile_cont(distance_km, 0.95)", 1)} AS p95_km,
                {even("avg(distance_km * 1.2e0)", 1)} AS avg_kwh_per_day,
                {even("sum(distance_km) * 1.2e0 / 1000", 2)} AS total_mwh, {even("avg(gap_hours)", 1)} AS avg_standing_hours,
                {even("quantile_cont(required_kw, 0.95)", 0)} AS required_kw
            FROM {loads} GROUP BY vehicle)
        ORDER BY total_mwh DESC, p95_km DESC, vehicle"""


def scenarios(years: tuple[int, ...], cherry: bool) -> str:
    inflow = {i.year: i.tractors + i.box_trucks for i in DEFAULT_INFLOWS}
    rows = ", ".join(f"({y}, {inflow.get(y, 0)})" for y in years)
    mode = "cherry-pick" if cherry else "linear"
    rank = "row_number() OVER (ORDER BY dwell_min DESC, planned_start, vehicle_code, trip_id, action_seq)"
    keep = "w.rank <= y.expected" if cherry else "true"
    return f"""
        SELECT y.year, '{mode}' AS mode, y.scale AS scale_factor, h.hour,
            CAST(ceil(round(coalesce(b.vehicles, 0) * y.scale, 9)) AS BIGINT) AS vehicles,
            CAST(ceil(round(coalesce(b.events, 0) * y.scale, 9)) AS BIGINT) AS events,
            {even(even("coalesce(b.kw, 0)", 0) + " * y.scale", 0)} AS required_kw,
            {even(even("coalesce(b.kw, 0)", 0) + " * y.scale / 1000", 2)} AS required_mw
        FROM (SELECT year, expected, {even("least(1.0e0, CAST(expected AS DOUBLE) / (SELECT greatest(1, count(DISTINCT vehicle_key)) FROM windows))", 4)} AS scale
            FROM (VALUES {rows}) AS v(year, expected)) y
        CROSS JOIN (SELECT CAST(range AS INTEGER) AS hour FROM range(24)) h
        LEFT JOIN (SELECT year, CAST(hour(slot) AS INTEGER) AS hour, vehicles, events, kw FROM (
                SELECT y.year, w.slot, count(DISTINCT w.vehicle_key) AS vehicles, count(*) AS events, round(sum(w.kw), 6) AS kw
                FROM (VALUES {rows}) AS y(year, expected)
                JOIN (SELECT s.*, r.rank FROM window_slots s JOIN (SELECT vehicle_code, location_id, planned_start, trip_id, action_seq, {rank} AS rank
                        FROM windows) r ON r.vehicle_code = s.vehicle_code AND r.location_id = s.location_id
                        AND r.planned_start = s.planned_start AND r.trip_id = s.trip_id AND r.action_seq = s.action_seq) w ON {keep}
                GROUP BY ALL)
            QUALIFY row_number() OVER (PARTITION BY year, hour(slot) ORDER BY kw DESC, vehicles DESC, slot) = 1) b
            ON b.year = y.year AND b.hour = h.hour"""


HEATMAP = """SELECT h.location_id, p.name AS location_name, h.hour, h.vehicles, h.required_kw, h.required_mw
    FROM place_hours h JOIN top_places p ON p.location_id = h.location_id"""

LAYOUTS = (
    "CAST({0} AS TIMESTAMP)", "date_trunc('minute', {0})", "CAST({0} AS TIMESTAMP)", "date_trunc('minute', {0})",
    "CAST({0} AS TIMESTAMP)", "date_trunc('minute', {0})", "CAST(date_trunc('day', {0}) AS TIMESTAMP)",
    "CAST(date_trunc('day', {0}) AS TIMESTAMP)", "CAST(date_trunc('day', {0}) AS TIMESTAMP)", "CAST(NULL AS TIMESTAMP)",
)

ANSWERS: dict[str, str] = {
    # Sources.
    "scan_trip_csv": """
        SELECT vehicle_code, trip_id, carrier, action, strftime(planned_start, '%d-%m-%Y %H:%M:%S') AS starts,
            strftime(planned_end, '%d-%m-%Y %H:%M:%S') AS ends, plate,
            coalesce(replace(printf('%.1f', trip_km), '.', ','), '') AS trip_km,
            replace(printf('%.1f', segment_km), '.', ',') AS segment_km, address FROM raw""",
    "scan_stops_parquet": f"""
        SELECT {TRIP}, stop_seq, action, location_name, address, planned_start, planned_end, segment_km, trip_km, dwell_min,
            lat, lon, '' AS plate, '' AS plate_norm, '' AS vehicle_type, pc6 FROM stops""",
    "scan_road_variants": """
        SELECT variant, lat1, lon1, lat2, lon2, n_vehicles, n_passes
        FROM edges CROSS JOIN (VALUES ('full'), ('eigen'), ('charter')) AS v(variant)""",
    "scan_road_heat": """
        SELECT variant, lat, round(lon, 6) AS lon, weight
        FROM heat CROSS JOIN (VALUES ('full'), ('eigen'), ('charter')) AS v(variant)""",
    "scan_chargers": "SELECT * FROM chargers",
    "scan_geocode": "SELECT address, lat, lon, count(*) AS n FROM typed GROUP BY ALL",
    "scan_ze_zones": "SELECT pc6, ze_zone, ze_start_date, count(*) AS n FROM stops WHERE in_zez GROUP BY ALL",
    "scan_fleet_tables": """
        SELECT fleet_no, plate, 'Midden' AS region, 'Depot ' || k AS depot, 'Brieven' AS location_type, 'Merk' AS brand,
            'Trekker' AS kind, 'Diesel' AS fuel, plate_norm FROM fleet""",
    "scan_fleet_depots": """
        SELECT name, 'Brieven' AS location_type FROM (
            SELECT DISTINCT 'Depot ' || k AS name FROM fleet UNION ALL SELECT DISTINCT 'DEPOT ' || k FROM fleet
            UNION ALL SELECT 'Totaal')""",
    # Ingest.
    "resolve_columns": """
        SELECT carrier, '' AS carrier_type_raw, vehicle_code, vehicle_type, trip_id, action, location_name, address,
            upper(plate) AS plate, plate_norm, planned_start, planned_end, coalesce(trip_km, segment_km) AS trip_km,
            segment_km FROM raw""",
    "parse_timestamp": " UNION ALL ".join(
        f"SELECT event_id, CAST({i} AS INTEGER) AS layout, {expr.format("date_trunc('second', ts)")} AS parsed FROM events"
        for i, expr in enumerate(LAYOUTS)
    ),
    "parse_decimal": """
        SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS DECIMAL(18, 2))::DOUBLE AS from_comma,
            CAST(l_extendedprice AS DECIMAL(18, 2))::DOUBLE AS from_dot, CAST(NULL AS DOUBLE) AS from_text FROM lineitem""",
    "normalize_plate": "SELECT DISTINCT vehicle_code, plate_norm FROM raw",
    "classify_carrier": """
        SELECT carrier, CASE carrier WHEN 'Eigen Vervoer' THEN 'own' WHEN 'Uitbesteed Vervoer' THEN 'charter'
                ELSE 'unknown' END AS vehicle_class,
            CASE carrier WHEN 'Eigen Vervoer' THEN 'eigen' WHEN 'Uitbesteed Vervoer' THEN 'charter' ELSE 'onbekend' END
                AS carrier_type, count(*) AS n FROM raw GROUP BY ALL""",
    "travel_filter": "SELECT vehicle_code, trip_id, action, planned_start FROM raw WHERE action = 'travel'",
    "geocode_join": "SELECT vehicle_code, trip_id, planned_start, address, lat, lon FROM typed",
    "valid_row_filter": "SELECT vehicle_code, trip_id, planned_start, action FROM raw WHERE plate <> ''",
    "sequence_actions": f"SELECT {TRIP}, action_seq, action, address, planned_start FROM actions",
    "location_id": "SELECT location_id, count(*) AS n FROM actions GROUP BY location_id",
    "dwell_minutes": f'SELECT {TRIP}, action_seq, dwell_min, 0.0e0 AS backwards, 0.0e0 AS "open" FROM actions',
    "build_route_actions": "SELECT * FROM actions",
    "build_stops": "SELECT * EXCLUDE (ze_zone, ze_start_date, in_zez) FROM stops",
    "route_actions_from_stops": f"""
        SELECT vehicle_code, carrier, CASE carrier_type WHEN 'eigen' THEN 'own' WHEN 'charter' THEN 'charter'
                ELSE 'unknown' END AS vehicle_class, trip_date, trip_id, stop_seq AS action_seq, action, location_name, address,
            {CELL.format("lat", "lon")} AS location_id, planned_start, planned_end, dwell_min, segment_km, trip_km, lat, lon,
            plate, plate_norm, vehicle_type FROM stops""",
    "extract_pc6": """
        SELECT DISTINCT address, CASE WHEN address = 'Onbekend adres' THEN ''
            ELSE replace(regexp_extract(address, '[0-9]{4} [A-Z]{2}'), ' ', '') END AS pc6 FROM actions""",
    "dedupe_ze_zones": """
        SELECT pc6, 'Zone ' || CAST(trip_date AS VARCHAR) AS ze_zone, trip_id AS ze_start_date FROM stops
        QUALIFY row_number() OVER (PARTITION BY pc6 ORDER BY trip_date, trip_id) = 1""",
    "enrich_ze_zone": f"SELECT {TRIP}, stop_seq, pc6, ze_zone, ze_start_date, in_zez FROM stops",
    "backfill_columns": f"""
        SELECT {TRIP}, stop_seq, '' AS plate, 0.0e0 AS trip_km, false AS in_zez, lat FROM stops""",
    # Derived tables.
    "daily_trips": "SELECT * FROM trips",
    "vehicle_days": "SELECT * FROM days",
    "overnight_candidates": "SELECT * REPLACE (round(gap_hours, 6) AS gap_hours, round(end_start_km, 6) AS end_start_km) FROM candidates",
    "overnight_home_location": f"SELECT vehicle_key, depot_id, events, last_seen, {six('median_gap_hours')}, rn FROM home",
    "overnight_events": f"""
        SELECT vehicle_code, trip_date, vehicle_key, depot_id, prev_end_time, day_start, day_km, {six("gap_hours")}
        FROM overnight""",
    "overnight_locations": """
        SELECT depot_id, round(avg(start_lat), 6) AS lat, round(avg(start_lon), 6) AS lon, any_value(start_address) AS address,
            count(*) AS events, count(DISTINCT vehicle_key) AS unique_vehicles,
            round(quantile_cont(gap_hours, 0.5), 6) AS median_gap_hours, round(quantile_cont(day_km, 0.95), 6) AS p95_day_km,
            round(sum(day_km), 6) AS total_day_km,
            round(least(1.0e0, count(DISTINCT vehicle_key) / 25) * 0.6e0 + least(1.0e0, count(*) / 100) * 0.4e0, 6) AS confidence
        FROM overnight GROUP BY depot_id""",
    "road_selection_index": f"""
        SELECT {TRIP}, start_lat, start_lon, end_lat, end_lon, {six("mid_lat", "mid_lon")}, distance_km FROM road_index""",
    "first_last_stop": f"""
        SELECT {TRIP}, max(stop_seq) FILTER (rf = 1) AS first_seq, max(planned_start) FILTER (rf = 1) AS first_start,
            max(address) FILTER (rf = 1) AS first_address, max(stop_seq) FILTER (rl = 1) AS last_seq,
            max(planned_start) FILTER (rl = 1) AS last_start, max(address) FILTER (rl = 1) AS last_address
        FROM (SELECT *, row_number() OVER (PARTITION BY {TRIP} ORDER BY planned_start, planned_end, stop_seq) AS rf,
                row_number() OVER (PARTITION BY {TRIP} ORDER BY planned_start DESC, planned_end DESC, stop_seq DESC) AS rl
            FROM stops) GROUP BY {TRIP}""",
    "previous_day_end": """
        SELECT vehicle_code, trip_date, prev_end_time, prev_end_lat, prev_end_lon, prev_end_address FROM days_before""",
    # Filters.
    "filter_stops": f"""
        SELECT {TRIP}, stop_seq, carrier_type, dwell_min, ze_zone FROM stops WHERE {SOME} AND dwell_min >= 15 AND in_zez""",
    "filter_date_range": f"""
        SELECT {TRIP}, distance_km FROM trips WHERE trip_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'""",
    "filter_in_list": f"SELECT {TRIP}, carrier FROM trips WHERE carrier IN ('Overig', 'Eigen Vervoer')",
    "filter_vehicle": f"SELECT {TRIP}, plate FROM trips WHERE {VEHICLES}",
    "filter_ze_stops": f"SELECT {TRIP}, stop_seq, pc6 FROM stops WHERE NOT in_zez",
    "filter_ze_trips": f"""
        SELECT {TRIP}, 'in' AS mode FROM trips WHERE {exists("trips", "in_zez")}
        UNION ALL SELECT {TRIP}, 'out' FROM trips WHERE {exists("trips", "NOT in_zez")}""",
    "filter_daily_trips": f"SELECT {TRIP}, distance_km FROM trips WHERE {SOME} AND {exists('trips', 'NOT in_zez')}",
    "filter_overnight": f"""
        SELECT vehicle_code, trip_date, depot_id, day_km FROM overnight WHERE {SOME} AND {exists("overnight", "in_zez", False)}""",
    "filter_within_radius": f"""
        SELECT vehicle_code, trip_date, depot_id, day_km FROM overnight
        WHERE {SOME} AND {hav("start_lat", "start_lon", "52.201e0", "5.102e0")} <= 1""",
    "filter_road_selection": f"SELECT {TRIP}, distance_km FROM on_road WHERE {SOME}",
    "filter_power_actions": f"""
        SELECT {TRIP}, action_seq, action, vehicle_class FROM actions
        WHERE planned_end > planned_start AND action IN ({WINDOWS}) AND dwell_min >= 15
            AND trip_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' AND vehicle_class IN ('own', 'charter')""",
    "filter_chargers": """
        SELECT id, name FROM chargers WHERE max_power_kw >= 200 AND connectors >= 3 AND dedicated = 'Ja'
            AND access IN ('Publiek', 'Semi-publiek')""",
    "filter_near_segment": f"SELECT vehicle_code, break_start, {six('break_lat', 'break_lon')} FROM near_breaks",
    "road_variant_choice": """
        SELECT asked, variant, (SELECT count(*) FROM edges) AS edges
        FROM (VALUES ('all', 'full'), ('own', 'eigen'), ('charter', 'charter')) AS v(asked, variant)""",
    # Totals and rankings.
    "metadata": """
        SELECT count(*) AS stop_count, count(DISTINCT trip_id) AS trip_count, count(DISTINCT vehicle_code) AS vehicle_count,
            min(trip_date) AS min_date, max(trip_date) AS max_date FROM stops""",
    "metadata_values": """
        SELECT DISTINCT 'carrier_type' AS kind, carrier_type AS value FROM stops
        UNION ALL SELECT DISTINCT 'carrier', carrier FROM stops UNION ALL SELECT DISTINCT 'vehicle_code', vehicle_code FROM stops
        UNION ALL SELECT DISTINCT 'ze_zone', ze_zone FROM stops WHERE in_zez""",
    "summary": f"""
        SELECT s.*, {even("total", 1)} AS total_km, {even("mean", 1)} AS avg_trip_km, {even("dwell / 60", 1)} AS dwell_hours,
            {even("100 * own / total", 1)} AS own_km_pct, {even("100 * charter / total", 1)} AS charter_km_pct
        FROM (SELECT count(*) AS stops, count(DISTINCT trip_id) AS trips, count(DISTINCT vehicle_code) AS vehicles
            FROM stops WHERE {SOME} AND dwell_min >= 15) s
        CROSS JOIN (SELECT sum(dwell_min) AS dwell FROM stops WHERE {SOME} AND dwell_min >= 15) w
        CROSS JOIN (SELECT sum(distance_km) AS total, avg(distance_km) AS mean,
                sum(distance_km) FILTER (carrier_type = 'eigen') AS own,
                sum(distance_km) FILTER (carrier_type = 'charter') AS charter FROM trips WHERE {SOME}) t""",
    "stop_heat": """
        SELECT round(lat, 3) AS lat, round(lon, 3) AS lon, greatest(sum(dwell_min), CAST(count(*) AS DOUBLE)) AS weight
        FROM stops GROUP BY 1, 2 ORDER BY weight DESC, 1, 2""",
    "stop_markers": f"""
        SELECT lat, lon, name, address, vehicles AS unique_vehicles, stops, trips, {even("mean", 1)} AS avg_dwell_min
        FROM {cells("stops", SOME + " AND dwell_min >= 15")} ORDER BY vehicles DESC, stops DESC, lat, lon""",
    "top_stops": f"""
        SELECT lat, lon, name, address, stops, vehicles, trips, {even("dwell / 60", 1)} AS dwell_hours,
            {even("mean", 1)} AS avg_dwell_min FROM {cells("stops")} ORDER BY vehicles DESC, dwell DESC, lat, lon""",
    "ze_zone_summary": """
        SELECT ze_zone AS zone, ze_start_date AS start_date, count(*) AS stops, count(DISTINCT trip_id) AS trips,
            count(DISTINCT vehicle_code) AS vehicles FROM stops WHERE in_zez GROUP BY 1, 2 ORDER BY stops DESC""",
    "chargers_ranked": """
        SELECT * FROM chargers WHERE max_power_kw >= 100 AND access IN ('Publiek', 'Semi-publiek')
        ORDER BY max_power_kw DESC, connectors DESC, name, id""",
    "nearest_charger": f"""
        SELECT printf('%.2f:%.2f', lat1, lon1) AS depot_id, round(min({hav("lat1", "lon1", "lat", "lon")}), 6) AS nearest_charger_km
        FROM (SELECT DISTINCT lat1, lon1 FROM edges)
        CROSS JOIN (SELECT DISTINCT lat, lon FROM chargers WHERE access <> 'Privaat') GROUP BY lat1, lon1""",
    "overnight_location_ranking": f"""
        SELECT depot_id, {even("lat", 6)} AS lat, {even("lon", 6)} AS lon, address, unique_vehicles, events,
            {even("gap", 1)} AS median_gap_hours, {even("p95", 1)} AS p95_day_km, {even("mwh", 1)} AS total_mwh,
            {even("mwh", 1)} AS shortage_mwh, {even("near", 1)} AS nearest_charger_km, {advice("mwh")} AS recommendation
        FROM (SELECT depot_id, avg(start_lat) AS lat, avg(start_lon) AS lon, any_value(start_address) AS address,
                count(*) AS events, count(DISTINCT vehicle_key) AS unique_vehicles, quantile_cont(gap_hours, 0.5) AS gap,
                quantile_cont(day_km, 0.95) AS p95, count(*) * 590.0e0 / 1000 AS mwh,
                (SELECT min({hav("avg(start_lat)", "avg(start_lon)", "c.lat", "c.lon")}) FROM chargers c
                    WHERE c.access <> 'Privaat') AS near
            FROM overnight GROUP BY depot_id)
        ORDER BY mwh DESC, unique_vehicles DESC, depot_id""",
    "selected_day_heat": f"""
        SELECT round(lat, 3) AS lat, round(lon, 3) AS lon, CAST(count(*) AS DOUBLE) AS weight FROM stops
        WHERE (vehicle_code, trip_date) IN (SELECT (vehicle_code, trip_date) FROM overnight WHERE depot_id = '{DEPOT}')
        GROUP BY 1, 2 ORDER BY weight DESC""",
    "selected_trip_heat": """
        SELECT round(lat, 3) AS lat, round(lon, 3) AS lon, CAST(count(*) AS DOUBLE) AS weight FROM stops
        WHERE (vehicle_code, trip_date, trip_id) IN (SELECT (vehicle_code, trip_date, trip_id) FROM on_road)
        GROUP BY 1, 2 ORDER BY weight DESC""",
    "daily_distance_of_selection": """
        SELECT vehicle_code, trip_date, day_km FROM days
        WHERE (vehicle_code, trip_date) IN (SELECT (vehicle_code, trip_date) FROM on_road)""",
    "distance_statistics": spread("loads", "distance_km"),
    "distance_distribution": """
        SELECT CAST(b * 50 AS INTEGER) AS from_km, CAST(b * 50 + 50 AS INTEGER) AS to_km, count(*) AS trips
        FROM (SELECT least(floor(distance_km / 50), greatest(1, ceil(max(distance_km) OVER () / 50)) - 1) AS b FROM trips)
        GROUP BY b""",
    "fixed_distance_distribution": """
        SELECT CAST(range * 50 AS INTEGER) AS from_km, CAST(range * 50 + 50 AS INTEGER) AS to_km,
            (SELECT count(*) FROM days WHERE least(floor(day_km / 50), 14) = range) AS trips FROM range(15)""",
    "selection_vehicles": selection_vehicles("loads", "overnight"),
    "selection_vehicles_road": selection_vehicles("road_loads", "on_road"),
    "selection_summary": f"""
        SELECT count(*) AS trips, count(DISTINCT vehicle) AS unique_vehicles, {even("sum(distance_km)", 1)} AS total_km,
            {even("sum(demand_kwh) / 1000", 1)} AS total_mwh, {even("avg(gap_hours)", 1)} AS avg_gap_hours,
            {advice("(sum(demand_kwh) / 1000)")} AS recommendation FROM loads""",
    "busy_windows": f"""
        SELECT strftime(start_time, '%H:00') AS time_slot, count(*) AS events, {even("sum(demand_kwh)", 0)} AS demand_kwh,
            0.0e0 AS deliverable_kwh, {even("sum(demand_kwh)", 0)} AS shortage_kwh,
            {even("sum(required_kw) / 1000", 2)} AS required_mw
        FROM loads GROUP BY 1 ORDER BY shortage_kwh DESC, required_mw DESC, time_slot LIMIT 12""",
    "charging_totals": f"""
        SELECT events, total_mwh, total_mwh AS shortage_mwh, peak_mw,
            CAST(ceil(round(peak_mw * 1000 / 350, 9)) AS INTEGER) AS required_plugs_at_peak
        FROM (SELECT count(*) AS events, {even("sum(demand_kwh) / 1000", 1)} AS total_mwh FROM loads)
        CROSS JOIN (SELECT max({even("required_kw / 1000", 2)}) AS peak_mw FROM slot_sums)""",
    "required_kw": f"""
        SELECT vehicle_code, trip_date, 'depot' AS kind, {six("required_kw")} FROM loads
        UNION ALL SELECT vehicle_code, trip_date, 'road', {six("required_kw")} FROM road_loads""",
    "hour_slots": "SELECT vehicle_code, trip_date, slot, round(overlap, 6) AS overlap_hours FROM load_slots",
    "hourly_demand_profile": f"""
        SELECT h.hour, coalesce(vehicles, 0) AS vehicles, coalesce(events, 0) AS events,
            {even("coalesce(demand_kwh, 0)", 0)} AS demand_kwh, {even("coalesce(required_kw, 0)", 0)} AS required_kw,
            {even("coalesce(required_kw, 0) / 1000", 2)} AS required_mw
        FROM (SELECT CAST(range AS INTEGER) AS hour FROM range(24)) h
        LEFT JOIN (SELECT * FROM slot_sums QUALIFY row_number() OVER (PARTITION BY hour(slot)
            ORDER BY vehicles DESC, required_kw DESC, slot) = 1) s ON hour(s.slot) = h.hour""",
    "weekly_demand_profile": f"""
        WITH best AS (SELECT *, isodow(slot) - 1 AS d, hour(slot) AS h FROM slot_sums
            QUALIFY row_number() OVER (PARTITION BY isodow(slot), hour(slot)
                ORDER BY required_kw DESC, vehicles DESC, slot) = 1),
        listed AS (SELECT slot, list_sort(list(DISTINCT upper(plates)) FILTER (plates <> ''))[1:40] AS plates,
                list_sort(list(DISTINCT upper(vehicle_code)))[1:40] AS codes FROM load_slots GROUP BY slot)
        SELECT CAST(r // 24 AS INTEGER) AS day_index, {pick(WEEKDAY_LABELS, "r // 24")} AS day_label,
            CAST(r % 24 AS INTEGER) AS hour, coalesce(vehicles, 0) AS vehicles, coalesce(events, 0) AS events,
            {even("coalesce(demand_kwh, 0)", 0)} AS demand_kwh, {even("coalesce(required_kw, 0)", 0)} AS required_kw,
            {even("coalesce(required_kw, 0) / 1000", 2)} AS required_mw,
            coalesce(array_to_string(plates, ','), '') AS plates, coalesce(array_to_string(codes, ','), '') AS codes
        FROM range(168) AS c(r) LEFT JOIN best ON d = r // 24 AND h = r % 24 LEFT JOIN listed l ON l.slot = best.slot""",
    "slot_vehicle_demand": f"""
        SELECT slot, min(vehicle_code) AS vehicle_code, min(CASE WHEN plates = '' THEN '-' ELSE plates END) AS plate,
            {even("sum(demand_kwh)", 0)} AS demand_kwh, {even("sum(required_kw)", 0)} AS required_kw,
            {even("max(gap_hours)", 1)} AS standing_hours,
            strftime(min(start_time), '%H:%M') || '-' || strftime(max(end_time), '%H:%M') AS "window"
        FROM load_slots GROUP BY slot, vehicle""",
    "peak_slot_vehicles": f"""
        WITH best AS (SELECT slot FROM slot_sums QUALIFY row_number() OVER (PARTITION BY isodow(slot), hour(slot)
            ORDER BY required_kw DESC, vehicles DESC, slot) = 1)
        SELECT CAST(isodow(slot) - 1 AS INTEGER) AS day_index, CAST(hour(slot) AS INTEGER) AS hour, slot,
            min(vehicle_code) AS vehicle_code, min(CASE WHEN plates = '' THEN '-' ELSE plates END) AS plate,
            {even("sum(demand_kwh)", 0)} AS demand_kwh, {even("sum(required_kw)", 0)} AS required_kw,
            {even("max(gap_hours)", 1)} AS standing_hours,
            strftime(min(start_time), '%H:%M') || '-' || strftime(max(end_time), '%H:%M') AS "window"
        FROM load_slots WHERE slot IN (SELECT slot FROM best) GROUP BY slot, vehicle""",
    # Selections.
    "depot_selection": selection("loads", f"loads WHERE depot_id = '{DEPOT}'", "distance_km", f"depot_id = '{DEPOT}'"),
    "stop_selection": selection(
        "loads",
        f"loads WHERE {hav('lat', 'lon', '52.101e0', '5.102e0')} <= 1",
        "distance_km",
        f"{hav('lat', 'lon', '52.101e0', '5.102e0')} <= 1",
    ),
    "road_selection": selection(
        "road_loads",
        "days WHERE (vehicle_code, trip_date) IN (SELECT (vehicle_code, trip_date) FROM on_road)",
        "day_km",
    ),
    "charging_scenario": f"""
        SELECT *, 'road' AS kind FROM ({
        selection(
            "(SELECT * REPLACE (distance_km * 2.0e0 AS demand_kwh, distance_km * 2.0e0 AS required_kw) FROM road_loads)",
            "days WHERE (vehicle_code, trip_date) IN (SELECT (vehicle_code, trip_date) FROM on_road)",
            "day_km",
        )
    })
        UNION ALL BY NAME SELECT *, 'depot' AS kind FROM ({
        selection(
            "(SELECT * REPLACE (1000.0e0 AS demand_kwh, 1000.0e0 / gap_hours AS required_kw) FROM loads)",
            f"loads WHERE depot_id = '{DEPOT}'",
            "distance_km",
            f"depot_id = '{DEPOT}'",
        )
    })""",
    # Power.
    "presence_windows": f"""
        SELECT vehicle_code, vehicle_key, vehicle_class, trip_date, trip_id, location_id, location_name, action_seq,
            planned_start, planned_end, {six("dwell_min", "distance_km")} FROM presence""",
    "merge_presence_windows": f"""
        SELECT vehicle_code, vehicle_key, vehicle_class, trip_date, trip_id, location_id, location_name, planned_start,
            planned_end, {six("dwell_min")} FROM windows""",
    "power_location_profile": "SELECT * FROM places ORDER BY peak_kw DESC, vehicles DESC, upper(name), location_id",
    "power_daily_metrics": "SELECT * FROM daily_power",
    "top_power_days": "SELECT * FROM daily_power ORDER BY peak_kw DESC, vehicles DESC, date LIMIT 10",
    "hourly_power_profile": "SELECT * FROM place_hours",
    "power_heatmap": HEATMAP,
    "power_slot_vehicles": f"""
        SELECT slot, location_id, min(vehicle_code) AS vehicle_code, min(CASE WHEN plate = '' THEN '-' ELSE plate END) AS plate,
            min(vehicle_class) AS class, CAST(count(*) * 590 AS DOUBLE) AS demand_kwh, {even("sum(kw)", 0)} AS required_kw,
            {even("max(dwell_min / 60)", 3)} AS standing_hours,
            strftime(min(planned_start), '%H:%M') || '-' || strftime(max(planned_end), '%H:%M') AS "window"
        FROM window_slots GROUP BY slot, location_id, vehicle_key""",
    "scenario_profiles": scenarios((2026, 2027, 2031, 2040), cherry=False),
    "scenario_profiles_cherry_pick": scenarios((2026, 2027, 2030, 2035), cherry=True),
    "power_diagnostics": f"""
        SELECT count(*) AS total, count(*) FILTER (action IN ({WINDOWS})) AS charge_window,
            count(*) FILTER (lat IS NULL) AS missing_location, count(*) FILTER (vehicle_class = 'unknown') AS unknown_class
        FROM power_actions""",
    "routes_without_wait": f"""
        WITH chosen AS (SELECT * FROM actions WHERE planned_end > planned_start AND dwell_min >= 15
            AND trip_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' AND vehicle_class IN ('own', 'charter'))
        SELECT count(*) AS n FROM (SELECT DISTINCT {TRIP} FROM chosen)
        ANTI JOIN (SELECT DISTINCT {TRIP} FROM chosen WHERE action IN ({WINDOWS})) USING ({TRIP})""",
    "vehicle_class_counts": """
        SELECT vehicle_class AS class, count(DISTINCT vehicle_key) AS vehicles, count(*) AS events
        FROM power_actions GROUP BY vehicle_class""",
    "fleet_match_count": """
        SELECT count(DISTINCT coalesce(nullif(plate_norm, ''), vehicle_code)) AS n FROM actions
        WHERE coalesce(nullif(plate_norm, ''), vehicle_code) IN (SELECT fleet_no FROM fleet UNION SELECT plate_norm FROM fleet)""",
    # Breaks.
    "break_trips": f"SELECT {TRIP}, plates, trip_start, trip_end, start_lat, end_lat, distance_km FROM trips",
    "reset_locations": f"SELECT {six('lat', 'lon')} FROM resets",
    "shift_sessions": f"SELECT {TRIP}, shift_id, shift_start, is_reset FROM progress",
    "shift_progress": f"SELECT {TRIP}, plausible, {six('drive_before', 'km_before')} FROM progress",
    "break_trip_labels": f"SELECT {TRIP}, reason FROM labelled",
    "break_events": f"""
        SELECT vehicle_code, plate, shift_start, break_start, drive_hours, bearing_bucket,
            {pick(DIRECTION_LABELS, "bearing_bucket")} AS direction,
            {six("km_since_shift_start", "demand_kwh", "required_kw", "break_lat", "break_lon")} FROM breaks""",
    "break_diagnostics": """
        SELECT r.reason, count(l.reason) AS n
        FROM (SELECT unnest(['included', 'invalid', 'implausible_speed', 'before_window', 'after_window']) AS reason) r
        LEFT JOIN labelled l ON l.reason = r.reason GROUP BY r.reason
        UNION ALL SELECT 'reset', count(*) FROM labelled WHERE is_reset""",
    "quarter_slots": f"SELECT vehicle_code, break_start, slot_start, {six('overlap_hours')} FROM quarters",
    "break_quarter_profile": f"""
        SELECT slot_start, count(DISTINCT vehicle) AS vehicles, {even("sum(required_kw)", 1)} AS required_kw,
            {even("sum(required_kw) / 1000", 3)} AS required_mw, {even("sum(required_kw * overlap_hours)", 1)} AS demand_kwh
        FROM quarters GROUP BY slot_start""",
    "break_hourly_profile": f"""
        SELECT h.hour, coalesce(vehicles, 0) AS vehicles, coalesce(events, 0) AS events,
            {even("coalesce(kwh, 0)", 1)} AS demand_kwh, {even("coalesce(kw, 0)", 1)} AS required_kw,
            {even("coalesce(kw, 0) / 1000", 3)} AS required_mw
        FROM (SELECT CAST(range AS INTEGER) AS hour FROM range(24)) h
        LEFT JOIN (SELECT hour(slot_start) AS hour, count(DISTINCT vehicle) AS vehicles,
                count(DISTINCT (vehicle_code, plate, break_start)) AS events, sum(required_kw * overlap_hours) AS kwh
            FROM quarters GROUP BY 1) t ON t.hour = h.hour
        LEFT JOIN (SELECT hour(slot_start) AS hour, max(s) AS kw FROM (SELECT slot_start, sum(required_kw) AS s
                FROM quarters GROUP BY 1) GROUP BY 1) p ON p.hour = h.hour""",
    "break_demand_lines": "SELECT * FROM break_lines",
    "break_demand_detail": f"""
        SELECT (SELECT max({even("s / 1000", 3)}) FROM (SELECT sum(required_kw) AS s FROM near_quarters GROUP BY slot_start)) AS peak_mw,
            {even("sum(demand_kwh)", 1)} AS total_kwh, count(DISTINCT vehicle) AS vehicles, count(*) AS passages
        FROM near_breaks""",
    "break_vehicles": f"""
        SELECT vehicle_code, plate, shift_start, break_start, {even("drive_hours", 2)} AS drive_hours,
            {even("km_since_shift_start", 1)} AS km_since_shift_start, {even("demand_kwh", 1)} AS demand_kwh,
            {even("required_kw", 1)} AS required_kw FROM near_breaks""",
    # Roads.
    "top_road_edges": "SELECT * FROM busy_edges",
    "road_heat": """
        SELECT lat, round(lon, 6) AS lon, weight FROM (SELECT * FROM heat ORDER BY weight DESC, lat, lon
            LIMIT (SELECT CAST(ceil(count(*) * 5 / 100.0) AS BIGINT) FROM heat))""",
    "enrich_road_edges": f"""
        SELECT lat1, lon1, lat2, lon2, n_passes, {bucket(bearing("lat1", "lon1", "lat2", "lon2"))} AS bucket,
            printf('%.5f:%.5f', lat1, lon1) AS start_key, printf('%.5f:%.5f', lat2, lon2) AS end_key,
            round({bearing("lat1", "lon1", "lat2", "lon2")}, 6) AS bearing,
            round({hav("lat1", "lon1", "lat2", "lon2")}, 6) AS length_km FROM edges""",
    "contract_road_chains": "SELECT lat1, lon1, lat2, lon2, bucket, n_passes, chain_id, pos FROM chained",
    # No chain here is longer than 8 km, so each is one piece.
    "split_road_chains": """
        SELECT lat1, lon1, lat2, lon2, chain_id, pos, CASE WHEN sum(length_km) OVER (PARTITION BY chain_id) <= 8
            THEN CAST(0 AS INTEGER) END AS segment_no FROM chained""",
    "road_lines": "SELECT * REPLACE (CAST(to_json(coordinates) AS VARCHAR) AS coordinates) FROM road_map",
    "dashboard_roads": """
        SELECT * EXCLUDE (coordinates) FROM road_map ORDER BY passes DESC, unique_vehicles DESC, segment_id, lat1, lon1""",
    "corridors": f"""
        SELECT CAST(row_number() OVER (ORDER BY median_passes DESC, max_vehicles DESC, lat, lon) AS INTEGER) AS rank, *
        FROM (SELECT {even("(lat1 + lat2) / 2", 2)} AS lat, {even("(lon1 + lon2) / 2", 2)} AS lon,
                list_sort(list(passes))[count(*) // 2 + 1] AS median_passes, max(passes) AS max_passes,
                max(unique_vehicles) AS max_vehicles,
                {even(hav("min(least(lat1, lat2))", "min(least(lon1, lon2))", "max(greatest(lat1, lat2))", "max(greatest(lon1, lon2))"), 1)} AS spread_km,
                count(*) AS segments FROM road_map GROUP BY 1, 2)
        ORDER BY rank LIMIT 20""",
    "search_road_lines": """
        SELECT * EXCLUDE (coordinates) FROM road_map
        WHERE upper(road_name) LIKE '%WEGVLAK%' OR upper(direction) LIKE '%WEGVLAK%'
        ORDER BY length_km, passes DESC, segment_id, lat1, lon1""",
    "snap_to_road": f"""
        SELECT l.*, road_id, CAST(to_json(coordinates) AS VARCHAR) AS coordinates
        FROM break_lines l JOIN (
            SELECT l.segment_id, r.road_id, r.coordinates
            FROM break_lines l JOIN (SELECT segment_id AS road_id, coordinates,
                    unnest(coordinates[1:len(coordinates) - 1]) AS a, unnest(coordinates[2:len(coordinates)]) AS z FROM road_map) r
                ON {segment_km("(l.lat1 + l.lat2) / 2", "(l.lon1 + l.lon2) / 2", "a.lat", "a.lon", "z.lat", "z.lon")} <= 2
            QUALIFY row_number() OVER (PARTITION BY l.segment_id ORDER BY
                {segment_km("(l.lat1 + l.lat2) / 2", "(l.lon1 + l.lon2) / 2", "a.lat", "a.lon", "z.lat", "z.lon")}, road_id) = 1) s
            ON s.segment_id = l.segment_id""",
    "infer_road_name": f"""
        SELECT lat1, lon1, lat2, lon2, CASE WHEN best.km <= 3 THEN best.name
            ELSE printf('Wegvlak bij %.3f, %.3f', (lat1 + lat2) / 2, (lon1 + lon2) / 2) END AS road_name
        FROM (SELECT *, {name_near("(lat1 + lat2) / 2", "(lon1 + lon2) / 2")} AS best FROM edges)""",
    "simplify_polyline": f"""
        SELECT {TRIP}, array_to_string(CASE WHEN n <= 80 THEN range(n)
            ELSE list_filter(range(n), lambda i: i % CAST(ceil(n / 78.0) AS BIGINT) = 0 OR i = n - 1) END, ',') AS points
        FROM (SELECT *, CAST(floor(distance_km) AS BIGINT) + 1 AS n FROM trips)""",
    # Fleet.
    "fleet_trip_stats": "SELECT * FROM stats",
    "fleet_depots": """
        SELECT 'fleet:' || 'DEPOT ' || f.k AS depot_id, 'DEPOT ' || f.k AS name, '' AS region, 'Brieven' AS location_type,
            any_value(lat) AS lat, any_value(lon) AS lon, count(*) AS vehicles, count(s.code) AS matched_in_trips
        FROM fleet f JOIN locations l ON l.k = f.k LEFT JOIN stats s ON s.code = f.fleet_no GROUP BY f.k""",
    "fleet_depot_vehicles": """
        SELECT 'fleet:DEPOT ' || f.k AS depot_id, fleet_no, plate, 'Midden' AS region, 'Depot ' || f.k AS depot,
            'Brieven' AS location_type, 'Merk' AS brand, 'Trekker' AS kind, 'Diesel' AS fuel, plate_norm,
            coalesce(s.trips, 0) AS trips_in_data, coalesce(s.km, 0) AS km_in_data
        FROM fleet f LEFT JOIN stats s ON s.code = f.fleet_no""",
    "charter_fleet_depots": """
        SELECT 'charter-fleet:' || base AS depot_id, base AS name, 'Plaats ' || b.k AS region,
            'Charterstandplaats' AS location_type, any_value(lat) AS lat, any_value(lon) AS lon, count(*) AS vehicles,
            count(s.code) AS matched_in_trips
        FROM bases b JOIN locations l ON l.k = b.k JOIN (SELECT DISTINCT user_id FROM events) u ON u.user_id % 12 = b.k
        LEFT JOIN stats s ON s.code = 'W' || u.user_id GROUP BY base, b.k""",
    "charter_fleet_depot_vehicles": """
        SELECT 'charter-fleet:' || base AS depot_id, 'W' || u.user_id AS fleet_no, 'Plaats ' || b.k AS region,
            CASE WHEN u.user_id % 2 = 0 THEN 'Vast' ELSE 'Flex' END AS location_type, 'Bakwagen' AS kind, 'Diesel' AS fuel,
            coalesce(s.trips, 0) AS trips_in_data, coalesce(s.km, 0) AS km_in_data
        FROM bases b JOIN (SELECT DISTINCT user_id FROM events) u ON u.user_id % 12 = b.k
        LEFT JOIN stats s ON s.code = 'W' || u.user_id""",
    # Sinks.
    "sink_hourly_csv": """
        SELECT h.location_id, p.name, p.address, h.hour, h.vehicles, h.events, h.required_kw, h.required_mw
        FROM place_hours h JOIN places p ON p.location_id = h.location_id""",
    "sink_daily_csv": """
        SELECT date, vehicles AS unique_vehicles, own AS own_vehicles, charter AS charter_vehicles, trips, events,
            avg_dwell_min, peak_kw FROM daily_power""",
    "sink_scenario_csv": scenarios((2027, 2030), cherry=False),
    "sink_heatmap_csv": HEATMAP,
    "sink_heatmap_parquet": HEATMAP,
    "export_focus_report": f"""
        SELECT '{FOCUS}' AS location_id, 'Depot 6' AS name, 'Adres 6 1006 AB' AS address, h.hour,
            coalesce(vehicles, 0) AS vehicles, coalesce(events, 0) AS events, {even("coalesce(kw, 0)", 0)} AS required_kw,
            {even(even("coalesce(kw, 0)", 0) + " / 1000", 2)} AS required_mw
        FROM (SELECT CAST(range AS INTEGER) AS hour FROM range(24)) h
        LEFT JOIN (SELECT slot, count(DISTINCT vehicle_key) AS vehicles, count(*) AS events, round(sum(kw), 6) AS kw
            FROM window_slots WHERE vehicle_class = 'own' AND location_id = '{FOCUS}' GROUP BY slot
            QUALIFY row_number() OVER (PARTITION BY hour(slot) ORDER BY round(sum(kw), 6) DESC,
                count(DISTINCT vehicle_key) DESC, slot) = 1) b ON hour(b.slot) = h.hour""",
    "geojson_features": f"""
        SELECT 'Feature' AS type, 'Point' AS shape, lon, lat, vehicles AS weight, name AS label, stops, trips
        FROM {cells("stops")} ORDER BY vehicles DESC, stops DESC, lat, lon""",
    # Scalars.
    "haversine_km": f"SELECT {TRIP}, round({hav(*ENDS)}, 6) AS km FROM trips",
    "bearing_degrees": f"SELECT {TRIP}, round({bearing(*ENDS)}, 6) AS bearing FROM trips",
    "direction_bucket": f"SELECT {TRIP}, {bucket(f'round({bearing(*ENDS)}, 6)')} AS bucket FROM trips",
    "compass_direction": f"SELECT {TRIP}, {pick(DIRECTION_LABELS, bucket(f'round({bearing(*ENDS)}, 6)'))} AS direction FROM trips",
    "project_point": f"""
        SELECT {TRIP}, {project("start_lat", "start_lon", "(distance_km % 360)", 0.75, "lat")} AS lat,
            {project("start_lat", "start_lon", "(distance_km % 360)", 0.75, "lon")} AS lon FROM trips""",
    "point_segment_km": f"SELECT {TRIP}, round({segment_km('52.13e0', '5.07e0', *ENDS)}, 6) AS km FROM trips",
    "interpolate": f"SELECT {TRIP}, round(start_lat + (end_lat - start_lat) * distance_km / 1000, 6) AS lat FROM trips",
    "coordinate_key": f"""
        SELECT {TRIP}, printf('%.5f:%.5f', {even("start_lat", 5)}, {even("start_lon + (end_lon - start_lon) * 0.3e0", 5)}) AS key
        FROM trips""",
    "quantile_linear": """
        SELECT carrier_type, round(quantile_cont(distance_km, 0.1), 6) AS p10, round(quantile_cont(distance_km, 0.5), 6) AS p50,
            round(quantile_cont(distance_km, 0.95), 6) AS p95, round(max(distance_km), 6) AS p100
        FROM trips GROUP BY carrier_type""",
    "mode_text": """
        SELECT location_id, location_name AS name FROM (SELECT location_id, location_name, count(*) AS n FROM actions GROUP BY ALL)
        QUALIFY row_number() OVER (PARTITION BY location_id ORDER BY n DESC, upper(location_name)) = 1""",
    "mode_value": """
        SELECT vehicle_code, address FROM (SELECT vehicle_code, address, count(*) AS n FROM actions GROUP BY ALL)
        QUALIFY row_number() OVER (PARTITION BY vehicle_code ORDER BY n DESC, address) = 1""",
    "distinct_list": """
        SELECT vehicle_code, trip_date, string_agg(DISTINCT start_address, ', ' ORDER BY start_address) AS addresses
        FROM trips GROUP BY vehicle_code, trip_date""",
    "vehicle_group_key": f"SELECT {TRIP}, CASE WHEN plates = '' THEN 'Z' ELSE plates END AS key FROM trips",
    "compact_list": """
        SELECT carrier, array_to_string(codes[1:3], ', ') || CASE WHEN len(codes) > 3 THEN ' +' || (len(codes) - 3) ELSE '' END AS shown
        FROM (SELECT carrier, list_sort(list(DISTINCT vehicle_code)) AS codes FROM trips GROUP BY carrier)""",
    "weekday_label": f"""
        SELECT {TRIP}, CAST(isodow(trip_start) - 1 AS INTEGER) AS day_index,
            {pick(WEEKDAY_LABELS, "isodow(trip_start) - 1")} AS label FROM trips""",
    "recommendation": f"""
        SELECT {TRIP}, {advice("(distance_km * 10)")} AS depot, CASE WHEN distance_km * 10 - 2000 <= 0
            THEN 'Geen laadvraag in deze selectie.' ELSE 'Wegvlakselectie met berekende corridor-laadvraag.' END AS road FROM trips""",
    "standplaats_key": f"""
        SELECT {TRIP}, start_address || ', ' || carrier || CASE WHEN stops > 1 THEN ', Nederland' ELSE ', België' END AS key FROM trips""",
    "bankers_round": f"""
        SELECT {TRIP}, {even("distance_km / 4", 0)} AS whole, {even("distance_km / 4", 1)} AS tenth FROM trips""",
    "vehicle_key": f"SELECT {TRIP}, coalesce(nullif(plate_norm, ''), vehicle_code) AS key FROM trips",
}


def answers() -> dict[str, str]:
    """Name to a complete SQL statement."""
    return {name: statement(sql) for name, sql in ANSWERS.items()}
