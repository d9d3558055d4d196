"""Small trip data with known answers. Expected results depend on each of them."""

from __future__ import annotations

from datetime import date, datetime

A, B, C, D = "Adres A 1234 AB", "Adres B", "Adres C", "Adres D"
OWN, HIRED = ("Eigen vervoer", "eigen"), ("Uitbesteed vervoer", "charter")

# vehicle, carrier, day of January 2026, trip, seq, action, name, address, time, segment km, trip km, dwell, lat, lon
_ROWS = [
    ("W1", OWN, 1, "T1", 0, "Origin", "Depot A", A, "08:00", 0.0, 120.0, 10.0, 52.000, 5.000),
    ("W1", OWN, 1, "T1", 1, "Stop", "Hub B", B, "12:00", 60.0, 120.0, 20.0, 52.500, 5.500),
    ("W1", OWN, 1, "T1", 2, "Destination", "Depot A", A, "18:00", 60.0, 120.0, 20.0, 52.000, 5.000),
    ("W1", OWN, 2, "T2", 0, "Origin", "Depot A", A, "06:00", 0.0, 180.0, 5.0, 52.000, 5.000),
    ("W1", OWN, 2, "T2", 1, "Stop", "Hub C", C, "11:00", 90.0, 180.0, 15.0, 52.200, 5.200),
    ("W1", OWN, 2, "T2", 2, "Destination", "Depot A", A, "15:00", 90.0, 180.0, 15.0, 52.000, 5.000),
    ("W2", HIRED, 2, "T3", 0, "Origin", "Depot C", C, "07:00", 0.0, 200.0, 5.0, 53.000, 6.000),
    ("W2", HIRED, 2, "T3", 1, "Destination", "Hub D", D, "17:00", 200.0, 200.0, 15.0, 51.900, 4.500),
    ("W2", HIRED, 2, "T4", 0, "Origin", "Hub D", D, "18:00", 0.0, 80.0, 5.0, 51.900, 4.500),
    ("W2", HIRED, 2, "T4", 1, "Destination", "Depot C", C, "21:00", 80.0, 80.0, 15.0, 53.000, 6.000),
    ("W3", OWN, 3, "T5", 0, "Origin", "Depot A", A, "06:00", 0.0, 100.0, 5.0, 52.000, 5.000),
    ("W3", OWN, 3, "T5", 1, "Destination", "Hub B", B, "08:00", 100.0, 100.0, 15.0, 52.010, 5.010),
    ("W3", OWN, 3, "T6", 0, "Origin", "Hub B", B, "08:20", 0.0, 110.0, 5.0, 52.010, 5.010),
    ("W3", OWN, 3, "T6", 1, "Destination", "Depot A", A, "10:30", 110.0, 110.0, 15.0, 52.000, 5.000),
    ("W3", OWN, 3, "T7", 0, "Origin", "Depot A", A, "13:00", 0.0, 90.0, 5.0, 52.000, 5.000),
    ("W3", OWN, 3, "T7", 1, "Destination", "Hub B", B, "14:30", 90.0, 90.0, 15.0, 52.010, 5.010),
    ("W4", ("Charter", "charter"), 3, "T8", 0, "Origin", "Klant X", "Adres X", "06:00", 0.0, 130.0, 5.0, 52.500, 5.500),
    ("W4", ("Charter", "charter"), 3, "T8", 1, "Destination", "Klant Y", "Adres Y", "08:00", 130.0, 130.0, 15.0, 52.600, 5.600),
    ("W4", ("Charter", "charter"), 3, "T9", 0, "Origin", "Klant Y", "Adres Y", "10:30", 0.0, 140.0, 5.0, 52.600, 5.600),
    ("W4", ("Charter", "charter"), 3, "T9", 1, "Destination", "Depot C", C, "13:00", 140.0, 140.0, 15.0, 53.000, 6.000),
]

STOPS_SCHEMA = (
    "wagencode string, vervoerder string, vervoerder_type string, trip_date date, trip_id string, stop_seq int, "
    "acties string, locatie_naam string, adres string, gepland_start timestamp_ntz, gepland_eind timestamp_ntz, "
    "afstand_km double, afstand_km_trip double, dwell_min double, lat double, lon double"
)


def stop_rows() -> list[tuple]:
    rows = []
    for vehicle, (carrier, kind), day, trip, seq, action, name, address, clock, segment, km, dwell, lat, lon in _ROWS:
        hour, minute = map(int, clock.split(":"))
        at = datetime(2026, 1, day, hour, minute)
        rows.append(
            (vehicle, carrier, kind, date(2026, 1, day), trip, seq, action, name, address, at, at, segment, km, dwell, lat, lon)
        )
    return rows


EDGES = [
    (52.000, 5.000, 52.010, 5.010, 3, 7),
    (52.010, 5.010, 52.020, 5.020, 2, 5),
    (52.010, 5.010, 52.000, 5.000, 1, 2),
    (52.500, 5.500, 52.600, 5.600, 1, 2),
]
HEAT = [(52.000, 5.000, 3.0), (52.100, 5.100, 2.0)]
CHARGERS = [
    (1, 52.1, 5.1, "Publieke HPC", "Operator A", "Straat 1", "Utrecht", "3500AA", 350.0, 8, "Publiek", "Ja", "Nee", "CCS"),
    (2, 52.2, 5.2, "Dedicated Depot", "Operator B", "Straat 2", "Amersfoort", "3800AA", 450.0, 4, "Privaat", "Nee", "Ja", "CCS/MCS"),
]
CHARGER_SCHEMA = (
    "LocatieID int, lat double, lon double, name string, operator string, address string, town string, postcode string, "
    "max_power_kw double, n_connectors int, toegankelijkheid string, twentyfour_seven string, dedicated string, ccs_mcs string"
)

TRIP_HEADER = [
    "Voertuig Type Eigenaar", "Wagen Code", "Wagentype Omschrijving", "Tripnummer", "Gerealizeerd Kenteken",
    "Starttijd Trip", "Eindtijd Trip", "Totale duur", "Totale rijtijd", "Totale Afstand (KM)", "Actie soort",
    "Gepland vanaf (Trip actie)", "Gepland tot (Trip actie)", "Adres", "Dagorder Nummer", "Gewicht Dagorder (KG)",
    "RunningSum Gewicht (KG)",
]


def trip_line(carrier, code, kind, trip, plate, starts, ends, km, action, planned, until, address) -> list[str]:
    return [carrier, code, kind, trip, plate, starts, ends, "09:00:00", "00:00:00", km, action, planned, until, address, "", "", "0"]


def _dutch(trip, starts, ends, km, planned, until, address):
    return trip_line("Eigen Vervoer", "001", "Trekker met oplegger", trip, "11-BZX-8", starts, ends, km, "travel", planned, until, address)


DUTCH_TRIPS = [
    _dutch("T1", "01-1-2026 08:00:00", "01-1-2026 18:00:00", "120,5", "01-1-2026 08:00:00", "01-1-2026 08:10:00", "Depot A"),
    _dutch("T1", "01-1-2026 08:00:00", "01-1-2026 18:00:00", "120,5", "01-1-2026 12:00:00", "01-1-2026 12:20:00", "Hub B"),
    _dutch("T1", "01-1-2026 08:00:00", "01-1-2026 18:00:00", "120,5", "01-1-2026 18:00:00", "01-1-2026 18:00:00", "Depot A"),
    _dutch("T2", "02-1-2026 06:00:00", "02-1-2026 15:00:00", "180", "02-1-2026 06:00:00", "02-1-2026 06:00:00", "Depot A"),
    _dutch("T2", "02-1-2026 06:00:00", "02-1-2026 15:00:00", "180", "02-1-2026 15:00:00", "02-1-2026 15:00:00", "Depot A"),
]
DUTCH_PLACES = [("Depot A", 52.0, 5.0), ("Hub B", 52.5, 5.5)]


def _action(carrier, code, kind, trip, plate, action, starts, ends, address):
    return trip_line(carrier, code, kind, trip, plate, starts, ends, "12", action, starts, ends, address)


FOCUS = "Verzonnenweg 80, Voorbeeldstad"
POWER_ACTIONS = [
    _action("Eigen Vervoer", "001", "Trekker met oplegger", "T1", "11-BZX-8", "travel", "01-1-2026 22:00:00", "01-1-2026 22:15:00", FOCUS),
    _action("Eigen Vervoer", "001", "Trekker met oplegger", "T1", "11-BZX-8", "wait_task_available", "01-1-2026 23:30:00", "02-1-2026 01:30:00", FOCUS),
    _action("Eigen Vervoer", "001", "Trekker met oplegger", "T9", "11-BZX-8", "wait_after", "01-1-2026 23:45:00", "02-1-2026 00:15:00", FOCUS),
    _action("Uitbesteed Vervoer", "C01", "Bakwagen 9 ton - hoog", "T2", "22-BBB-2", "pause", "01-1-2026 12:00:00", "01-1-2026 12:45:00", "Depot B"),
    _action("Eigen Vervoer", "002", "Bakwagen 9 ton - hoog", "T3", "33-CCC-3", "travel", "01-1-2026 08:00:00", "01-1-2026 08:15:00", "Depot C"),
]
POWER_PLACES = [(FOCUS, 52.030, 5.080), ("Depot B", 52.1, 5.1), ("Depot C", 52.2, 5.2)]

GENERIC_LINES = [
    "vehicle_id,trip_id,trip_date,planned_start,planned_end,lat,lon,address,distance_km,carrier_type,license_plate",
    "TRUCK-1,RIT-1,2026-02-01,2026-02-01 08:00:00,2026-02-01 08:15:00,52.10,5.10,Depot,42,eigen,AB-12-CD",
    "TRUCK-1,RIT-1,2026-02-01,2026-02-01 09:00:00,2026-02-01 09:10:00,52.20,5.20,Klant,42,eigen,AB-12-CD",
]


def csv_text(header: list[str], rows: list[list[str]]) -> str:
    return "\n".join(",".join('"' + v.replace('"', '""') + '"' for v in row) for row in [header, *rows]) + "\n"
