"""Text rules: identifiers, postcodes, labels and parsing of raw text columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from dwellgrid.functions.geo import bankers_round, column

# Accepted timestamp layouts, in order of preference.
TIMESTAMP_LAYOUTS = (
    "d-M-yyyy H:m:s",
    "d-M-yyyy H:m",
    "d/M/yyyy H:m:s",
    "d/M/yyyy H:m",
    "yyyy-M-d H:m:s",
    "yyyy-M-d H:m",
    "d-M-yyyy",
    "d/M/yyyy",
    "yyyy-M-d",
)

# Weekday labels, Monday first.
WEEKDAY_LABELS = ("Maandag", "Dinsdag", "Woensdag", "Donderdag", "Vrijdag", "Zaterdag", "Zondag")


def blank_to_null(value) -> Column:
    return F.nullif(F.trim(column(value)), F.lit(""))


def text_or_empty(value) -> Column:
    return F.coalesce(column(value).cast("string"), F.lit(""))


def parse_timestamp(*candidates) -> Column:
    """First candidate that reads as a timestamp in any accepted layout, else null."""
    attempts = [
        F.try_to_timestamp(blank_to_null(candidate), F.lit(layout))
        for candidate in candidates
        for layout in TIMESTAMP_LAYOUTS
    ]
    return F.coalesce(*attempts).cast("timestamp_ntz") if attempts else F.lit(None).cast("timestamp_ntz")


def parse_decimal(value) -> Column:
    """Number with either decimal mark; with a comma present, dots separate thousands."""
    text = blank_to_null(value)
    dotted = F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    return F.when(F.contains(text, F.lit(",")), dotted.try_cast("double")).otherwise(text.try_cast("double"))


def normalize_plate(value) -> Column:
    return F.regexp_replace(F.upper(F.trim(column(value))), "[^A-Z0-9]", "")


def normalize_pc6(value) -> Column:
    return F.regexp_replace(F.upper(text_or_empty(value)), r"[^\p{L}\p{N}]", "")


def extract_pc6(address) -> Column:
    """Dutch postcode within an address, '' when there is none."""
    found = F.regexp_extract(text_or_empty(address), r"([0-9]{4})\s*([A-Za-z]{2})", 0)
    return F.regexp_replace(F.upper(found), r"\s", "")


def classify_carrier(carrier_type, carrier, own: str = "own", charter: str = "charter", unknown: str = "unknown") -> Column:
    """The explicit carrier type decides; without one, the carrier's name does."""
    kind, name = F.lower(text_or_empty(carrier_type)), F.lower(text_or_empty(carrier))
    return (
        F.when(kind.contains("eigen") | kind.contains("own"), own)
        .when(kind.contains("charter") | kind.contains("sub"), charter)
        .when(name.contains("eigen"), own)
        .when(name.contains("uitbesteed") | name.contains("charter"), charter)
        .otherwise(unknown)
    )


def vehicle_key(plate_norm, code) -> Column:
    return F.coalesce(F.nullif(column(plate_norm), F.lit("")), column(code))


def split_plates(plates) -> Column:
    parts = F.transform(F.split(text_or_empty(plates), ","), lambda part: F.trim(part))
    return F.filter(parts, lambda part: part != "")


def vehicle_group_key(plates, code) -> Column:
    """First plate of a comma-separated list, else the vehicle code."""
    return F.coalesce(F.get(split_plates(plates), F.lit(0)), column(code))


def compact_list(shown, total, visible: int) -> Column:
    """Up to ``visible`` values and how many more there are; '-' when there are none."""
    head = F.array_join(F.slice(column(shown), 1, visible), ", ")
    rest = column(total) - visible
    return (
        F.when(F.coalesce(column(total), F.lit(0)) == 0, "-")
        .when(rest > 0, F.concat(head, F.lit(" +"), rest.cast("string")))
        .otherwise(head)
    )


def weekday_label(day_index) -> Column:
    labels = F.array(*[F.lit(label) for label in WEEKDAY_LABELS])
    return F.element_at(labels, column(day_index).cast("int") + 1)


def recommendation(total_mwh, public_mwh, is_road: bool) -> Column:
    if is_road:
        text = F.lit("Wegvlakselectie met berekende corridor-laadvraag.")
    else:
        text = F.format_string(
            "Publieke laadvraag: %s MWh in dit scenario.", F.format_number(bankers_round(public_mwh, 1), 1)
        )
    return F.when(column(total_mwh) <= 0, "Geen laadvraag in deze selectie.").otherwise(text)


def standplaats_key(address, place, country) -> Column:
    land = F.coalesce(blank_to_null(country), F.lit("Nederland"))
    return F.concat_ws(", ", blank_to_null(address), blank_to_null(place), land)


def resolve_column(columns: Sequence[str], *names: str) -> str | None:
    """The actual header for the first synonym present, ignoring case and outer blanks."""
    present = {name.strip().lower(): name for name in columns}
    return next((present[n.lower()] for n in names if n.lower() in present), None)


def resolve_text(columns: Sequence[str], *names: str) -> Column:
    """First non-null value over all synonyms present, '' when none is."""
    found = list(dict.fromkeys(filter(None, (resolve_column(columns, name) for name in names))))
    return F.coalesce(*[quoted(name) for name in found], F.lit(""))


def resolve_timestamp(columns: Sequence[str], *names: str) -> Column:
    found = list(dict.fromkeys(filter(None, (resolve_column(columns, name) for name in names))))
    return parse_timestamp(*[quoted(name) for name in found])


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")
