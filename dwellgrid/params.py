"""Arguments of the operators, with the bounds each one is held to."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from datetime import date


def clamp(value, low, high):
    return max(low, min(value, high))


def within(name, value, low, high=None):
    """The value itself, or an error where it lies outside its bounds; None stands for "all"."""
    if value is not None and (value < low or (high is not None and value > high)):
        raise ValueError(f"{name} must be {f'at least {low}' if high is None else f'from {low} to {high}'}, not {value}")
    return value


def clean_values(values: Iterable[str] | None) -> tuple[str, ...]:
    """Trimmed, non-blank, unique ignoring case, in order."""
    unique: dict[str, str] = {}
    for value in values or ():
        text = (value or "").strip()
        if text:
            unique.setdefault(text.upper(), text)
    return tuple(unique[key] for key in sorted(unique))


@dataclass(frozen=True)
class Filter:
    """The filter every question shares; ``marker_top_n`` None shows all."""

    date_from: date | None = None
    date_to: date | None = None
    carrier_types: tuple[str, ...] = ()
    carriers: tuple[str, ...] = ()
    vehicle_codes: tuple[str, ...] = ()
    min_dwell_min: float = 0.0
    road_threshold: int = 1
    road_top_percent: int = 1
    marker_top_n: int | None = None
    ze_mode: str = "all"

    def normalized(self) -> Filter:
        mode = (self.ze_mode or "").lower()
        return replace(
            self,
            carrier_types=clean_values(self.carrier_types),
            carriers=clean_values(self.carriers),
            vehicle_codes=clean_values(self.vehicle_codes),
            min_dwell_min=max(0.0, self.min_dwell_min),
            road_threshold=clamp(self.road_threshold, 1, 1_000_000),
            road_top_percent=within("road_top_percent", self.road_top_percent, 1, 100),
            marker_top_n=within("marker_top_n", self.marker_top_n, 1),
            ze_mode=mode if mode in ("in", "out") else "all",
        )


@dataclass(frozen=True)
class Scenario:
    """Energy assumptions of a charging selection."""

    kwh_per_km: float = 1.2
    capacity_kwh: float = 590.0
    kw_per_plug: float = 350.0

    def normalized(self) -> Scenario:
        return Scenario(
            kwh_per_km=clamp(self.kwh_per_km, 0.5, 3.5),
            capacity_kwh=clamp(self.capacity_kwh, 100, 1_500),
            kw_per_plug=clamp(self.kw_per_plug, 50, 2_000),
        )


@dataclass(frozen=True)
class ChargerFilter:
    min_power_kw: float = 350.0
    min_connectors: int = 1
    only_dedicated: bool = False
    access: tuple[str, ...] = ("Publiek", "Semi-publiek")

    def normalized(self) -> ChargerFilter:
        return replace(
            self,
            min_power_kw=clamp(self.min_power_kw, 0, 2_000),
            min_connectors=clamp(self.min_connectors, 1, 100),
            access=clean_values(self.access),
        )


@dataclass(frozen=True)
class Road:
    """A selected road segment and the distance around it that counts."""

    lat1: float
    lon1: float
    lat2: float
    lon2: float
    radius_km: float = 3.0

    def for_selection(self) -> Road:
        return replace(self, radius_km=clamp(self.radius_km, 0.2, 20))

    def for_break_detail(self) -> Road:
        return Road(
            clamp(self.lat1, -90, 90),
            clamp(self.lon1, -180, 180),
            clamp(self.lat2, -90, 90),
            clamp(self.lon2, -180, 180),
            clamp(self.radius_km, 0.2, 100),
        )

    @property
    def mid_lat(self) -> float:
        return (self.lat1 + self.lat2) / 2.0

    @property
    def mid_lon(self) -> float:
        return (self.lon1 + self.lon2) / 2.0


@dataclass(frozen=True)
class Inflow:
    """Electric vehicles expected to have arrived by a year."""

    year: int
    tractors: int
    box_trucks: int


# Expected fleet inflow per year.
DEFAULT_INFLOWS = (
    Inflow(2026, 3, 1),
    Inflow(2027, 10, 16),
    Inflow(2028, 21, 25),
    Inflow(2029, 38, 25),
    Inflow(2030, 56, 25),
    Inflow(2031, 75, 25),
)


@dataclass(frozen=True)
class Power:
    """Arguments of the power profiles; ``top_locations`` None shows all."""

    vehicle_classes: tuple[str, ...] = ()
    top_locations: int | None = 5
    scenario_years: tuple[int, ...] = ()
    scenario_mode: str = "linear"
    capacity_kwh: float = 590.0
    max_vehicle_kw: float = 400.0
    inflows: tuple[Inflow, ...] = field(default=DEFAULT_INFLOWS)

    def normalized(self) -> Power:
        years = self.scenario_years or (2027, 2030)
        limit = 400.0 if self.max_vehicle_kw <= 0 else self.max_vehicle_kw
        return replace(
            self,
            vehicle_classes=vehicle_classes(self.vehicle_classes),
            top_locations=within("top_locations", self.top_locations, 1),
            scenario_years=tuple(sorted({within("scenario_years", y, 2026, 2040) for y in years})),
            scenario_mode="cherry-pick" if (self.scenario_mode or "").lower() == "cherry-pick" else "linear",
            capacity_kwh=clamp(self.capacity_kwh, 100, 1_500),
            max_vehicle_kw=clamp(limit, 50, 1_500),
        )


def vehicle_classes(values: Iterable[str] | None) -> tuple[str, ...]:
    """Class names in English; anything that is not a class is dropped."""
    english = {"eigen": "own", "onbekend": "unknown"}
    names = {english.get(v.strip().lower(), v.strip().lower()) for v in values or ()}
    return tuple(sorted(names & {"own", "charter", "unknown"}))


@dataclass(frozen=True)
class Breaks:
    """Arguments of the break-time corridor demand."""

    kwh_per_km: float = 1.2
    capacity_kwh: float = 590.0
    target_soc_pct: float = 100.0
    window_start_h: float = 3.5
    window_end_h: float = 4.5
    break_h: float = 0.75
    reset_gap_h: float = 2.0
    reset_radius_km: float = 0.75
    max_kmh: float = 95.0
    threshold: int = 1
    top_percent: float = 1.0
    min_visits: int = 20

    def normalized(self) -> Breaks:
        start = clamp(self.window_start_h, 0.5, 12)
        return Breaks(
            kwh_per_km=clamp(self.kwh_per_km, 0.1, 5),
            capacity_kwh=clamp(self.capacity_kwh, 100, 1_500),
            target_soc_pct=clamp(self.target_soc_pct, 20, 100),
            window_start_h=start,
            window_end_h=clamp(self.window_end_h, start + 0.25, 14),
            break_h=clamp(self.break_h, 0.25, 3),
            reset_gap_h=clamp(self.reset_gap_h, 0.5, 12),
            reset_radius_km=clamp(self.reset_radius_km, 0.1, 5),
            max_kmh=clamp(self.max_kmh, 50, 120),
            threshold=clamp(self.threshold, 1, 1_000_000),
            top_percent=within("top_percent", self.top_percent, 0, 100),
            min_visits=within("min_visits", self.min_visits, 1),
        )
