"""Settings of a co-location analysis: a frozen value on the driver, read from YAML or built in code."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path


@dataclass(frozen=True)
class Config:
    start_date: str = "2024-01-01"
    first_meeting: str | None = None
    key_dates: dict[str, str] = field(default_factory=dict)
    distance_m: float = 150.0
    neighborhood_m: float = 750.0
    city_m: float = 5000.0
    time_minutes: int = 30
    travel_max_gap_hours: float = 18.0
    night_from: int = 22
    night_to: int = 6
    home_tolerance_m: float = 300.0
    home_region: tuple[float, float, float, float] = (47.0, 55.0, 2.5, 15.0)
    #: name, lowest and highest latitude, lowest and highest longitude; the first that fits counts.
    country_bounds: tuple[tuple[str, float, float, float, float], ...] = (
        ("netherlands", 50.75, 53.55, 3.36, 7.23),
        ("belgium", 49.50, 51.51, 2.54, 6.41),
        ("germany", 47.27, 55.06, 5.87, 15.04),
        ("spain", 36.0, 43.8, -9.3, 3.3),
        ("france", 41.33, 51.09, -5.14, 9.56),
    )
    #: A box on the border of three countries that is looked at first: below `split_lat` one name, east of `split_lon` another, else the third.
    border_box: tuple[float, float, float, float] | None = (50.7, 51.1, 5.5, 6.1)
    split_lat: float = 50.75
    split_lon: float = 6.0
    border_names: tuple[str, str, str] = ("Belgium", "Germany", "Netherlands (South Limburg)")
    home_countries: tuple[str, ...] = ("Netherlands", "Belgium", "Germany")
    data_files: dict[str, list[str]] = field(default_factory=dict)


def from_mapping(raw: dict) -> Config:
    """Config from the nested mapping of the YAML file; absent keys keep their defaults."""
    limits, gaps = raw.get("thresholds") or {}, raw.get("interpolation") or {}
    found = {
        "start_date": raw.get("start_date"),
        "key_dates": {k: str(v) for k, v in (raw.get("key_dates") or {}).items()},
        "first_meeting": (raw.get("key_dates") or {}).get("first_meeting"),
        "distance_m": limits.get("distance_meters"),
        "neighborhood_m": limits.get("neighborhood_meters"),
        "city_m": limits.get("city_meters"),
        "time_minutes": limits.get("time_minutes"),
        "travel_max_gap_hours": gaps.get("travel_max_gap_hours"),
        "night_from": (gaps.get("overnight_hours") or {}).get("start"),
        "night_to": (gaps.get("overnight_hours") or {}).get("end"),
        "home_tolerance_m": gaps.get("home_tolerance_meters"),
        "data_files": raw.get("data_files"),
    }
    bounds = raw.get("country_bounds") or {}
    boxes, border = [], None
    for name, box in bounds.items():
        if isinstance(box, dict):  # a country with a general box and one on the border
            boxes.append((name, *map(float, box["general"])))
            inner = [v for k, v in box.items() if k != "general"]
            border = tuple(map(float, inner[0])) if inner else border
        else:
            boxes.append((name, *map(float, box)))
    if boxes:
        found |= {"country_bounds": tuple(boxes), "border_box": border}
    for key in ("start_date", "first_meeting"):
        found[key] = str(found[key]) if found[key] is not None else None
    return Config(**{k: v for k, v in found.items() if v is not None})


def load(path: str | Path) -> Config:
    import yaml

    return from_mapping(yaml.safe_load(Path(path).read_text()) or {})
