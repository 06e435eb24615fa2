"""Settings of the engine: defaults, ranges, a file of overrides."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, fields, replace
from pathlib import Path

from ridgeline.functions import fixed


@dataclass(frozen=True)
class Settings:
    """Thresholds that a user may change."""

    gap_hours: float = fixed.GAP_HOURS
    jump_km: float = fixed.JUMP_KM
    jump_minutes: float = fixed.JUMP_MINUTES
    trip_gap_hours: float = fixed.TRIP_GAP_HOURS
    trip_max_days: float = fixed.TRIP_MAX_DAYS
    agreement_km: float = fixed.AGREEMENT_KM
    min_probability: float = fixed.MIN_PROBABILITY
    near_bits: int = fixed.NEAR_BITS
    near_window_hours: float = fixed.NEAR_WINDOW_HOURS


#: Least and largest value of a setting, and whether the least is allowed itself.
RANGES = {"gap_hours": (0, 720, False), "trip_gap_hours": (0, 48, True), "trip_max_days": (0, 30, False), "jump_km": (0, 20_000, False), "min_probability": (0, 1, True), "near_bits": (0, 64, True)}


def overridden(settings: Settings, values: dict) -> Settings:
    """``settings`` with other values; an unknown name, a value that is no number and one out of range are errors."""
    known = {f.name for f in fields(settings)}
    for name, value in values.items():
        if name not in known:
            raise KeyError(f"no setting is named {name}")
        if isinstance(value, bool) or not isinstance(value, int | float) or value != value:
            raise ValueError(f"{name} is no number: {value!r}")
        low, high, closed = RANGES.get(name, (0, float("inf"), True))
        if not (low <= value <= high) or (value == low and not closed):
            raise ValueError(f"{name} is out of range: {value}")
    return replace(settings, **values)


def read_settings(path: str | Path | None) -> Settings:
    """Settings of a TOML file, with or without a byte order mark; the defaults without one."""
    if path is None or not Path(path).exists():
        return Settings()
    return overridden(Settings(), tomllib.loads(Path(path).read_bytes().decode("utf-8-sig")))
