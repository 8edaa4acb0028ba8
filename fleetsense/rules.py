"""Frozen parameter records. Values are the production settings of the analytics being rebuilt."""

from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    """When a rental counts as given up, and how many people make an alarm."""

    max_sec: float = 180
    max_m: float = 300.0
    alarm_k: int = 2
    same_person: bool = True
    retry_gap_sec: float = 120


@dataclass(frozen=True)
class EvRule:
    """The same idea for chargers: minutes plugged in, minutes between two tries."""

    max_min: float = 3.0
    gap_min: float = 10.0
    alarm_k: int = 2


@dataclass(frozen=True)
class Shift:
    """One crew shift."""

    minutes: float = 180.0
    kmh: float = 18.0
    detour: float = 1.3
    stop_min: float = 6.0
    bike_min: float = 4.0


# Fixed values shared by lists, scores and feed checks.
LOOKBACK_DAYS = 7
KEEP_DAYS = 9
FRESH_HOURS = 24
SEEN_MINUTES = 10
SETTLE_HOURS = 7
THIN_SHARE = 0.3
RECHECK_HOURS = 48
LEVEL_HIGH = "빨강"
LEVEL_LOW = "노랑"
OTHER_DISTRICT = "기타"
