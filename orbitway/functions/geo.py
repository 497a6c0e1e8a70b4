"""Distances, times and fares as SQL text."""

from __future__ import annotations

#: Radius of the earth in metres; detour factor and access speed (km/h) of surface legs.
RADIUS, DETOUR, ACCESS_KMH = 6371000, 1.3, 30


def equirectangular(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    x = f"radians({lon2} - {lon1}) * cos(radians(({lat1} + {lat2}) * cast(0.5 as double))) * {RADIUS}"
    y = f"radians({lat2} - {lat1}) * {RADIUS}"
    return f"sqrt(({x}) * ({x}) + ({y}) * ({y}))"


def haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """Rounded metres, one at least."""
    a = f"(power(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * power(sin(radians({lon2} - {lon1}) / 2), 2))"
    return f"greatest(cast(round(2 * atan2(sqrt({a}), sqrt(1 - {a})) * {RADIUS}) as bigint), 1)"


def surface_meters(distance: str) -> str:
    return f"cast(ceil(({distance}) * cast({DETOUR} as double)) as bigint)"


def surface_seconds(distance: str) -> str:
    return f"cast(ceil(({distance}) * cast({DETOUR} as double) / (cast({ACCESS_KMH} as double) / cast(3.6 as double))) as bigint)"


def buffer_seconds(base: str, div: str) -> str:
    """A fifth, rounded up, and five minutes at least."""
    return f"greatest(300, ({base} + 4) {div} 5)"


def fare_yen(meters: str, rule: str, div: str) -> str:
    """Fare in yen of a distance that is a multiple of the rule's unit; null if it isn't.

    Whole micro-yen throughout: the minimum zone first, then units and terminal charge, tax, rounding
    half up to the multiple, and the clamp.
    """
    taxed = f"((({meters} {div} {rule}.unit) * {rule}.rate + {rule}.terminal * 1000000) * {rule}.tax {div} 10000)"
    rounded = f"(({taxed} + {rule}.multiple * 500000) {div} ({rule}.multiple * 1000000) * {rule}.multiple)"
    return f"case when {meters} % {rule}.unit <> 0 then null when {meters} <= {rule}.zone then {rule}.least else least(greatest({rounded}, {rule}.least), {rule}.most) end"


def fare_yen_up(meters: str, rule: str, div: str) -> str:
    """The data-preparation variant: units round up, and the multiple is ten yen."""
    taxed = f"(((({meters} + {rule}.unit - 1) {div} {rule}.unit) * {rule}.rate + {rule}.terminal * 1000000) * {rule}.tax {div} 10000)"
    rounded = f"(({taxed} + 5000000) {div} 10000000 * 10)"
    return f"case when {meters} <= {rule}.zone then {rule}.least else least(greatest({rounded}, {rule}.least), {rule}.most) end"
