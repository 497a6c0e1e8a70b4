"""Spellings that differ between Spark SQL and the SQL of the comparison engine."""

from __future__ import annotations

SPARK = {
    "div": "div",
    "sha": lambda x: f"sha2({x}, 256)",
    "joined": lambda x, order: f"listagg({x}, ',') within group (order by {order})",
    "bytes": lambda x: f"octet_length({x})",
    "count_if": lambda x: f"count_if({x})",
    "matches": lambda x, p: f"{x} rlike '{p}'",
    "minutes": lambda t, n: f"timestampadd(MINUTE, {n}, {t})",
    "range": lambda a, b: f"explode(sequence({a}, {b}))",
    "split": lambda x: f"explode(split({x}, ';'))",
}
DUCK = {
    "div": "//",
    "sha": lambda x: f"sha256({x})",
    "joined": lambda x, order: f"string_agg({x}, ',' order by {order})",
    "bytes": lambda x: f"strlen({x})",
    "count_if": lambda x: f"(count(*) filter (where {x}))",
    "matches": lambda x, p: f"regexp_matches({x}, '{p}')",
    "minutes": lambda t, n: f"({t} + to_minutes({n}))",
    "range": lambda a, b: f"unnest(range({a}, {b} + 1))",
    "split": lambda x: f"unnest(string_split({x}, ';'))",
}
