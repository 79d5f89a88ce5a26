"""The text form of a unit database: quantities in dashes, then lines of
`names; dimension; scale; offset`."""

from __future__ import annotations

import re

from tagweave.functions.units import Unit

_BASE = ("kg", "m", "sec", "K", "A", "mol", "cd")


def read_units(text: str) -> list[Unit]:
    out, quantity = [], ""
    for raw in text.split("\n"):
        line = raw.strip()
        if not line or line.startswith("//"):
            continue
        if m := re.fullmatch(r"--\s*(.*?)\s*(?:\(.*\))?\s*--", line):
            quantity = m[1]
            continue
        parts = [p.strip() for p in line.split(";")]
        powers = dict.fromkeys(_BASE, 0)
        for name, power in re.findall(r"(kg|mol|sec|cd|m|K|A)(-?\d+)", parts[1] if len(parts) > 1 else ""):
            powers[name] = int(power)
        scale = float(parts[2]) if len(parts) > 2 and parts[2] else 1.0
        offset = float(parts[3]) if len(parts) > 3 and parts[3] else 0.0
        out += [Unit(n.strip(), quantity, tuple(powers.values()), scale, offset) for n in parts[0].split(",")]
    return out
