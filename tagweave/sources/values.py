"""Values of tagged records: what the text formats read and write."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from datetime import date, datetime, time
from typing import Any

from tagweave.functions.filters import Quantity, Ref, Symbol, Uri


@dataclass(frozen=True)
class Marker:
    pass


@dataclass(frozen=True)
class NotAvailable:
    pass


@dataclass(frozen=True)
class Remove:
    pass


@dataclass(frozen=True)
class Coord:
    lat: float
    lng: float


@dataclass(frozen=True)
class XStr:
    type: str
    value: str


@dataclass(frozen=True)
class DateTime:
    """An ISO instant and the name of its zone."""

    value: str
    tz: str = "UTC"


@dataclass(frozen=True)
class NamedRef(Ref):
    dis: str = ""


@dataclass
class Grid:
    meta: dict[str, Any] = field(default_factory=dict)
    columns: list[tuple[str, dict[str, Any]]] = field(default_factory=list)
    rows: list[dict[str, Any]] = field(default_factory=list)


MARKER, NA, REMOVE = Marker(), NotAvailable(), Remove()


def number_text(x: float) -> str:
    if x != x:
        return "NaN"
    if x in (float("inf"), float("-inf")):
        return "INF" if x > 0 else "-INF"
    return str(int(x)) if x == int(x) and abs(x) < 1e15 else repr(x)


def to_hayson(v: Any) -> Any:
    """JSON values, tagged with _kind where JSON has no such type."""
    match v:
        case None | bool() | str():
            return v
        case int() | float():
            return v
        case Marker():
            return {"_kind": "marker"}
        case NotAvailable():
            return {"_kind": "na"}
        case Remove():
            return {"_kind": "remove"}
        case Quantity():
            return {"_kind": "number", "val": v.value, "unit": v.unit} if v.unit else v.value
        case NamedRef() if v.dis:
            return {"_kind": "ref", "val": v.id, "dis": v.dis}
        case Ref():
            return {"_kind": "ref", "val": v.id}
        case Symbol():
            return {"_kind": "symbol", "val": v.name}
        case Uri():
            return {"_kind": "uri", "val": v.text}
        case Coord():
            return {"_kind": "coord", "lat": v.lat, "lng": v.lng}
        case XStr():
            return {"_kind": "xstr", "type": v.type, "val": v.value}
        case DateTime():
            return {"_kind": "dateTime", "val": v.value, "tz": v.tz}
        case datetime():
            return {"_kind": "dateTime", "val": v.isoformat(), "tz": "UTC"}
        case date():
            return {"_kind": "date", "val": v.isoformat()}
        case time():
            return {"_kind": "time", "val": v.isoformat()}
        case list() | tuple():
            return [to_hayson(x) for x in v]
        case dict():
            return {k: to_hayson(x) for k, x in v.items()}
        case Grid():
            return {
                "_kind": "grid", "meta": to_hayson(v.meta), "cols": [{"name": n, "meta": to_hayson(m)} for n, m in v.columns],
                "rows": [to_hayson(r) for r in v.rows],
            }
    raise TypeError(f"no tagged value: {v!r}")


def from_hayson(v: Any) -> Any:
    if isinstance(v, list):
        return [from_hayson(x) for x in v]
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return Quantity(float(v))
    if not isinstance(v, dict):
        return v
    match v.get("_kind"):
        case "marker":
            return MARKER
        case "na":
            return NA
        case "remove":
            return REMOVE
        case "number":
            return Quantity(float(v["val"]), v.get("unit", ""))
        case "ref":
            return NamedRef(v["val"], v.get("dis", "")) if v.get("dis") else Ref(v["val"])
        case "symbol":
            return Symbol(v["val"])
        case "uri":
            return Uri(v["val"])
        case "coord":
            return Coord(v["lat"], v["lng"])
        case "xstr":
            return XStr(v["type"], v["val"])
        case "dateTime":
            return DateTime(v["val"], v.get("tz", "UTC"))
        case "date":
            return date.fromisoformat(v["val"])
        case "time":
            return time.fromisoformat(v["val"])
        case "grid":
            return Grid(from_hayson(v.get("meta", {})), [(c["name"], from_hayson(c.get("meta", {}))) for c in v.get("cols", [])], [from_hayson(r) for r in v.get("rows", [])])
    return {k: from_hayson(x) for k, x in v.items() if k != "_kind"}


def record_json(record: dict[str, Any]) -> dict[str, str]:
    """A record as tag to JSON text."""
    return {k: json.dumps(to_hayson(x), ensure_ascii=False) for k, x in record.items() if x is not None}


def read_hayson(text: str) -> Grid:
    parsed = from_hayson(json.loads(text))
    if isinstance(parsed, Grid):
        return parsed
    rows = parsed if isinstance(parsed, list) else [parsed]
    return Grid({}, [(n, {}) for n in dict.fromkeys(k for r in rows for k in r)], rows)
