"""Small scalar helpers over records: formats, zones, defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names that source texts call as built in, by what they do (fixed values).
BUILTINS = {
    "database": ("read", "readAll", "readById", "readByIds", "readCount", "commit", "diff", "add", "update", "remove"),
    "history": ("hisRead", "hisWrite", "hisClear", "hisRollup", "hisInterpolate"),
    "grid": ("toGrid", "gridColNames", "gridRowCount", "gridGet"),
    "record": ("point", "points", "equip", "equips", "site", "sites", "pointWrite", "pointWriteArray", "pointEmergencyWrite"),
    "utility": ("now", "today", "yesterday", "dateTime", "date", "time", "toStr", "toNumber", "toBool", "toUnit"),
    "collection": ("map", "filter", "find", "findAll", "each", "reduce", "fold", "sort", "sortr", "unique", "flatten", "join"),
    "math": ("min", "max", "avg", "sum", "abs", "round", "floor", "ceil"),
    "string": ("contains", "startsWith", "endsWith", "split", "trim", "replace"),
    "logic": ("and", "or", "not", "if", "do", "end"),
    "type": ("isDict", "isGrid", "isList", "isNumber", "isStr", "isBool", "isDate", "isTime", "isDateTime", "isRef", "isUri"),
    "io": ("ioReadCsv", "ioReadZinc", "ioWriteCsv", "ioWriteZinc"),
    "spark": ("sparkWrite", "sparkRead", "sparkHisRead"),
    "project": ("proj", "projName", "projMeta"),
    "other": ("echo", "log", "logInfo", "logWarn", "logErr", "throw", "try", "catch", "finally", "marker", "na", "null", "removeMarker"),
}


def builtin_kind(name: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, names in BUILTINS.items():
        out = F.when(name.isin(*names), kind).otherwise(out)
    return out


def format_number(value: Column, digits: int, unit: str = "") -> Column:
    """Fixed digits with grouping, and the unit after it."""
    shown = F.format_number(value, digits)
    return F.concat(shown, F.lit(unit)) if unit else shown


#: City names of zones whose region isn't plain from the name (fixed values).
ZONES = {
    "New_York": "America/New_York", "Chicago": "America/Chicago", "Denver": "America/Denver", "Los_Angeles": "America/Los_Angeles",
    "London": "Europe/London", "Paris": "Europe/Paris", "Berlin": "Europe/Berlin", "Tokyo": "Asia/Tokyo", "Sydney": "Australia/Sydney",
    "UTC": "UTC", "GMT": "Etc/GMT",
}


def zone_of(city: str) -> str:
    """The zone of a city name; a full name is its own."""
    if "/" in city:
        return city
    if city in ZONES:
        return ZONES[city]
    from zoneinfo import available_timezones

    found = sorted(z for z in available_timezones() if z.rpartition("/")[2] == city)
    if not found:
        raise ValueError(f"no time zone {city!r}")
    return found[0]


def local_time(instant: Column, city: str) -> Column:
    """Wall time in a city of an instant in UTC."""
    return F.from_utc_timestamp(instant, zone_of(city))


_DEFAULTS = {"bool": False, "number": 0.0, "str": "", "marker": True, "list": [], "dict": {}, "uri": "", "ref": "null"}


def new_record(kinds: dict[str, str]) -> dict:
    """A record with each tag's default for its kind; kinds without one are left out."""
    return {name: _DEFAULTS[kind] for name, kind in kinds.items() if kind in _DEFAULTS}
