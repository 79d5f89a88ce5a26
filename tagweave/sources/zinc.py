"""Zinc: a typed, comma-separated text form of grids."""

from __future__ import annotations

import re
from datetime import date, time
from typing import Any

from tagweave.functions.filters import Quantity, Ref, Symbol, Uri
from tagweave.sources.values import MARKER, NA, REMOVE, Coord, DateTime, Grid, Marker, NamedRef, NotAvailable, Remove, XStr, number_text


class ZincError(ValueError):
    pass


_SCALAR = re.compile(
    r"""(?P<datetime>\d{4}-\d\d-\d\dT[0-9:.]+(?:Z|[+-]\d\d:\d\d)?(?:\ [A-Z][A-Za-z0-9_/+-]*)?)
      |(?P<date>\d{4}-\d\d-\d\d)
      |(?P<time>\d\d:\d\d(?::\d\d(?:\.\d+)?)?)
      |(?P<number>-?(?:INF\b|\d[\d_]*(?:\.\d+)?(?:[eE][+-]?\d+)?))(?P<unit>[A-Za-z%_/$\u0080-\uffff]*)
      |(?P<coord>C\(\s*(-?[\d.]+)\s*,\s*(-?[\d.]+)\s*\))
      |@(?P<ref>[A-Za-z0-9_:.~-]+)
      |\^(?P<symbol>[A-Za-z0-9_:.~-]+)
      |(?P<xstr>[A-Z][A-Za-z0-9_]*)\("
      |(?P<word>NaN|INF|NA|[NMRTF])(?![A-Za-z0-9_])""",
    re.X,
)
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}
_WORDS = {"N": None, "M": MARKER, "R": REMOVE, "T": True, "F": False, "NA": NA, "NaN": Quantity(float("nan")), "INF": Quantity(float("inf"))}


class Reader:
    def __init__(self, text: str):
        self.text, self.at = text.replace("\r\n", "\n"), 0

    def _peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def _space(self, more: str = " \t") -> None:
        while self._peek() and self._peek() in more:
            self.at += 1

    def _eat(self, text: str) -> bool:
        if self.text.startswith(text, self.at):
            self.at += len(text)
            return True
        return False

    def _need(self, text: str) -> None:
        if not self._eat(text):
            raise ZincError(f"expected {text!r} at {self.at}: {self.text[self.at:self.at + 20]!r}")

    def _quoted(self, end: str) -> str:
        out = []
        while True:
            c = self._peek()
            if not c or c == "\n":
                raise ZincError(f"text isn't closed at {self.at}")
            self.at += 1
            if c == end:
                return "".join(out)
            if c == "\\":
                e = self._peek()
                self.at += 1
                if e == "u":
                    out.append(chr(int(self.text[self.at : self.at + 4], 16)))
                    self.at += 4
                else:
                    out.append(_ESCAPES.get(e, e))
            else:
                out.append(c)

    def name(self) -> str:
        m = _NAME.match(self.text, self.at)
        if not m:
            raise ZincError(f"expected a name at {self.at}")
        self.at = m.end()
        return m[0]

    def value(self) -> Any:
        if self._eat('"'):
            return self._quoted('"')
        if self._eat("`"):
            return Uri(self._quoted("`"))
        if self._eat("<<"):
            self._space(" \t\n")
            grid = self.grid(nested=True)
            self._need(">>")
            return grid
        if self._eat("["):
            items = []
            self._space(" \t\n")
            while not self._eat("]"):
                items.append(self.value())
                self._space(" \t\n")
                if self._eat(","):
                    self._space(" \t\n")
            return items
        if self._eat("{"):
            tags = self.tags("}")
            self._need("}")
            return tags
        m = _SCALAR.match(self.text, self.at)
        if not m:
            raise ZincError(f"no value at {self.at}: {self.text[self.at:self.at + 20]!r}")
        self.at = m.end()
        kind = next(k for k, v in m.groupdict().items() if v is not None)
        raw = m[kind]
        if kind == "datetime":
            stamp, _, tz = raw.partition(" ")
            return DateTime(stamp, tz or "UTC")
        if kind == "date":
            return date.fromisoformat(raw)
        if kind == "time":
            return time.fromisoformat(raw)
        if kind == "number":
            return Quantity(float("-inf") if raw == "-INF" else float(raw.replace("_", "")), m["unit"] or "")
        if kind == "coord":
            lat, lng = raw[2:-1].split(",")
            return Coord(float(lat), float(lng))
        if kind == "ref":
            start = self.at
            self._space()
            if self._peek() == '"':
                self.at += 1
                return NamedRef(raw, self._quoted('"'))
            self.at = start
            return Ref(raw)
        if kind == "symbol":
            return Symbol(raw)
        if kind == "xstr":
            out = XStr(raw, self._quoted('"'))
            self._need(")")
            return out
        return _WORDS[raw]

    def tags(self, end: str) -> dict[str, Any]:
        out = {}
        self._space(" \t\n" if end == "}" else " \t")
        while self._peek() and self._peek() not in end + ("," if end != "}" else "") + "\n":
            name = self.name()
            out[name] = self.value() if self._eat(":") else MARKER
            self._space(" \t\n" if end == "}" else " \t")
            if end == "}" and self._eat(","):
                self._space(" \t\n")
        return out

    def grid(self, nested: bool = False) -> Grid:
        self._need("ver:")
        self.value()
        grid = Grid(meta=self.tags("\n"))
        self._need("\n")
        while True:
            self._space()
            name = self.name()
            grid.columns.append((name, self.tags("\n")))
            self._space()
            if not self._eat(","):
                break
        while self._eat("\n"):
            if not self._peek() or self._peek() == "\n" or nested and self.text.startswith(">>", self.at):
                break
            row, k = {}, 0
            while True:
                self._space()
                if self._peek() not in (",", "\n", "") and not (nested and self.text.startswith(">>", self.at)):
                    value = self.value()
                    if value is not None and k < len(grid.columns):
                        row[grid.columns[k][0]] = value
                self._space()
                k += 1
                if not self._eat(","):
                    break
            grid.rows.append({n: v for n, v in row.items() if not (n == "empty" and v is MARKER and len(grid.columns) == 1)})
        return grid


def read_zinc(text: str) -> Grid:
    reader = Reader(text)
    reader._space(" \t\n")
    return reader.grid()


def quote(text: str, mark: str = '"') -> str:
    out = text.replace("\\", "\\\\").replace(mark, "\\" + mark)
    for letter, char in _ESCAPES.items():
        out = out.replace(char, "\\" + letter)
    return mark + (out.replace("$", "\\$") if mark == '"' else out) + mark


def write_value(v: Any) -> str:
    match v:
        case None:
            return "N"
        case bool():
            return "T" if v else "F"
        case Marker():
            return "M"
        case NotAvailable():
            return "NA"
        case Remove():
            return "R"
        case str():
            return quote(v)
        case int() | float():
            return number_text(float(v))
        case Quantity():
            return number_text(v.value) + v.unit
        case NamedRef() if v.dis:
            return f"@{v.id} {quote(v.dis)}"
        case Ref():
            return "@" + v.id
        case Symbol():
            return "^" + v.name
        case Uri():
            return quote(v.text, "`")
        case Coord():
            return f"C({v.lat},{v.lng})"
        case XStr():
            return f"{v.type}({quote(v.value)})"
        case DateTime():
            return v.value if v.tz == "UTC" and v.value.endswith("Z") else f"{v.value} {v.tz}"
        case date() | time():
            return v.isoformat()
        case list() | tuple():
            return "[" + ", ".join(map(write_value, v)) + "]"
        case dict():
            return "{" + write_tags(v) + "}"
        case Grid():
            return "<<\n" + write_zinc(v) + ">>"
    raise TypeError(f"no tagged value: {v!r}")


def write_tags(tags: dict[str, Any]) -> str:
    return " ".join(k if isinstance(v, Marker) else f"{k}:{write_value(v)}" for k, v in tags.items())


def write_zinc(grid: Grid) -> str:
    head = 'ver:"3.0"' + (" " + write_tags(grid.meta) if grid.meta else "")
    columns = grid.columns or [("empty", {})]
    names = ",".join(n + (" " + write_tags(m) if m else "") for n, m in columns)
    rows = [",".join("" if r.get(n) is None else write_value(r[n]) for n, _ in columns) for r in grid.rows]
    return "\n".join([head, names, *rows]) + "\n"
