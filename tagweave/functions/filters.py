"""The tagged-record filter language, compiled to Catalyst predicates and joins.

    site and area > 1000ft² and not equipRef->siteRef->closed

A filter is parsed to a small tree; `Compiler` turns the tree into one Column, and each
distinct reference hop into one left join, so pushdown and join choice are Catalyst's.
A missing tag, a null and a not-available value are all SQL NULL; every predicate of
a missing tag is null, which a filter takes as false, and `not tag` is true. Nothing
wraps a comparison, so a scan can be given it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import date, datetime, time
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagweave.functions.units import UNITS, convert, same_quantity


class FilterError(ValueError):
    pass


@dataclass(frozen=True)
class Quantity:
    value: float
    unit: str = ""


@dataclass(frozen=True)
class Ref:
    id: str


@dataclass(frozen=True)
class Symbol:
    name: str


@dataclass(frozen=True)
class Uri:
    text: str


Path = tuple[str, ...]


@dataclass(frozen=True)
class Any_:
    """True if one of the parts is."""

    parts: tuple

    def __str__(self) -> str:
        return " or ".join(map(str, self.parts))


@dataclass(frozen=True)
class All_:
    """True if every part is; false for no parts."""

    parts: tuple

    def __str__(self) -> str:
        return " and ".join(f"({p})" if isinstance(p, Any_) else str(p) for p in self.parts)


@dataclass(frozen=True)
class Has:
    path: Path

    def __str__(self) -> str:
        return "->".join(self.path)


@dataclass(frozen=True)
class Missing:
    path: Path

    def __str__(self) -> str:
        return "not " + "->".join(self.path)


@dataclass(frozen=True)
class Compare:
    path: Path
    op: str
    value: Any

    def __str__(self) -> str:
        return f"{'->'.join(self.path)} {self.op} {literal_text(self.value)}"


@dataclass(frozen=True)
class IsA:
    symbol: str

    def __str__(self) -> str:
        return f"^{self.symbol}"


@dataclass(frozen=True)
class Related:
    relation: str
    term: str | None = None
    ref: str | None = None

    def __str__(self) -> str:
        return self.relation + "?" + (f" ^{self.term}" if self.term else "") + (f" @{self.ref}" if self.ref else "")


@dataclass(frozen=True)
class Upward:
    """The path, followed again and again, reaches the ref."""

    path: Path
    ref: str

    def __str__(self) -> str:
        return f"{'->'.join(self.path)} *== @{self.ref}"


def literal_text(value: Any) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, Quantity):
        return f"{value.value:g}{value.unit}"
    if isinstance(value, Ref):
        return f"@{value.id}"
    if isinstance(value, Symbol):
        return f"^{value.name}"
    if isinstance(value, Uri):
        return f"`{value.text}`"
    if isinstance(value, (datetime, date, time)):
        return value.isoformat()
    escaped = str(value).replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\t", "\\t")
    return f'"{escaped}"'


_TOKENS = re.compile(
    r"""\s*(?:
      (?P<datetime>\d{4}-\d\d-\d\dT\d\d:\d\d(?::\d\d(?:\.\d+)?)?(?:Z|[+-]\d\d:\d\d)?(?:\s+[A-Z][A-Za-z_/+-]*\d*)?)
    | (?P<date>\d{4}-\d\d-\d\d)
    | (?P<time>\d\d:\d\d(?::\d\d(?:\.\d+)?)?)
    | (?P<number>-?\d[\d_]*(?:\.\d+)?(?:[eE][+-]?\d+)?)(?P<unit>[A-Za-z%$_/°²³µΔΩ€£¥]*)
    | "(?P<string>(?:[^"\\]|\\.)*)"
    | `(?P<uri>(?:[^`\\]|\\.)*)`
    | @(?P<ref>[A-Za-z0-9_:.~-]+)
    | \^(?P<symbol>[a-z][A-Za-z0-9:.-]*)
    | (?P<op>\*==|->|==|!=|<=|>=|<|>|\(|\)|\?)
    | (?P<name>[A-Za-z][A-Za-z0-9_]*(?:-[a-z0-9][A-Za-z0-9_]*)*)
    )""",
    re.X,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}


def _unescape(text: str) -> str:
    def one(m: re.Match) -> str:
        return chr(int(m[1][1:], 16)) if len(m[1]) == 5 else _ESCAPES.get(m[1], m[1])

    return re.sub(r"\\(u[0-9a-fA-F]{4}|.)", one, text)


def lex(text: str) -> list[tuple[str, Any]]:
    found, at = [], 0
    while text[at:].strip():
        m = _TOKENS.match(text, at)
        if not m:
            raise FilterError(f"unexpected {text[at:].strip()[:12]!r} at {at} in {text!r}")
        at = m.end()
        kind = next(k for k, v in m.groupdict().items() if v is not None)
        raw = m[kind]
        if kind == "number":
            found.append(("value", Quantity(float(raw.replace("_", "")), m["unit"] or "")))
        elif kind == "string":
            found.append(("value", _unescape(raw)))
        elif kind == "uri":
            found.append(("value", Uri(_unescape(raw))))
        elif kind == "ref":
            found.append(("ref", raw))
        elif kind == "symbol":
            found.append(("symbol", raw))
        elif kind == "date":
            found.append(("value", date.fromisoformat(raw)))
        elif kind == "time":
            found.append(("value", time.fromisoformat(raw)))
        elif kind == "datetime":
            found.append(("value", datetime.fromisoformat(raw.split()[0].replace("Z", "+00:00"))))
        elif kind == "name" and raw in ("true", "false"):
            found.append(("value", raw == "true"))
        elif kind == "name" and raw in ("and", "or", "not"):
            found.append(("word", raw))
        else:
            found.append((kind, raw))
    return found


class Parser:
    """or < and < term; `not` stands before a path only."""

    def __init__(self, text: str):
        self.text, self.tokens, self.at = text, lex(text), 0

    def peek(self) -> tuple[str, Any]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", None)

    def take(self, kind: str, value: Any = None) -> Any:
        token = self.peek()
        if token[0] != kind or value is not None and token[1] != value:
            raise FilterError(f"expected {value or kind}, found {token[1]!r} in {self.text!r}")
        self.at += 1
        return token[1]

    def parse(self):  # noqa: ANN201
        node = self.either()
        self.take("end") if self.at < len(self.tokens) else None
        return node

    def either(self):  # noqa: ANN201
        parts = [self.both()]
        while self.peek() == ("word", "or"):
            self.at += 1
            parts.append(self.both())
        return parts[0] if len(parts) == 1 else Any_(tuple(parts))

    def both(self):  # noqa: ANN201
        parts = [self.term()]
        while self.peek() == ("word", "and"):
            self.at += 1
            parts.append(self.term())
        return parts[0] if len(parts) == 1 else All_(tuple(parts))

    def path(self) -> Path:
        names = [self.take("name")]
        while self.peek() == ("op", "->"):
            self.at += 1
            names.append(self.take("name"))
        return tuple(names)

    def term(self):  # noqa: ANN201
        kind, value = self.peek()
        if (kind, value) == ("op", "("):
            self.at += 1
            node = self.either()
            self.take("op", ")")
            return node
        if kind == "symbol":
            self.at += 1
            return IsA(value)
        if (kind, value) == ("word", "not"):
            self.at += 1
            return Missing(self.path())
        path = self.path()
        kind, value = self.peek()
        if kind == "op" and value in ("==", "!=", "<", "<=", ">", ">="):
            self.at += 1
            return Compare(path, value, self.literal())
        if (kind, value) == ("op", "*=="):
            self.at += 1
            return Upward(path, self.take("ref"))
        if (kind, value) == ("op", "?"):
            self.at += 1
            term = self.take("symbol") if self.peek()[0] == "symbol" else None
            ref = self.take("ref") if self.peek()[0] == "ref" else None
            return Related("-".join(path), term, ref)
        return Has(path)

    def literal(self) -> Any:
        kind, value = self.peek()
        if kind not in ("value", "ref", "symbol"):
            raise FilterError(f"expected a value, found {value!r} in {self.text!r}")
        self.at += 1
        return Ref(value) if kind == "ref" else Symbol(value) if kind == "symbol" else value


def parse(text: str):  # noqa: ANN201
    return Parser(text).parse()


@dataclass
class Model:
    """What a filter may reach: refs by tag name, and an ontology for ^symbol terms.

    refs: tag -> (table, id column). A referenced table must be unique on its id.
    descendants: def name -> names of its subtypes, itself included.
    """

    refs: dict[str, tuple[DataFrame, str]] = field(default_factory=dict)
    descendants: dict[str, set[str]] = field(default_factory=dict)
    #: relation -> tags that carry it, each with the terms it stands for
    relations: dict[str, dict[str, set[str]]] = field(default_factory=dict)


_KINDS = {
    Quantity: (T.NumericType,), bool: (T.BooleanType,), str: (T.StringType,), Ref: (T.StringType, T.IntegralType),
    Symbol: (T.StringType,), Uri: (T.StringType,), date: (T.DateType,), datetime: (T.TimestampType, T.TimestampNTZType),
    time: (T.StringType,),
}


class Compiler:
    def __init__(self, df: DataFrame, model: Model | None = None):
        self.df, self.model = df, model or Model()
        self.columns = list(df.columns)
        self.hops: dict[Path, dict[str, T.StructField]] = {(): {f.name: f for f in df.schema}}

    def _hop(self, prefix: Path) -> dict[str, T.StructField] | None:
        """The fields that lie behind a reference path; joins each path once."""
        if prefix in self.hops:
            return self.hops[prefix]
        found = self._field(prefix)
        if found is None:
            return None
        column, info = found
        if isinstance(info.dataType, T.StructType):
            self.hops[prefix] = {f.name: f for f in info.dataType}
            return self.hops[prefix]
        if prefix[-1] not in self.model.refs:
            return None
        target, key = self.model.refs[prefix[-1]]
        mark = "__" + "__".join(prefix) + "__"
        renamed = target.select(*(F.col(f"`{c}`").alias(mark + c) for c in target.columns))
        self.df = self.df.join(renamed, column.cast(target.schema[key].dataType) == F.col(f"`{mark}{key}`"), "left")
        self.hops[prefix] = {f.name: T.StructField(mark + f.name, f.dataType, True, f.metadata) for f in target.schema}
        return self.hops[prefix]

    def _field(self, path: Path) -> tuple[Column, T.StructField] | None:
        fields = self._hop(path[:-1])
        if fields is None or path[-1] not in fields:
            return None
        info = fields[path[-1]]
        outer = self._field(path[:-1]) if len(path) > 1 else None
        if outer and isinstance(outer[1].dataType, T.StructType):
            return outer[0].getField(path[-1]), info
        return F.col(f"`{info.name}`"), info

    def column(self, node) -> Column:  # noqa: ANN001
        no = F.lit(False)
        if isinstance(node, Any_):
            out = no
            for part in node.parts:
                out = out | self.column(part)
            return out
        if isinstance(node, All_):
            if not node.parts:
                return no
            out = F.lit(True)
            for part in node.parts:
                out = out & self.column(part)
            return out
        if isinstance(node, Has):
            found = self._field(node.path)
            return found[0].isNotNull() if found else no
        if isinstance(node, Missing):
            found = self._field(node.path)
            return found[0].isNull() if found else F.lit(True)
        if isinstance(node, Compare):
            return self._compare(node)
        if isinstance(node, IsA):
            tags = self.model.descendants.get(node.symbol, {node.symbol})
            return self._any_tag(tags)
        if isinstance(node, Related):
            return self._related(node)
        if isinstance(node, Upward):
            return self._upward(node)
        raise FilterError(f"no such node: {node!r}")

    def _any_tag(self, tags: set[str]) -> Column:
        out = F.lit(False)
        for name in self.columns:
            if name in tags:
                held = F.col(f"`{name}`")
                marker = isinstance(self.hops[()][name].dataType, T.BooleanType)
                out = out | (F.coalesce(held, F.lit(False)) if marker else held.isNotNull())
        return out

    def _compare(self, node: Compare) -> Column:
        found = self._field(node.path)
        if not found:
            return F.lit(False)
        column, info = found
        value = node.value
        kinds = _KINDS[type(value)]
        if isinstance(info.dataType, T.ArrayType):
            one = T.StructField("x", info.dataType.elementType, True, info.metadata)
            return F.exists(column, lambda x: self._against(x, one, node.op, value, kinds))
        return self._against(column, info, node.op, value, kinds)

    def _against(self, column: Column, info: T.StructField, op: str, value: Any, kinds: tuple) -> Column:
        if not isinstance(info.dataType, kinds):
            return F.lit(False)
        if isinstance(value, Quantity):
            unit = (info.metadata or {}).get("unit", "")
            number = value.value
            if unit != value.unit:
                if op in ("==", "!="):
                    return F.lit(False) if op == "==" else column.isNotNull()
                if not (unit in UNITS and value.unit in UNITS and same_quantity(unit, value.unit) and UNITS[unit].quantity == "time"):
                    raise FilterError(f"{'value'} in {value.unit or 'no unit'} against {unit or 'no unit'}")
                number = convert(number, value.unit, unit)
            other = F.lit(int(number) if number.is_integer() and isinstance(info.dataType, T.IntegralType) else number)
        elif isinstance(value, Ref):
            other = F.lit(value.id).cast(info.dataType)
        elif isinstance(value, (Symbol, Uri)):
            other = F.lit(value.name if isinstance(value, Symbol) else value.text)
        elif isinstance(value, time):
            other = F.lit(value.isoformat())
        else:
            other = F.lit(value).cast(info.dataType)
        return {"==": column == other, "!=": column != other, "<": column < other, "<=": column <= other, ">": column > other, ">=": column >= other}[op]

    def _related(self, node: Related) -> Column:
        tags = self.model.relations.get(node.relation, {})
        out = F.lit(False)
        for tag, terms in tags.items():
            if tag not in self.columns or node.term and not terms & self.model.descendants.get(node.term, {node.term}):
                continue
            held = F.col(f"`{tag}`")
            if node.ref:
                out = out | F.coalesce(held.cast("string") == node.ref, F.lit(False))
            else:
                out = out | held.isNotNull()
        return out

    def _upward(self, node: Upward) -> Column:
        """One semi-join against the ids from which the ref is reached; cycles end it."""
        if len(node.path) != 1 or node.path[0] not in self.model.refs:
            raise FilterError(f"{node.path} is no reference")
        target, key = self.model.refs[node.path[0]]
        reached = ids_below(target.select(F.col(key).cast("string").alias("id"), F.col(node.path[0]).cast("string").alias("up")), node.ref)
        mark = f"__up{len(self.hops)}"
        self.hops[(mark,)] = {}
        self.df = self.df.join(reached.select(F.col("id").alias(mark)), F.col(node.path[0]).cast("string") == F.col(mark), "left")
        return F.col(mark).isNotNull()

    def filter(self, text: str) -> DataFrame:
        predicate = self.column(parse(text))
        return self.df.where(predicate).select(*(F.col(f"`{c}`") for c in self.columns))


def ids_below(parents: DataFrame, top: str) -> DataFrame:
    """The id `top` and all ids whose chain of `up` references meets it."""
    spark = parents.sparkSession
    name = f"parents_{abs(hash((top, id(parents))))}"
    parents.createOrReplaceTempView(name)
    shown = top.replace("'", "''")
    return spark.sql(
        f"WITH RECURSIVE below(id, depth) AS (SELECT '{shown}', 0 UNION ALL"
        f" SELECT p.id, b.depth + 1 FROM {name} p JOIN below b ON p.up = b.id WHERE b.depth < 64 AND p.id <> '{shown}') SELECT DISTINCT id FROM below"
    )


def apply_filter(df: DataFrame, text: str, model: Model | None = None) -> DataFrame:
    return Compiler(df, model).filter(text)


class FilterBuilder:
    """Builds a filter step by step: Filter().has("site").and_().greater("area", 10)."""

    def __init__(self) -> None:
        self.words: list[str] = []

    def _add(self, *words: str) -> FilterBuilder:
        self.words.extend(words)
        return self

    def has(self, path: str) -> FilterBuilder:
        return self._add(path)

    def missing(self, path: str) -> FilterBuilder:
        return self._add("not", path)

    def and_(self) -> FilterBuilder:
        return self._add("and")

    def or_(self) -> FilterBuilder:
        return self._add("or")

    def is_a(self, symbol: str) -> FilterBuilder:
        return self._add("^" + symbol.lstrip("^"))

    def opened(self) -> FilterBuilder:
        return self._add("(")

    def closed(self) -> FilterBuilder:
        return self._add(")")

    def compare(self, path: str, op: str, value: Any) -> FilterBuilder:
        if isinstance(value, (int, float)) and not isinstance(value, bool):
            value = Quantity(float(value))
        return self._add(path, op, literal_text(value))

    def equals(self, path: str, value: Any) -> FilterBuilder:
        return self.compare(path, "==", value)

    def not_equals(self, path: str, value: Any) -> FilterBuilder:
        return self.compare(path, "!=", value)

    def less(self, path: str, value: Any) -> FilterBuilder:
        return self.compare(path, "<", value)

    def at_most(self, path: str, value: Any) -> FilterBuilder:
        return self.compare(path, "<=", value)

    def greater(self, path: str, value: Any) -> FilterBuilder:
        return self.compare(path, ">", value)

    def at_least(self, path: str, value: Any) -> FilterBuilder:
        return self.compare(path, ">=", value)

    def filter(self, text: str) -> FilterBuilder:
        return self._add("(", str(parse(text)), ")")

    def build(self) -> str:
        text = " ".join(self.words)
        parse(text)
        return text
