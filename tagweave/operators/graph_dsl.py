"""A small query text for graphs, and a builder for the same queries.

    MATCH [kind] WHERE field = "x" AND (other LIKE "pre*" OR n CONTAINS "y") CALLERS depth=3 PROJECT 1 LIMIT 20
    PATH FROM "a" TO "b" maxDepth=8
    COUNT [kind] WHERE ...

AND binds tighter than OR. Conditions become one predicate; a traversal starts from
every match.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagweave.operators import graph


class GraphQueryError(ValueError):
    pass


@dataclass(frozen=True)
class Test:
    field: str
    op: str
    value: object

    def column(self) -> Column:
        c, v = F.col(self.field), self.value
        match self.op:
            case "equals":
                return c.cast("string") == str(v)
            case "not_equals":
                return c.cast("string") != str(v)
            case "contains":
                return F.contains(F.lower(c), F.lit(str(v).lower()))
            case "starts_with":
                return F.startswith(F.lower(c), F.lit(str(v).lower()))
            case "ends_with":
                return F.endswith(F.lower(c), F.lit(str(v).lower()))
            case "in":
                return c.cast("string").isin([str(x) for x in v])
            case "not_in":
                return ~c.cast("string").isin([str(x) for x in v])
        raise GraphQueryError(f"no test {self.op!r}")


@dataclass(frozen=True)
class GraphQuery:
    """Alternatives of conjunctions of tests, then a traversal and a cut."""

    action: str = "match"
    kind: str | None = None
    tests: tuple[tuple[Test, ...], ...] = ((),)
    direction: str | None = None
    depth: int = 5
    project: int | None = None
    limit: int = 50
    offset: int = 0
    start: str | None = None
    end: str | None = None
    group: str | None = None

    # builder
    def where(self, field_: str, op: str, value: object) -> GraphQuery:
        return replace(self, tests=tuple((*t, Test(field_, op, value)) for t in self.tests))

    def of(self, kind: str) -> GraphQuery:
        return replace(self, kind=kind)

    def traverse(self, direction: str, depth: int = 5) -> GraphQuery:
        return replace(self, direction=direction, depth=depth)

    def path(self, start: str, end: str, depth: int = 10) -> GraphQuery:
        return replace(self, action="path", start=start, end=end, depth=depth)

    def group_by(self, name: str) -> GraphQuery:
        return replace(self, action="group", group=name)

    def count(self) -> GraphQuery:
        return replace(self, action="count")

    def page(self, offset: int, limit: int) -> GraphQuery:
        return replace(self, offset=offset, limit=limit)

    def in_project(self, project: int) -> GraphQuery:
        return replace(self, project=project)

    def matched(self, nodes: DataFrame) -> DataFrame:
        if self.kind:
            nodes = nodes.where(F.col("kind") == self.kind)
        if self.project is not None and "project" in nodes.columns:
            nodes = nodes.where(F.col("project") == self.project)
        any_ = F.lit(False)
        for tests in self.tests:
            all_ = F.lit(True)
            for test in tests:
                all_ = all_ & test.column()
            any_ = any_ | all_
        return nodes.where(any_)

    def run(self, nodes: DataFrame, edges: DataFrame) -> DataFrame:
        if self.action == "path":
            own = F.col("id").cast("string")

            def one(text: str) -> Column:
                """The node of this id, else the smallest of this name."""
                return F.coalesce(F.min(F.when(own == text, own)), F.min(F.when(F.col("name") == text, F.col("id"))).cast("string"), F.lit(text))

            start, end = nodes.agg(one(self.start).alias("a"), one(self.end).alias("b")).first()
            return graph.shortest_path(edges, start, end, self.depth)
        found = self.matched(nodes)
        if self.action == "count":
            return found.agg(F.count("*").alias("n"))
        if self.action == "group":
            return found.groupBy(self.group).agg(F.count("*").alias("n")).orderBy(F.desc("n"), self.group)
        if self.direction:
            step = graph.callers if self.direction == "callers" else graph.callees
            found = step(edges, found.select("id"), self.depth).join(nodes, "id")
            return found.orderBy("depth", "name", "id").offset(self.offset).limit(self.limit)
        return found.orderBy("name", "id").offset(self.offset).limit(self.limit)


_TOKEN = re.compile(r"""\s*(?:"((?:[^"\\]|\\.)*)"|'((?:[^'\\]|\\.)*)'|([A-Za-z]+)=(\d+)|(==|=|\(|\))|([^\s"'()=]+))""")
_STOPS = {"CALLERS", "CALLEES", "PROJECT", "LIMIT"}


@dataclass
class _Text:
    tokens: list[tuple[str, str]] = field(default_factory=list)
    at: int = 0

    def word(self) -> str:
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")
        return value.upper() if kind == "word" else ""

    def take(self, *kinds: str) -> str:
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")
        if kinds and kind not in kinds:
            raise GraphQueryError(f"expected {' or '.join(kinds)}, found {value!r}")
        self.at += 1
        return value

    def option(self, name: str) -> int | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "option" and self.tokens[self.at][1].lower().startswith(name.lower() + "="):
            return int(self.take().split("=")[1])
        return None


def _lex(text: str) -> _Text:
    out, at = _Text(), 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m or m.end() == at:
            raise GraphQueryError(f"unexpected {text[at:at + 10]!r}")
        at = m.end()
        double, single, name, number, op, word = m.groups()
        if double is not None or single is not None:
            out.tokens.append(("string", double if double is not None else single))
        elif name:
            out.tokens.append(("option", f"{name}={number}"))
        elif op:
            out.tokens.append(("op", op))
        else:
            out.tokens.append(("word", word))
    return out


def _test(t: _Text) -> Test:
    name = t.take("word")
    op = t.take("op", "word").upper()
    if op in ("=", "=="):
        return Test(name, "equals", t.take("string", "word"))
    value = t.take("string", "word")
    if op == "LIKE":
        if value.endswith("*"):
            return Test(name, "starts_with", value[:-1])
        return Test(name, "ends_with", value[1:]) if value.startswith("*") else Test(name, "contains", value)
    if op == "CONTAINS":
        return Test(name, "contains", value)
    if op == "IN":
        return Test(name, "in", tuple(v.strip() for v in value.split(",")))
    raise GraphQueryError(f"no operator {op!r}")


Clauses = tuple[tuple[Test, ...], ...]


def _either(t: _Text) -> Clauses:
    out = _both(t)
    while t.word() == "OR":
        t.at += 1
        out = out + _both(t)
    return out


def _both(t: _Text) -> Clauses:
    out = _one(t)
    while t.word() == "AND":
        t.at += 1
        right = _one(t)
        out = tuple(a + b for a in out for b in right)
    return out


def _one(t: _Text) -> Clauses:
    if t.at < len(t.tokens) and t.tokens[t.at] == ("op", "("):
        t.at += 1
        out = _either(t)
        if t.take("op") != ")":
            raise GraphQueryError("a parenthesis isn't closed")
        return out
    return ((_test(t),),)


def parse(text: str) -> GraphQuery:
    t = _lex(text)
    command = t.take("word").upper()
    if command == "PATH":
        if t.take("word").upper() != "FROM":
            raise GraphQueryError("expected FROM")
        start = t.take("string", "word")
        if t.take("word").upper() != "TO":
            raise GraphQueryError("expected TO")
        end = t.take("string", "word")
        return GraphQuery().path(start, end, t.option("maxDepth") or 10)
    if command not in ("MATCH", "COUNT"):
        raise GraphQueryError(f"no command {command!r}")
    query = GraphQuery(action="match" if command == "MATCH" else "count")
    if t.word() and t.word() not in {"WHERE", *_STOPS}:
        query = query.of(t.take("word").lower())
    if t.word() == "WHERE":
        t.at += 1
        query = replace(query, tests=_either(t))
    if t.word() in ("CALLERS", "CALLEES"):
        query = query.traverse(t.take().lower())
        query = replace(query, depth=t.option("depth") or 5)
    if t.word() == "PROJECT":
        t.at += 1
        query = query.in_project(int(t.take("word")))
    if t.word() == "LIMIT":
        t.at += 1
        query = replace(query, limit=int(t.take("word")))
    if t.at < len(t.tokens):
        raise GraphQueryError(f"unexpected {t.tokens[t.at][1]!r}")
    return query
