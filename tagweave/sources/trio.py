"""Trio: records as lines of `tag` or `tag: value`, set apart by dashes."""

from __future__ import annotations

from typing import Any

from tagweave.sources.values import MARKER, Marker
from tagweave.sources.zinc import Reader, ZincError, write_value


def _value(text: str) -> Any:
    reader = Reader(text)
    try:
        value = reader.value()
    except (ZincError, ValueError):
        return text
    return value if reader.at == len(reader.text) else text


def read_trio(text: str) -> list[dict[str, Any]]:
    """Values that aren't valid literals are plain text; a tag with nothing after its
    colon takes the indented lines that follow."""
    out: list[dict[str, Any]] = []
    record: dict[str, Any] = {}
    lines = text.replace("\r\n", "\n").split("\n")
    at = 0
    while at < len(lines):
        line = lines[at]
        at += 1
        stripped = line.strip()
        if stripped.startswith("--"):
            if record:
                out.append(record)
            record = {}
            continue
        if not stripped or stripped.startswith("//"):
            continue
        name, colon, rest = stripped.partition(":")
        name, rest = name.strip(), rest.strip()
        if not colon:
            record[name] = MARKER
        elif rest:
            record[name] = _value(rest)
        else:
            body = []
            while at < len(lines) and (not lines[at].strip() or lines[at][:1] in " \t"):
                body.append(lines[at])
                at += 1
            while body and not body[-1].strip():
                body.pop()
            indent = min((len(x) - len(x.lstrip()) for x in body if x.strip()), default=0)
            record[name] = "\n".join(x[indent:] for x in body)
    if record:
        out.append(record)
    return out


def _line(name: str, v: Any) -> str:
    if isinstance(v, Marker):
        return name
    if isinstance(v, str) and "\n" in v and not any(x.strip() == "" for x in v.split("\n")) and not v[:1].isspace():
        return f"{name}:\n" + "\n".join("  " + x for x in v.split("\n"))
    return f"{name}: {write_value(v)}"


def write_trio(records: list[dict[str, Any]]) -> str:
    return "---\n".join("\n".join(_line(k, v) for k, v in r.items() if v is not None) + "\n" for r in records)
