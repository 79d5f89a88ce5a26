"""Calls in source texts, found by their tokens: brackets nest, strings and comments say nothing."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words before a parenthesis that call nothing.
KEYWORDS = frozenset("if else for while switch return catch try throw do and or not".split())

#: What a text is made of. Strings end with their line, unless they have three marks; a
#: comment or string that isn't closed lasts to the end. No part is tried twice.
_TOKEN = re.compile(
    r"""(?P<skip>[ \t\r\f]+|//[^\n]*|/\*(?s:.*?)(?:\*/|\Z))
      | (?P<line>\n)
      | (?P<string>\"{3}(?s:.*?)(?:\"{3}|\Z) | r"[^"\n]*+"? | "(?:\\.|[^"\\\n])*+"? | `(?:\\.|[^`\\\n])*+`?)
      | (?P<name>[A-Za-z_]\w*)
      | (?P<number>\d\w*(?:\.\d\w*)?)
      | (?P<arrow>=>)
      | (?P<dot>->|::|\.(?!\.))
      | (?P<mark>[()\[\]{},:])
      | (?P<other>(?s:.))""",
    re.VERBOSE,
)
#: Words that go on with the statement of the line before.
_GOES_ON = frozenset(("do", "else", "end", "catch", "and", "or"))
_CLOSES = {")": "(", "]": "[", "}": "{"}

CALL = "array<struct<seq:int,line:int,name:string,method:boolean,n_args:int,depth:int,outer:string,definition:string>>"
_ARROW = pa.list_(pa.struct([("seq", pa.int32()), ("line", pa.int32()), ("name", pa.string()), ("method", pa.bool_()), ("n_args", pa.int32()), ("depth", pa.int32()), ("outer", pa.string()), ("definition", pa.string())]))


def _tokens(text: str) -> list[tuple[str, str, int, bool]]:
    """(kind, text, line, whether it starts a line); blanks and comments are left out."""
    found, line, fresh = [], 1, True
    for m in _TOKEN.finditer(text):
        kind, said = m.lastgroup, m.group()
        if kind == "line":
            line, fresh = line + 1, True
        elif kind == "skip":
            line += said.count("\n")
        else:
            found.append((kind, said, line, fresh))
            line, fresh = line + said.count("\n"), False
    return found


def _closing(tokens) -> dict[int, int]:
    """Place of the mark that closes each bracket. A bracket that another kind closes, or
    none, has no place; a closing mark that fits none open is passed over."""
    open_, closed = [], {}
    counts = dict.fromkeys("([{", 0)
    for i, (kind, said, _, _) in enumerate(tokens):
        if kind != "mark":
            continue
        if said in counts:
            open_.append(i)
            counts[said] += 1
        elif said in _CLOSES and counts[_CLOSES[said]]:
            while open_:
                at = open_.pop()
                counts[tokens[at][1]] -= 1
                if tokens[at][1] == _CLOSES[said]:
                    closed[at] = i
                    break
    return closed


def calls_of(text: str | None) -> list[dict]:
    """The calls of a text in the order of their names; see `calls`."""
    tokens = _tokens(text or "")
    closed = _closing(tokens)
    ends = {j: i for i, j in closed.items()}
    n = len(tokens)

    def said(i: int) -> str:
        return tokens[i][1] if 0 <= i < n and tokens[i][0] != "string" else ""

    def leads(i: int) -> bool:
        """Whether the bracket at i holds the parameters of a function."""
        return i in closed and said(closed[i] + 1) == "=>"

    found: list[dict] = []
    called: dict[int, dict] = {}  # by the place of the opening bracket
    stack: list[tuple[int, dict | None, dict | None]] = []  # open brackets: place, its call, nearest call
    definition, blocks = None, 0
    for i, (kind, word, line, fresh) in enumerate(tokens):
        if kind == "name":
            member = i > 0 and tokens[i - 1][0] == "dot" and said(i - 1) != "::"
            if fresh and definition and not stack and not blocks and word not in _GOES_ON and (tokens[i - 1][0] in ("name", "number", "string") or i - 1 in ends):
                definition = None  # another statement
            if not member:
                blocks = blocks + 1 if word == "do" else max(blocks - 1, 0) if word == "end" else blocks
            if not stack and not blocks and said(i + 1) == ":" and (leads(i + 2) or said(i + 3) == "=>" and tokens[i + 2][0] == "name"):
                definition = word
            if said(i + 1) == "(" and not tokens[i + 1][3] and (member or word not in KEYWORDS):
                outer = stack[-1][2] if stack else None
                call = {"seq": len(found), "line": line, "name": word, "method": member, "n_args": 0, "depth": outer["depth"] + 1 if outer else 0, "outer": outer and outer["name"], "definition": definition}
                found.append(call)
                called[i + 1] = call
                if leads(i + 1):  # name (parameters) => body: the function is the one argument
                    call["n_args"] = 1
            elif said(i + 1) == "=>" and not fresh and i - 1 in ends and ends[i - 1] in called:
                called[ends[i - 1]]["n_args"] += 1  # name(arguments) parameter => body
        elif kind == "mark" and word in "([{":
            call = called.get(i)
            if word == "(" and leads(i):
                if not call and not fresh and i - 1 in ends and ends[i - 1] in called:
                    called[ends[i - 1]]["n_args"] += 1  # name(arguments) (parameters) => body
                call = None
            elif call and i + 1 < n and said(i + 1) != ")":
                call["n_args"] = 1
            stack.append((i, call, call or (stack[-1][2] if stack else None)))
        elif kind == "mark" and word == ",":
            if stack and stack[-1][1]:
                stack[-1][1]["n_args"] += 1
        elif kind == "mark" and i in ends:
            while stack and stack.pop()[0] != ends[i]:
                pass
    return found


def call_list(source: Column) -> Column:
    """The calls of a text as an array of structs."""

    @F.arrow_udf(CALL)
    def read(texts: pa.Array) -> pa.Array:
        return pa.array([calls_of(t) for t in texts.to_pylist()], _ARROW)

    return read(source)


def calls(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, seq, line, name, method, n_args, depth, outer, definition): every call of a
    text, numbered by where its name stands; seq from 0, lines from 1.

    n_args counts what is between the call's own parentheses, a receiver not among it, and
    a function that trails them, as in `each(rows) (row, i) => row` or `map(rows) r => r`.
    depth is the number of calls around it and outer the name of the nearest; definition
    is the function of the text's top level that it stands in. Both are null where there is
    none. A call that isn't closed has the arguments up to the text's end. Null and empty
    texts have no calls; a column of df that isn't the key is left out. One text is read by one task."""
    listed = df.select(F.col(key).alias("__key"), call_list(F.col(text)).alias("__calls"))
    return listed.select("__key", F.inline("__calls")).withColumnRenamed("__key", key)
