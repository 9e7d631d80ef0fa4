"""Table definitions from SQL text: a tokenizer, statements in one spelling, and the structure of CREATE TABLE."""

from __future__ import annotations

import re
from itertools import pairwise
from typing import Any

_TOKEN = re.compile(r"--[^\n]*|/\*.*?\*/|'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`|\[[A-Za-z_][^\]]*\]|[A-Za-z_\u0080-￿][\w$\u0080-￿]*|\d+(?:\.\d+)?|[<>!=]=|<>|\|\||::|\S", re.S)
# Words written in capitals, and types, which their length follows without a blank.
KEYWORDS = set(
    "ADD ALTER AND AS ASC AUTO_INCREMENT BY CASCADE CHECK COLUMN COMMENT CONSTRAINT CREATE CURRENT_TIMESTAMP DEFAULT DELETE DESC DROP EXISTS FALSE FOREIGN FROM GENERATED "
    "IDENTITY IF IN INDEX INSERT INTO IS KEY LIKE NO NOT NULL ON OR PRIMARY REFERENCES RESTRICT SELECT SET TABLE TEMPORARY TRUE UNIQUE UPDATE VALUES VIEW WHERE WITH".split()
)
TYPES = set("BIGINT BINARY BIT BLOB BOOLEAN CHAR CHARACTER CLOB DATE DATETIME DECIMAL DOUBLE FLOAT INT INTEGER JSON NCHAR NUMBER NUMERIC NVARCHAR REAL SMALLINT STRING TEXT TIME TIMESTAMP TINYINT UUID VARBINARY VARCHAR VARCHAR2".split())

# Types of several words, and their one spelling; a length stands after the first word or the last.
LONG_TYPES = {
    "DOUBLE PRECISION": "DOUBLE PRECISION",
    "CHARACTER VARYING": "VARCHAR",
    "CHAR VARYING": "VARCHAR",
    "TIME WITH TIME ZONE": "TIMETZ",
    "TIME WITHOUT TIME ZONE": "TIME",
    "TIMESTAMP WITH TIME ZONE": "TIMESTAMPTZ",
    "TIMESTAMP WITHOUT TIME ZONE": "TIMESTAMP",
}


class DDLError(ValueError):
    """The text is no sequence of statements."""


def statements(sql: str) -> list[tuple[list[str], list[str]]]:
    """(tokens, comments) of each statement; quotes and brackets must close."""
    out, tokens, comments, depth = [], [], [], 0
    for t in _TOKEN.findall(sql):
        if t[:2] in ("--", "/*"):
            comments.append(t[2:].removesuffix("*/").strip() if t[:2] == "/*" else t[2:].strip())
        elif t == ";" and not depth:
            if tokens:
                out.append((tokens, comments))
            tokens, comments = [], []
        elif t in "'\"`":
            raise DDLError("a quote does not close")
        else:
            depth += (t == "(") - (t == ")")
            if depth < 0:
                raise DDLError("a bracket closes that none opened")
            tokens.append(t)
    if depth:
        raise DDLError("a bracket does not close")
    return out + ([(tokens, comments)] if tokens else [])


def spelled(tokens: list[str]) -> str:
    """Tokens in one spelling: keywords and types in capitals, blanks after commas and before brackets other than a type's."""
    out = ""
    for i, t in enumerate(tokens):
        known = t.upper() in KEYWORDS | TYPES
        word = t.upper() if known and not (i and tokens[i - 1] == ".") else t
        before = tokens[i - 1] if i else ""
        tight = not i or t in ",).;" or before in ("(", ".") or t == "(" and before.upper() in TYPES or t == "." or t == "::" or before == "::"
        out += word if tight else " " + word
    return out


def _name(token: str) -> str:
    return token[1:-1] if token[:1] in "\"`[" else token


def _split(tokens: list[str]) -> list[list[str]]:
    parts, depth = [[]], 0
    for t in tokens:
        depth += (t == "(") - (t == ")")
        if t == "," and not depth:
            parts.append([])
        else:
            parts[-1].append(t)
    return [p for p in parts if p]


def _close(tokens: list[str], at: int) -> int:
    depth = 0
    for i in range(at, len(tokens)):
        depth += (tokens[i] == "(") - (tokens[i] == ")")
        if not depth:
            return i
    raise DDLError("a bracket does not close")


def _columns(tokens: list[str], at: int) -> list[str]:
    return [_name(p[0]) for p in _split(tokens[at + 1 : _close(tokens, at)])] if at < len(tokens) and tokens[at] == "(" else []


def _type(tokens: list[str]) -> tuple[str, int]:
    """The spelled type that ``tokens`` begin with, and how many of them it takes."""

    def length(at: int) -> int:
        return _close(tokens, at) + 1 if at < len(tokens) and tokens[at] == "(" else at

    first = length(1)
    for words, name in LONG_TYPES.items():
        head, *more = words.split()
        end = first + len(more)
        if tokens[:1] and tokens[0].upper() == head and [t.upper() for t in tokens[first:end]] == more:
            after = length(end)
            size = tokens[1:first] or tokens[end:after]
            return name + spelled(size), after
    return spelled(tokens[:first]), first


def _reference(tokens: list[str], at: int, columns: list[str]) -> dict[str, Any]:
    end = at + 2
    while end < len(tokens) and tokens[end] == ".":
        end += 2
    return {"columns": columns, "target_table": spelled(tokens[at + 1 : end]), "target_columns": _columns(tokens, end)}


def table_of(tokens: list[str]) -> dict[str, Any] | None:
    """The table that a CREATE TABLE statement with a column list makes; None for other statements."""
    upper = [t.upper() for t in tokens]
    if upper[:1] != ["CREATE"] or "TABLE" not in upper[:4] or any(x in upper[: upper.index("TABLE")] for x in ("VIEW", "INDEX")):
        return None
    at = upper.index("TABLE") + 1
    at += 3 if upper[at : at + 3] == ["IF", "NOT", "EXISTS"] else 0
    end = at + 1
    while end < len(tokens) and tokens[end] == ".":
        end += 2
    if end >= len(tokens) or tokens[end] != "(":
        return None
    t: dict[str, Any] = {"name": spelled(tokens[at:end]), "columns": [], "primary_key": [], "foreign_keys": [], "constraints": []}
    later: list[dict[str, Any]] = []
    for part in _split(tokens[end + 1 : _close(tokens, end)]):
        up = [x.upper() for x in part]
        start = 2 if up[0] == "CONSTRAINT" else 0
        head = up[start : start + 1]
        if head and head[0] in ("PRIMARY", "FOREIGN", "UNIQUE", "CHECK", "KEY", "INDEX") or start:
            t["constraints"].append(spelled(part))
            if head == ["PRIMARY"]:
                t["primary_key"] = _columns(part, part.index("("))
            elif head == ["FOREIGN"]:
                r = up.index("REFERENCES") if "REFERENCES" in up else len(part)
                later.append(_reference(part, r, _columns(part, part.index("("))) if r < len(part) else {"columns": _columns(part, part.index("(")), "target_table": "None", "target_columns": []})
            continue
        of, taken = _type(part[1:])
        name, found, rest = _name(part[0]), [], part[1 + taken :]
        begins = [i for i, x in enumerate(rest) if x.upper() in ("PRIMARY", "NOT", "NULL", "UNIQUE", "DEFAULT", "REFERENCES", "CHECK", "COMMENT", "CONSTRAINT", "GENERATED", "AUTO_INCREMENT") and not (x.upper() == "NULL" and i and rest[i - 1].upper() in ("NOT", "DEFAULT"))]
        for a, b in pairwise([*begins, len(rest)]):
            found.append(spelled(rest[a:b]))
            if rest[a].upper() == "REFERENCES":
                t["foreign_keys"].append(_reference(rest, a, [name]))
        if any(c.startswith("PRIMARY KEY") for c in found):
            t["primary_key"].append(name)
        t["columns"].append({"name": name, "type": of, "constraints": found, "comments": []})
    t["foreign_keys"] += later
    return t
