"""Python: top-level functions, decorated ones, and methods of undecorated top-level classes."""

from __future__ import annotations

import re

from graphloom.extract.tokens import Reader, Token, arity, last_line, member, param, record, returns, value


def nullable(t: str) -> bool:
    return t.startswith("Optional") or "| None" in t or "None |" in t or ("Union[" in t and "None" in t)


def _statements(r: Reader, a: int, b: int) -> list[tuple[int, int]]:
    """Logical lines: token ranges that begin outside brackets on a line of their own."""
    out, i, start = [], a, a
    while i < b:
        j = r.after(i)
        if j >= b or r.at(j).line > last_line(r.at(j - 1)):
            out.append((start, j))
            start = j
        i = j
    return out


def _blocks(r: Reader, statements: list[tuple[int, int]], indent: int) -> list[tuple[int, int]]:
    """Index ranges of statements: each with the deeper ones below it."""
    out, i = [], 0
    while i < len(statements):
        j = i + 1
        while j < len(statements) and r.at(statements[j][0]).column > indent:
            j += 1
        out.append((i, j))
        i = j
    return out


def _keyword(r: Reader, i: int) -> str:
    return r.word(i + 1) if r.word(i) == "async" else r.word(i)


def _fields(r: Reader, body: list[tuple[int, int]]) -> list[dict]:
    """Annotated assignments of a class body."""
    out = []
    if not body:
        return out
    indent = r.at(body[0][0]).column
    for a, b in body:
        if r.at(a).column == indent and r.is_name(a) and r.word(a + 1) == ":" and b > a + 2 and r.word(a) not in ("else", "try", "finally"):
            end = next((k for k in range(a + 2, b) if r.word(k) == "=" and _level(r, a + 2, k)), b)
            t = r.slice(a + 2, end)
            out.append(member(r.word(a), t, nullable(t)))
    return out


def _level(r: Reader, a: int, k: int) -> bool:
    """Token k is not inside a bracket opened behind a."""
    i = a
    while i < k:
        i = r.after(i)
    return i == k


def functions(path: str, text: str, tokens: list[Token]) -> list[dict]:
    r = Reader(text, tokens)
    statements = _statements(r, 0, len(tokens))
    groups = _blocks(r, statements, 0)
    classes: dict[str, list] = {}
    for i, j in groups:
        head = statements[i][0]
        if r.word(head) == "class" and r.is_name(head + 1):
            classes[r.word(head + 1)] = _fields(r, statements[i + 1 : j])
    base = re.split(r"[\\/]", path)[-1]
    test_file = base.startswith("test_") or base.endswith("_test.py")
    out: list[dict] = []
    decorated: int | None = None
    for i, j in groups:
        head = statements[i][0]
        if r.word(head) == "@":
            decorated = head if decorated is None else decorated
            continue
        if _keyword(r, head) == "def":
            out += _function(r, path, statements, i, j, classes, test_file, "", decorated)
        elif r.word(head) == "class" and decorated is None and r.is_name(head + 1):
            out += _methods(r, path, statements, i, j, classes, test_file)
        decorated = None
    return out


def _methods(r: Reader, path: str, statements: list, i: int, j: int, classes: dict, test_file: bool) -> list[dict]:
    body, name, out = statements[i + 1 : j], r.word(statements[i][0] + 1), []
    if not body:
        return out
    decorated: int | None = None
    for a, b in _blocks(r, body, r.at(body[0][0]).column):
        head = body[a][0]
        if r.word(head) == "@":
            decorated = head if decorated is None else decorated
            continue
        if _keyword(r, head) == "def":
            out += _function(r, path, body, a, b, classes, test_file, name, decorated)
        decorated = None
    return out


def _function(r: Reader, path: str, statements: list, i: int, j: int, classes: dict, test_file: bool, owner: str, decorated: int | None) -> list[dict]:
    head = statements[i][0]
    at = head + (2 if r.word(head) == "async" else 1)
    if not r.is_name(at):
        return []
    name, k = r.word(at), at + 1
    if r.word(k) == "[":
        k = r.after(k)
    if r.word(k) != "(":
        return []
    params, taken = [p for a, b in r.split(k + 1, r.at(k).mate) if (p := _param(r, a, b, classes)) is not None], arity(r, k, bool(owner))
    if owner:
        params = [p for p in params if p["name"] != "self"]
    k = r.after(k)
    values = []
    if r.word(k) == "->":
        end = k + 1
        while end < statements[i][1] and r.word(end) != ":":
            end = r.after(end)
        t = r.slice(k + 1, end)
        values = [] if t == "None" else [value("", t, nullable=nullable(t), expanded=classes.get(t))]
    hidden = name.startswith("_") and not name.startswith("__")
    last = r.at(statements[j - 1][1] - 1)
    return [
        record(
            path, "python", name, f"{owner}.{name}" if owner else name, r.at(head if decorated is None else decorated).line, last_line(last), kind="method" if owner else "function", receiver=owner,
            exported=not hidden, tag="test" if test_file and name.startswith("test_") else "application", parameters=params, returns=returns(values),
            contract_completeness="inferred" if any(not p["type"] for p in params) else "full", **taken,
        )
    ]


def _param(r: Reader, a: int, b: int, classes: dict) -> dict | None:
    """A parameter; None for separators and untyped star parameters."""
    star = r.word(a) in ("*", "**")
    name = a + star
    if not r.is_name(name):
        return None
    if r.word(name + 1) == ":" and name + 1 < b:
        end = next((k for k in range(name + 2, b) if r.word(k) == "=" and _level(r, name + 2, k)), b)
        t = r.slice(name + 2, end)
        return param("" if star else r.word(name), t, nullable=nullable(t), expanded=classes.get(t))
    return None if star else param(r.word(name))
