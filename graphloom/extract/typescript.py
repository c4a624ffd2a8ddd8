"""TypeScript: functions, arrow functions of const and let, and methods of exported classes."""

from __future__ import annotations

import re

from graphloom.extract.tokens import Reader, Token, arity, last_line, member, param, record, returns, value

_MEMBER_WORDS = frozenset("public private protected static async readonly override abstract get set declare accessor".split())
_GOES_ON = frozenset(". ?. + - * / % & | ^ < > = == => ? : && || ?? ) ] } , instanceof in as".split())


def _angles(r: Reader, i: int) -> int:
    depth = 0
    while i < len(r.tokens):
        w = r.word(i)
        depth += (w == "<") - (w == ">")
        if w in ("(", "[", "{"):
            i = r.after(i)
            continue
        i += 1
        if depth <= 0:
            return i
    return i


def _type_end(r: Reader, i: int, stops: tuple[str, ...]) -> int:
    """Place behind the type that begins at i; braces belong to it only where a type may begin."""
    begin = True
    while i < len(r.tokens):
        w = r.word(i)
        if w in stops and not (w == "{" and begin):
            return i
        if w == "<":
            i, begin = _angles(r, i), False
            continue
        if w in ("(", "[", "{"):
            i, begin = r.after(i), False
            continue
        if w in (")", "]", "}"):
            return i
        if not begin and r.at(i).line > r.at(i - 1).line and w not in ("|", "&", "=>", "extends", "?", ":", "[", "."):
            return i
        begin = w in ("|", "&", "=>", ":", "?", "extends", "keyof", "typeof", "infer", "readonly", "is")
        i += 1
    return i


def _fields(r: Reader, a: int, b: int, alias: bool) -> list[dict]:
    """Property signatures of an object type."""
    out, i = [], a
    while i < b:
        start = i
        if r.word(i) == "readonly" and r.is_name(i + 1):
            i += 1
        name = i
        optional = r.word(i + 1) == "?"
        colon = i + 1 + optional
        if (r.is_name(name) or r.at(name).kind == "string") and r.word(colon) == ":":
            end = _type_end(r, colon + 1, (";", ","))
            out.append(member(r.word(name), r.slice(colon + 1, end), optional and not alias))
            i = end
        else:
            while i < b and r.word(i) not in (";", ",") and not (i > start and r.at(i).line > r.at(i - 1).line):
                i = r.after(i)
        i += r.word(i) in (";", ",") or i == start
    return out


def _types(r: Reader) -> dict[str, list]:
    interfaces, aliases, i = {}, {}, 0
    while i < len(r.tokens):
        first = i == 0 or r.at(i).line > r.at(i - 1).line or r.word(i - 1) in (";", "}")
        if first and r.word(i) == "interface" and r.is_name(i + 1):
            body = i + 2
            while body < len(r.tokens) and r.word(body) != "{":
                body += 1
            interfaces[r.word(i + 1)] = _fields(r, body + 1, r.at(body).mate, False)
            i = r.after(body)
            continue
        if first and r.word(i) == "type" and r.is_name(i + 1) and r.word(i + 2) == "=" and r.word(i + 3) == "{":
            aliases[r.word(i + 1)] = _fields(r, i + 4, r.at(i + 3).mate, True)
        i = r.after(i)
    return interfaces | aliases


def functions(path: str, text: str, tokens: list[Token]) -> list[dict]:
    r, out, i = Reader(text, tokens), [], 0
    types = _types(r)
    test = bool(re.search(r"\.(?:test|spec)\.tsx?$", path))
    while i < len(tokens):
        exported = r.word(i) == "export"
        at = i + exported + (exported and r.word(i + 1) == "default")
        if not exported and i and r.at(i).line == r.at(i - 1).line and r.word(i - 1) not in (";", "}"):
            i = r.after(i)
            continue
        k = at + (r.word(at) in ("async", "declare"))
        if r.word(k) == "function":
            i = _function(r, path, at, k + 1, exported, types, test, out)
        elif r.word(k) in ("const", "let"):
            i = _arrows(r, path, k + 1, exported, types, test, out)
        elif exported and r.word(k + (r.word(k) == "abstract")) == "class":
            i = _class(r, path, k + (r.word(k) == "abstract"), types, test, out)
        else:
            i = r.after(i)
    return out


def _made(r: Reader, path: str, name: str, start: int, stop: int, opening: int | None, returned: tuple[int, int] | None, types: dict, test: bool, **more) -> dict:
    params = _params(r, opening, types) if opening is not None else []
    values = []
    if returned and more.get("kind") != "constructor":
        t = r.slice(*returned)
        values = [] if t == "void" else [value("", t, nullable="| null" in t or "| undefined" in t, expanded=types.get(t))]
    partial = any(x["type"] == "any" for x in params + values)
    return record(
        path, "typescript", name, name, r.at(start).line, last_line(r.at(stop - 1)), tag="test" if test else "application", parameters=params, returns=returns(values), contract_completeness="partial" if partial else "full",
        **(arity(r, opening) if opening is not None else {"least_args": 1, "most_args": 1}),
    ) | more


def _params(r: Reader, opening: int, types: dict) -> list[dict]:
    out = []
    for a, b in r.split(opening + 1, r.at(opening).mate, angles=True):
        while r.word(a) in ("public", "private", "protected", "readonly", "override") and a + 1 < b and (r.is_name(a + 1) or r.word(a + 1) in ("{", "[")):
            a += 1
        if r.word(a) == "@":
            continue
        rest = r.word(a) == "..."
        name = a + rest
        after = r.after(name)
        optional = r.word(after) == "?"
        colon = after + optional
        t = ""
        if r.word(colon) == ":" and colon < b:
            end = min(_type_end(r, colon + 1, ("=", ",")), b)
            t = r.slice(colon + 1, end)
        plain = r.is_name(name) and not rest and r.word(name) != "this"
        out.append(param(r.word(name) if plain else "", t, nullable=optional or "| null" in t or "| undefined" in t, expanded=types.get(t)))
    return out


def _signature(r: Reader, i: int, arrow: bool = False) -> tuple[int | None, tuple[int, int] | None, int]:
    """(opening bracket, return type, place behind) of type parameters, parameters and return type at i."""
    if r.word(i) == "<":
        i = _angles(r, i)
    if r.word(i) != "(":
        return None, None, i
    opening, i, returned = i, r.after(i), None
    if r.word(i) == ":":
        end = _type_end(r, i + 1, ("=>",) if arrow else ("{", ";"))
        returned, i = (i + 1, end), end
    return opening, returned, i


def _function(r: Reader, path: str, start: int, i: int, exported: bool, types: dict, test: bool, out: list) -> int:
    i += r.word(i) == "*"
    if not r.is_name(i):
        return r.after(i)
    name = r.word(i)
    opening, returned, i = _signature(r, i + 1)
    if r.word(i) == "{":
        stop = r.after(i)
        out.append(_made(r, path, name, start, stop, opening, returned, types, test, exported=exported))
        return stop
    return i + 1


def _arrows(r: Reader, path: str, i: int, exported: bool, types: dict, test: bool, out: list) -> int:
    """The declarators of a const or let statement; only arrow functions give records."""
    while r.is_name(i):
        name, i = r.word(i), i + 1
        if r.word(i) == ":":
            i = _type_end(r, i + 1, ("=", ",", ";"))
        if r.word(i) != "=":
            return i
        start = i + 1
        k = start + (r.word(start) == "async" and r.at(start + 1).text in ("(", "<") or r.word(start) == "async" and r.is_name(start + 1))
        opening = returned = None
        if r.is_name(k) and r.word(k + 1) == "=>":
            k += 1
        else:
            opening, returned, k = _signature(r, k, arrow=True)
        if r.word(k) == "=>" and (opening is not None or r.is_name(k - 1)):
            stop = r.after(k + 1) if r.word(k + 1) == "{" else _expression_end(r, k + 1)
            out.append(_made(r, path, name, start, stop, opening, returned, types, test, exported=exported))
        else:
            stop = _expression_end(r, start)
        i = stop
        if r.word(i) != ",":
            return i
        i += 1
    return i


def _expression_end(r: Reader, i: int) -> int:
    while i < len(r.tokens):
        j = r.after(i)
        w = r.word(j)
        if w in (";", ",") or w == "" or w in (")", "]", "}"):
            return j
        if r.at(j).line > last_line(r.at(j - 1)) and w not in _GOES_ON and r.word(j - 1) not in _GOES_ON - {")", "]", "}"}:
            return j
        i = j
    return i


def _class(r: Reader, path: str, i: int, types: dict, test: bool, out: list) -> int:
    name = r.word(i + 1) if r.is_name(i + 1) else ""
    while i < len(r.tokens) and r.word(i) != "{":
        i += 1
    end, k = r.at(i).mate, i + 1
    while k < end:
        start, words = k, set()
        while r.word(k) == "@":
            k = r.after(k + 2) if r.word(k + 2) == "(" else k + 2
            start = k
        while r.word(k) in _MEMBER_WORDS and r.word(k + 1) not in ("(", "=", ":", ";", "?", "!", "<"):
            words.add(r.word(k))
            k += 1
        k += r.word(k) == "*"
        if r.is_name(k) and r.word(k + 1 + (r.word(k + 1) == "?")) in ("(", "<"):
            own = r.word(k)
            opening, returned, after = _signature(r, k + 1 + (r.word(k + 1) == "?"))
            if r.word(after) == "{" and opening is not None:
                stop = r.after(after)
                out.append(
                    _made(
                        r, path, own, start, stop, opening, returned, types, test, kind="constructor" if own == "constructor" else "method", receiver=name, qualified_name=f"{name}.{own}", exported="public" in words
                    )
                )
                k = stop
                continue
            k = after
        while k < end and r.word(k) not in (";", "}") and not (k > start and r.at(k).line > last_line(r.at(k - 1)) and r.word(k) not in _GOES_ON and r.word(k - 1) not in _GOES_ON - {")", "]", "}"}):
            k = r.after(k)
        k += r.word(k) == ";" or k == start
    return end + 1
