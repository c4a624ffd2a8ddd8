"""Java: methods and constructors of top-level classes and interfaces."""

from __future__ import annotations

from graphloom.extract.tokens import Reader, Token, arity, last_line, member, param, record, returns, value

_MODIFIERS = frozenset("public private protected static final abstract synchronized native strictfp default transient volatile sealed non-sealed".split())
_TYPES = frozenset("class interface enum record".split())


def _modifiers(r: Reader, i: int) -> tuple[set[str], set[str], int]:
    """(modifiers, annotations, place behind them)."""
    words, notes = set(), set()
    while True:
        if r.word(i) == "@" and r.word(i + 1) != "interface":
            i += 1
            last = r.word(i)
            i += 1
            while r.word(i) == ".":
                last, i = r.word(i + 1), i + 2
            notes.add(last)
            if r.word(i) == "(":
                i = r.after(i)
        elif r.word(i) in _MODIFIERS:
            words.add(r.word(i))
            i += 1
        else:
            return words, notes, i


def _angles(r: Reader, i: int) -> int:
    """Place behind the type arguments that begin at i."""
    depth = 0
    while i < len(r.tokens):
        w = r.word(i)
        depth += (w == "<") - (w == ">")
        i += 1
        if depth == 0 or w in (";", "{", "}"):
            return i
    return i


def _type_end(r: Reader, i: int) -> int:
    while r.is_name(i):
        i += 1
        if r.word(i) == "<":
            i = _angles(r, i)
        if r.word(i) != ".":
            break
        i += 1
    while r.word(i) == "[" and r.word(i + 1) == "]":
        i += 2
    return i


def functions(path: str, text: str, tokens: list[Token]) -> list[dict]:
    r, out, package, i = Reader(text, tokens), [], "", 0
    while i < len(tokens):
        if r.word(i) == "package":
            end = next((k for k in range(i, len(tokens)) if r.word(k) == ";"), i + 1)
            package, i = "".join(t.text for t in tokens[i + 1 : end]), end + 1
            continue
        if r.word(i) in ("class", "interface") and r.word(i - 1) not in ("@", ".") and r.is_name(i + 1):
            name, kind = r.word(i + 1), r.word(i)
            body = i + 2
            while body < len(tokens) and r.word(body) != "{":
                body += 1
            out += _members(r, path, package, name, kind, body)
            i = r.after(body)
            continue
        if r.word(i) in ("enum", "record", "interface") and r.is_name(i + 1) or r.word(i) == "{":
            while i < len(tokens) and r.word(i) != "{":
                i += 1
        i = r.after(i)
    return out


def _members(r: Reader, path: str, package: str, owner: str, kind: str, body: int) -> list[dict]:
    out, fields, i, end = [], [], body + 1, r.at(body).mate
    found = []
    while i < end:
        start = i
        words, notes, i = _modifiers(r, i)
        if r.word(i) in _TYPES or r.word(i) == "@":
            while i < end and r.word(i) != "{":
                i += 1
            i = r.after(i)
            continue
        if r.word(i) in ("{", ";"):
            i = r.after(i)
            continue
        if r.word(i) == "<":
            i = _angles(r, i)
        if r.is_name(i) and r.word(i + 1) == "(":
            close = r.after(i + 1)
            stop = _body_end(r, close, end)
            if kind == "class" and r.word(i) == owner:
                found.append(("constructor", r.word(i), None, i + 1, words, notes, start, stop))
            i = stop
            continue
        after = _type_end(r, i)
        if after > i and r.is_name(after) and r.word(after + 1) == "(":
            stop = _body_end(r, r.after(after + 1), end)
            found.append(("method", r.word(after), (i, after), after + 1, words, notes, start, stop))
            i = stop
            continue
        if after > i and r.is_name(after):
            t, k = r.slice(i, after), after
            while k < end and r.word(k) != ";":
                if r.is_name(k) and (k == after or r.word(k - 1) == ","):
                    fields.append(member(r.word(k), t))
                k = r.after(k)
            i = k + 1
            continue
        i = max(r.after(i), i + 1)
    types = {owner: fields} if kind == "class" else {}
    for what, name, returned, opening, words, notes, start, stop in found:
        values = _returned(r, returned, types) if returned else []
        test = what == "method" and kind == "class" and bool(notes & {"Test", "ParameterizedTest"})
        out.append(
            record(
                path, "java", name, ".".join(x for x in (package, owner, name) if x), r.at(start).line, last_line(r.at(stop - 1)), package=package, kind=what, receiver=owner,
                exported="public" in words, tag="test" if test else "application", parameters=_params(r, opening, types), returns=returns(values), **arity(r, opening),
            )
        )
    return out


def _body_end(r: Reader, i: int, end: int) -> int:
    """Place behind the body, or behind the semicolon of a bodiless member."""
    while i < end and r.word(i) not in ("{", ";"):
        i = r.after(i)
    return r.after(i) if i < end else end


def _returned(r: Reader, place: tuple[int, int], types: dict) -> list[dict]:
    a, b = place
    t = r.slice(a, b)
    dotted = any(r.word(k) == "." for k in range(a, b) if r.word(k - 1) != "." and k < (next((x for x in range(a, b) if r.word(x) == "<"), b)))
    if t == "void" or dotted:
        return []
    return [value("", t, nullable=t.startswith("Optional<"), expanded=types.get(t))]


def _params(r: Reader, opening: int, types: dict) -> list[dict]:
    out = []
    for a, b in r.split(opening + 1, r.at(opening).mate, angles=True):
        _, notes, i = _modifiers(r, a)
        end = _type_end(r, i)
        t = r.slice(i, end)
        if r.word(end) == "...":
            end += 1
        if r.word(end) == "this":
            continue
        out.append(param(r.word(end) if r.is_name(end) and end < b else "", t, nullable="Nullable" in notes, expanded=types.get(t)))
    return out
