"""Go: top-level functions and methods."""

from __future__ import annotations

from graphloom.extract.tokens import Reader, Token, arity, last_line, member, param, record, returns, value

#: fixed values: types that are never expressions
PRIMITIVES = frozenset(
    "bool string int int8 int16 int32 int64 uint uint8 uint16 uint32 uint64 uintptr byte rune float32 float64 complex64 complex128 error any interface{}".split() + [""]
)


def _type_end(r: Reader, i: int) -> int:
    """Place behind the type that begins at i (i itself if none does)."""
    w = r.word(i)
    if w in ("*", "..."):
        return _type_end(r, i + 1)
    if w == "(":
        return r.after(i)
    if w == "[":
        return _type_end(r, r.after(i))
    if w == "map":
        return _type_end(r, r.after(i + 1))
    if w == "<-":
        return _type_end(r, i + 1)
    if w == "chan":
        return _type_end(r, i + 2 if r.word(i + 1) == "<-" else i + 1)
    if w in ("struct", "interface"):
        return r.after(i + 1)
    if w == "func":
        return _result_end(r, r.after(i + 1))
    if r.is_name(i):
        i += 1
        while r.word(i) == "." and r.is_name(i + 1):
            i += 2
        return r.after(i) if r.word(i) == "[" and r.at(i).start == r.at(i - 1).end else i
    return i


def _result_end(r: Reader, i: int) -> int:
    return r.after(i) if r.word(i) == "(" else _type_end(r, i)


def _declarations(r: Reader, a: int, b: int) -> list[tuple[str, int, int]]:
    """(first name or '', start and end of the type) of each declaration in a parameter or result list."""
    parts = r.split(a, b)
    named = [r.is_name(x) and y - x > 1 and r.word(x) not in ("map", "chan", "func", "struct", "interface") and _type_end(r, x) < y for x, y in parts]
    if not any(named):
        return [("", x, y) for x, y in parts]
    out, first = [], None
    for (x, y), has_type in zip(parts, named):
        first = r.word(x) if first is None else first
        if has_type:
            out.append((first, x + 1, y))
            first = None
    return out


def nullable(t: str) -> bool:
    return t.startswith("*") or t == "error"


def _typed(t: str, structs: dict[str, list]) -> dict:
    """Type or type expression, nullability, and one hop of expansion."""
    base = t.removeprefix("*")
    out = {"nullable": nullable(t)}
    if base in structs:
        return out | {"type": t, "expanded": structs[base]}
    core = t
    while core.startswith(("*", "[]")):
        core = core.removeprefix("*") if core.startswith("*") else core[2:]
    plain = core in PRIMITIVES or "." in core or core in structs
    return out | ({"type": t} if plain else {"type_expr": t})


def _structs(r: Reader) -> dict[str, list]:
    """Fields of the file's struct types: the first name of each declaration; embedded ones are left out."""
    out: dict[str, list] = {}
    i = 0
    while i < len(r.tokens):
        if r.word(i) == "type" and r.at(i).column == 0:
            specs = [i + 1]
            if r.word(i + 1) == "(":
                specs = [k for k in range(i + 2, r.at(i + 1).mate) if r.is_name(k) and r.at(k - 1).line < r.at(k).line]
            for k in specs:
                body = k + 2
                if r.is_name(k) and r.word(k + 1) == "struct" and r.word(body) == "{":
                    out[r.word(k)] = _fields(r, body + 1, r.at(body).mate)
        i = r.after(i)
    return out


def _fields(r: Reader, a: int, b: int) -> list[dict]:
    out, i = [], a
    while i < b:
        j = i
        while j < b and r.word(j) != ";" and (j == i or last_line(r.at(j - 1)) == r.at(j).line):
            j = r.after(j)
        k = i + 1
        while r.word(k) == "," and r.is_name(k + 1):
            k += 2
        end = min(_type_end(r, k), j)
        if r.is_name(i) and end > k and r.at(k).kind != "string" and r.word(k) != ".":
            t = r.slice(k, end)
            out.append(member(r.word(i), t, nullable(t)))
        i = j + (r.word(j) == ";") if j > i else i + 1
    return out


def functions(path: str, text: str, tokens: list[Token]) -> list[dict]:
    r, out = Reader(text, tokens), []
    structs = _structs(r)
    package, i = "", 0
    while i < len(tokens):
        if r.word(i) == "package" and not package and r.is_name(i + 1):
            package = r.word(i + 1)
        if r.word(i) == "func" and (i == 0 or tokens[i - 1].line < tokens[i].line or r.word(i - 1) == ";"):
            made, i = _function(r, i, path, package, structs)
            out += made
            continue
        i = r.after(i)
    return out


def _function(r: Reader, start: int, path: str, package: str, structs: dict) -> tuple[list[dict], int]:
    i, receiver = start + 1, ""
    if r.word(i) == "(":
        own = _declarations(r, i + 1, r.at(i).mate)
        receiver = r.slice(own[0][1], own[0][2]) if own else ""
        i = r.after(i)
    if not r.is_name(i):
        return [], start + 1
    name = r.word(i)
    i += 1
    if r.word(i) == "[":
        i = r.after(i)
    if r.word(i) != "(":
        return [], i
    params = []
    for label, a, b in _declarations(r, i + 1, r.at(i).mate):
        t = r.slice(a, b)
        params.append(param(label, t, variadic=True) if t.startswith("...") else param(label, **_typed(t, structs)))
    taken, i = arity(r, i), r.after(i)
    end = _result_end(r, i)
    if r.word(i) == "(":
        values = [value(label, **_typed(r.slice(a, b), structs)) for label, a, b in _declarations(r, i + 1, r.at(i).mate)]
    else:
        values = [value(**_typed(r.slice(i, end), structs))] if end > i else []
    i = r.after(end) if r.word(end) == "{" else end
    test = path.endswith("_test.go") and name.startswith(("Test", "Benchmark", "Example"))
    owner = receiver.removeprefix("*")
    made = record(
        path, "go", name, ".".join(x for x in (package, owner, name) if x), r.at(start).line, last_line(r.at(i - 1)), package=package, kind="method" if receiver else "function", receiver=receiver,
        exported="A" <= name[:1] <= "Z", tag="test" if test and not receiver else "application", parameters=params, returns=returns(values, len(values) > 1), **taken,
    )
    return [made], i
