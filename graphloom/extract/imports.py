"""Imports of a file as keys of what they may mean.

A key is ``file:<path without extension>``, ``dir:<folder>`` or ``pkg:<package>``; which of them exists is found by a
join with the functions of the project. Imports of foreign code give keys that match nothing."""

from __future__ import annotations

import posixpath

from graphloom.extract.tokens import Reader, Token


def _text(token: Token) -> str:
    return token.text.strip("\"'`")


def _path_keys(path: str) -> list[str]:
    path = posixpath.normpath(path)
    return [] if path.startswith("..") else [f"file:{path}", f"dir:{path}"]


def _go(r: Reader, path: str) -> list[str]:
    out, i = [], 0
    while i < len(r.tokens):
        if r.word(i) == "import":
            end = r.at(i + 1).mate if r.word(i + 1) == "(" else i + 3
            for t in r.tokens[i + 1 : end]:
                if t.kind == "string":
                    parts = _text(t).split("/")
                    # the module's own prefix is unknown here: every tail of the path may be a folder
                    out += [f"dir:{'/'.join(parts[k:])}" for k in range(len(parts))]
                    if r.word(i + 1) != "(":
                        break
        i = r.after(i)
    return out


def _python(r: Reader, path: str) -> list[str]:
    out, folder = [], posixpath.dirname(path)
    for i, t in enumerate(r.tokens):
        first = i == 0 or r.at(i - 1).line < t.line or r.word(i - 1) == ";"
        if not first or t.text not in ("from", "import"):
            continue
        j, dots = i + 1, 0
        while r.word(j) in (".", "..."):
            dots += len(r.word(j))
            j += 1
        names: list[str] = []
        while True:
            own = []
            while r.is_name(j) and r.word(j) not in ("import", "as"):
                own.append(r.word(j))
                j += 1
                if r.word(j) != ".":
                    break
                j += 1
            names.append("/".join(own))
            if r.word(j) == "as":
                j += 2
            if t.text == "from" or r.word(j) != ",":
                break
            j += 1
        imported: list[str] = []
        if t.text == "from" and r.word(j) == "import":
            k = j + 1 + (r.word(j + 1) == "(")
            while r.is_name(k):
                imported.append(r.word(k))
                k += 3 if r.word(k + 1) == "as" else 1
                if r.word(k) != ",":
                    break
                k += 1
        base = folder
        for _ in range(dots - 1):
            base = posixpath.dirname(base)
        for base in [base] if dots else dict.fromkeys(["", folder]):
            for name in names:
                whole = posixpath.join(base, name) if name else base
                if whole:
                    out += _path_keys(whole)
                for more in imported:
                    out += _path_keys(posixpath.join(whole, more))
    return out


def _java(r: Reader, path: str) -> list[str]:
    out = []
    for i, t in enumerate(r.tokens):
        if t.text == "import" and (i == 0 or r.word(i - 1) in (";", "}")):
            j = i + 1 + (r.word(i + 1) == "static")
            parts = []
            while r.is_name(j) or r.word(j) in (".", "*"):
                if r.word(j) not in (".", "*"):
                    parts.append(r.word(j))
                j += 1
            out += [f"pkg:{'.'.join(parts[:k])}" for k in range(1, len(parts) + 1)]
    return out


def _typescript(r: Reader, path: str) -> list[str]:
    out, folder = [], posixpath.dirname(path)
    for i, t in enumerate(r.tokens):
        before = r.word(i - 1)
        if t.kind != "string" or not (before in ("from", "import") or before == "(" and r.word(i - 2) in ("import", "require")):
            continue
        target = _text(t)
        if target.startswith("."):
            whole = posixpath.join(folder, target)
            for ext in (".ts", ".tsx", ".js"):
                whole = whole.removesuffix(ext)
            out += [*_path_keys(whole), *_path_keys(posixpath.join(whole, "index"))]
    return out


_BY_LANGUAGE = {"go": _go, "python": _python, "java": _java, "typescript": _typescript}


def import_keys(tokens: list[Token], path: str, language: str) -> list[str]:
    """Distinct keys of a file's imports, in order."""
    return list(dict.fromkeys(_BY_LANGUAGE[language](Reader("", tokens), path)))
