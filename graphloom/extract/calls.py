"""Call sites of a token stream: line, called name and number of arguments."""

from __future__ import annotations

from graphloom.extract.tokens import Reader, Token

_NOT_CALLED = {
    "go": {"func", "if", "for", "switch", "return", "select", "go", "defer", "range", "case", "type", "map", "chan", "struct", "interface", "var", "const", "import", "else"},
    "python": {"def", "class", "if", "elif", "while", "for", "in", "return", "not", "and", "or", "is", "lambda", "assert", "yield", "await", "del", "with", "except", "raise", "import", "from", "else"},
    "java": {"if", "for", "while", "switch", "catch", "return", "synchronized", "try", "super", "this", "throw", "assert", "else", "do"},
    "typescript": {"if", "for", "while", "switch", "catch", "return", "function", "typeof", "super", "import", "await", "void", "delete", "in", "of", "yield", "throw", "constructor", "else", "do", "async"},
}


def _chain_start(r: Reader, i: int) -> int:
    """First token of the member chain that ends at the name i."""
    while r.word(i - 1) in (".", "?."):
        i -= 2
        while r.at(i).text in (")", "]") and r.at(i).mate >= 0:
            i = r.at(i).mate - 1
            if not (r.is_name(i) or r.at(i).text in (")", "]")):
                return i + 1
    return max(i, 0)


def call_sites(tokens: list[Token], language: str, strict_parity: bool = False) -> list[dict]:
    if language == "java" and strict_parity:
        return []
    r, skip, out = Reader("", tokens), _NOT_CALLED[language], []
    for i, t in enumerate(tokens):
        if t.text != "(" or not r.is_name(i - 1) or r.word(i - 1) in skip:
            continue
        before = r.word(i - 2)
        if before in ("func", "def", "class", "function", "new", "interface", "type") or before == "@" and language == "java":
            continue
        # a method's declaration is a name and a list in front of a body
        after = r.after(i)
        if language in ("java", "typescript") and before not in (".", "?.") and _declares(r, i, after, language):
            continue
        if language == "go" and before == ")" and r.word(r.at(i - 2).mate - 1) == "func":
            continue
        start = _chain_start(r, i - 1)
        if r.word(start - 1) == "new" and not any(x.text == ")" for x in tokens[start : i - 1]):
            continue
        out.append({"line": r.at(start).line, "called_name": r.word(i - 1), "arg_count": len(r.split(i + 1, after - 1))})
    return out


def _declares(r: Reader, i: int, after: int, language: str) -> bool:
    before = r.at(i - 2)
    if language == "java":
        return (before.kind == "name" and before.text not in ("return", "else", "throw", "new", "assert", "case", "yield", "do") or before.text in (">", "]")) and r.word(after) in ("{", "throws", ";") or r.word(after) in ("{", "throws") and before.text in ("{", "}", ";", "public", "private", "protected")
    if r.word(after) == "{":
        return before.text in ("{", "}", ";", "async", "*", "get", "set", "static", "public", "private", "protected", "readonly", "override", "abstract") or before.line < r.at(i - 1).line and before.text not in ("=", "=>", "(", ",", "return")
    if r.word(after) == ":" and before.text in ("{", "}", ";", "async", "*", "static", "public", "private", "protected", "override", "abstract"):
        return True
    return False
