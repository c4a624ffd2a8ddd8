"""One lexer for the four languages: tokens with places, comments and white space left out."""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

OPEN, CLOSE = {"(": ")", "[": "]", "{": "}"}, {")": "(", "]": "[", "}": "{"}

_COMMON = {
    "blank": r"[ \t\r\n\f\v]+",
    "comment": r"//[^\n]*|/\*.*?(?:\*/|\Z)",
    "number": r"\d(?:[\w.]|(?<=[eE])[+-])*",
    "name": r"(?:[^\W\d]|\$)[\w$]*",
    "mark": r"=>|->|\.\.\.|\?\.|::|:=|<-|\*\*|[-+*/%&|^<>=!~?:;,.@#\\()\[\]{}]",
}
_STRING = r'"(?:[^"\\\n]|\\.)*"?|\'(?:[^\'\\\n]|\\.)*\'?'
_LANGUAGE = {
    "go": {"string": r"`[^`]*`?|" + _STRING},
    "java": {"string": r'"""(?:[^"\\]|\\.|"(?!""))*(?:""")?|' + _STRING},
    "typescript": {"string": _STRING},
    "python": {
        "comment": r"#[^\n]*|\\\r?\n",
        "string": r"[rRbBuUfF]{0,3}(?:\"\"\"(?:[^\"\\]|\\.|\"(?!\"\"))*(?:\"\"\")?|'''(?:[^'\\]|\\.|'(?!''))*(?:''')?|" + _STRING + ")",
    },
}
_ORDER = ("blank", "comment", "string", "number", "name", "mark")
_LEXERS = {
    lang: re.compile("|".join(f"(?P<{k}>{(_COMMON | extra)[k]})" for k in _ORDER), re.S) for lang, extra in _LANGUAGE.items()
}
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_BEFORE_REGEX = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "else"}


@dataclass(slots=True)
class Token:
    kind: str
    text: str
    start: int
    end: int
    line: int
    column: int
    mate: int = -1  # the matching bracket


def _template(text: str, at: int) -> int:
    """End of a template literal, nested substitutions included."""
    i, depth = at + 1, 0
    while i < len(text):
        c = text[i]
        if c == "\\":
            i += 1
        elif c == "`" and depth == 0:
            return i + 1
        elif c == "`":
            i = _template(text, i) - 1
        elif text.startswith("${", i):
            depth += 1
            i += 1
        elif c == "}" and depth:
            depth -= 1
        i += 1
    return len(text)


def tokenize(text: str, language: str) -> list[Token]:
    lexer = _LEXERS[language]
    starts = [0] + [m.end() for m in re.finditer("\n", text)]
    out: list[Token] = []
    stack: list[int] = []
    i = 0
    while i < len(text):
        kind = end = None
        if language == "typescript" and text[i] == "`":
            kind, end = "string", _template(text, i)
        elif language == "typescript" and text[i] == "/" and (not out or out[-1].kind == "mark" and out[-1].text not in (")", "]", "}") or out[-1].text in _BEFORE_REGEX):
            m = _REGEX.match(text, i)
            if m:
                kind, end = "string", m.end()
        if kind is None:
            m = lexer.match(text, i)
            if m is None:
                i += 1
                continue
            kind, end = m.lastgroup, m.end()
        if kind not in ("blank", "comment"):
            line = bisect_right(starts, i)
            token = Token(kind, text[i:end], i, end, line, i - starts[line - 1])
            if kind == "mark" and token.text in OPEN:
                stack.append(len(out))
            elif kind == "mark" and token.text in CLOSE:
                # an unmatched bracket inside closes with the one around it
                at = next((k for k in reversed(stack) if out[k].text == CLOSE[token.text]), None)
                if at is not None:
                    while stack.pop() != at:
                        pass
                    out[at].mate, token.mate = len(out), at
            out.append(token)
        i = end
    for k in stack:
        out[k].mate = len(out) - 1
    return out


def last_line(token: Token) -> int:
    return token.line + token.text.count("\n")


class Reader:
    """Helpers over a token list; places beyond the end read as an empty token."""

    END = Token("end", "", 0, 0, 0, 0)

    def __init__(self, text: str, tokens: list[Token]):
        self.text, self.tokens = text, tokens

    def at(self, i: int) -> Token:
        return self.tokens[i] if 0 <= i < len(self.tokens) else self.END

    def word(self, i: int) -> str:
        return self.at(i).text

    def is_name(self, i: int) -> bool:
        return self.at(i).kind == "name"

    def slice(self, a: int, b: int) -> str:
        """Verbatim text of tokens a to b, b excluded."""
        return self.text[self.at(a).start : self.at(b - 1).end] if b > a else ""

    def after(self, i: int) -> int:
        """Place behind the token, or behind the bracket it opens."""
        t = self.at(i)
        return t.mate + 1 if t.text in OPEN and t.mate > i else i + 1

    def split(self, a: int, b: int, mark: str = ",", angles: bool = False) -> list[tuple[int, int]]:
        """Token ranges between separators at the level of a."""
        out, start, i, depth = [], a, a, 0
        while i < b:
            w = self.word(i)
            if angles and w == "<":
                depth += 1
            elif angles and w == ">" and depth:
                depth -= 1
            if w == mark and not depth:
                out.append((start, i))
                start = i + 1
            i = self.after(i)
        if start < b:
            out.append((start, b))
        return [r for r in out if r[1] > r[0]]


def arity(r: Reader, opening: int, owned: bool = False) -> dict[str, int | None]:
    """How many arguments the parameter list at ``opening`` takes: at least, and at most (None: any number).

    Names of one type count each; ``owned`` leaves out a first ``self`` or ``cls``."""
    least, most, endless = 0, 0, False
    for n, (a, b) in enumerate(r.split(opening + 1, r.at(opening).mate, angles=True)):
        words, k = [], a
        while k < b:
            words.append(r.word(k))
            k = r.after(k)
        if words in (["*"], ["/"]) or words[0] == "this" or owned and n == 0 and words[0] in ("self", "cls"):
            continue
        if words[0] in ("*", "**") or "..." in words:
            endless = True
            continue
        most += 1
        least += "=" not in words and words[1:2] != ["?"]
    return {"least_args": least, "most_args": None if endless else most}


def record(path: str, language: str, name: str, qualified: str, start: int, end: int, **more) -> dict:
    """A function record with the fields every language has."""
    base = {
        "name": name, "qualified_name": qualified, "file": path, "package": "", "language": language, "start_line": start, "end_line": end, "kind": "function", "receiver": "",
        "exported": False, "tag": "application", "parameters": [], "returns": returns([]), "contract_completeness": "full", "least_args": 0, "most_args": 0,
    }
    return base | more


def param(name: str = "", type: str = "", type_expr: str = "", nullable: bool = False, variadic: bool = False, expanded: list | None = None) -> dict:
    return {"name": name, "type": type, "type_expr": type_expr, "nullable": nullable, "variadic": variadic, "expanded": expanded or []}


def value(name: str = "", type: str = "", type_expr: str = "", nullable: bool = False, expanded: list | None = None) -> dict:
    return {"name": name, "type": type, "type_expr": type_expr, "nullable": nullable, "expanded": expanded or []}


def returns(values: list, multiple: bool = False) -> dict:
    return {"multiple": multiple, "values": values}


def member(name: str, type: str, nullable: bool = False) -> dict:
    return {"name": name, "type": type, "nullable": nullable}
