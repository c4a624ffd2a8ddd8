"""Sentence boundaries across languages and scripts, as code-point ranges of each text.

A text is cut into units first: fenced and indented code (one sentence each), list items, quoted lines,
lone links, and paragraphs between blank lines. In a unit every run of terminators, line break and, in
Thai, space is a gap to be classified:

* spaced scripts: the lattice of terminators, with masks for links and inline code, nesting of quotes and
  brackets, abbreviations, initials, ordinals, versions, and the case or opening word of what follows;
* spaceless scripts: a word lattice over the whole run of such letters between two gaps (least-cost path over a
  dictionary: closed-class words, and the words of a public tokenizer's vocabulary by their rank; unknown
  characters at a higher cost) gives the word before and the word behind the gap. At an ellipsis, a word that can't
  be final before it or an opening word behind it goes on; a final particle before it outweighs the opening words that
  only stand behind nouns and, if it is one that closes a sentence for good, those that as well begin another.

Looks to either side of a gap end at the unit's bounds only. Everything is local to a post, so the operator is one Arrow pass next to the scan, without a shuffle.

Defined results: null, empty or blank texts give no sentences; a post with a null id keeps its null;
repeated rows give repeated sentences; an unclosed fence runs to the end of the text.
"""

from __future__ import annotations

import base64
import math
import os
import re
import unicodedata
import warnings
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.shipping import ship

#: the vocabulary whose words of spaceless scripts are the lattice's content words
VOCABULARY = os.environ.get("GRAPHLOOM_VOCABULARY", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
_BREAK = re.compile(r"\r\n|[\n\r\x85  ]")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})([^\n]*)$")
_BULLET = re.compile(r"\s{0,3}(?:[-*+•‣▪]\s+)")
_NUMBERED = re.compile(r"\s{0,3}(\d{1,3})[.)]\s+")
_QUOTED = re.compile(r"\s{0,3}(?:>\s?)+")
_URL = re.compile(r"(?:https?|ftp)://[A-Za-z0-9\-._~:/?#\[\]@!$&'()*+,;=%]+")
_CODE = re.compile(r"(`+)(?!`).*?(?<!`)\1(?!`)", re.S)
_SMILEY = re.compile(r"(?:[:;=8][-^'o]?[)(DPp\]\[]|\^[_.]\^|<3|[☺-☻\U0001f300-\U0001faff][️‍\U0001f3fb-\U0001f3ff]*)(?=\s|$)")
_TERMINATOR = re.compile(r"[.!?…。！？｡．؟।॥۔‼⁇⁈⁉]+")
_STRONG = set("!?。！？｡؟।॥۔‼⁇⁈⁉")
_ALWAYS = set("。！？｡।॥۔")  # end a sentence without white space behind them
_PAIRS = {"“": "”", "„": "“”", "«": "»", "»": "«", "「": "」", "『": "』", "《": "》", "(": ")", "（": "）", "[": "]", "【": "】", "‘": "’", "‚": "‘’"}
_BRACKETS = set("(（[【")
_CLOSING = set("”’»」』》）)】]\"'“")
_JOINING = set(",，、;；:：)）]】—–/")

#: fixed values: abbreviations that never end a sentence, those that count only before a number, and
#: those that end one where a capital follows
NEVER = frozenset(
    "dr dra mr mrs ms mx prof sr sra srta st mme mlle hr fr mgr capt col gen lt sgt rev hon vs cf vgl bzw ca approx env incl esp resp ggf evtl bspw sog "
    "e.g i.e d.h z.b p.ej p.ex u.a o.ä ej ex z d h д-р г-н г-жа проф см напр англ т е डॉ रु श्री सुश्री प्रो د أ م".split()
)
NUMBERED = frozenset("sol ans no nos nr nrs nº núm núms num pág págs pag p pp s fig figs abb abs art arts vol vols vers ver v sec sect ch chap cap eq tab bd bl стр рис гл п ст табл т № न पृ".split())
CAPITAL = frozenset("etc usw inc ltd co corp gmbh bros jr sr. al др пр г гг в вв д п тыс млн млрд руб a.m p.m u.s u.k u.n ph.d m.a b.a jan feb mar apr jun jul aug sep sept oct nov dec".split())
_MONTHS = frozenset("januar jänner februar märz april mai juni juli august september oktober november dezember".split())
_ARTICLES = frozenset("am im zum vom beim der die das dem den des jeder jedes jeden ab bis seit".split())
#: fixed values: words that go on with a sentence behind a closing quote or an ellipsis
GO_ON = frozenset("और पर लेकिन फिर या कि तो ثم و أو لكن ف بعد ثمّ".split())

#: fixed values: the same of cased scripts, for posts without capitals
CONJUNCTIONS = frozenset("and but or then while said says asked und aber oder et mais ou avant puis y e o pero и а но или".split())

#: fixed values: closed-class words of the spaceless scripts
FINAL = frozenset(
    "了 吗 呢 吧 啊 呀 嘛 啦 です ます でした ました ません ませんでした だった ですか ますか だ か ね よ よね ください しょう ない たい ครับ ค่ะ คะ นะ".split()
)
NOT_FINAL = frozenset(
    "以后 之后 以前 之前 时候 时 后 前 里 中 和 与 或 但是 但 因为 如果 就是 比如 例如 那个 这个 而且 所以 然后 对 把 被 在 从 到 の は が を に へ で と も や から まで では には とは のは ので のに けど けれど ば たら なら และ หรือ แต่ ที่ ของ ใน".split()
)
OPENING_ON = frozenset("说 问 道 写 想 喊 答 叫 然后 接着 就 便 后 又 と って という との とか など とは は が を に も の で ๆ ฯลฯ".split())
#: fixed values: those of them that a finished predicate can't have behind it (はい, もう begin another sentence)
NOUN_ON = frozenset("は を に も で".split())
#: fixed values: final particles that close a sentence for good, and opening words that begin another one behind them
CLOSING = frozenset("吗 呢 吧 啊 呀 嘛 啦 です ます でした ました ません ませんでした ですか ますか か ね よ よね ください ครับ ค่ะ คะ นะ".split())
OPENING_NEW = frozenset("然后 接着 就 便 又 それで そして และ หรือ แต่ เพราะ".split())
OPENING_ON |= frozenset("それで そして และ หรือ แต่ เพราะ ที่".split())
#: fixed values: last parts that a noun of place or time may have in common with words that can't be final, and first
#: parts that make no such noun
PLACES, NO_NOUN = frozenset("里 裡 前 后 後 中 时 時 在".split()), frozenset("我你他她它就不也都来來看的")
_CLOSED = FINAL | NOT_FINAL | OPENING_ON | CLOSING | OPENING_NEW


_SPACELESS = re.compile("[\u3005\u3006\u3040-\u30ff\u31f0-\u31ff\u3400-\u9fff\u0e00-\u0e7f\uf900-\ufaff\U00020000-\U000323af]+")


_RUN_BEFORE = re.compile(r"^" + _SPACELESS.pattern)
_THAI_SPACE, _VISIBLE = re.compile(r"(?<=[฀-๿]) +|(?<=\S) +(?=[฀-๿])"), re.compile(r"\S")
_NESTING = re.compile("[" + re.escape("".join(sorted(set(_PAIRS) | _CLOSING))) + "]")
_THAI, _LETTER, _WORD = re.compile("[\u0e00-\u0e7f]"), re.compile(r"[^\W_]"), re.compile(r"\w+")
_MARKED_WORD, _INITIAL = re.compile(r"[^\W\d_]*[ऀ-ॿ؀-ۿ]*"), re.compile(r"[^\W\d_]\.")


def spaceless(ch: str) -> bool:
    """Han, kana and Thai letters (and their marks)."""
    c = ord(ch)
    return 0x3040 <= c <= 0x30FF or 0x3400 <= c <= 0x9FFF or 0x0E00 <= c <= 0x0E7F or 0xF900 <= c <= 0xFAFF or 0x20000 <= c <= 0x323AF or 0x31F0 <= c <= 0x31FF or c in (0x3005, 0x3006)


def thai(ch: str) -> bool:
    return 0x0E00 <= ord(ch) <= 0x0E7F


class Lattice:
    """Word lattices over a dictionary: closed-class words at cost 1, content words at up to 1.3 by their rank, and
    unknown characters at 1.4 each."""

    def __init__(self, content: dict[str, int] | None = None):
        last = math.log(2 + max((content or {"": 0}).values(), default=0))
        self.cost = {w: 1.0 + 0.3 * math.log(2 + rank) / last for w, rank in (content or {}).items()} | dict.fromkeys(_CLOSED, 1.0)
        self.longest = max(map(len, self.cost))

    def words(self, text: str) -> list[str]:
        """The least-cost path through the lattice of a run."""
        n = len(text)
        cost, back = [0.0] + [math.inf] * n, [0] * (n + 1)
        for i in range(n):
            at = cost[i]
            for j in range(i + 1, min(n, i + self.longest) + 1):
                c = self.cost.get(text[i:j], 1.4 if j == i + 1 else math.inf)
                if at + c < cost[j]:
                    cost[j], back[j] = at + c, i
        out, at = [], n
        while at:
            out.append(text[back[at] : at])
            at = back[at]
        return out[::-1]


_lattice: dict[str | None, Lattice] = {None: Lattice()}


def content_words(path: str) -> dict[str, int]:
    """Words of two characters and more, all of a spaceless script, in a vocabulary file, with their ranks."""
    out: dict[str, int] = {}
    with open(path, "rb") as lines:
        for token, rank in map(bytes.split, lines):
            try:
                word = base64.b64decode(token).decode().strip()
            except UnicodeDecodeError:  # part of a character
                continue
            # a vowel sign or tone mark can't begin a word
            if len(word) > 1 and _SPACELESS.fullmatch(word) and not unicodedata.category(word[0]).startswith("M") and not _phrase(word):
                out.setdefault(word, int(rank))
    return out


def _phrase(word: str) -> bool:
    """An entry that ends in a final particle, another particle or a preposition and so is no word of its own."""
    last = _lattice[None].words(word)[-1]
    return last != word and (last in FINAL or last in CLOSING or last in NOT_FINAL and not (last in PLACES and word[0] not in NO_NOUN))


def lattice_of(path: str | None) -> Lattice:
    """The lattice over a vocabulary file's words, made once per Python worker; over closed-class words without a path."""
    if path not in _lattice:
        from pyspark import SparkFiles

        shipped = SparkFiles.get(os.path.basename(path)) if SparkFiles._root_directory or SparkFiles._is_running_on_worker else path
        _lattice[path] = Lattice(content_words(shipped if os.path.exists(shipped) else path))
    return _lattice[path]


class _Unit:
    """One stretch of running text: where its sentences may end."""

    def __init__(self, text: str, start: int, end: int, mark: int, lowered: bool = False, words: Lattice = _lattice[None]):
        self.words, self.known = words, (start, None)
        self.text, self.start, self.end, self.mark = text, start, end, mark
        self.lowered = lowered  # the post has no capitals, so that case tells nothing
        body = text[start:end]
        self.masked = [(start + m.start(), start + m.start() + len(m.group().rstrip(".,!?;:'\")]"))) for m in _URL.finditer(body)] if "://" in body else []
        if "`" in body:
            self.masked += [(start + m.start(), start + m.end()) for m in _CODE.finditer(body)]
        self.smileys = {start + m.start(): start + m.end() for m in _SMILEY.finditer(body) if m.start() == 0 or body[m.start() - 1].isspace()}
        self.masked += list(self.smileys.items())
        self.masked.sort()
        self.from_ = [a for a, _ in self.masked]
        self.spans = self._nesting()
        dense = "" if body.isascii() else "".join(_SPACELESS.findall(body))
        self.dense = bool(dense) and sum(map(str.isalpha, dense)) * 2 > sum(map(str.isalpha, body))

    def is_masked(self, at: int) -> bool:
        i = bisect_right(self.from_, at) - 1
        return any(a <= at < b for a, b in self.masked[max(0, i - 2) : i + 1])

    def _nesting(self) -> list[tuple[int, int]]:
        """Outermost (opening, closing) places of quotes and brackets that are closed within the unit."""
        text, stack, found, straight = self.text, [], [], None
        for m in _NESTING.finditer(text, max(self.start, self.mark), self.end):
            i, c = m.start(), m[0]
            if self.masked and self.is_masked(i):
                continue
            before = text[i - 1] if i > self.start else " "
            behind = text[i + 1] if i + 1 < self.end else " "
            if c == '"':
                if straight is None:
                    straight = i
                else:
                    found.append((straight, i))
                    straight = None
            elif c in "'‘’" and before.isalnum() and behind.isalnum():
                continue
            elif c == "'":
                if not before.isalnum() and not behind.isspace() and not any(text[o] == "'" for o in stack):
                    stack.append(i)
                elif not behind.isalnum() and any(text[o] == "'" for o in stack):
                    self._close(stack, found, "'", i)
            else:
                opener = next((o for o in reversed(stack) if c in _PAIRS.get(text[o], "")), None)
                if opener is not None:
                    del stack[stack.index(opener) :]
                    found.append((opener, i))
                elif c in _PAIRS:
                    stack.append(i)
        found.sort()
        outer: list[tuple[int, int]] = []
        for a, b in found:
            if not outer or a > outer[-1][1]:
                outer.append((a, b))
            elif b > outer[-1][1]:
                outer[-1] = (outer[-1][0], b)
        return outer

    def _close(self, stack: list[int], found: list[tuple[int, int]], mark: str, at: int) -> None:
        opener = next(o for o in reversed(stack) if self.text[o] == mark)
        del stack[stack.index(opener) :]
        found.append((opener, at))

    def around(self, at: int) -> tuple[int, int] | None:
        i = bisect_right(self.spans, (at, self.end + 1)) - 1
        return self.spans[i] if i >= 0 and self.spans[i][0] < at < self.spans[i][1] else None

    def ends(self) -> list[int]:
        """Places behind the last character of each sentence but the last."""
        text, out, began = self.text, [], self.mark
        low = max(self.start, self.mark)
        gaps = [(m.start(), m.end(), "t") for m in _TERMINATOR.finditer(text, low, self.end)]
        gaps += [(m.start(), m.end(), "n") for m in _BREAK.finditer(text, self.start, self.end)]
        gaps += [(b, b, "s") for b in self.smileys.values()]
        if _THAI.search(text, self.start, self.end):
            gaps += [(m.start() + self.start, m.end() + self.start, "w") for m in _THAI_SPACE.finditer(text[self.start : self.end]) if m.start() + self.start >= self.mark]
        classify = {"t": self._terminator, "n": self._line_break, "s": self._smiley, "w": self._thai_space}
        for a, b, kind in sorted(gaps):
            if a < began:
                continue
            end = classify[kind](a, b, began)
            if end is not None and _VISIBLE.search(text, end, self.end):
                out.append(end)
                began = end
        return out

    def _behind(self, at: int) -> int:
        while at < self.end and self.text[at].isspace():
            at += 1
        return at

    def _content(self, began: int, at: int) -> bool:
        return any(c.isalnum() for c in self.text[began:at])

    def _last_letter(self, at: int) -> str | None:
        """The last letter or digit of the unit before a place; places are asked for in order, so each is seen once."""
        since, letter = self.known
        found = next((self.text[i] for i in range(at - 1, since - 1, -1) if self.text[i].isalnum()), letter)
        self.known = (at, found)
        return found

    def _word_before(self, at: int) -> str:
        run = _RUN_BEFORE.search(self.text[self.start : at][::-1])
        return (self.words.words(run[0][::-1]) or [""])[-1] if run else ""

    def _word_behind(self, at: int) -> str:
        run = _SPACELESS.match(self.text, at, self.end)
        return self.words.words(run[0])[0] if run else ""

    def _token_before(self, at: int, began: int) -> str:
        """What stands between white space before a place, white space in front of the place aside."""
        j = at
        while j > began and self.text[j - 1].isspace():
            j -= 1
        i = j
        while i > began and not self.text[i - 1].isspace():
            i -= 1
        return self.text[i:j]

    def _line_break(self, a: int, b: int, began: int) -> int | None:
        before, letter = self._last_letter(a) or "x", _LETTER.search(self.text, b, self.end)
        behind = letter[0] if letter else "x"
        return a if self.dense or spaceless(before) or spaceless(behind) else None

    def _smiley(self, a: int, b: int, began: int) -> int | None:
        n = self._behind(a)
        return a if n < self.end and n > a and self._content(began, a) and not self.text[n].islower() and not self.around(a) else None

    def _thai_space(self, a: int, b: int, began: int) -> int | None:
        text = self.text
        if self.is_masked(a) or self.around(a) or not self._content(began, a) or b in self.smileys or b >= self.end:
            return None
        if text[b] in _CLOSING and text[b] not in _PAIRS and text[b] not in "\"'" or text[b] in _JOINING or _TERMINATOR.match(text, b) or text[a - 1] in _PAIRS:
            return None
        if not thai(text[a - 1]) and not self.dense and not _THAI.search(text, began, a):
            return None
        i = a
        while i > began and text[i - 1] in ".…":
            i -= 1
        if i > began and (a - i > 1 or text[i:a] == "…") and thai(text[i - 1]) and thai(text[b]) and self._leads_on(i, b):
            return None
        return None if thai(text[b]) and self._word_behind(b) in {"ๆ", "ฯลฯ"} else a

    def _terminator(self, a: int, b: int, began: int) -> int | None:
        text = self.text
        if self.is_masked(a):
            return None
        run, pos, inner, span = text[a:b], b, False, self.around(a)
        if span:
            tail = text[b : span[1]]
            if any(not c.isspace() and c not in _CLOSING for c in tail):
                return None
            if text[span[0]] in _BRACKETS and self._content(began, span[0]):
                return None
            pos, inner = span[1] + 1, True
        while pos < self.end and text[pos] in _CLOSING and (text[pos] not in "\"'" or not any(o == pos for o, _ in self.spans)) and not (text[pos] in _PAIRS and any(o == pos for o, _ in self.spans)):
            pos += 1
        smile = self._behind(pos)
        smiled = smile in self.smileys
        while smile in self.smileys:
            pos = self.smileys[smile]
            smile = self._behind(pos)
        n = self._behind(pos)
        if n >= self.end:
            return None
        nxt, gap = text[n], n > pos
        if not self._content(began, a) and set(run) <= set(".…"):
            return None
        if nxt in _JOINING and not (nxt in _PAIRS):
            return None
        if smiled:
            return pos
        dense = spaceless(nxt) or (a > began and spaceless(text[a - 1]))
        if inner:
            return None if self._goes_on(n, gap) else pos
        strong = any(c in _STRONG for c in run)
        if not strong and (len(run) > 1 or run == "…"):
            if dense:
                return None if self._leads_on(a, n) else pos
            apart = a > began and text[a - 1].isspace()  # set off on both sides, it stands within a sentence
            return None if not gap or apart or self._goes_on(n, gap) else pos
        if strong:
            if gap or run[-1] in _ALWAYS or dense:
                return pos
            return pos if nxt.isalpha() and not nxt.islower() and a > began and (text[a - 1].isalpha() or text[a - 1].isdigit() or text[a - 1] in _CLOSING) else None
        if not gap:
            return pos if run == "．" and dense else None
        return None if self._abbreviated(a, began, n) else pos

    def _leads_on(self, a: int, n: int) -> bool:
        """Behind an ellipsis from place a, what stands at n belongs to the same sentence of a spaceless script."""
        before, behind = self._word_before(a), self._word_behind(n)
        if before in NOT_FINAL or not spaceless(self.text[a - 1]) and not thai(self.text[n]):
            return True
        return behind in OPENING_ON and not (before in FINAL and behind in NOUN_ON) and not (before in CLOSING and behind in OPENING_NEW)

    def _goes_on(self, n: int, gap: bool) -> bool:
        """What follows a closing quote or an ellipsis belongs to the same sentence."""
        nxt = self.text[n]
        if nxt in _JOINING or nxt == "-":
            return True
        if nxt.islower():
            return not self.lowered or _WORD.match(self.text, n, self.end)[0] in CONJUNCTIONS
        if spaceless(nxt):
            return not thai(nxt) and self._word_behind(n) in OPENING_ON
        word = _MARKED_WORD.match(self.text, n, self.end)[0]
        return word in GO_ON

    def _abbreviated(self, a: int, began: int, n: int) -> bool:
        text = self.text
        i = a
        while i > began and not text[i - 1].isspace():
            i -= 1
        word = text[i:a].lstrip("([{\"'“„«»‘¿¡-–—>*_")
        nxt, low = text[n], re.split("['’]", word.lower())[-1]  # an elided article may stand before it
        if not word:
            return False
        if len(word) == 1 and word.isalpha() and (word.isupper() or self.lowered or _INITIAL.match(text, n, self.end) or i > began and _INITIAL.fullmatch(self._token_before(i, began))) and low not in CAPITAL:
            return True
        if low in NUMBERED and (nxt.isdigit() or len(low) == 1 and nxt.islower()):
            return True
        if low in CAPITAL or re.fullmatch(r"(?:[^\W\d_]\.)+[^\W\d_]", word) and low not in NEVER:
            return not (nxt.isupper() or nxt in "¿¡\"“«„")
        if low in NEVER:
            return True
        if word.isdigit() and len(word) <= 2:
            following = _WORD.match(text, n, self.end)
            return bool(following) and following[0].lower() in _MONTHS or self._token_before(i, began).lower() in _ARTICLES and nxt.isalpha()
        return False


def _units(text: str) -> Iterator[tuple[str, int, int, int]]:
    """('code' | 'text', start, end, end of the mark) of each unit, in order."""
    lines, at = [], 0
    for m in _BREAK.finditer(text):
        lines.append((at, m.start()))
        at = m.end()
    lines.append((at, len(text)))
    i, open_, last_number = 0, None, None
    while i < len(lines):
        a, b = lines[i]
        line = text[a:b]
        fence = _FENCE.match(line)
        if fence and not ("`" in fence[2] and fence[1][0] == "`"):
            if open_:
                yield ("text", *open_)
            j = i + 1
            while j < len(lines):
                close = _FENCE.match(text[lines[j][0] : lines[j][1]])
                if close and close[1][0] == fence[1][0] and len(close[1]) >= len(fence[1]) and not close[2].strip():
                    break
                j += 1
            j = min(j, len(lines) - 1)
            yield "code", a, lines[j][1], a
            open_, last_number, i = None, None, j + 1
            continue
        if not line.strip():
            if open_:
                yield ("text", *open_)
            open_, last_number = None, None
        elif line.startswith("    "):
            if open_:
                yield ("text", *open_)
            j = i
            while j + 1 < len(lines) and (nxt := text[lines[j + 1][0] : lines[j + 1][1]]).startswith("    ") and nxt.strip():
                j += 1
            yield "code", a, lines[j][1], a
            open_, last_number, i = None, None, j
        else:
            numbered = _NUMBERED.match(line)
            # a number at the start of a wrapped line is a mark only where a list begins or goes on
            if numbered and open_ and int(numbered[1]) != 1 and (last_number is None or int(numbered[1]) <= last_number):
                numbered = None
            mark = _QUOTED.match(line) or _BULLET.match(line) or numbered
            lone = "://" in line and _URL.match(line.strip()) and not re.search(r"\s", line.strip()) and _URL.match(line.strip()).end() == len(line.strip())
            if mark:
                if open_:
                    yield ("text", *open_)
                end = a + mark.end()
                if mark is not numbered:  # marks within marks
                    while inner := _BULLET.match(text[end:b]) or _NUMBERED.match(text[end:b]) or _QUOTED.match(text[end:b]):
                        end += inner.end()
                open_ = (a, b, end)
                last_number = int(numbered[1]) if mark is numbered else None
            elif lone:
                if open_:
                    yield ("text", *open_)
                yield "text", a, b, a
                open_ = None
            else:
                open_ = (open_[0], b, open_[2]) if open_ else (a, b, a)
        i += 1
    if open_:
        yield ("text", *open_)


def _trimmed(text: str, a: int, b: int) -> tuple[int, int] | None:
    while a < b and text[a].isspace():
        a += 1
    while b > a and text[b - 1].isspace():
        b -= 1
    return (a, b) if a < b else None


def segment(text: str | None, words: Lattice = _lattice[None]) -> list[tuple[int, int]]:
    """Ranges of the text's sentences, in order; together they cover all characters but white space."""
    out, text = [], text or ""
    units = list(_units(text))
    prose = "\n".join(text[a:b] for kind, a, b, _ in units if kind == "text")
    if "`" in prose or "://" in prose:
        prose = "\n".join(_URL.sub("", _CODE.sub("", text[a:b])) for kind, a, b, _ in units if kind == "text")
    lowered = prose == prose.lower() != prose.upper()
    for kind, a, b, mark in units:
        cuts = [a, *(_Unit(text, a, b, mark, lowered, words).ends() if kind == "text" else []), b]
        out += [r for x, y in zip(cuts, cuts[1:]) if (r := _trimmed(text, x, y))]
    return out


def _scanner(vocabulary: str | None):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = lattice_of(vocabulary)
        for batch in batches:
            ids, texts = batch.column("id"), batch.column("text")
            index, starts, ends = [], [], []
            for i, text in enumerate(texts.to_pylist()):
                for a, b in segment(text, words):
                    index.append(i)
                    starts.append(a)
                    ends.append(b)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(index, pa.int64())), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], ["id", "start_pos", "end_pos"])

    return scan


def sentences(df: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = VOCABULARY) -> DataFrame:
    """``(doc_id, start_pos, end_pos)``: one row per sentence of every post. ``vocabulary`` is a file of a public tokenizer;
    without one (None, or a warning where it is missing) the dictionary is the closed-class words."""
    ship(df.sparkSession)
    if vocabulary and not os.path.exists(vocabulary):
        warnings.warn(f"no vocabulary at {vocabulary}: the word lattice has closed-class words only", stacklevel=2)
        vocabulary = None
    if vocabulary:
        df.sparkSession.sparkContext.addFile(vocabulary)
    rows = df.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(_scanner(vocabulary), f"id {dict(rows.dtypes)['id']}, start_pos bigint, end_pos bigint").withColumnRenamed("id", doc_id)
