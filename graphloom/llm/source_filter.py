"""Generated, minified, vendored and data files among source files.

Thresholds on layout statistics, set per language: share of long lines (minified), share of characters
in lines of literals and long encoded runs (data), and periodicity of the normalised line shapes
(generated code repeats a short block of lines; hand-written code doesn't). A generator's marker counts
only as the start of a comment line. Third-party copies are known by the folder, by the licence header
naming project, version and authors in the comments above the code, or by five-word shingles at least 0.8 similar to such a file.

One Arrow pass computes all statistics next to the scan. The similarity step joins min-hash bands of
distinct contents (copies are one class, however many there are) within a size class, as only sizes within a
factor of 1.25 can be 0.8 similar, and compares the pairs exactly. First come two representatives per band and
size class, so that a band shared by a third of all files costs a few pairs per class; each content that they don't
prove is then compared with all proven contents of its bands, in parts of bounded size where these are many.

Defined results
    * null, empty or blank content: hand-written, unless its folder is a third-party one.
    * a content of fewer than ``LEAST_SHINGLES`` shingles is no evidence for its twins elsewhere, nor they for it.
    * folders named ``deps`` or ``external`` count only with a project's own folder below them.
    * a file scanned more than once: the latest scan counts (then the greatest content digest).
    * a null path or language: only the content decides, by the default thresholds.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.shipping import ship
from graphloom.storage import materialize

#: fixed values: folders that hold third-party code
VENDOR_FOLDERS = ("vendor", "third_party", "thirdparty", "node_modules", "bower_components", "deps", "external", "site-packages")

#: those of them that hand-written helper modules also lie in: a project's own folder has to follow
LOOSE_FOLDERS = ("deps", "external")

#: fixed values: how generators' comments begin, in several languages
MARKERS = re.compile(
    r"""(?ix) ^ (?: (?:this\ file\ (?:is|was)\ )? (?:code\ )?(?:auto(?:matically)?[\ -]?)?generated\ (?:by|from|with|file|:)
    | this\ file\ (?:is|was)\ (?:produced|created|written)\ automatically
    | <auto-?generated | @generated\b | auto-?generated\ (?:file|code|by|from) | automatically\ generated\s*: | machine-made\ by
    | do\ not\ (?:modify|edit)\ by\ hand | built\ from\ \S+\ by\ .*edit
    | automatisch\ (?:erzeugt|generiert) | fichier\ (?:engendré|généré) | archivo\ generado | generado\ autom )"""
)
NEGATED = re.compile(r"(?i)\b(?:no longer|any ?more|not generated|this file may be)\b")
# a line that begins with the project and its version; each start is tried in linear time, however long a banner is
PROJECT = re.compile(r"(?im)^(?:[^\w\n]*+|[^\w\n]*?(?<![.-])(?=[.-]))(?:@?license\s++)?([a-z][\w./-]*+)\s++v?\d++(?:\.\d++)++(?![\w.])")
RIGHTS_NEXT = re.compile(r"(?i)[^\w(©]*+(?:copyright\b|©|\(c\)\s|licen[sc]ed?\b|spdx-|all rights reserved\b)")
RIGHTS = re.compile(r"(?i)\bcopyright\b|©|\(c\)|\blicen[sc]ed?\b|\bspdx-|\ball rights reserved\b")


@dataclass(frozen=True)
class Limits:
    long_line: int = 200  # characters from which a line is long
    long_share: float = 0.5  # of the code lines
    mean_line: int = 120  # together with little white space: minified
    space_share: float = 0.08
    alnum_share: float = 0.55
    data_share: float = 0.8  # of the code's characters in lines of literals
    encoded_run: int = 200  # characters of one encoded run
    encoded_share: float = 0.6
    period: float = 0.8  # share of lines whose shape comes back at the best period
    period_lines: int = 20


#: tuned on the statistics of each language: README has them. None: no or another language
LIMITS = {
    "java": Limits(long_line=220, mean_line=130, period=0.75),
    "python": Limits(long_line=180, mean_line=110, space_share=0.1, period=0.75),
    "go": Limits(mean_line=100, period=0.78),
    "javascript": Limits(mean_line=120, period=0.75),
    "typescript": Limits(mean_line=120, period=0.8),
}
#: part of the thresholds that suffices in a folder which the configuration excludes
RELAXED = 0.9
#: shingles from which the same or a similar content elsewhere is evidence
LEAST_SHINGLES = 10

_COMMENT = re.compile(r"\s*(?://|\#|/\*|\*|<!--)")
_MARK = re.compile(r"^\s*(?:/\*+|\*+/?|//+|#+)\s?")
_NO_WORD = re.compile(r"\W*")
_OPENING = re.compile(r"""\s*[rRuU]?("{3}|'{3}|/\*|<!--)""")
_CLOSINGS = {"/*": "*/", "<!--": "-->", '"""': '"""', "'''": "'''"}
_PREAMBLE = re.compile(r"""\s*(?:package\s+[\w.]+\s*;?\s*(?://.*)?$|<\?(?:php|xml)\b|<!doctype\b|@charset\b|(["'])use strict\1\s*;?\s*$)""", re.I)
# possessive throughout: a line that isn't all literals fails in one pass, however long it is
_DATA = re.compile(
    r"""[\s\[\]{}(),;+]*+(?:(?:-?+\.?+\d[\w.+-]*+|"(?:[^"\\]|\\.)*+"|'(?:[^'\\]|\\.)*+'|true|false|null|nil|None)[\s\[\]{}(),;:+]*+)++$"""
)
_STRING = re.compile(r'"(?:[^"\\]|\\.)*+"|\'(?:[^\'\\]|\\.)*+\'')
# a string of one of these kinds of quotes; a group holds the closing one, if there is one
_OPENED = {kinds: re.compile("|".join(rf"{q}(?:[^{q}\\]|\\.)*+({q})?" for q in kinds)) for kinds in ("\"'", '"', "'")}
_NAME = re.compile(r"[^\W\d]\w*")
_NUMBER = re.compile(r"\d+")
# runs of any length: each is consumed once, and only long ones count
_ENCODED = re.compile(r"(?:0x[0-9a-fA-F]{2},\s*)+|(?:\\x[0-9a-fA-F]{2})+|[A-Za-z0-9+/=_-]+")
_ENCODED_LEAST = 40
_BREAK = re.compile(r"\r\n|\r|\n")
_WORD = re.compile(r"\w+")

SHINGLE, BANDS, ROWS = 5, 20, 5
#: proven contents of one band and size class that one key of the join holds, about
PART = 1000
_rng = np.random.default_rng(20240229)
_MUL = _rng.integers(1, 2**61, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_ADD = _rng.integers(0, 2**61, BANDS * ROWS, dtype=np.uint64)


def without_strings(line: str) -> str:
    """The line as ``_STRING.sub("s", line)`` gives it, in linear time: behind a quote that isn't closed, no other of its kind is."""
    out, at, kinds = [], 0, "\"'"
    while kinds and (m := _OPENED[kinds].search(line, at)):
        quote, closed = m[0][0], m.lastindex is not None
        out += [line[at : m.start()], "s" if closed else quote]
        at = m.end() if closed else m.start() + 1
        kinds = kinds if closed else kinds.replace(quote, "")
    return "".join(out) + line[at:]


def statistics(text: str) -> dict[str, float]:
    """Layout statistics of one file."""
    lines = [x for x in _BREAK.split(text) if x.strip()]
    code = [x for x in lines if not _COMMENT.match(x)]
    chars = sum(map(len, code)) or 1
    shapes = [_NUMBER.sub("0", _NAME.sub("w", _STRING.sub("s", x) if len(x) < 2000 else without_strings(x))).strip() for x in code]
    period = 0.0
    for p in range(1, 13):
        if len(shapes) >= 3 * p:
            period = max(period, sum(a == b for a, b in zip(shapes, shapes[p:])) / max(1, len(shapes) - p))
    sizes = list(map(len, code))
    longer = lambda n: sum(k > n for k in sizes) / max(1, len(sizes))
    runs = [n for n in map(len, _ENCODED.findall(text)) if n >= _ENCODED_LEAST]
    body = "".join(code)
    return {
        "lines": len(code),
        "max_line": max(sizes, default=0),
        "mean_line": chars / max(1, len(code)),
        "long_180": longer(180),
        "long_200": longer(200),
        "long_220": longer(220),
        "space": (body.count(" ") + body.count("\t")) / chars,
        "alnum": sum(map(len, _WORD.findall(text))) / (len(text) or 1),
        "data": sum(n for x, n in zip(code, sizes) if _NUMBER.search(x) and _DATA.match(x)) / chars,
        "encoded": sum(runs) / (len(text) or 1),
        "run": max(runs, default=0),
        "period": period,
    }


def marked(text: str) -> bool:
    """A comment line that begins as a generator's marker does."""
    for line in _BREAK.split(text):
        m = _COMMENT.match(line)
        if m and MARKERS.match(line[m.end() :].lstrip("/*#!- \t")) and not NEGATED.search(line):
            return True
    return False


def limits(language: str | None, share: float = 1.0) -> Limits:
    lim = LIMITS.get((language or "").lower(), Limits())
    return replace(lim, **{f: getattr(lim, f) * share for f in ("long_share", "data_share", "encoded_share", "period")}) if share != 1 else lim


def layout_kind(text: str, language: str | None) -> str | None:
    """'generated', 'minified', 'data', or None for hand-written layout."""
    return layout_kinds(text, language)[0]


def layout_kinds(text: str, language: str | None) -> tuple[str | None, str | None]:
    """The kind by the thresholds, and the kind in an excluded folder; one computation of the statistics."""
    if not text or not text.strip():
        return None, None
    s, mark = statistics(text), marked(text)
    strict = _kind(s, mark, limits(language))
    return strict, strict or _kind(s, mark, limits(language, RELAXED))


def _kind(s: dict[str, float], mark: bool, lim: Limits) -> str | None:
    if s["lines"] and s["data"] >= lim.data_share and s["lines"] + s["max_line"] > 60:
        return "data"
    if s["run"] >= lim.encoded_run and s["encoded"] >= lim.encoded_share:
        return "data"
    if s["lines"] >= lim.period_lines and s["period"] >= lim.period or mark:
        return "generated"
    long = s[f"long_{lim.long_line}"]
    if long >= lim.long_share or (s["mean_line"] >= lim.mean_line and s["space"] <= lim.space_share and s["alnum"] >= lim.alnum_share and long >= 0.3):
        return "minified"
    return None


def vendored_path(path: str | None) -> bool:
    folders = path.replace("\\", "/").lower().split("/")[:-1] if path else []
    return any(part in VENDOR_FOLDERS and (part not in LOOSE_FOLDERS or i + 1 < len(folders)) for i, part in enumerate(folders))


def leading(lines: list[str]) -> Iterator[str]:
    """The lines before the first one of code; what has to stand above a header is passed over."""
    closing = None
    for line in lines:
        if closing is None:
            opened = _OPENING.match(line)
            if opened:
                closing = _CLOSINGS[opened[1]]
            elif _PREAMBLE.match(line):
                continue
            elif line.strip() and not _COMMENT.match(line):
                return
        yield line
        if closing and closing in (line[opened.end() :] if opened else line):
            closing = None
        opened = None


def licensed(text: str) -> bool:
    """A header above the code that begins a line with a project and its version and speaks of rights in it."""
    lines = _BREAK.split(text.removeprefix("\ufeff"))
    body = "\n".join(lines)
    first = body.rfind("\n", 0, _NO_WORD.match(body).end()) + 1  # with marks of any language
    head = "\n".join(_MARK.sub("", x) for x in leading(lines))
    m = PROJECT.match(body, first)
    if m and RIGHTS_NEXT.match(body, m.end()):
        return True
    return bool(PROJECT.search(head)) and bool(RIGHTS.search(head))


def shingles(text: str) -> np.ndarray:
    """Sorted distinct hashes of the text's five-word shingles (of all words, where there are fewer)."""
    words = np.array([xxhash.xxh3_64_intdigest(w) for w in _WORD.findall(text)], dtype=np.uint64)
    if len(words) == 0:
        return words
    n = max(1, len(words) - SHINGLE + 1)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(min(SHINGLE, len(words))):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[i : i + n]
    return np.unique(out)


def bands(s: np.ndarray) -> list[int]:
    """Min-hash band keys of a set of shingles."""
    if len(s) == 0:
        return []
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(s), 4096):  # bounded memory, however long the text
        block = s[at : at + 4096, None] * _MUL + _ADD
        block ^= block >> np.uint64(29)
        low = np.minimum(low, block.min(axis=0))
    return [xxhash.xxh3_64_intdigest(low[i * ROWS : (i + 1) * ROWS].tobytes(), seed=i) - 2**63 for i in range(BANDS)]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kinds, weak, evidence, keys, sizes = [], [], [], [], []
        for path, language, text in zip(*(batch.column(c).to_pylist() for c in ("path", "language", "content"))):
            text = text or ""
            kind, relaxed = layout_kinds(text, language)
            proof = vendored_path(path) or licensed(text)
            kinds.append(kind)
            weak.append(relaxed)
            evidence.append(proof)
            s = shingles(text) if kind is None or proof else shingles("")
            s = s if len(s) >= LEAST_SHINGLES else s[:0]
            keys.append(bands(s))
            sizes.append(int(math.log(len(s), 1.25)) if len(s) else 0)
        yield pa.RecordBatch.from_arrays(
            [batch.column("file_id"), batch.column("at"), batch.column("digest"), pa.array(kinds, pa.string()), pa.array(weak, pa.string()), pa.array(evidence, pa.bool_()), pa.array(keys, pa.list_(pa.int64())), pa.array(sizes, pa.int32())],
            ["file_id", "at", "digest", "kind", "weak", "evidence", "bands", "size"],
        )


@F.pandas_udf(T.ArrayType(T.LongType()))
def _shingle_column(texts):
    return texts.map(lambda t: shingles(t or "").view(np.int64).tolist())


def _alike(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """``(digest)`` of the contents that are similar enough to a known one they are paired with."""
    pairs = materialize(pairs.select("digest", "known").distinct(), "pairs")
    needed = pairs.select("digest").union(pairs.select(F.col("known").alias("digest"))).distinct()
    texts = texts.join(needed, "digest", "left_semi").groupBy("digest").agg(F.first("content").alias("content"))
    sets = materialize(texts.select("digest", _shingle_column("content").alias("s")), "sets")
    both = pairs.join(sets, "digest").join(sets.select(F.col("digest").alias("known"), F.col("s").alias("t")), "known")
    shared = F.size(F.array_intersect("s", "t"))
    return materialize(both.where(shared >= similarity * (F.size("s") + F.size("t") - shared)).select("digest").distinct(), "alike")


def classify(df: DataFrame, file_id: str = "file_id", path: str = "file", language: str = "language", content: str = "content", scanned: str = "scanned_at", similarity: float = 0.8, excluded: DataFrame | None = None, repo_id: str = "repo_id") -> DataFrame:
    """``(file_id, kind)`` of all files: kind is 'generated', 'minified', 'data', 'vendored' or 'hand-written'.

    ``excluded`` holds (repo_id, folder) as ``excluded_folders`` gives them."""
    ship(df.sparkSession)
    rows = df.where(F.col(file_id).isNotNull()).select(
        F.col(file_id).alias("file_id"), F.col(scanned).alias("at"), F.md5(F.coalesce(content, F.lit(""))).alias("digest"), F.col(path).alias("path"), F.col(language).alias("language"), F.col(content).alias("content")
    )
    types = dict(rows.dtypes)
    seen = rows.mapInArrow(_scan, f"file_id {types['file_id']}, at {types['at']}, digest string, kind string, weak string, evidence boolean, bands array<bigint>, size int")
    latest = seen.groupBy("file_id").agg(F.max_by(F.struct("digest", "kind", "weak", "evidence", "bands", "size"), F.struct("at", "digest", "evidence")).alias("r"))
    files = materialize(latest.select("file_id", "r.*"), "files")
    # distinct contents; every copy of one has the same bands
    classes = files.where(F.size("bands") > 0).groupBy("digest").agg(F.max("evidence").alias("evidence"), F.first("bands").alias("bands"), F.first("size").alias("size"))
    classes = materialize(classes, "classes")
    keyed = classes.select("digest", "evidence", "size", F.explode("bands").alias("band"))
    known = keyed.where("evidence").select("band", "size", F.col("digest").alias("known"))
    near = keyed.where(~F.col("evidence")).select("digest", "band", F.explode(F.sequence(F.col("size") - 1, F.col("size") + 1)).alias("size"))
    groups = known.groupBy("band", "size").agg(F.min("known").alias("a"), F.max("known").alias("b"), F.count(F.lit(1)).alias("n"))
    first = groups.select("band", "size", F.explode(F.array_distinct(F.array("a", "b"))).alias("known"))
    texts = rows.select("digest", "content")
    alike = _alike(near.join(first, ["band", "size"]), texts, similarity)
    # what no representative proved meets all others of its bands
    more = groups.where("n > 2").select("band", "size", F.ceil(F.col("n") / PART).cast("int").alias("parts"))
    rest = near.join(alike, "digest", "left_anti").join(more, ["band", "size"]).select("digest", "band", "size", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    others = known.join(more, ["band", "size"]).select("known", "band", "size", F.pmod(F.hash("known"), "parts").alias("part"))
    alike = alike.union(_alike(rest.join(others, ["band", "size", "part"]), texts, similarity))
    proven = classes.where("evidence").select("digest").union(alike).withColumn("copied", F.lit(True))
    out = files.join(proven, "digest", "left")
    layout = F.col("kind")
    if excluded is not None:
        out = out.join(_in_excluded(df, file_id, path, repo_id, excluded), "file_id", "left")
        layout = F.when(F.col("excluded"), F.col("weak")).otherwise(F.col("kind"))
    kind = F.when(F.col("evidence") | F.coalesce("copied", F.lit(False)), "vendored").otherwise(F.coalesce(layout, F.lit("hand-written")))
    return out.select(F.col("file_id").alias(file_id), kind.alias("kind"))


def _in_excluded(df: DataFrame, file_id: str, path: str, repo_id: str, excluded: DataFrame) -> DataFrame:
    """(file_id, excluded) of the files below an excluded folder of their repository; contents take no part.

    A file lists the folders it lies in, by name and as paths from the root, and meets the entries by equality."""
    parts = F.transform(F.split(F.regexp_replace(path, "\\\\", "/"), "/"), lambda p: F.trim(p))
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    roots = F.transform(F.sequence(F.lit(1), F.greatest(F.size(folders), F.lit(1))), lambda n: F.array_join(F.slice(folders, F.lit(1), n), "/"))
    rows = df.where(F.col(file_id).isNotNull() & F.col(path).isNotNull() & F.col(repo_id).isNotNull())
    below = rows.select(F.col(file_id).alias("file_id"), F.col(repo_id).alias("repo_id"), F.explode(F.array_distinct(F.concat(folders, roots))).alias("folder")).where(F.col("folder") != "")
    entries = excluded.select("repo_id", "folder").distinct()
    return below.join(entries, ["repo_id", "folder"], "left_semi").select("file_id").distinct().withColumn("excluded", F.lit(True))


def not_hand_written(df: DataFrame, **columns) -> DataFrame:
    kinds = classify(df, **columns)
    return kinds.where(F.col("kind") != "hand-written")


def excluded_folders(configs: DataFrame) -> DataFrame:
    """``(repo_id, folder)`` that each repository's latest config names: trimmed, without './' and closing
    slashes, once each; blank entries name nothing."""
    entry = F.regexp_replace(F.trim("e"), "^(?:\\./)+|/+$", "")
    latest = configs.where(F.col("repo_id").isNotNull()).groupBy("repo_id").agg(F.max_by("exclude", F.struct("version", "updated_at")).alias("exclude"))
    return latest.select("repo_id", F.explode("exclude").alias("e")).select("repo_id", entry.alias("folder")).where(F.col("folder") != "").distinct()
