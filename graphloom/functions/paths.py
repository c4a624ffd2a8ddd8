"""Path functions as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.schema import EXTENSIONS


def dirname(path: Column) -> Column:
    """Folder of a path; '.' for one without folder."""
    folder = F.regexp_extract(path, "^(.*)/[^/]*$", 1)
    return F.when(path.contains("/"), F.when(folder == "", "/").otherwise(folder)).otherwise(F.when(path.isNotNull(), "."))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """The last dot and what follows it, '' without a dot."""
    return F.regexp_extract(basename(path), "(\\.[^.]*)$", 1)


def language(path: Column) -> Column:
    """The supported language of a path, else ''."""
    ext, out = extension(path), F.lit("")
    for e, lang in EXTENSIONS.items():
        out = F.when(ext == e, lang).otherwise(out)
    return out


def glob_regex(pattern: str) -> str:
    """A glob over one name (``*``, ``?``, ``[a-z]``, ``[^a]``, backslash) as an anchored regular expression."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[" and "]" in pattern[i + 2 :]:
            end = pattern.index("]", i + 2)
            out.append("[" + pattern[i + 1 : end].replace("\\", "\\\\") + "]")
            i = end
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            out.append(re.escape(pattern[i]))
        else:
            out.append(re.escape(c))
        i += 1
    return "^" + "".join(out) + "$"
