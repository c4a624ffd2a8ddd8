"""Distributed source scan: files below a folder as (path, language, ext, content)."""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.config import TOOL_DIR
from graphloom.functions.paths import basename, extension, glob_regex, language
from graphloom.shipping import ship


def load_gitignore(root: str) -> list[str]:
    """Lines of the root's ignore file: trimmed, without blanks and comments."""
    try:
        with open(os.path.join(root, ".gitignore"), encoding="utf-8") as f:
            return [s for line in f if (s := line.strip()) and not s.startswith("#")]
    except OSError:
        return []


def excluded_dir(path: Column, exclude: list[str], gitignore: list[str]) -> Column:
    """A folder of the relative path is left out: by its name, or as the configured prefix of the path.

    Prefixes are compared as text, so 'build' also leaves out 'builder/'."""
    folders = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    names = [".git", TOOL_DIR, *exclude, *(g.rstrip("/") for g in gitignore)]
    out = F.arrays_overlap(folders, F.array(*[F.lit(n) for n in names]))
    inside = path.contains("/")
    for prefix in exclude:
        if prefix:
            # the prefix rule speaks of folders: a root-level file is never left out by it
            out = out | (inside & path.startswith(prefix))
    return F.coalesce(out, F.lit(False))


def ignored_file(path: Column, gitignore: list[str]) -> Column:
    """The file's base name matches an ignore line as a glob."""
    out = F.lit(False)
    for pattern in gitignore:
        out = out | basename(path).rlike(glob_regex(pattern))
    return out


def filesystem(root: str):
    """(file system, base path) of a folder given as a path or as a URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), os.path.abspath(root))


def _skipped(rel: str, names: frozenset[str], prefixes: tuple[str, ...]) -> bool:
    """The folder rule on the driver's side of the listing, so that left-out trees are never listed."""
    return rel.rsplit("/", 1)[-1] in names or any(p and rel.startswith(p) for p in prefixes)


def _list(store, base: str, rel: str) -> tuple[list[tuple[str, int]], list[str]]:
    """(files with sizes and times, folders) of one folder, relative to the base; an unreadable folder is empty."""
    from pyarrow import fs

    try:
        infos = store.get_file_info(fs.FileSelector(f"{base}/{rel}" if rel else base))
    except OSError:
        return [], []
    join = lambda i: f"{rel}/{i.base_name}" if rel else i.base_name
    return [(join(i), i.size or 0, i.mtime_ns or 0) for i in infos if i.type == fs.FileType.File], [join(i) for i in infos if i.type == fs.FileType.Directory]


#: folders that the driver lists before executors take over; files per task that reads them
FRONTIER, FILES_PER_TASK = 256, 500
#: bytes of file contents that one batch gathers
BATCH_BYTES = 16 << 20


def _folders(store, base: str, rel: str) -> list[str]:
    return _list(store, base, rel)[1]


def list_files(spark: SparkSession, root: str, exclude: list[str] = (), gitignore: list[str] | None = None, scope: str = "") -> DataFrame:
    """``(path, size, modified)`` of all files below the root that no folder rule leaves out, hidden names included.

    Spark's own file sources pass over names that begin with '_' or '.', and with them every
    ``__init__.py``; so the tree is listed here: a bounded frontier of folders on the driver, then one task per
    folder of it, each going down on its own."""
    gitignore = load_gitignore(root) if gitignore is None else gitignore
    names = frozenset([".git", TOOL_DIR, *exclude, *(g.rstrip("/") for g in gitignore)])
    prefixes = tuple(exclude)
    store, base = filesystem(root)
    # the driver learns folders only, a bounded number; the files of every folder are listed by the tasks
    taken, frontier = [], [scope.strip("/")] if scope.strip("/.") else [""]
    while frontier and len(frontier) + len(taken) < FRONTIER:
        start = frontier.pop(0)
        taken.append((start, False))
        frontier += [d for d in _folders(store, base, start) if not _skipped(d, names, prefixes)]

    def descend(batches):
        store, base = filesystem(root)
        for batch in batches:
            for start, deep in zip(batch["folder"], batch["deep"]):
                stack = [start]
                while stack:
                    found, below = _list(store, base, stack.pop())
                    stack += [d for d in below if deep and not _skipped(d, names, prefixes)]
                    for at in range(0, len(found), 10_000):
                        yield pd.DataFrame(found[at : at + 10_000], columns=["path", "size", "modified"])

    ship(spark)
    folders = spark.createDataFrame(taken + [(d, True) for d in frontier], "folder string, deep boolean")
    out = folders.repartition(len(taken) + len(frontier)).mapInPandas(descend, "path string, size bigint, modified bigint")
    return out.where(~ignored_file(F.col("path"), gitignore))


def scan(spark: SparkSession, root: str, exclude: list[str] = (), gitignore: list[str] | None = None, scope: str = "", languages: list[str] | None = None) -> DataFrame:
    """All kept files, also of unsupported languages (language ''), as ``(path, language, ext, size)``;
    paths are relative to the root. ``scope`` restricts the listing to a sub-folder."""
    files = list_files(spark, root, list(exclude), gitignore, scope)
    out = files.select("path", language(F.col("path")).alias("language"), extension(F.col("path")).alias("ext"), "size")
    return out.where(F.col("language").isin(list(languages))) if languages else out


def with_content(files: DataFrame, root: str) -> DataFrame:
    """Adds ``content`` to scanned files; unreadable ones get null. Read by as many tasks as the files ask for."""
    ship(files.sparkSession)
    tasks = max(1, -(-files.count() // FILES_PER_TASK))

    def read(batches):
        store, base = filesystem(root)
        for batch in batches:
            rows, held = [], 0
            for row in batch.itertuples(index=False):
                try:
                    with store.open_input_stream(f"{base}/{row.path}") as f:
                        content = f.read()
                except OSError:
                    content = None
                rows.append((*row, content))
                held += len(content or b"")
                if held >= BATCH_BYTES:  # a task holds about this much beside the file it reads
                    yield pd.DataFrame(rows, columns=[*batch.columns, "content"])
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=[*batch.columns, "content"])

    fields = ", ".join(f"{n} {t}" for n, t in files.dtypes)
    return files.repartition(tasks).mapInPandas(read, f"{fields}, content binary")


def skipped_extensions(files: DataFrame) -> DataFrame:
    """``(ext, n_files)`` of files whose extension isn't supported; files without one aren't counted."""
    return files.where((F.col("language") == "") & (F.col("ext") != "")).groupBy("ext").agg(F.count(F.lit(1)).alias("n_files"))


def found_languages(files: DataFrame) -> list[str]:
    from graphloom.schema import LANGUAGES

    seen = {r.language for r in files.where(F.col("language") != "").select("language").distinct().collect()}  # at most four
    return [x for x in LANGUAGES if x in seen]
