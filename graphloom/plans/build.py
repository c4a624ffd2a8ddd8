"""Source tree to stored graph: scan, extract, resolve, write."""

from __future__ import annotations

import os
import time
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from graphloom import config as cfg
from graphloom.extract.frames import call_site_table, extract_files, function_table, import_table
from graphloom.graph import CodeGraph, graph_meta
from graphloom.operators.modules import contract_coverage
from graphloom.plans.resolve import edge_table, import_edges, mismatched_calls, resolve
from graphloom.sources import walk
from graphloom.storage import materialize, temporary

#: fixed values: languages by the extensions that aren't supported yet
COMING = {".rb": "Ruby", ".rs": "Rust", ".cs": "C#", ".kt": "Kotlin", ".swift": "Swift"}


#: extensions that the summary names; the graph's ``skipped`` table holds all
SHOWN = 50


@dataclass
class Options:
    root: str
    scope: str = ""
    out: str = ""
    strict_parity: bool = False  # no call sites from Java
    same_language: bool = False  # calls stay in their language
    configured_languages: bool = False  # leave out languages that the configuration doesn't name
    imports: bool = False  # IMPORTS edges beside the calls


@dataclass
class Result:
    function_count: int = 0
    file_count: int = 0
    edge_count: int = 0
    languages: list[str] = field(default_factory=list)
    coverage: dict[str, int] = field(default_factory=dict)
    skipped: dict[str, int] = field(default_factory=dict)
    skipped_extensions: int = 0
    errors: int = 0
    seconds: float = 0.0
    graph_path: str = ""


def graph_path(root: str) -> str:
    return os.path.join(root, cfg.TOOL_DIR, "graph")


def build(spark: SparkSession, options: Options) -> tuple[CodeGraph, Result]:
    """Builds and stores the graph anew.

    Each file is read and parsed once: records and call sites come from one pass and are kept in the shared
    folder for the joins. Files that can't be read or parsed are listed in the ``errors`` table."""
    with temporary():
        return _build(spark, options)


def _build(spark: SparkSession, options: Options) -> tuple[CodeGraph, Result]:
    began = time.time()
    config = cfg.init(options.root)
    files = materialize(walk.scan(spark, options.root, config.exclude, scope=options.scope), "files")
    languages = config.languages if options.configured_languages else None
    taken = files.where(F.col("language").isin(languages)) if languages else files
    extracted = materialize(extract_files(walk.with_content(taken.where("language <> ''"), options.root), options.strict_parity), "extracted")
    functions = materialize(function_table(extracted), "functions")
    calls = call_site_table(extracted)
    edges = edge_table(resolve(functions, calls, options.same_language), functions)
    if options.imports:
        edges = edges.unionByName(import_edges(functions, import_table(extracted)))
    graph = CodeGraph(functions, edges, graph_meta(spark, functions))
    path = options.out or graph_path(options.root)
    graph.save(path)
    extracted.where("error is not null").select("file", "error").write.mode("overwrite").parquet(f"{path}/errors")
    calls.write.mode("overwrite").parquet(f"{path}/call_sites")
    mismatched_calls(functions, calls).write.mode("overwrite").parquet(f"{path}/mismatches")
    stored = CodeGraph.load(spark, path)
    result = Result(graph_path=path)
    result.function_count = stored.functions.count()
    result.edge_count = stored.edges.count()
    result.file_count = extracted.count()
    result.errors = spark.read.parquet(f"{path}/errors").count()
    result.languages = walk.found_languages(files)
    result.coverage = {r.contract_completeness: r.functions for r in contract_coverage(stored.functions).collect()}  # three kinds
    walk.skipped_extensions(files).write.mode("overwrite").parquet(f"{path}/skipped")
    skipped = spark.read.parquet(f"{path}/skipped")  # whole; the summary shows its first page
    result.skipped = {r.ext: r.n_files for r in skipped.orderBy(F.desc("n_files"), "ext").limit(SHOWN).collect()}
    result.skipped_extensions = skipped.count()
    result.seconds = time.time() - began
    return stored, result


def summary(r: Result) -> str:
    lines = [f"Build complete in {r.seconds:.3f}s", f"  Files:     {r.file_count}", f"  Functions: {r.function_count}", f"  Edges:     {r.edge_count}"]
    if r.coverage:
        lines.append("  Contracts: " + ", ".join(f"{n} {k}" for k, n in sorted(r.coverage.items())))
    lines += [f"  Skipped {n} {ext} files ({COMING.get(ext, ext)} support coming)" for ext, n in sorted(r.skipped.items())]
    if r.skipped_extensions > len(r.skipped):
        lines.append(f"  Skipped files of {r.skipped_extensions - len(r.skipped)} more extensions")
    return "\n".join([*lines, f"  Graph:     {r.graph_path}"]) + "\n"
