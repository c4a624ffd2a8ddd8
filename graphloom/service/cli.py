"""Command line: init, build, parse, query, pattern, serve, watch."""

from __future__ import annotations

import argparse
import json
import os
import sys

from graphloom import __version__
from graphloom import config as cfg
from graphloom.extract import extract
from graphloom.graph import CodeGraph
from graphloom.plans.build import Options, build, graph_path, summary
from graphloom.schema import EXTENSIONS
from graphloom.service import rpc
from graphloom.service.tools import Tools
from graphloom.session import local_session

_WITH_FUNCTION = ("callers", "contract", "impact", "breaks", "test-coverage")
_WITH_MODULE = ("exports", "domain")
_PLAIN = ("entry-points", "domains", "coupling", "untested", "summary", "mismatches")


def format_functions(items: list[dict]) -> str:
    """Two lines a function."""
    if not items:
        return "No results.\n"
    return "".join(f"  {i['QualifiedName']}\n    {i['File']}:{i['StartLine']}-{i['EndLine']}  [{i['Completeness']}]\n" for i in items)


def format_result(command: str, result: dict) -> str:
    if command == "contract":
        return f"{result['QualifiedName']}\n  {result['File']}:{result['StartLine']}-{result['EndLine']}\n  Contract: {result['Contract']}\n  Completeness: {result['Completeness']}\n"
    if command == "summary":
        return json.dumps(result, indent=2) + "\n"
    items = result["items"]
    if command == "domains":
        return "".join(f"  {i['Module']:<30} {i['Functions']} functions\n" for i in items) or "No results.\n"
    if command == "coupling":
        return "".join(f"  {i['FromModule']} -> {i['ToModule']}  ({i['EdgeCount']} edges)\n" for i in items) or "No results.\n"
    return format_functions(items)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="graphloom", description="Code-graph analytics on Spark")
    p.add_argument("--version", action="version", version=__version__)
    p.add_argument("--root", default=os.getcwd())
    commands = p.add_subparsers(dest="command", required=True)
    commands.add_parser("init")
    b = commands.add_parser("build")
    b.add_argument("scope", nargs="?", default="")
    b.add_argument("--strict-parity", action="store_true")
    b.add_argument("--same-language", action="store_true")
    b.add_argument("--configured-languages", action="store_true")
    b.add_argument("--imports", action="store_true")
    commands.add_parser("parse").add_argument("file")
    q = commands.add_parser("query").add_subparsers(dest="query", required=True)
    for name in _WITH_FUNCTION:
        own = q.add_parser(name)
        own.add_argument("function")
        if name == "impact":
            own.add_argument("--depth", type=int, default=3)
    for name in _WITH_MODULE:
        q.add_parser(name).add_argument("module")
    for name in _PLAIN:
        q.add_parser(name)
    commands.add_parser("pattern").add_argument("text")
    commands.add_parser("serve")
    w = commands.add_parser("watch")
    w.add_argument("--seconds", type=float, default=None)
    return p


def main(argv: list[str] | None = None, spark=None, out=None) -> int:
    out = out or sys.stdout
    a = parser().parse_args(argv)
    if a.command == "init":
        config = cfg.init(a.root)
        out.write(f"Languages: {', '.join(config.languages) or 'none'}\nWrote {cfg.config_path(a.root)}\n")
        return 0
    if a.command == "parse":
        language = EXTENSIONS.get(os.path.splitext(a.file)[1])
        if language is None:
            sys.stderr.write(f"unsupported file: {a.file}\n")
            return 1
        with open(a.file, encoding="utf-8", errors="replace") as f:
            out.write(json.dumps(extract(a.file, language, f.read())[0], indent=2) + "\n")
        return 0
    spark = spark or local_session()
    if a.command == "build":
        _, result = build(spark, Options(a.root, a.scope, strict_parity=a.strict_parity, same_language=a.same_language, configured_languages=a.configured_languages, imports=a.imports))
        out.write(summary(result))
        return 0
    if a.command == "watch":
        from graphloom.streaming.watch import watch

        watch(spark, a.root, seconds=a.seconds)
        return 0
    try:
        graph = CodeGraph.load(spark, graph_path(a.root))
    except Exception as e:
        sys.stderr.write(f"open graph: {str(e).splitlines()[0]} (run build first)\n")
        return 1
    if a.command == "serve":
        rpc.serve(Tools(graph.cached()), sink=out)
        return 0
    if a.command == "pattern":
        from graphloom.pattern import run

        for row in run(graph, a.text).toLocalIterator():
            out.write(json.dumps(row.asDict(True), default=str) + "\n")
        return 0
    if a.query == "mismatches":
        rows = spark.read.parquet(f"{graph_path(a.root)}/mismatches").orderBy("caller_file", "line", "called_name", "caller_qualified")
        for r in rows.toLocalIterator():
            out.write(f"  {r.caller_qualified}\n    {r.caller_file}:{r.line}  {r.called_name} takes {r.least} {'or more' if r.most is None else f'to {r.most}'}, given {r.arg_count}\n")
        return 0
    args = {"limit": 0} | {k: v for k in ("function", "module", "depth") if (v := getattr(a, k, None)) is not None}
    try:
        result = Tools(graph).call({"summary": "graph_summary"}.get(a.query, a.query.replace("-", "_")), args)
    except LookupError as e:
        sys.stderr.write(f"{e}\n")
        return 1
    out.write(format_result(a.query, result))
    if a.query == "domain":
        out.write("".join(f"  {e['From']} -> {e['To']}\n" for e in result["internal_edges"]))
    return 0


if __name__ == "__main__":
    sys.exit(main())
