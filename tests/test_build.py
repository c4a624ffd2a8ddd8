import io
import json
import os

import fixtures as fx
import pytest
from graphloom import config as cfg
from graphloom.extract.frames import call_site_table, extract_files, function_table, import_table
from graphloom.graph import CodeGraph
from graphloom.plans import build as build_module
from graphloom.plans.build import Options, build, summary
from graphloom.plans.resolve import data_shape, import_edges, mismatched_calls, resolve
from graphloom.service import cli
from graphloom.sources import walk
from graphloom.streaming.watch import Watcher, changed_files, watch
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def project(tmp_path_factory):
    root = tmp_path_factory.mktemp("project+plus space")
    fx.write_project(root)
    return root


@pytest.fixture(scope="module")
def built(spark, project):
    return build(spark, Options(str(project)))


def test_scan(spark, project):
    files = walk.scan(spark, str(project), cfg.DEFAULT_EXCLUDE)
    got = {r.path: (r.language, r.ext) for r in files.select("path", "language", "ext").collect()}
    # 'build' leaves out 'builder/' as well: prefixes are text
    assert set(got) == {"shop/basket.go", "shop/basket_test.go", "app/service.py", "app/test_service.py", "java/Store.java", "web/desk.ts", "web/desk.test.ts", "tools/x.rb", "Makefile", "root.py", ".gitignore"}
    assert got["web/desk.test.ts"] == ("typescript", ".ts") and got["Makefile"] == ("", "")
    assert {(r.ext, r.n_files) for r in walk.skipped_extensions(files).collect()} == {(".rb", 1), (".gitignore", 1)}
    assert walk.found_languages(files) == ["go", "java", "typescript", "python"]
    assert {r.language for r in walk.scan(spark, str(project), cfg.DEFAULT_EXCLUDE, languages=["go"]).collect()} == {"go"}
    assert {r.path for r in walk.scan(spark, str(project), [], scope="shop").select("path").collect()} == {"shop/basket.go", "shop/basket_test.go"}
    read = walk.with_content(files.where("ext = '.rb' or path = 'Makefile'"), str(project)).collect()
    assert {r.path: bytes(r.content) for r in read} == {"tools/x.rb": b"puts 1\n", "Makefile": b"all:\n"}
    gone = spark.createDataFrame([("nowhere.py", 1, 1)], "path string, size bigint, modified bigint")
    assert walk.with_content(gone, str(project)).first().content is None


def test_hidden_names_and_deep_trees(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(walk, "FRONTIER", 2)
    for path in ("a/b/c/d/__init__.py", "a/_x.py", "a/b/.hidden/y.py", "a/node_modules/z/q.py", "e/f/g.py", "e/.git/h.py", "i.py"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text("def f(): pass\n")
    got = {r.path for r in walk.list_files(spark, str(tmp_path), ["node_modules"]).collect()}
    assert got == {"a/b/c/d/__init__.py", "a/_x.py", "a/b/.hidden/y.py", "e/f/g.py", "i.py"}


def test_config(tmp_path):
    fx.write_project(tmp_path)
    assert not cfg.exists(str(tmp_path))
    made = cfg.init(str(tmp_path))
    assert made.languages == ["go", "java", "typescript", "python"] and cfg.exists(str(tmp_path)) and cfg.load(str(tmp_path)) == made
    made.exclude = ["x"]
    cfg.write(str(tmp_path), made)
    assert cfg.init(str(tmp_path)).exclude == ["x"]


def test_build(spark, project, built):
    graph, result = built
    f = {(r.qualified_name, r.file): r for r in graph.functions.collect()}
    assert result.function_count == len(f) == 32 and result.file_count == 8 and result.errors == 0
    assert f["shop/*Basket.Describe", "shop/basket.go"].module == "shop" and f["./top", "root.py"].module == "." and f["app/Request.load", "app/service.py"].package == "app"
    assert json.loads(f["shop/Checkout", "shop/basket.go"].contract)["returns"]["multiple"]
    names = {r.node_id: r.qualified_name for r in graph.functions.collect()}
    edges = {(names[r.src], names[r.dst]) for r in graph.edges.collect()}
    assert {("shop/Checkout", "shop/addUp"), ("shop/TestCheckout", "shop/Checkout"), ("app/handle", "app/open_all"), ("app/test_open", "app/open_all"), ("web/once", "web/plain"), ("web/short", "web/twice")} <= edges
    assert len(edges) == result.edge_count and not any(a == b for a, b in edges)
    assert graph.meta.first().function_count == 32 and graph.node_count() == 33
    shape = graph.edges.join(graph.functions.where("name = 'open_all'").select(F.col("node_id").alias("dst")), "dst").first().data_shape
    assert shape == {"path": "", "mode": "", "#2": "str"}
    assert set(result.coverage) == {"full", "inferred", "partial"} and result.skipped == {".rb": 1, ".gitignore": 1}
    text = summary(result)
    assert "Functions: 32" in text and "Skipped 1 .rb files (Ruby support coming)" in text


def test_rebuild_overwrites(spark, project, built):
    again, result = build(spark, Options(str(project)))
    assert again.functions.count() == 32 == result.function_count and again.edges.count() == result.edge_count
    scoped, few = build(spark, Options(str(project), scope="shop", out=str(project / "out")))
    assert few.function_count == 7 and few.languages == ["go"] and spark.read.parquet(f"{few.graph_path}/errors").count() == 0


def test_resolver_options(spark):
    files = spark.createDataFrame([("a.go", "go", b"package x\nfunc Run() { go_() }\nfunc go_() { Run(); Run() }\n"), ("b.py", "python", b"def Run(a):\n    go_(1)\ndef other():\n    Run(1, 2, 3)\n"), ("c.py", "python", None)], "path string, language string, content binary")
    extracted = extract_files(files).cache()
    f, calls = function_table(extracted), call_site_table(extracted)
    pairs = lambda df: {(r.caller_qualified, r.callee_qualified) for r in df.collect()}
    wide, narrow = resolve(f, calls), resolve(f, calls, same_language=True)
    # both homonyms are './Run', so their edges are one, and a call between them is a self call
    assert pairs(wide) == {("./Run", "./go_"), ("./go_", "./Run"), ("./other", "./Run")} and pairs(narrow) == pairs(wide)
    assert wide.count() == 3
    assert {(r.caller_qualified, r.called_name, r.arg_count) for r in mismatched_calls(f, calls).collect()} == {("./Run", "go_", 1), ("./other", "Run", 3)}
    imports = import_edges(f, spark.createDataFrame([("b.py", "dir:."), ("b.py", "file:nowhere"), ("b.py", "dir:.")], "file string, key string"))
    assert imports.count() == 2 and imports.first().label == "IMPORTS"
    assert f.select(data_shape().alias("d")).where("size(d) > 0").count() == 1


def test_extraction_errors_are_rows(spark):
    files = spark.createDataFrame([("a.go", "go", bytearray(b"\xff\xfe\x00func X() {}")), ("b.go", "go", None), ("c.rb", "", b"x")], "path string, language string, content binary")
    rows = extract_files(files).collect()
    assert {r.file for r in rows} == {"a.go", "b.go"} and all(r.error is None for r in rows)


def run(spark, project, *args):
    out = io.StringIO()
    code = cli.main(["--root", str(project), *args], spark, out)
    return code, out.getvalue()


def test_command_line(spark, project, built, capsys):
    assert run(spark, project, "query", "callers", "addUp")[1].startswith("  shop/")
    assert "[" in run(spark, project, "query", "impact", "addUp", "--depth", "2")[1]
    assert run(spark, project, "query", "exports", "nowhere") == (0, "No results.\n")
    assert "shop" in run(spark, project, "query", "domains")[1] and "functions" in run(spark, project, "query", "domains")[1]
    assert "Contract: {" in run(spark, project, "query", "contract", "Checkout")[1]
    assert run(spark, project, "query", "callers", "missing")[0] == 1 and 'function "missing" not found' in capsys.readouterr().err
    assert " -> " in run(spark, project, "query", "domain", "shop")[1]
    assert '"total_edges"' in run(spark, project, "query", "summary")[1]
    assert json.loads(run(spark, project, "parse", str(project / "shop/basket.go"))[1])[0]["name"] == "Checkout"
    assert run(spark, project, "parse", str(project / "tools/x.rb"))[0] == 1
    assert '"f.name": "addUp"' in run(spark, project, "pattern", "MATCH (f {name: 'addUp'}) RETURN f.name")[1]
    assert run(spark, project, "init")[0] == 0
    assert " takes " in run(spark, project, "query", "mismatches")[1]
    assert run(spark, project / "nothing", "query", "untested")[0] == 1


def test_imports(spark, project):
    graph, _ = build(spark, Options(str(project), imports=True, out=str(project / "with_imports")))
    assert graph.edges.where("label = 'IMPORTS'").count() == 0  # nothing in the project imports the project
    files = [
        ("a/x.go", "go", b'package a\nimport (\n\t"fmt"\n\tq "example.com/m/b/c"\n)\nfunc X() {}\n'), ("b/c/y.go", "go", b"package c\nfunc Y() {}\nfunc z() {}\n"), ("p/m.py", "python", b"from .n import f as g\nimport os, p.k\ndef m(): pass\n"),
        ("p/n.py", "python", b"def f(): pass\n"), ("p/k.py", "python", b"def k(): pass\n"), ("j/A.java", "java", b"package j.a;\nimport static j.b.B.go;\nclass A { void a() {} }\n"), ("j/B.java", "java", b"package j.b;\nclass B { public static void go() {} }\n"),
        ("w/u.ts", "typescript", b"import { v } from '../w/v';\nimport 'react';\nfunction u() {}\n"), ("w/v.ts", "typescript", b"export function v() {}\n"),
    ]
    extracted = extract_files(spark.createDataFrame(files, "path string, language string, content binary")).cache()
    f = function_table(extracted)
    names = {r.node_id: r.name for r in f.collect()}
    assert {(names[r.src], names[r.dst]) for r in import_edges(f, import_table(extracted)).collect()} == {("X", "Y"), ("m", "f"), ("m", "k"), ("a", "go"), ("u", "v")}


def test_watch_sees_new_edited_and_deleted_files(spark, tmp_path):
    fx.write_project(tmp_path)
    results = watch(spark, str(tmp_path), once=True)
    assert len(results) == 1 and results[0].function_count == 32
    assert CodeGraph.load(spark, results[0].graph_path).functions.count() == 32
    w = Watcher(spark, str(tmp_path))  # a restarted watch goes on from the last listing
    assert not w.tick()
    (tmp_path / "app" / "more.py").write_text("def more(): pass\n")
    (tmp_path / "notes.txt").write_text("no source")
    assert w.tick() and w.results[-1].function_count == 33 and not w.tick()
    (tmp_path / "app" / "more.py").write_text("def more(): pass\ndef most(): pass\n")
    assert w.tick() and w.results[-1].function_count == 34
    os.remove(tmp_path / "app" / "more.py")
    assert w.tick() and w.results[-1].function_count == 32 and not w.tick()
    old = spark.createDataFrame([("a", 1, 5), ("b", 1, 5), ("c", 1, 5)], "path string, size bigint, modified bigint")
    new = spark.createDataFrame([("a", 1, 5), ("b", 1, 6), ("d", 1, 5)], old.schema)
    assert {tuple(r) for r in changed_files(old, new).collect()} == {("b", "edited"), ("c", "removed"), ("d", "added")}


def test_watch_runs_on_a_clock(spark, tmp_path):
    (tmp_path / "a.py").write_text("def a(): pass\n")

    def then(result):
        (tmp_path / "b.py").write_text("def b(): pass\n")
        return result.function_count == 2

    results = watch(spark, str(tmp_path), seconds=120, interval="1 second", on_build=then)
    assert [r.function_count for r in results] == [1, 2]


def test_many_skipped_extensions(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(build_module, "SHOWN", 2)
    for i in range(4):
        (tmp_path / f"f.x{i}").write_text("")
    _, result = build(spark, Options(str(tmp_path)))
    assert len(result.skipped) == 2 and result.skipped_extensions == 4 and "of 2 more extensions" in summary(result)
    assert spark.read.parquet(f"{result.graph_path}/skipped").count() == 4
