import hashlib
import math
import random
from unittest import mock

import pytest

from graphloom.llm import source_filter
from graphloom.llm.source_filter import RELAXED, _STRING, bands, classify, excluded_folders, layout_kind, licensed, limits, marked, shingles, statistics, vendored_path, without_strings
from pyspark.sql import functions as F

NAMES = [f"{a}{b}" for a in ("order", "user", "cart", "stock", "price", "report", "ticket", "wallet") for b in ("Id", "Name", "Total", "State", "Code")]


def hand(seed, lines=60):
    rng = random.Random(seed)
    shapes = ["if {a} > {n}:", "    return {b}", "{a} = {b}.get({c})", "for {a} in {b}:", "    {c}.append({a})", "try:", "    {a}({b}, {c})", "except {c}Error:", "    log.warning('{a}')", "# {a} before {b}", "", "def {a}_{b}({c}):", "while not {a}:", "assert {a} is {b}, '{c} {a}'"]
    return "\n".join(rng.choice(shapes).format(a=rng.choice(NAMES), b=rng.choice(NAMES), c=rng.choice(NAMES), n=rng.randint(1, 9)) for _ in range(lines)) + "\n"


GETTERS = "export class M {\n" + "".join(f"  get {n}() {{ return this.v[{i}]; }}\n  set {n}(x) {{ this.v[{i}] = x; }}\n" for i, n in enumerate(NAMES)) + "}\n"
MINIFIED = ";".join(f"function a{i}(b,c){{return b.x?c(b.x):b[{i}]}}" for i in range(80))
NUMBERS = "const d = [\n" + "".join(", ".join(f"{(i * 7 + j) % 91 - 40}.{j}5" for j in range(9)) + ",\n" for i in range(40)) + "];\n"
ENCODED = "var k = [\n" + "".join('"' + "QmFzZTY0aXNo" * 6 + '" +\n' for _ in range(20)) + "];\n"


def test_layouts():
    assert layout_kind(GETTERS, "typescript") == "generated"
    assert layout_kind(MINIFIED, "javascript") == "minified" and layout_kind("/*! lib */\n" + MINIFIED, None) == "minified"
    assert layout_kind(NUMBERS, "javascript") == "data" and layout_kind(ENCODED, "go") == "data"
    for seed in range(5):
        assert layout_kind(hand(seed), "python") is None
    assert layout_kind(hand(1) + "# pattern: " + "|".join(NAMES * 8) + "\n", "python") is None
    assert layout_kind(hand(1) + "T = [\n" + "1, 2, 3, 4, 5, 6,\n" * 6 + "]\n", "python") is None
    for text in (None, "", " \n", "from . import model\n", "package util\n"):
        assert layout_kind(text, "python") is None


def test_markers_begin_a_comment():
    assert marked("// Code generated by tool. DO NOT EDIT.\npackage x") and marked("# @generated by x\n") and marked("x\n# Automatisch erzeugt mit y\n") and marked("/* <auto-generated/> */")
    assert not marked('var h = "Code generated by %s. DO NOT EDIT."\n') and not marked("# The auto-generated ids come from here\n") and not marked("# Not generated any more: by hand\n")


def test_evidence():
    assert vendored_path("a/third_party/x.py") and vendored_path("node_modules/q/x.js") and not vendored_path("a/vendor_rates/x.py") and not vendored_path("vendor.py") and not vendored_path(None)
    assert licensed("/*\n * left-pad 1.2.3\n * Copyright (c) 2012 the left-pad authors\n */\nx") and not licensed("// Copyright (c) the project. Internal use.\nx") and not licensed("")


def test_licence_anywhere_above_the_code():
    header = "left-pad 1.2.3\nCopyright (c) 2012 the left-pad authors\n"
    hashed, starred = "".join(f"# {x}\n" for x in header.splitlines()), "/*\n" + "".join(f" * {x}\n" for x in header.splitlines()) + " */\n"
    for above in ("#!/usr/bin/env python\n", "# -*- coding: utf-8 -*-\n", "\n" * 40, "# " + "-" * 3000 + "\n", "# Lines of a banner.\n" * 150, "\ufeff", '"""Docstring\nof two lines."""\n'):
        assert licensed(above + hashed + "x = 1\n"), above
    for above in ("package a.b;\n\n", "package b\n", '"use strict";\n', "<?php\n", "// tool: off\n\n", "/* One\ncomment */\n"):
        assert licensed(above + starred + "x()\n") and licensed(above.replace("\n", "\r\n") + "/*\r\n" + header.replace("\n", "\r\n") + "*/\r\n"), above
    assert licensed('"""\n' + header + '"""\n') and licensed("-- " + header.replace("\n", "\n-- ")) and licensed("%%%%\n% " + header)
    assert not licensed("x = 1\n" + hashed) and not licensed("package b\nimport c\n" + starred) and not licensed("# Works like left-pad 1.2.3\n# Copyright (c) 2012 the right-pad authors\n")
    assert not licensed("# " + "-" * 300_000 + "\n" + "#\n" * 100_000 + "# " + "a.1 " * 100_000)


def test_statistics_in_linear_time():
    long = "x = [" + "1234567890abcdef" * 40_000 + "!\n" + '"' + "a'" * 50_000 + "\n" + "\\x41" * 50_000
    assert statistics(long)["max_line"] > 600_000


def test_long_lines_have_shapes():
    block = "  read{n}(x) {{\n    const v = [{calls}];\n    return v;\n  }}\n"
    long = lambda i: ", ".join(f"x.get{NAMES[(i + j) % 40]}({i * j % 97}, '{NAMES[i * j % 40]}')" for j in range(90))
    text = "export class M {\n" + "".join(block.format(n=NAMES[i], calls=long(i)) for i in range(30)) + "}\n"
    assert min(map(len, text.split("\n")[2::4][:30])) > 2000
    assert statistics(text)["long_200"] < 0.3 and layout_kind(text, "typescript") == "generated"
    assert layout_kind(hand(1) + "T = " + "a + 'b' + " * 300 + "c\n", "python") is None


def test_without_strings():
    rng = random.Random(3)
    for _ in range(3000):
        line = "".join(rng.choice(["'", '"', "\\", "a", " ", '\\"']) for _ in range(rng.randint(0, 14)))
        assert without_strings(line) == _STRING.sub("s", line)
    assert len(without_strings('\\"' * 400_000)) == 800_000


def test_bands_agree_with_similarity():
    a = hand(3, 200)
    b = a.replace("log.warning", "log.error", 2)
    keys = lambda t: set(bands(shingles(t)))
    assert len(keys(a) & keys(b)) > 3 and not keys(a) & keys(hand(4, 200))
    assert len(shingles("one two")) == 1 and bands(shingles("")) == []


def test_table(spark):
    library = hand(11, 120)
    patched = library.replace("log.warning", "log.error", 1)
    rows = [
        (1, "vendor/lib/a.py", library), (2, "src/a.py", library), (3, "src/b.py", patched), (4, "src/own.py", hand(12)), (5, "src/own_copy.py", hand(12)), (6, "src/gen.ts", GETTERS), (7, "src/m.js", MINIFIED), (8, "src/d.js", NUMBERS),
        (9, "src/empty.py", ""), (10, None, None), (11, "deps/lib/x.py", None), (12, "src/lic.py", "# foo-bar 1.2\n# Copyright (c) 2011 the foo-bar authors\n" + hand(13)),
    ]
    data = [(i, p, None if i % 2 else "python", c, None, "z", "y") for i, p, c in rows] + [(4, "src/own.py", "python", hand(12), None, "z", "y"), (None, "x", None, GETTERS, None, None, None)]
    df = spark.createDataFrame(data, "file_id bigint, file string, language string, content string, scanned_at timestamp, kind string, digest string")
    got = {r.file_id: r.kind for r in classify(df).collect()}
    assert got == {1: "vendored", 2: "vendored", 3: "vendored", 4: "hand-written", 5: "hand-written", 6: "generated", 7: "minified", 8: "data", 9: "hand-written", 10: "hand-written", 11: "vendored", 12: "vendored"}
    assert classify(df.limit(0)).count() == 0


def test_middle_version_proves_its_copy(spark):
    """Of many versions only one is similar enough, and its digest is neither the least nor the greatest in any band."""
    rng, lines, middle = random.Random(8), hand(21, 210).split("\n"), 13
    versions = ["\n".join(lines[k * 3 : k * 3 + 120]) for k in range(30)]
    own = versions[middle].split("\n")
    for i in rng.sample(range(120), 6):
        own[i] = f"{rng.choice(NAMES)} = patched{i}(a, b)"
    copy = "\n".join(own)
    sets = [set(shingles(t).tolist()) for t in (*versions, copy)]
    assert [k for k in range(30) if len(sets[k] & sets[30]) / len(sets[k] | sets[30]) >= 0.8] == [middle]
    digests, sizes, keys = [hashlib.md5(v.encode()).hexdigest() for v in versions], [int(math.log(len(s), 1.25)) for s in sets], [set(bands(shingles(v))) for v in versions]
    shared = [[digests[k] for k in range(30) if band in keys[k] and sizes[k] == sizes[middle]] for band in keys[middle] & set(bands(shingles(copy)))]
    assert shared and all(min(group) < digests[middle] < max(group) for group in shared)
    data = [(i, f"vendor/lib{i}/a.py", "python", v, None) for i, v in enumerate(versions)] + [(100, "src/a.py", "python", copy, None), (101, "src/own.py", "python", hand(12), None)]
    df = spark.createDataFrame(data, "file_id bigint, file string, language string, content string, scanned_at timestamp")
    for part in (1000, 3):  # in one part, and in several
        with mock.patch.object(source_filter, "PART", part):
            got = {r.file_id: r.kind for r in classify(df).collect()}
        assert got[100] == "vendored" and got[101] == "hand-written"


def test_excluded_folders(spark):
    df = spark.createDataFrame([(1, 1, ["old"], None), (1, 2, [" ./vendor/ ", "vendor", "", None, "dist"], None), (2, 1, None, None), (3, 1, [], None), (None, 1, ["x"], None)], "repo_id bigint, version int, exclude array<string>, updated_at timestamp")
    assert {(r.repo_id, r.folder) for r in excluded_folders(df).collect()} == {(1, "vendor"), (1, "dist")}


def test_stubs_and_helpers_in_third_party_folders_condemn_no_twins(spark):
    stub = "package util\n"
    helper = "\n".join(f"func Pick{w}(a int) int {{ return a + {i} }}  // {w} of the {w} table" for i, w in enumerate(["One", "Last", "Left", "Odd"]))
    rows = [(1, "vendor/acme/util/doc.go", stub), (2, "src/util/doc.go", stub), (3, "src/deps/helper.go", helper), (4, "src/external/pick.go", helper + "\n// own"), (5, "deps/acme/pick.go", hand(21)), (6, "lib/pick.go", hand(21))]
    df = spark.createDataFrame([(i, f, "go", t, None) for i, f, t in rows], "file_id bigint, file string, language string, content string, scanned_at timestamp")
    got = {r.file_id: r.kind for r in classify(df).collect()}
    assert got == {1: "vendored", 2: "hand-written", 3: "hand-written", 4: "hand-written", 5: "vendored", 6: "vendored"}


@pytest.mark.parametrize(
    "header, third",
    [
        ("/*! lumen-grid v3.6.0 | (c) Lumen Foundation | lumen.example/license */", True),
        ("// slate.js 2.4.1\n// Licensed under the MIT License", True),
        ("# brasskit 0.9.12\n#\n# SPDX-License-Identifier: Apache-2.0", True),
        ("/**\n * @license reedbox v1.2.0\n * All rights reserved.\n */", True),
        ("// Copyright (c) the project. Internal use.", False),
        ("// needs python 3.11 or later", False),
        ("// Licensed under the MIT License", False),
        ("# release 2.0.1 changed the order of the rows", False),
    ],
)
def test_headers_of_other_projects(header, third):
    code = "\nfunction pick(a) {\n  return a + 1; // Copyright (c) nobody, slate.js 2.4.1\n}\n"
    assert licensed(header + code) == third


def test_excluded_folders_lower_the_thresholds(spark):
    lines = [f"set_value({i}, {i * 3})" if i % 5 else f"{'other' + '.x' * i} = call([{i}])" for i in range(60)] + ["z = " + "(" * i + "a" + ")" * i for i in range(1, 9)]
    text = "\n".join(lines)
    share = statistics(text)["period"]
    assert limits("python", RELAXED).period <= share < limits("python").period
    rows = [(1, 7, "gen/a.py"), (2, 7, "src/gen/b.py"), (3, 7, "src/c.py"), (4, 8, "gen/d.py"), (5, 7, "api/v1/e.py"), (6, None, "gen/f.py"), (7, 7, None)]
    df = spark.createDataFrame([(i, r, f, "python", text, None) for i, r, f in rows], "file_id bigint, repo_id bigint, file string, language string, content string, scanned_at timestamp")
    configs = spark.createDataFrame([(7, ["./gen/", " api/v1", "", None], 1), (8, ["other"], 1)], "repo_id bigint, exclude array<string>, version int").withColumn("updated_at", F.lit(None).cast("timestamp"))
    got = {r.file_id: r.kind for r in classify(df, excluded=excluded_folders(configs)).collect()}
    assert got == {1: "generated", 2: "generated", 3: "hand-written", 4: "hand-written", 5: "generated", 6: "hand-written", 7: "hand-written"}
    assert {r.kind for r in classify(df).collect()} == {"hand-written"}
