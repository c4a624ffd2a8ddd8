import fnmatch
import posixpath
import re

import pytest
from graphloom.extract.tokens import tokenize
from graphloom.functions import paths
from graphloom.functions.paths import glob_regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F


@given(st.text("ab*?.[]-_", max_size=8), st.text("ab.[]-_", max_size=8))
@settings(max_examples=300, deadline=None)
def test_globs_match_as_file_names_do(pattern, name):
    if "[" in pattern or "]" in pattern:  # classes are tested below
        return
    assert bool(re.match(glob_regex(pattern), name)) == fnmatch.fnmatchcase(name, pattern)


@pytest.mark.parametrize("pattern, name, match", [("*.py", "a.py", True), ("*.py", "a/b.py", False), ("[ab].go", "a.go", True), ("[^ab].go", "a.go", False), ("[^ab].go", "c.go", True), ("a\\*b", "a*b", True), ("a\\*b", "axb", False), ("[", "[", True), ("a+b", "a+b", True)])
def test_glob_details(pattern, name, match):
    assert bool(re.match(glob_regex(pattern), name)) == match


def test_path_columns(spark):
    names = ["a/b/c.go", "c.py", "/x", "/x/y.tsx", ".gitignore", "a.b/c", "d/e.tar.gz", "", None]
    rows = spark.createDataFrame([(n,) for n in names], "p string")
    got = {r.p: r for r in rows.select("p", paths.dirname(F.col("p")).alias("d"), paths.basename(F.col("p")).alias("b"), paths.extension(F.col("p")).alias("e"), paths.language(F.col("p")).alias("l")).collect()}
    for n in names[:-1]:
        assert got[n].d == (posixpath.dirname(n) or ".") and got[n].b == posixpath.basename(n)
    assert [got[n].e for n in names[:-2]] == [".go", ".py", "", ".tsx", ".gitignore", "", ".gz"]
    assert [got[n].l for n in names[:-2]] == ["go", "python", "", "typescript", "", "", ""] and got[None].d is None


@given(st.sampled_from(["go", "python", "java", "typescript"]), st.text("ab1\"'`(){}[]<>/*#\n .,:=$\\é", max_size=60))
@settings(max_examples=300, deadline=None)
def test_tokens_are_places_in_order(language, text):
    last = 0
    tokens = tokenize(text, language)
    for i, t in enumerate(tokens):
        assert last <= t.start < t.end and text[t.start : t.end] == t.text and t.line == text.count("\n", 0, t.start) + 1
        assert t.mate == -1 or 0 <= t.mate < len(tokens)
        last = t.end
