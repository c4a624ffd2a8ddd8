"""Looking functions up: by name, by module, by neighbourhood."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.graph import CodeGraph, NotFound

#: the deterministic order of "the first function of a name"
FIRST = ("file", "start_line", "ordinal", "node_id")


def named(functions: DataFrame, name: str, qualified: bool = False) -> DataFrame:
    """All functions of a name; with ``qualified`` the qualified name serves too."""
    same = F.col("name") == F.lit(name)
    return functions.where(same | (F.col("qualified_name") == F.lit(name)) if qualified else same)


def find_by_name(g: CodeGraph, name: str, qualified: bool = False) -> DataFrame:
    """The first function of the name, as a table of one row or none."""
    return named(g.functions, name, qualified).orderBy(*FIRST).limit(1)


def _known(g: CodeGraph, name: str, qualified: bool) -> DataFrame:
    found = find_by_name(g, name, qualified)
    if found.isEmpty():
        raise NotFound(name)
    return found


def in_neighbours(g: CodeGraph, targets: DataFrame) -> DataFrame:
    """Functions that call the targets, one row per edge.

    The targets are a handful of ids and the edges are clustered by target: the semi join prunes them first."""
    hits = g.calls().join(targets.select(F.col("node_id").alias("dst")).distinct(), "dst", "left_semi").select(F.col("src").alias("node_id"))
    return hits.join(g.functions, "node_id")


def callers(g: CodeGraph, name: str, qualified: bool = False, strict: bool = True) -> DataFrame:
    """Direct callers of the first function of the name."""
    return in_neighbours(g, _known(g, name, qualified) if strict else find_by_name(g, name, qualified))


def contract(g: CodeGraph, name: str, qualified: bool = False, strict: bool = True) -> DataFrame:
    return _known(g, name, qualified) if strict else find_by_name(g, name, qualified)


def breaks(g: CodeGraph, name: str, qualified: bool = False, strict: bool = True) -> DataFrame:
    """Functions that a change of this one may break: its direct callers."""
    return callers(g, name, qualified, strict)


def test_coverage(g: CodeGraph, name: str, qualified: bool = False, strict: bool = True) -> DataFrame:
    return callers(g, name, qualified, strict).where("is_test")


def entry_points(g: CodeGraph) -> DataFrame:
    """Functions that nothing calls, tests included."""
    return g.functions.join(g.calls().select(F.col("dst").alias("node_id")), "node_id", "left_anti")


def untested(g: CodeGraph) -> DataFrame:
    """Functions, tests aside, that no test calls directly."""
    tests = g.functions.where("is_test").select(F.col("node_id").alias("src"))
    covered = g.calls().join(tests, "src", "left_semi").select(F.col("dst").alias("node_id"))
    return g.functions.where(~F.col("is_test")).join(covered, "node_id", "left_anti")


def exports(g: CodeGraph, module: str) -> DataFrame:
    return g.functions.where((F.col("module") == F.lit(module)) & F.col("exported") & ~F.col("is_test"))


def domain(g: CodeGraph, module: str) -> DataFrame:
    return g.functions.where(F.col("module") == F.lit(module))

