"""Modules: counts, coupling, coverage and communities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.graph import CodeGraph
from graphloom.operators.hot_keys import ranked, ranked_id
from graphloom.operators.lookup import untested
from graphloom.storage import counted, materialize, release


def _named_modules(functions: DataFrame) -> DataFrame:
    return functions.where(F.col("module").isNotNull() & (F.col("module") != ""))


def domains(g: CodeGraph) -> DataFrame:
    """``(module, functions)``, blank modules left out."""
    return _named_modules(g.functions).groupBy("module").agg(F.count(F.lit(1)).alias("functions"))


def _module_edges(g: CodeGraph) -> DataFrame:
    """Edges between modules, counted per pair of nodes before the ends are joined."""
    pairs = g.calls().groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    ends = _named_modules(g.functions).select("node_id", "module")
    out = pairs.join(ends.select(F.col("node_id").alias("src"), F.col("module").alias("from_module")), "src")
    return out.join(ends.select(F.col("node_id").alias("dst"), F.col("module").alias("to_module")), "dst")


def coupling(g: CodeGraph) -> DataFrame:
    """``(from_module, to_module, edges)`` between different modules."""
    cross = _module_edges(g).where("from_module <> to_module")
    return cross.groupBy("from_module", "to_module").agg(F.sum("n").alias("edges"))


def domain_edges(g: CodeGraph) -> DataFrame:
    """``(module, functions, internal_edges, cross_edges)``: domains with the edges inside them and across."""
    edges = _module_edges(g)
    inner = edges.where("from_module = to_module").groupBy(F.col("from_module").alias("module")).agg(F.sum("n").alias("internal_edges"))
    ends = edges.where("from_module <> to_module").select(F.explode(F.array("from_module", "to_module")).alias("module"), "n")
    cross = ends.groupBy("module").agg(F.sum("n").alias("cross_edges"))
    out = domains(g).join(inner, "module", "left").join(cross, "module", "left")
    return out.select("module", "functions", F.coalesce("internal_edges", F.lit(0)).alias("internal_edges"), F.coalesce("cross_edges", F.lit(0)).alias("cross_edges"))


def internal_edges(g: CodeGraph, module: str) -> DataFrame:
    """``(caller, callee)`` of calls inside one module."""
    ends = g.functions.where(F.col("module") == F.lit(module)).select("node_id", "qualified_name")
    out = g.calls().join(ends.select(F.col("node_id").alias("src"), F.col("qualified_name").alias("caller")), "src")
    return out.join(ends.select(F.col("node_id").alias("dst"), F.col("qualified_name").alias("callee")), "dst").select("caller", "callee")


def contract_coverage(functions: DataFrame) -> DataFrame:
    return functions.groupBy("contract_completeness").agg(F.count(F.lit(1)).alias("functions"))


def graph_summary(g: CodeGraph) -> DataFrame:
    """One row: modules (list of structs, largest first), total_functions, total_edges, untested_count."""
    per = domains(g).agg(
        F.array_sort(F.collect_list(F.struct((-F.col("functions")).alias("order"), "module", "functions"))).alias("m"), F.coalesce(F.sum("functions"), F.lit(0)).alias("total_functions")
    )
    edges = g.edges.agg(F.count(F.lit(1)).alias("total_edges"))
    bare = untested(g).agg(F.count(F.lit(1)).alias("untested_count"))
    # three tables of one row
    row = per.withColumn("k", F.lit(1)).join(edges.withColumn("k", F.lit(1)), "k").join(bare.withColumn("k", F.lit(1)), "k")
    return row.select(F.transform("m", lambda x: F.struct(x["module"].alias("module"), x["functions"].alias("functions"))).alias("modules"), "total_functions", "total_edges", "untested_count")


def coverage_percent(g: CodeGraph) -> DataFrame:
    """One row: share of the functions, tests aside, that a test calls directly."""
    total = g.functions.where(~F.col("is_test")).agg(F.count(F.lit(1)).alias("n_functions")).withColumn("k", F.lit(1))
    bare = untested(g).agg(F.count(F.lit(1)).alias("n_untested")).withColumn("k", F.lit(1))
    share = F.when(F.col("n_functions") > 0, 100.0 * (F.col("n_functions") - F.col("n_untested")) / F.col("n_functions"))
    return total.join(bare, "k").select("n_functions", "n_untested", share.alias("coverage_pct"))


def communities(g: CodeGraph, rounds: int = 5) -> DataFrame:
    """``(node_id, community, settled)`` by label propagation: each round a node takes the most frequent label among
    its neighbours and itself, the smallest among equals. Deterministic; ends early when nothing moves.

    Labels can swing for ever between neighbours, so ``rounds`` bounds them; settled tells of each node whether
    the last round left its label as it was."""
    both = g.calls().select("src", "dst").where("src <> dst")
    links = materialize(both.union(both.select("dst", "src")).distinct(), "links")
    state = materialize(g.functions.select("node_id", F.col("node_id").alias("community"), F.lit(rounds > 0).alias("moved")), "labels")
    for _ in range(rounds):
        votes = links.join(state.select(F.col("node_id").alias("src"), "community"), "src").select(F.col("dst").alias("node_id"), "community")
        tally = votes.unionByName(state.select("node_id", "community")).groupBy("node_id", "community").agg(F.count(F.lit(1)).alias("n"))
        best = tally.groupBy("node_id").agg(F.max(ranked(F.col("n"), -F.col("community"))).alias("r")).select("node_id", (-ranked_id(F.col("r"))).alias("next"))
        fresh = materialize(state.join(best, "node_id").select("node_id", F.col("next").alias("community"), (F.col("next") != F.col("community")).alias("moved")), "labels", count=F.col("moved"))
        still = not counted(fresh)
        release(state)
        state = fresh
        if still:
            break
    return state.select("node_id", "community", (~F.col("moved")).alias("settled"))


def drift(g: CodeGraph, labels: DataFrame) -> DataFrame:
    """``(module, functions, drifted)``: how many of a module's functions belong by their calls to another module.

    ``labels`` holds (node_id, community); a community's home is the module of most of its functions, the first by name
    among equals."""
    placed = _named_modules(g.functions).select("node_id", "module").join(labels.select("node_id", "community"), "node_id")
    counts = placed.groupBy("community", "module").agg(F.count(F.lit(1)).alias("n"))
    homes = counts.groupBy("community").agg(F.min_by("module", F.struct(-F.col("n"), "module")).alias("home"))
    return counts.join(homes, "community").groupBy("module").agg(F.sum("n").alias("functions"), F.sum(F.when(F.col("module") != F.col("home"), F.col("n")).otherwise(0)).alias("drifted"))


def cohesion(g: CodeGraph) -> DataFrame:
    """``(module, cohesion)``: share of the calls from a module that stay in it."""
    edges = _module_edges(g)
    return edges.groupBy(F.col("from_module").alias("module")).agg((F.sum(F.when(F.col("from_module") == F.col("to_module"), F.col("n")).otherwise(0)) / F.sum("n")).alias("cohesion"))
