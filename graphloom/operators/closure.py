"""Bounded reachability over CALLS edges.

A frontier loop: each round joins the frontier with the edges, keeps distinct new nodes by an anti join
with those seen, and writes them to the shared folder, so a plan never grows with the depth and a lost
executor costs one task. Work is bounded by edges times depth; walks are never enumerated."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom import schema
from graphloom.graph import CodeGraph
from graphloom.operators.lookup import find_by_name, in_neighbours, named
from graphloom.storage import counted, materialize, release

DEFAULT_DEPTH = 3


def reachable(edges: DataFrame, start: DataFrame, depth: int, forward: bool = False, least: int = 1) -> DataFrame:
    """``(node_id, distance)`` of nodes reached in ``least..depth`` links from ``start(node_id)``.

    distance is the smallest number of links. A start node counts only if a path comes back to it."""
    a, b = ("src", "dst") if forward else ("dst", "src")
    links = edges.select(F.col(a).alias("at"), F.col(b).alias("node_id"))
    frontier = start.select(F.col("node_id").alias("at")).distinct()
    rounds: list[DataFrame] = []
    for d in range(1, depth + 1):
        fresh = links.join(frontier, "at", "left_semi").select("node_id").distinct()
        for seen in rounds:
            fresh = fresh.join(seen.select("node_id"), "node_id", "left_anti")
        fresh = materialize(fresh.withColumn("distance", F.lit(d)), "frontier")
        if not counted(fresh):
            release(fresh)
            break
        rounds.append(fresh)
        frontier = fresh.select(F.col("node_id").alias("at"))
    out = start.select("node_id").withColumn("distance", F.lit(0)).where(F.lit(False))
    for fresh in rounds:
        out = out.unionByName(fresh)
    return out.where(F.col("distance") >= least) if least > 1 else out


def impact_nodes(g: CodeGraph, name: str, depth: int = DEFAULT_DEPTH, forward: bool = False, qualified: bool = False) -> DataFrame:
    """Functions with the distance from any function of the name; one row per node."""
    depth = DEFAULT_DEPTH if depth <= 0 else depth
    start = named(g.functions, name, qualified).select("node_id")
    return reachable(g.calls(), start, depth, forward).join(g.functions, "node_id")


def impact(g: CodeGraph, name: str, depth: int = DEFAULT_DEPTH, qualified: bool = False) -> DataFrame:
    """Functions that reach any function of the name in 1..depth calls, one per qualified name.

    An unknown name gives no rows. On a cycle a function is in its own impact."""
    return _one_per_name(impact_nodes(g, name, depth, qualified=qualified))


def callees(g: CodeGraph, name: str, depth: int = DEFAULT_DEPTH, qualified: bool = False) -> DataFrame:
    """Functions that any function of the name reaches in 1..depth calls, one per qualified name."""
    return _one_per_name(impact_nodes(g, name, depth, forward=True, qualified=qualified))


def subgraph(g: CodeGraph, name: str, hops: int = 2, qualified: bool = False, true_callees: bool = True) -> DataFrame:
    """The surroundings of a function as rows with a ``part``: 'center', 'callers', 'callees' (the impact set, as clients
    of the protocol know it) and 'true_callees' (the other direction)."""
    center = find_by_name(g, name, qualified)
    parts = {"center": center, "callers": in_neighbours(g, center), "callees": impact(g, name, hops, qualified)}
    if true_callees:
        parts["true_callees"] = callees(g, name, hops, qualified)
    out = None
    for part, rows in parts.items():
        rows = rows.select(F.lit(part).alias("part"), "node_id", *schema.INFO)
        out = rows if out is None else out.unionByName(rows)
    return out


def _one_per_name(rows: DataFrame) -> DataFrame:
    columns = [c for c in rows.columns if c not in ("distance", "data_shape", "parameters", "returns")]
    first = rows.groupBy("qualified_name").agg(F.min_by(F.struct(*columns), F.struct("distance", "file", "start_line", "ordinal", "node_id")).alias("r"))
    return first.select("r.*")


def walk_ends(edges: DataFrame, start: DataFrame, least: int, most: int, forward: bool = True) -> DataFrame:
    """``(start_id, node_id)``, once each, of the ends of walks of least..most links; a walk may pass an edge again.

    Up to ``least`` links a round keeps the distinct ends of walks of just its length; from there on ends that an
    earlier round gave go no further, as the shorter walk leads everywhere the longer one would. So the work is bounded
    by starts times edges times ``most``, where the number of paths grows with the power of it."""
    a, b = ("src", "dst") if forward else ("dst", "src")
    links = edges.select(F.col(a).alias("at"), F.col(b).alias("to")).distinct()
    here = start.select(F.col("node_id").alias("start_id"), F.col("node_id").alias("at")).distinct()
    ends = [here.select("start_id", F.col("at").alias("node_id"))] if least == 0 else []
    for hop in range(1, most + 1):
        grown = here.join(links, "at").select("start_id", F.col("to").alias("node_id")).distinct()
        if hop > least:
            for seen in ends:
                grown = grown.join(seen, ["start_id", "node_id"], "left_anti")
        fresh = materialize(grown, "walks")
        if not ends:
            release(here)
        if not counted(fresh):
            break
        if hop >= least:
            ends.append(fresh)
        here = fresh.select("start_id", F.col("node_id").alias("at"))
        here._graphloom_path = fresh._graphloom_path
    out = start.select(F.col("node_id").alias("start_id"), "node_id").where(F.lit(False))
    for fresh in ends:
        out = out.unionByName(fresh)
    return out


def trails(edges: DataFrame, start: DataFrame, least: int, most: int, forward: bool = True) -> DataFrame:
    """``(start_id, node_id, hops)`` of every path of least..most links that repeats no edge.

    One row per path, so parallel edges and diamonds count apart; use ``walk_ends`` where the set is asked."""
    a, b = ("src", "dst") if forward else ("dst", "src")
    links = edges.select(F.col(a).alias("at"), F.col(b).alias("to"), F.col("edge_id").alias("e"))
    paths = start.select(F.col("node_id").alias("start_id"), F.col("node_id").alias("at"), F.expr("cast(array() as array<bigint>)").alias("used"))
    out = start.select(F.col("node_id").alias("start_id"), "node_id", F.lit(0).alias("hops"))
    out = out if least == 0 else out.where(F.lit(False))
    for hop in range(1, most + 1):
        grown = paths.join(links, "at").where(~F.array_contains("used", F.col("e")))
        paths = materialize(grown.select("start_id", F.col("to").alias("at"), F.concat("used", F.array("e")).alias("used")), "trails")
        if not counted(paths):
            break
        if hop >= least:
            out = out.unionByName(paths.select("start_id", F.col("at").alias("node_id"), F.lit(hop).alias("hops")))
    return out
