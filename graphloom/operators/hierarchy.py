"""Parent-child links of unknown depth to full hierarchies, by heavy-path decomposition.

1. Cycle separation and subtree sizes, by pointer doubling: after round k every node knows its
   ancestor 2^k links up and how many nodes lie less than 2^k links below it. A round in which no node
   reaches its root proves that all remaining nodes lead into cycles.
2. Heavy paths: every node's child with the largest subtree continues its chain. Any way to the root
   crosses at most log2(n) chains, so chain labels are a compact, exact form of paths (a list of
   (chain, position) segments) and of descendants (an interval of preorder numbers).
3. Chains are ranked by doubling along heavy links and then resolved level by level of the tree of
   chains, whose height is at most log2(n).

No step takes a number of rounds that grows with the depth of the trees, none holds a node's
descendants in one task. Joins from many children to one parent have their unique side on the parent, so
adaptive execution can split a hot parent; siblings are numbered within buckets whose number
grows with the family.

Defined results
    * blanks around names are removed; an empty name is null; a link with a null end only names the
      other end; repeated links count once.
    * a callee with several callers keeps the one seen last (the greatest name among equals).
    * a self link is a cycle of one. Nodes on a cycle are 'cycle', those below one 'below_cycle', both
      with the smallest name on it as root and depth -1; all others are 'tree'.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.hot_keys import ranked, ranked_id
from graphloom.storage import counted, materialize, release

BUCKET = 4096
#: preorder numbers that one row of the descendants' plan stands for
BLOCK = 4096
#: fixed value: the blank characters around names (ASCII, Unicode's space separators, the byte order mark)
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def _clean(c: Column) -> Column:
    return F.nullif(F.btrim(c, F.lit(BLANKS)), F.lit(""))


def _left(rows: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Left join that keeps rows with a null key out of the shuffle, where they would all meet in one task."""
    missing = rows.where(F.col(key).isNull())
    return rows.where(F.col(key).isNotNull()).join(other, key, "left").unionByName(missing, allowMissingColumns=True)


def _named_links(links: DataFrame, parent: str, child: str, seen: str | None) -> tuple[DataFrame, DataFrame]:
    """(id, name) of every node, and (id, parent) of those that have one."""
    pairs = links.select(_clean(F.col(parent)).alias("p"), _clean(F.col(child)).alias("c"), (F.col(seen) if seen else F.lit(None).cast("timestamp")).alias("at"))
    kept = pairs.where(F.col("c").isNotNull()).groupBy("c").agg(F.max_by("p", F.when(F.col("p").isNotNull(), F.struct("at", "p"))).alias("p"))
    kept = materialize(kept.select("c", "p", F.monotonically_increasing_id().alias("id")), "kept")
    # callers that nothing calls follow with negative ids
    tops = pairs.where(F.col("p").isNotNull()).select("p").distinct().join(kept.select(F.col("c").alias("p")), "p", "left_anti")
    names = materialize(kept.select("id", F.col("c").alias("name")).unionByName(tops.select((-1 - F.monotonically_increasing_id()).alias("id"), F.col("p").alias("name"))), "names")
    up = materialize(kept.where(F.col("p").isNotNull()).select("id", "p").join(names.select(F.col("id").alias("parent"), F.col("name").alias("p")), "p").select("id", "parent"), "up")
    release(kept)
    return names, up


def _separate(names: DataFrame, up: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, size) of tree nodes, and (id, jump) of the nodes that lead into cycles.

    A round reads and writes only the nodes whose ancestor 2^k links up exists; what a round adds below a node is kept
    apart and summed at the end. Trees of mean depth d so cost about d rows a node in all, not one a node and round."""
    active = up.select("id", F.col("parent").alias("jump"), F.lit(1).cast("long").alias("size"))
    gains: list[DataFrame] = []
    count, owned = counted(up), None
    while count:
        below = active.groupBy(F.col("jump").alias("id")).agg(F.sum("size").alias("size")).select("id", F.lit(None).cast("long").alias("jump"), "size")
        onward = active.select(F.col("id").alias("jump"), F.col("jump").alias("next"))
        moved = active.join(onward, "jump").select("id", F.col("next").alias("jump"), "size")
        moved = moved.join(below.select("id", F.col("size").alias("more")), "id", "left").select("id", "jump", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"))
        both = materialize(moved.withColumn("kind", F.lit("a")).unionByName(below.withColumn("kind", F.lit("b"))), "sizes", by="kind", count=F.col("kind") == "a")
        gains.append(both.where("kind = 'b'").select("id", "size"))
        active, owned = both.where("kind = 'a'").select("id", "jump", "size"), both
        left = counted(both)
        if left == count:  # no node reached its root: all that remain lead into cycles
            break
        count = left
    sizes = names.select("id", F.lit(1).cast("long").alias("size"))
    for more in gains:
        sizes = sizes.unionByName(more)
    looping = active.select("id", "jump")
    if owned is not None and count:
        sizes = sizes.join(looping, "id", "left_anti")
    return sizes.groupBy("id").agg(F.sum("size").alias("size")), looping if count else looping.where(F.lit(False))


def _cycles(names: DataFrame, up: DataFrame, looping: DataFrame) -> DataFrame | None:
    """(id, state, root name) of all nodes that lead into cycles; None if there are none."""
    if looping.isEmpty():
        return None
    jump = materialize(looping, "jump")
    image = jump.select(F.col("jump").alias("id")).distinct().count()
    while True:  # the image of the jump shrinks until it is just the nodes on cycles
        onward = jump.select(F.col("id").alias("jump"), F.col("jump").alias("next"))
        fresh = materialize(jump.join(onward, "jump").select("id", F.col("next").alias("jump")), "jump")
        release(jump)
        jump, before, image = fresh, image, fresh.select("jump").distinct().count()
        if image == before:
            break
    on = jump.select(F.col("jump").alias("id")).distinct()
    ring = up.join(on, "id", "left_semi").join(names, "id")
    least = materialize(ring.select("id", F.col("parent").alias("ahead"), F.col("name").alias("least")), "least")
    while True:  # the least name among 2^k nodes ahead, until it no longer changes
        onward = least.select(F.col("id").alias("ahead"), F.col("ahead").alias("next"), F.col("least").alias("other"))
        fresh = materialize(
            least.join(onward, "ahead").select("id", F.col("next").alias("ahead"), F.least("least", "other").alias("least"), (F.col("other") < F.col("least")).alias("moved")), "least", count=F.col("moved")
        )
        moved = counted(fresh) > 0
        release(least)
        least = fresh
        if not moved:
            break
    roots = least.select(F.col("id").alias("jump"), F.col("least").alias("root"))
    own = least.select("id", F.lit("cycle").alias("own"), F.col("least").alias("own_root"))
    return (
        jump.join(roots, "jump")
        .join(own, "id", "left")
        .select("id", F.coalesce("own", F.lit("below_cycle")).alias("state"), F.coalesce("own_root", "root").alias("root"))
    )


def _ranked_chains(tree: DataFrame) -> DataFrame:
    """(id, chain, pos): the id of the chain's head and the number of heavy links from it.

    Pointers double along a chain and stop at its head; a round writes only the nodes whose pointer moved."""
    heads = tree.where(F.col("heavy_parent").isNull()).select("id", F.col("id").alias("chain"), F.lit(0).cast("long").alias("pos"), F.lit(True).alias("done"))
    active = tree.where(F.col("heavy_parent").isNotNull()).select("id", F.col("heavy_parent").alias("chain"), F.lit(1).cast("long").alias("pos"))
    settled = heads
    while True:
        targets = settled.unionByName(active.withColumn("done", F.lit(False)))
        onward = targets.select(F.col("id").alias("chain"), F.col("chain").alias("next"), F.col("pos").alias("more"), "done")
        # nodes that are not done point 2^k links up their own chain: no target has two of them
        moved = active.join(onward, "chain").select("id", F.col("next").alias("chain"), (F.col("pos") + F.col("more")).alias("pos"), "done")
        fresh = materialize(moved, "chains", by="done", count=~F.col("done"))
        settled = settled.unionByName(fresh.where("done"))
        active = fresh.where(~F.col("done")).select("id", "chain", "pos")
        if not counted(fresh):
            return settled.select("id", "chain", "pos")


def decompose(links: DataFrame, parent: str, child: str, seen: str | None = None, intervals: bool = True) -> DataFrame:
    """One row per node: ``node, state, root, depth, chain, pos, size, segments`` and, with ``intervals``, ``first, last``.

    chain, pos: the heavy path by the id of its head, and the place on it; segments: the (chain, pos)
    pairs through which the path from the root leaves each chain, the node's own place last; (first, last): preorder
    numbers within the root's tree of the node and of its last descendant."""
    names, up = _named_links(links, parent, child, seen)
    sizes, looping = _separate(names, up)
    cyclic = _cycles(names, up, looping)
    tree = materialize(_family(sizes, up), "tree")
    ranked = _ranked_chains(tree)
    columns = ["id", "parent", "size"]
    nodes = tree.select(*columns).join(ranked, "id")
    if intervals:
        nodes = nodes.join(_offsets(tree, names), "id", "left")
    else:
        nodes = nodes.withColumn("offset", F.lit(0).cast("long"))
    nodes = materialize(nodes, "nodes")
    heads = nodes.where(F.col("id") == F.col("chain")).select("chain", F.col("parent").alias("above"), "offset")
    placed = nodes.select(F.col("id").alias("above"), F.col("chain").alias("up_chain"), F.col("pos").alias("up_pos"))
    heads = materialize(_left(heads, placed, "above").select("chain", "up_chain", "up_pos", "offset"), "heads")
    level = materialize(
        heads.where(F.col("up_chain").isNull()).join(names.select(F.col("id").alias("chain"), F.col("name").alias("root")), "chain").select(
            "chain", "root", F.lit(0).cast("long").alias("base"), F.lit(0).cast("long").alias("start"), F.expr("cast(array() as array<struct<chain:bigint,pos:bigint>>)").alias("above")
        ),
        "level",
    )
    heads = heads.where(F.col("up_chain").isNotNull())
    levels = [level]
    while True:  # the tree of chains, at most log2(n) levels
        onward = level.select(F.col("chain").alias("up_chain"), "root", "base", "start", "above")
        level = materialize(
            heads.join(onward, "up_chain").select(
                "chain", "root",
                (F.col("base") + F.col("up_pos") + 1).alias("base"),
                (F.col("start") + F.col("up_pos") + F.col("offset")).alias("start"),
                F.concat("above", F.array(F.struct(F.col("up_chain").alias("chain"), F.col("up_pos").alias("pos")))).alias("above"),
            ),
            "level",
        )
        if not counted(level):
            release(level)
            break
        levels.append(level)
    chains = levels[0]
    for more in levels[1:]:
        chains = chains.unionByName(more)
    out = nodes.select("id", "chain", "pos", "size").join(chains, "chain").join(names, "id")
    first = F.col("start") + F.col("pos")
    trees = out.select(
        F.col("name").alias("node"), F.lit("tree").alias("state"), "root", (F.col("base") + F.col("pos")).alias("depth"), "chain", "pos", "size",
        *([first.alias("first"), (first + F.col("size") - 1).alias("last")] if intervals else []),
        F.concat("above", F.array(F.struct("chain", "pos"))).alias("segments"),
    )
    if cyclic is None:
        return trees
    loops = cyclic.join(names, "id").select(F.col("name").alias("node"), "state", "root", F.lit(-1).cast("long").alias("depth"))
    return trees.unionByName(loops, allowMissingColumns=True)


def _family(sizes: DataFrame, up: DataFrame) -> DataFrame:
    """(id, parent, size, heavy_parent, heavy_size, n): every tree node with its parent's heaviest child in view.

    The heaviest child is a maximum of one fixed-width value, (size, id), so it combines map-side."""
    family = sizes.join(up, "id", "left")
    best = family.where(F.col("parent").isNotNull()).groupBy("parent").agg(F.max(ranked(F.col("size"), F.col("id"))).alias("best"), F.max("size").alias("heavy_size"), F.count(F.lit(1)).alias("n"))
    best = best.select("parent", ranked_id(F.col("best")).alias("heavy"), "heavy_size", "n")
    return _left(family, best, "parent").select("id", "parent", "size", F.when(F.col("heavy") == F.col("id"), F.col("parent")).alias("heavy_parent"), "heavy_size", "n")


def _offsets(tree: DataFrame, names: DataFrame) -> DataFrame:
    """(id, offset): how many preorder numbers lie between a light child and its parent.

    Light siblings are ordered by bucket and name behind the heavy child; the buckets grow with the family."""
    light = tree.where(F.col("parent").isNotNull() & F.col("heavy_parent").isNull()).join(names, "id")
    light = light.withColumn("bucket", F.pmod(F.xxhash64("name"), F.ceil(F.col("n") / BUCKET)))
    totals = light.groupBy("parent", "bucket").agg(F.sum("size").alias("t"))
    to_here = Window.partitionBy("parent").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("parent", "bucket", F.coalesce(F.sum("t").over(to_here), F.lit(0)).alias("base"))
    within = Window.partitionBy("parent", "bucket").orderBy("name").rowsBetween(Window.unboundedPreceding, -1)
    light = light.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0))).join(totals, ["parent", "bucket"])
    return light.select("id", (F.col("before") + F.col("base") + F.col("heavy_size") + 1).alias("offset"))


def ancestor_pairs(hierarchy: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, node_depth, above, above_depth, root): every node of a tree (of ``nodes``, rows of it) with each node of its
    path, itself included.

    Each segment lists its places on the chain, and a place (chain, pos) holds one node: an equality join with a
    unique side, whose candidates are the result."""
    tree = hierarchy.where(F.col("state") == "tree")
    parts = (tree if nodes is None else nodes).select("node", F.col("depth").alias("node_depth"), F.explode("segments").alias("s")).select("node", "node_depth", F.col("s.chain").alias("chain"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("s.pos"))).alias("pos"))
    members = tree.select("chain", "pos", F.col("node").alias("above"), F.col("depth").alias("above_depth"), "root")
    return parts.join(members, ["chain", "pos"]).select("node", "node_depth", "above", "above_depth", "root")


def full_paths(hierarchy: DataFrame) -> DataFrame:
    """(node, root, depth, path): the names from the root to the node."""
    pairs = ancestor_pairs(hierarchy).groupBy("node", "root", F.col("node_depth").alias("depth")).agg(F.array_sort(F.collect_list(F.struct("above_depth", "above"))).alias("p"))
    return pairs.select("node", "root", "depth", F.col("p.above").alias("path"))


def descendants(hierarchy: DataFrame) -> DataFrame:
    """(node, below, distance): every node with each function below it, from the preorder intervals.

    An interval is dealt out in blocks, which a shuffle spreads, and a preorder number of a tree is one node: an
    equality join with a unique side, whose candidates are the result, however many lie below one node."""
    tree = hierarchy.where(F.col("state") == "tree")
    wide = tree.where(F.col("last") > F.col("first")).select("node", F.col("depth").alias("above"), "root", "last", F.explode(F.sequence(F.col("first") + 1, F.col("last"), F.lit(BLOCK).cast("long"))).alias("from"))
    spread = wide.repartition(F.col("root"), F.col("from"))
    places = spread.select("node", "above", "root", F.explode(F.sequence("from", F.least(F.col("from") + (BLOCK - 1), F.col("last")))).alias("first"))
    members = tree.select("root", "first", F.col("node").alias("below"), "depth")
    return places.join(members, ["root", "first"]).select("node", "below", (F.col("depth") - F.col("above")).alias("distance"))
