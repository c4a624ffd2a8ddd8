"""Syntax tree of a pattern query to a DataFrame plan over a graph's tables.

Each path is a chain of equality joins. A path of lo..hi links gives a row for each of its trails (no edge twice);
under RETURN DISTINCT without aggregates only the set of its ends counts, which walks give in bounded work (for lo > 1
a walk may pass an edge again). A path that only its last node narrows is read from there. Labels,
inline properties and WHERE terms of one node filter its scan before it joins, and only columns that the query
names are read. Values are bound as literals, never spliced into text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.graph import CodeGraph
from graphloom.operators.closure import trails, walk_ends
from graphloom.pattern.parser import Link, Match, Node, Param, PatternError, Query, parse


class _Plan:
    def __init__(self, g: CodeGraph, query: Query, params: dict[str, object]):
        self.g, self.query, self.params = g, query, params
        self.bound: dict[str, str] = {}  # name -> 'node' or 'edge'
        self.labels: dict[str, str | None] = {}
        for m in query.matches:
            for n in m.nodes:
                self.labels[n.name] = self.labels.get(n.name) or n.label
        self.wanted: dict[str, set[str] | None] = {}
        self._collect()

    # ------------------------------------------------------------ columns

    def _want(self, name: str, prop: str | None) -> None:
        if prop is None:
            self.wanted[name] = None
        elif self.wanted.get(name, set()) is not None:
            self.wanted.setdefault(name, set()).add(prop)

    def _collect(self) -> None:
        for r in self.query.returns:
            if r.name != "*" and not (r.function and r.prop is None):
                self._want(r.name, r.prop)
        for name, prop, _ in self.query.order:
            if prop:
                self._want(name, prop)
        for m in self.query.matches:
            for name, prop in _props(m.where):
                self._want(name, prop)

    def _source(self, label: str | None) -> DataFrame:
        if label is not None and label == "GraphMeta":
            if self.g.meta is None:
                raise PatternError("the graph has no record of itself")
            return self.g.meta.withColumn("node_id", F.lit(-1).cast("long")).withColumn("label", F.lit("GraphMeta"))
        return self.g.functions if label is None else self.g.functions.where(F.col("label") == F.lit(label))

    def nodes(self, node: Node, terms: list | None = None) -> DataFrame:
        """Scan of a node: its id and the wanted properties, named ``<name>.<property>``."""
        df = self._source(self.labels.get(node.name))
        for prop, v in node.props.items():
            df = df.where(self._column(df, prop) == self._literal(v))
        for term in terms or []:
            df = df.where(self._condition(term, lambda _, prop: self._column(df, prop)))
        wanted = self.wanted.get(node.name, set())
        columns = df.columns if wanted is None else sorted(wanted)
        return df.select(F.col("node_id").alias(f"{node.name}#"), *[self._column(df, c).alias(f"{node.name}.{c}") for c in columns])

    @staticmethod
    def _column(df: DataFrame, prop: str) -> Column:
        return F.col(prop) if prop in df.columns else F.lit(None).cast("string")

    def _literal(self, v) -> Column:
        if isinstance(v, Param):
            if v.name not in self.params:
                raise PatternError(f"parameter ${v.name} has no value")
            v = self.params[v.name]
        return F.lit(v)

    def _condition(self, term, column) -> Column:
        kind = term[0]
        if kind in ("and", "or"):
            out = self._condition(term[1][0], column)
            for t in term[1][1:]:
                c = self._condition(t, column)
                out = out & c if kind == "and" else out | c
            return out
        if kind == "not":
            return ~self._condition(term[1], column)
        c = column(term[1], term[2])
        if kind in ("set", "unset"):
            return c.isNotNull() if kind == "set" else c.isNull()
        v = column(term[3][1], term[3][2]) if isinstance(term[3], tuple) else self._literal(term[3])
        if kind == "=":
            return F.coalesce(c == v, F.lit(False))
        if kind in ("<>", "!="):  # an absent property differs from any value
            return ~c.eqNullSafe(v)
        if kind in ("starts", "ends", "contains"):
            return {"starts": c.startswith, "ends": c.endswith, "contains": c.contains}[kind](v)
        return {"<": c < v, ">": c > v, "<=": c <= v, ">=": c >= v}[kind]

    # ------------------------------------------------------------ paths

    def _edges(self, link: Link) -> DataFrame:
        e = self.g.edges.where(F.col("label").isin(*link.types)) if link.types else self.g.edges
        out = e.select("edge_id", "src", "dst", "label", "data_shape")
        if link.direction == "in":
            return out.select("edge_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "label", "data_shape")
        if link.direction == "both":
            return out.unionByName(out.where("src <> dst").select("edge_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "label", "data_shape"))
        return out

    def match(self, m: Match, start: DataFrame | None, terms: dict[str, list]) -> DataFrame:
        """Rows of one path; from ``start`` where its first node is bound there."""
        first = m.nodes[0]
        out = self.nodes(first, terms.get(first.name)) if start is None else start
        seen = {first.name}
        for left_node, link, node in zip(m.nodes, m.links, m.nodes[1:]):
            left = f"{left_node.name}#"
            out = self._step(out, left, link, node, terms, node.name in seen or (start is not None and f"{node.name}#" in start.columns))
            seen.add(node.name)
        return out

    def _step(self, out: DataFrame, left: str, link: Link, node: Node, terms: dict[str, list], known: bool) -> DataFrame:
        target = f"{node.name}#"
        if link.variable:
            starts = out.select(F.col(left).alias("node_id")).distinct()
            ends = walk_ends if self.query.distinct and not any(r.function for r in self.query.returns) else trails
            paths = ends(self._edges(link), starts, link.lo, link.hi).select(F.col("start_id").alias(left), F.col("node_id").alias("_to"))
            out = out.join(paths, left)
        else:
            hop = self._edges(link).select(F.col("src").alias("_from"), F.col("dst").alias("_to"), F.struct("edge_id", "src", "dst", "label", "data_shape").alias(f"{link.name}@"))
            if self.wanted.get(link.name, set()) is not None and link.name not in self.wanted:
                hop = hop.drop(f"{link.name}@")
            out = out.join(hop, F.col(f"`{left}`") == F.col("_from")).drop("_from")
        if known:
            return out.where(F.col(f"`{target}`") == F.col("_to")).drop("_to")
        return out.join(self.nodes(node, terms.get(node.name)), F.col("_to") == F.col(f"`{target}`")).drop("_to")

    def rows(self) -> DataFrame:
        out: DataFrame | None = None
        for m in self.query.matches:
            single, rest = _split(m.where, {n.name for n in m.nodes} - ({c[:-1] for c in out.columns if c.endswith("#")} if out is not None else set()))
            if out is None:
                if any(x.variable for x in m.links) and self._narrow(m.nodes[-1], single) and not self._narrow(m.nodes[0], single):
                    m = _reversed(m)
                out = self.match(m, None, single)
                if rest is not None:
                    out = out.where(self._condition(rest, self._bound))
                continue
            shared = [n.name for n in m.nodes if f"{n.name}#" in out.columns]
            if not shared:
                raise PatternError("paths of one query must share a node")
            if m.nodes[0].name not in shared and not m.optional and m.nodes[-1].name in shared:
                m = _reversed(m)
            if not m.optional:
                out = self.match(m, out, single)
                if rest is not None:
                    out = out.where(self._condition(rest, self._bound))
                continue
            # the optional part on its own, then an outer join on the shared nodes
            anchors = out.select(*[F.col(f"`{s}#`") for s in shared]).distinct()
            first = m.nodes[0].name
            part = self.match(m, anchors, single) if first in shared else self.match(m, None, single)
            if rest is not None:
                keep = [c for c in out.columns if c not in part.columns and not c.endswith("#")]
                part = part.join(out.select(*[F.col(f"`{s}#`") for s in shared], *[F.col(f"`{c}`") for c in keep]).distinct(), [f"{s}#" for s in shared]) if keep else part
                part = part.where(self._condition(rest, self._bound)).drop(*keep)
            again = [c for c in part.columns if c in out.columns and c not in [f"{s}#" for s in shared]]
            out = out.join(part.drop(*again), [f"{s}#" for s in shared], "left")
        return out

    @staticmethod
    def _narrow(node: Node, single: dict[str, list]) -> bool:
        return bool(node.props) or node.name in single

    @staticmethod
    def _bound(name: str, prop: str) -> Column:
        return F.col(f"`{name}.{prop}`")

    # ------------------------------------------------------------ result

    def _value(self, df: DataFrame, name: str, prop: str | None) -> Column:
        if prop is not None:
            if f"{name}.{prop}" in df.columns:
                return F.col(f"`{name}.{prop}`")
            if f"{name}@" in df.columns:
                return F.col(f"`{name}@`")[prop]
            raise PatternError(f"{name} is not bound")
        if f"{name}@" in df.columns:
            return F.col(f"`{name}@`")
        own = [c for c in df.columns if c.startswith(f"{name}.")]
        if f"{name}#" not in df.columns:
            raise PatternError(f"{name} is not bound")
        return F.when(F.col(f"`{name}#`").isNotNull(), F.struct(*[F.col(f"`{c}`").alias(c[len(name) + 1 :]) for c in own]))

    def frame(self) -> DataFrame:
        df, q = self.rows(), self.query
        grouped = [r for r in q.returns if r.function]
        if grouped:
            keys = [r for r in q.returns if not r.function]
            aggregates = []
            for r in grouped:
                if r.function not in ("count", "min", "max", "sum", "avg", "collect"):
                    raise PatternError(f"unknown function {r.function}")
                c = F.lit(1) if r.name == "*" else F.col(f"`{r.name}#`") if r.prop is None and f"{r.name}#" in df.columns else self._value(df, r.name, r.prop)
                f = {"count": F.count, "min": F.min, "max": F.max, "sum": F.sum, "avg": F.avg, "collect": F.collect_list}[r.function]
                aggregates.append(f(c).alias(r.alias))
            out = df.groupBy(*[self._value(df, r.name, r.prop).alias(r.alias) for r in keys]).agg(*aggregates)
            order = [(F.col(f"`{n}.{p}`") if p else F.col(f"`{n}`"), down) for n, p, down in q.order]
        else:
            by = []
            for i, (name, prop, down) in enumerate(q.order):
                alias = next((r for r in q.returns if r.alias == name and prop is None), None)
                c = self._value(df, alias.name, alias.prop) if alias else self._value(df, name, prop)
                by.append((f"_order{i}", c, down))
            out = df.select(*[self._value(df, r.name, r.prop).alias(r.alias) for r in q.returns], *[c.alias(n) for n, c, _ in by])
            order = [(F.col(n), down) for n, _, down in by]
        if q.distinct:
            out = out.distinct()
        if order:
            out = out.orderBy(*[c.desc() if down else c.asc() for c, down in order])
        if q.skip:
            out = out.offset(q.skip)
        if q.limit is not None:
            out = out.limit(q.limit)
        return out.drop(*[c for c in out.columns if c.startswith("_order")])


def _reversed(m: Match) -> Match:
    return Match(m.nodes[::-1], [Link(x.name, x.types, {"out": "in", "in": "out"}.get(x.direction, "both"), x.lo, x.hi, x.variable) for x in m.links[::-1]], m.optional, m.where)


def _props(term) -> list[tuple[str, str]]:
    if term is None:
        return []
    if term[0] in ("and", "or"):
        return [p for t in term[1] for p in _props(t)]
    if term[0] == "not":
        return _props(term[1])
    own = [(term[1], term[2])]
    return own + ([(term[3][1], term[3][2])] if len(term) > 3 and isinstance(term[3], tuple) else [])


def _split(where, names: set[str]) -> tuple[dict[str, list], object]:
    """Terms that speak of one of the names alone, and what is left."""
    if where is None:
        return {}, None
    single: dict[str, list] = {}
    rest = []
    for t in where[1] if where[0] == "and" else [where]:
        about = {n for n, _ in _props(t)}
        if len(about) == 1 and about <= names:
            single.setdefault(about.pop(), []).append(t)
        else:
            rest.append(t)
    return single, None if not rest else rest[0] if len(rest) == 1 else ("and", rest)


def run(g: CodeGraph, text: str, params: dict[str, object] | None = None) -> DataFrame:
    """Result of a pattern query; columns are named by the returned expressions."""
    return _Plan(g, parse(text), params or {}).frame()
