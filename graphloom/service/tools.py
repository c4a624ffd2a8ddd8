"""The queries as named tools with JSON arguments: what the RPC service and the command line call."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom import schema
from graphloom.graph import CodeGraph
from graphloom.operators import closure, lookup, modules
from graphloom.operators.paging import DEFAULT_LIMIT, Options, Page, paginate
from graphloom.storage import materialize, temporary

ORDER = ["file", "start_line", "qualified_name"]
_KEYS = dict(zip(schema.INFO, ("Name", "QualifiedName", "File", "StartLine", "EndLine", "Module", "Exported", "Tag", "Contract", "Completeness")))


def function_items(page: Page) -> list[dict]:
    return [{_KEYS[c]: (r[c] if r[c] is not None else "") for c in schema.INFO} for r in page.items]


class Tools:
    def __init__(self, graph: CodeGraph, qualified: bool = True):
        self.graph, self.qualified = graph, qualified
        self.calls: dict[str, Callable[[dict], object]] = {
            "callers": self._named(lookup.callers),
            "contract": self._contract,
            "impact": self._impact,
            "breaks": self._named(lookup.breaks),
            "entry_points": lambda a: self._functions(lookup.entry_points(self.graph), a),
            "exports": lambda a: self._functions(lookup.exports(self.graph, _text(a, "module")), a),
            "domains": self._domains,
            "domain": self._domain,
            "coupling": self._coupling,
            "untested": lambda a: self._functions(lookup.untested(self.graph), a),
            "test_coverage": self._named(lookup.test_coverage),
            "graph_summary": self._summary,
            "subgraph": self._subgraph,
        }

    def call(self, name: str, args: dict) -> object:
        if name not in self.calls:
            raise LookupError(f"unknown tool: {name}")
        with temporary():
            return self.calls[name](args)

    # ------------------------------------------------------------ results

    def page(self, df: DataFrame, args: dict) -> Page:
        return paginate(df.select(*schema.INFO), ORDER, options(args))

    def _functions(self, df: DataFrame, args: dict) -> dict:
        page = self.page(df, args)
        return envelope(page, function_items(page))

    def _named(self, f) -> Callable[[dict], dict]:
        return lambda a: self._functions(f(self.graph, _text(a, "function"), self.qualified), a)

    def _impact(self, args: dict) -> dict:
        return self._functions(closure.impact(self.graph, _text(args, "function"), _number(args, "depth", closure.DEFAULT_DEPTH), self.qualified), args)

    def _contract(self, args: dict) -> dict:
        return function_items(self.page(lookup.contract(self.graph, _text(args, "function"), self.qualified), {}))[0]

    def _domains(self, args: dict) -> dict:
        page = paginate(modules.domains(self.graph), [F.desc("functions"), "module"], options(args))
        return envelope(page, [{"Module": r.module, "Functions": r.functions, "Edges": 0} for r in page.items])

    def _coupling(self, args: dict) -> dict:
        page = paginate(modules.coupling(self.graph), [F.desc("edges"), "from_module", "to_module"], options(args))
        return envelope(page, [{"FromModule": r.from_module, "ToModule": r.to_module, "EdgeCount": r.edges} for r in page.items])

    def _domain(self, args: dict) -> dict:
        """A page of the module's functions and, paged alike, the calls inside it."""
        module = _text(args, "module")
        inside = paginate(modules.internal_edges(self.graph, module), ["caller", "callee"], Options(options(args).limit))
        return self._functions(lookup.domain(self.graph, module), args) | {"internal_edges": [{"From": r.caller, "To": r.callee} for r in inside.items], "internal_edge_count": inside.total}

    def _summary(self, _: dict) -> dict:
        r = modules.graph_summary(self.graph).first()
        covered = modules.coverage_percent(self.graph).first()
        return {
            "modules": [{"Module": m.module, "Functions": m.functions, "Edges": 0} for m in r.modules],
            "total_functions": r.total_functions, "total_edges": r.total_edges, "untested_count": r.untested_count, "coverage_pct": covered.coverage_pct,
        }

    def _subgraph(self, args: dict) -> dict:
        """'callees' holds the impact set, as clients of the protocol know it; 'true_callees' the other direction.

        Each part is a page of ``limit`` rows from the part's start (all, where the request names none); ``counts`` tells
        how many there are."""
        name, hops = _text(args, "function"), _number(args, "hops", 2)
        rows = closure.subgraph(self.graph, name, hops, self.qualified)
        kept = materialize(rows, "subgraph")
        counts = {r.part: r.n for r in kept.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}  # four parts
        known = "center" in counts
        page = lambda part: function_items(self.page(kept.where(F.col("part") == part), {"limit": _number(args, "limit", 0)}))
        return {
            "center": page("center")[0] if known else None, "callers": page("callers") if known else None, "callees": page("callees"), "true_callees": page("true_callees"),
            "counts": {part: counts.get(part, 0) for part in ("callers", "callees", "true_callees")},
        }


def _text(args: dict, key: str) -> str:
    return args[key] if isinstance(args.get(key), str) else ""


def _number(args: dict, key: str, default: int) -> int:
    v = args.get(key)
    return int(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else default


def options(args: dict) -> Options:
    return Options(_number(args, "limit", DEFAULT_LIMIT), _number(args, "offset", 0))


def envelope(page: Page, items: list) -> dict:
    out = {"total_count": page.total, "returned": page.returned, "offset": page.offset, "items": items, "truncated": page.truncated}
    return out | ({"hint": f"Use offset={page.offset + page.returned} to see more"} if page.truncated else {})


def definitions() -> list[dict]:
    """Names, descriptions and input schemas of the tools."""
    function = {"function": {"type": "string", "description": "Name or qualified name of the function"}}
    module = {"module": {"type": "string", "description": "Module: the folder of its files"}}
    pages = {
        "limit": {"type": "number", "description": "Most results to return; 0 for all", "default": DEFAULT_LIMIT, "minimum": 0},
        "offset": {"type": "number", "description": "Results to skip", "default": 0, "minimum": 0},
    }
    depth = {"depth": {"type": "number", "description": "Most calls between the functions", "default": 3, "minimum": 1, "maximum": 10}}
    hops = {"hops": {"type": "number", "description": "Radius in calls", "default": 2, "minimum": 1, "maximum": 5}}
    rows = [
        ("callers", "Functions that call the function directly.", function | pages, ["function"]),
        ("contract", "Parameters and return values of the function.", function, ["function"]),
        ("impact", "Functions that reach the function within some calls.", function | depth | pages, ["function"]),
        ("breaks", "Callers that a change of the function may break.", function | pages, ["function"]),
        ("entry_points", "Functions that nothing calls.", pages, []),
        ("exports", "Exported functions of the module.", module | pages, ["module"]),
        ("domains", "Modules with their number of functions.", pages, []),
        ("domain", "Functions of the module and the calls inside it.", module | pages, ["module"]),
        ("coupling", "Calls between modules.", pages, []),
        ("untested", "Functions that no test calls.", pages, []),
        ("test_coverage", "Tests that call the function.", function | pages, ["function"]),
        ("graph_summary", "Modules, counts and coverage of the graph.", {}, []),
        ("subgraph", "The surroundings of the function.", function | hops | {"limit": pages["limit"] | {"default": 0}}, ["function"]),
    ]
    return [
        {"name": n, "description": d, "inputSchema": {"type": "object"} | ({"properties": p} if p else {}) | ({"required": r} if r else {})} for n, d, p, r in rows
    ]
