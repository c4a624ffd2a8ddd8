"""Registered queries over the test tables: name -> callable(spark, folder) -> DataFrame, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom import config, goldens, pattern, schema
from graphloom.extract import frames
from graphloom.functions import paths
from graphloom.graph import CodeGraph, graph_meta
from graphloom.operators import closure, hierarchy, hot_keys, lookup, modules, shred, snapshots
from graphloom.operators.paging import Options, page_after, with_total
from graphloom.plans import resolve
from graphloom.session import table
from graphloom.sources import walk
from graphloom.storage import materialize

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# ---------------------------------------------------------------- 1 nested records


def _opened_sql(x: str) -> str:
    """A JSON value, also where it is given as JSON text."""
    return f"case when json_type({x}) = 'VARCHAR' then try_cast({x} ->> '$' as json) else {x} end"


def _list_sql(x: str) -> str:
    return f"case json_type({x}) when 'ARRAY' then json_extract({x}, '$[*]') when 'OBJECT' then [{x}] else [] end"


_SHRED_SQL = f"""
with d as (select record_id, payload from (select record_id, regexp_replace(payload, '^[\\s\ufeff]+', '') as payload, extracted_at from extract_records where record_id is not null) where json_valid(payload)
  qualify row_number() over (partition by record_id order by extracted_at desc nulls last, payload desc) = 1),
t0 as (select record_id, payload::json as j from d), t1 as (select record_id, {_opened_sql("j")} as j from t0),
t2 as (select record_id, case json_type(j) when 'ARRAY' then j -> 0 else j end as j from t1),
t3 as (select record_id, case when json_type(j -> 'record') = 'OBJECT' then j -> 'record' else j end as j from t2 where json_type(j) = 'OBJECT'),
r as (select record_id, {_opened_sql("x")} as x from (select record_id, j -> 'returns' as x from t3)),
m as (select record_id, 'parameters' as branch, j -> 'parameters' as x from t3 union all select record_id, 'returns', case json_type(x) when 'ARRAY' then x when 'OBJECT' then x -> 'values' end from r),
o as (select record_id, branch, {_opened_sql("x")} as x from m), l as (select record_id, branch, {_list_sql("x")} as l from o),
e as (select record_id, branch, pos, {_opened_sql("x")} as x from (select record_id, branch, unnest(l) as x, unnest(generate_series(0, len(l) - 1))::int as pos from l)),
p as (select * from e where json_type(x) = 'OBJECT'),
f as (select record_id, branch, pos, {_opened_sql("x")} as x from (select record_id, branch, pos, x -> 'expanded' as x from p)), g as (select record_id, branch, pos, {_list_sql("x")} as l from f),
h as (select record_id, branch, pos, sub_pos, {_opened_sql("x")} as x from (select record_id, branch, pos, unnest(l) as x, unnest(generate_series(0, len(l) - 1))::int as sub_pos from g))
"""


@query("p1_found", _SHRED_SQL + "select record_id, branch, pos, -1 as sub_pos from p union all select record_id, branch, pos, sub_pos from h where json_type(x) = 'OBJECT'")
def p1_found(spark, d):
    tables = shred.shred_functions(table(spark, d, "extract_records"))
    return shred.shredded_cases(tables)


@query(
    "p1_functions",
    _SHRED_SQL
    + """select t3.record_id, j ->> 'name' as name, j ->> 'qualified_name' as qualified_name, j ->> 'file' as file, j ->> 'language' as language, j ->> 'package' as package, j ->> 'receiver' as receiver, j ->> 'kind' as kind,
  j ->> 'tag' as tag, j ->> 'contract_completeness' as contract_completeness, try_cast(j ->> 'start_line' as int) as start_line, try_cast(j ->> 'end_line' as int) as end_line,
  coalesce(j ->> 'exported' = 'true', false) as exported, coalesce(json_type(x) = 'OBJECT' and x ->> 'multiple' = 'true', false) as multiple from t3 join r using (record_id)""",
)
def p1_functions(spark, d):
    return shred.shred_functions(table(spark, d, "extract_records"))["functions"]


@query("p1_parameters", _SHRED_SQL + "select record_id, pos, x ->> 'name' as name, x ->> 'type' as type, x ->> 'type_expr' as type_expr, coalesce(x ->> 'nullable' = 'true', false) as nullable, coalesce(x ->> 'variadic' = 'true', false) as variadic from p where branch = 'parameters'")
def p1_parameters(spark, d):
    return shred.shred_functions(table(spark, d, "extract_records"))["parameters"]


@query("p1_returns", _SHRED_SQL + "select record_id, pos, x ->> 'name' as name, x ->> 'type' as type, x ->> 'type_expr' as type_expr, coalesce(x ->> 'nullable' = 'true', false) as nullable from p where branch = 'returns'")
def p1_returns(spark, d):
    return shred.shred_functions(table(spark, d, "extract_records"))["returns"]


@query("p1_expanded", _SHRED_SQL + "select record_id, branch, pos, sub_pos, x ->> 'name' as name, x ->> 'type' as type, coalesce(x ->> 'nullable' = 'true', false) as nullable from h where json_type(x) = 'OBJECT'")
def p1_expanded(spark, d):
    return shred.shred_functions(table(spark, d, "extract_records"))["expanded"]


# ---------------------------------------------------------------- 2 snapshots


def _changes(spark, d):
    t = table(spark, d, "function_snapshots")
    content = snapshots.contract_hash(F.col("parameters"), F.col("returns"))
    return snapshots.snapshot_changes(t, "repo_id", "qualified_name", "snapshot_no", content, "delivered_at", "row_id")


_CHANGES_SQL = """
with src as (select * from function_snapshots where repo_id is not null and snapshot_no is not null),
canon as (select *, list_transform(coalesce(parameters, []), lambda p: {'n': coalesce(p.name, ''), 't': coalesce(p.type, ''), 'e': coalesce(p.type_expr, ''), 'u': coalesce(p.nullable, false), 'v': coalesce(p.variadic, false),
    'x': list_transform(coalesce(p.expanded, []), lambda f: {'n': coalesce(f.name, ''), 't': coalesce(f.type, ''), 'u': coalesce(f.nullable, false)})}) as cp,
  list_transform(coalesce(returns.values, []), lambda p: {'n': coalesce(p.name, ''), 't': coalesce(p.type, ''), 'e': coalesce(p.type_expr, ''), 'u': coalesce(p.nullable, false),
    'x': list_transform(coalesce(p.expanded, []), lambda f: {'n': coalesce(f.name, ''), 't': coalesce(f.type, ''), 'u': coalesce(f.nullable, false)})}) as cv,
  coalesce(len(returns.values), 0) > 0 and coalesce(returns.multiple, false) as cm from src),
rows as (select repo_id, qualified_name, snapshot_no, to_json({'p': cp, 'v': cv, 'm': cm})::varchar as c from canon where qualified_name is not null
  qualify row_number() over (partition by repo_id, qualified_name, snapshot_no order by delivered_at desc nulls last, row_id desc) = 1),
snaps as (select repo_id, snapshot_no, lag(snapshot_no) over (partition by repo_id order by snapshot_no) as prev from (select distinct repo_id, snapshot_no from src)),
pairs as (select * from snaps where prev is not null),
changes as (select p.repo_id, n.qualified_name, p.snapshot_no, case when o.c is null then 'added' else 'changed' end as change from pairs p join rows n on n.repo_id = p.repo_id and n.snapshot_no = p.snapshot_no
  left join rows o on o.repo_id = p.repo_id and o.snapshot_no = p.prev and o.qualified_name = n.qualified_name where o.c is distinct from n.c
  union all select p.repo_id, o.qualified_name, p.snapshot_no, 'removed' from pairs p join rows o on o.repo_id = p.repo_id and o.snapshot_no = p.prev
  where not exists (select 1 from rows n where n.repo_id = p.repo_id and n.snapshot_no = p.snapshot_no and n.qualified_name = o.qualified_name))
"""


@query("p2_found", _CHANGES_SQL + "select repo_id, qualified_name, snapshot_no, change from changes")
def p2_found(spark, d):
    return _changes(spark, d).select("repo_id", "qualified_name", "snapshot_no", "change")


@query(
    "p2_change_counts",
    _CHANGES_SQL + "select repo_id, snapshot_no, count(*) filter (where change = 'added') as added, count(*) filter (where change = 'removed') as removed, count(*) filter (where change = 'changed') as changed from changes group by all",
)
def p2_change_counts(spark, d):
    return _changes(spark, d).groupBy("repo_id", "snapshot_no").agg(*[F.count(F.when(F.col("change") == c, 1)).alias(c) for c in ("added", "removed", "changed")])


# ---------------------------------------------------------------- 3 hot keys



@query(
    "p3_found",
    """
with e as (select distinct on (build_no, callee_name) build_no, callee_name, call_id from call_edges
  where callee_name is not null and seen_at is not null order by build_no, callee_name, seen_at desc, call_id desc),
f as (select distinct on (build_no, name) build_no, name, fn_id from functions
  where name is not null and collected_at is not null order by build_no, name, collected_at desc, fn_id desc)
select 'callee_name' as key_field, cast(build_no as bigint) as build_no, callee_name as key_value, call_id as row_id from e
union all select 'name', cast(build_no as bigint), name, fn_id from f""",
)
def p3_found(spark, d):
    edges = hot_keys.latest_per_key(table(spark, d, "call_edges"), ["build_no", "callee_name"], "seen_at", "call_id")
    nodes = hot_keys.latest_per_key(table(spark, d, "functions"), ["build_no", "name"], "collected_at", "fn_id")
    return edges.select(F.lit("callee_name").alias("key_field"), "build_no", F.col("callee_name").alias("key_value"), "row_id").unionByName(
        nodes.select(F.lit("name").alias("key_field"), "build_no", F.col("name").alias("key_value"), "row_id")
    )


@query(
    "p3_profile",
    """
with s as (select build_no, callee_name, count(*) as n_rows, min(seen_at) as first_at, max(seen_at) as last_at
  from call_edges where callee_name is not null group by all)
select build_no, callee_name, n_rows, first_at, last_at, n_rows / sum(n_rows) over (partition by build_no) as share from s""",
)
def p3_profile(spark, d):
    return hot_keys.key_profile(table(spark, d, "call_edges"), ["build_no", "callee_name"], "seen_at")


# ---------------------------------------------------------------- 5 hierarchies


def _hierarchy(spark, d, intervals=False):
    return hierarchy.decompose(table(spark, d, "call_links"), "caller_qualified", "callee_qualified", "seen_at", intervals)


_TREES_SQL = """
with recursive l as (select nullif(regexp_replace(caller_qualified, '^\\s+|\\s+$', '', 'g'), '') as p, nullif(regexp_replace(callee_qualified, '^\\s+|\\s+$', '', 'g'), '') as c, seen_at from call_links),
nodes as (select c as n from l where c is not null union select p from l where p is not null),
up as (select c, p from l where c is not null and p is not null qualify row_number() over (partition by c order by seen_at desc nulls last, p desc) = 1),
reach(n, a) as (select c, p from up union select r.n, up.p from reach r join up on up.c = r.a),
loops as (select n from reach where n = a),
cyc as (select r.n, min(r.a) as root, bool_or(r.n = r.a) as own from reach r join loops on loops.n = r.a group by r.n),
tree as (select n, count(a) as depth from nodes left join reach using (n) where n not in (select n from cyc) group by n),
above as (select r.n, r.a, t.depth as ad from reach r join tree t on t.n = r.a where r.n in (select n from tree) union all select n, n, depth from tree)
"""


@query(
    "p5_found",
    _TREES_SQL
    + """select t.n as node_qualified, a.a as root_qualified, t.depth, 'tree' as state from tree t join above a on a.n = t.n and a.ad = 0
union all select n, root, -1, case when own then 'cycle' else 'below_cycle' end from cyc""",
)
def p5_found(spark, d):
    h = _hierarchy(spark, d)
    return h.select(F.col("node").alias("node_qualified"), F.col("root").alias("root_qualified"), "depth", "state")


@query(
    "p5_paths",
    _TREES_SQL + "select a.n as node, min(a.a) filter (where ad = 0) as root, any_value(t.depth) as depth, string_agg(a.a, ' > ' order by ad) as path from above a join tree t on t.n = a.n group by a.n",
)
def p5_paths(spark, d):
    return hierarchy.full_paths(_hierarchy(spark, d)).select("node", "root", "depth", F.array_join("path", " > ").alias("path"))


@query("p5_below", _TREES_SQL + "select a.a as node, a.n as below, t.depth - a.ad as distance from above a join tree t on t.n = a.n where a.a <> a.n")
def p5_below(spark, d):
    return hierarchy.descendants(_hierarchy(spark, d, intervals=True))


# ---------------------------------------------------------------- the code graph of the test tables


def code_graph(spark, d) -> CodeGraph:
    """Functions by their latest row and calls by theirs; a call's ends are looked up by repository, build and
    qualified name, the last function of a name counting. Whole tables, parallel edges kept."""
    rows = table(spark, d, "functions").where(F.col("fn_id").isNotNull())
    columns = [c for c in rows.columns if c != "fn_id"]
    # one aggregate a column, all over the same rank: those that a query doesn't name are pruned down to the scan
    fn = rows.groupBy(F.col("fn_id").alias("node_id")).agg(*[F.max_by(c, F.struct("loaded_at", "collected_at")).alias(c) for c in columns])
    ids = fn.groupBy("repo_id", "build_no", "qualified_name").agg(F.max("node_id").alias("id"))
    calls = table(spark, d, "call_edges").where(F.col("call_id").isNotNull()).select("call_id", "repo_id", "build_no", "caller_qualified", "callee_qualified", "label", "loaded_at", "seen_at")
    kept = ["repo_id", "build_no", "caller_qualified", "callee_qualified", "label"]
    once = calls.groupBy(F.col("call_id").alias("edge_id")).agg(*[F.max_by(c, F.struct("loaded_at", "seen_at")).alias(c) for c in kept])
    edges = (
        once.join(ids.select("repo_id", "build_no", F.col("qualified_name").alias("caller_qualified"), F.col("id").alias("src")), ["repo_id", "build_no", "caller_qualified"])
        .join(ids.select("repo_id", "build_no", F.col("qualified_name").alias("callee_qualified"), F.col("id").alias("dst")), ["repo_id", "build_no", "callee_qualified"])
        .select("edge_id", "src", "dst", "label")
    )
    return CodeGraph.with_defaults(fn, edges)


def stored(g: CodeGraph) -> CodeGraph:
    """The graph as written tables, for queries that pass over the edges more than once."""
    return CodeGraph(materialize(g.functions, "functions"), materialize(g.edges, "edges"), g.meta)


GRAPH_SQL = """
with recursive fn as (select fn_id as node_id, * exclude (fn_id, is_test), coalesce(is_test, false) as is_test from (
  select *, row_number() over (partition by fn_id order by loaded_at desc nulls last, collected_at desc nulls last) as rn from functions where fn_id is not null) where rn = 1),
ids as (select repo_id, build_no, qualified_name, max(node_id) as id from fn group by all),
ce as (select * from (select *, row_number() over (partition by call_id order by loaded_at desc nulls last, seen_at desc nulls last) as rn from call_edges where call_id is not null) where rn = 1),
ae as (select ce.call_id as edge_id, s.id as src, t.id as dst, ce.label as label from ce
  join ids s on s.repo_id = ce.repo_id and s.build_no = ce.build_no and s.qualified_name = ce.caller_qualified
  join ids t on t.repo_id = ce.repo_id and t.build_no = ce.build_no and t.qualified_name = ce.callee_qualified
  ), e as (select * from ae where label = 'CALLS'),
one as (select node_id from fn where name = '{name}' order by file nulls first, start_line nulls first, node_id limit 1)
"""
INFO_SQL = "node_id, name, qualified_name, file, start_line, end_line, module, exported, is_test"
NAME = "handle"


def _shown(df):
    return df.select("node_id", "name", "qualified_name", "file", "start_line", "end_line", "module", "exported", "is_test")


def graph_query(name: str, select: str, **names):
    sql = GRAPH_SQL.replace("{name}", names.get("target", NAME)) + select

    def add(f):
        return query(name, sql)(lambda spark, d: f(code_graph(spark, d)))

    return add


_F = ", ".join(f"fn.{c.strip()}" for c in INFO_SQL.split(","))
graph_query("callers", f"select {_F} from e join one on e.dst = one.node_id join fn on fn.node_id = e.src")(lambda g: _shown(lookup.callers(g, NAME)))
graph_query("callers_homonym", f"select {_F} from e join one on e.dst = one.node_id join fn on fn.node_id = e.src", target="get")(lambda g: _shown(lookup.callers(g, "get")))
graph_query("contract", f"select {_F}, fn.contract, fn.contract_completeness from fn join one using (node_id)")(
    lambda g: lookup.contract(g, NAME).select("node_id", "name", "qualified_name", "file", "start_line", "end_line", "module", "exported", "is_test", "contract", "contract_completeness")
)
graph_query("breaks", f"select {_F} from e join one on e.dst = one.node_id join fn on fn.node_id = e.src")(lambda g: _shown(lookup.breaks(g, NAME)))
graph_query("test_coverage", f"select {_F} from e join one on e.dst = one.node_id join fn on fn.node_id = e.src where fn.is_test")(lambda g: _shown(lookup.test_coverage(g, NAME)))
graph_query("entry_points", f"select {_F} from fn where not exists (select 1 from e where e.dst = fn.node_id)")(lambda g: _shown(lookup.entry_points(g)))
graph_query("exports", f"select {_F} from fn where module = 'auth' and exported and not is_test")(lambda g: _shown(lookup.exports(g, "auth")))
graph_query("domain", f"select {_F} from fn where module = 'auth'")(lambda g: _shown(lookup.domain(g, "auth")))
graph_query("domains", "select module, count(*) as functions from fn where module <> '' group by module")(lambda g: modules.domains(g))
graph_query(
    "coupling",
    "select a.module as from_module, b.module as to_module, count(*) as edges from e join fn a on a.node_id = e.src join fn b on b.node_id = e.dst where a.module <> b.module and a.module <> '' and b.module <> '' group by all",
)(lambda g: modules.coupling(g))
graph_query("untested", f"select {_F} from fn where not is_test and not exists (select 1 from e join fn t on t.node_id = e.src and t.is_test where e.dst = fn.node_id)")(lambda g: _shown(lookup.untested(g)))

for _depth in (1, 3, 5):
    graph_query(
        f"impact_d{_depth}",
        f""", reach(node_id, depth) as (select node_id, 0 from fn where name = '{NAME}'
  union select e.src, reach.depth + 1 from reach join e on e.dst = reach.node_id where reach.depth < {_depth})
select distinct fn.qualified_name from reach join fn using (node_id) where reach.depth > 0""",
    )(lambda g, n=_depth: closure.impact(stored(g), NAME, n).select("qualified_name"))
graph_query(
    "callees_d2",
    f""", reach(node_id, depth) as (select node_id, 0 from fn where name = '{NAME}'
  union select e.dst, reach.depth + 1 from reach join e on e.src = reach.node_id where reach.depth < 2)
select distinct fn.qualified_name from reach join fn using (node_id) where reach.depth > 0""",
)(lambda g: closure.callees(stored(g), NAME, 2).select("qualified_name"))

_PAGE_SQL = "select t.node_id, t.name, (select count(*) from fn) as total_count from (select node_id, name from fn order by name nulls first, node_id limit {limit} offset {offset}) t"
for _page, _options in {"page_first": Options(50, 0), "page_mid": Options(50, 1200), "page_past_end": Options(50, 100_000_000)}.items():
    graph_query(_page, _PAGE_SQL.format(limit=_options.limit, offset=_options.offset))(
        lambda g, o=_options: with_total(g.functions.select("node_id", "name"), ["name", "node_id"], o)
    )
graph_query(
    "graph_summary",
    """select (select count(*) from (select distinct module from fn where module <> '')) as n_modules, (select count(*) from fn where module <> '') as total_functions, (select count(*) from ae) as total_edges,
  (select count(*) from fn where not is_test and not exists (select 1 from e join fn t on t.node_id = e.src and t.is_test where e.dst = fn.node_id)) as untested_count""",
)(lambda g: modules.graph_summary(g).select(F.size("modules").cast("long").alias("n_modules"), "total_functions", "total_edges", "untested_count"))
graph_query(
    "coverage_pct",
    """, n as (select count(*) as n_functions, count(*) filter (where not exists (select 1 from e join fn t on t.node_id = e.src and t.is_test where e.dst = fn.node_id)) as n_untested from fn where not is_test)
select n_functions, n_untested, 100.0::double * (n_functions - n_untested) / n_functions as coverage_pct from n""",
)(lambda g: modules.coverage_percent(g))
graph_query(
    "domain_edges",
    """, m as (select a.module as f, b.module as t from e join fn a on a.node_id = e.src join fn b on b.node_id = e.dst where a.module <> '' and b.module <> '')
select module, count(*) as functions, (select count(*) from m where f = module and t = module) as internal_edges, (select count(*) from m where f <> t and (f = module or t = module)) as cross_edges
from fn where module <> '' group by module""",
)(lambda g: modules.domain_edges(g))
graph_query(
    "cohesion",
    """select a.module as module, count(*) filter (where a.module = b.module) / count(*) as cohesion from e join fn a on a.node_id = e.src join fn b on b.node_id = e.dst
where a.module <> '' and b.module <> '' group by a.module""",
)(lambda g: modules.cohesion(g))
graph_query("contract_coverage", "select contract_completeness, count(*) as functions from fn group by contract_completeness")(lambda g: modules.contract_coverage(g.functions))
graph_query("node_edge_counts", "select (select count(*) from fn) as nodes, (select count(*) from ae) as edges")(
    lambda g: g.spark.createDataFrame([(g.node_count(), g.edge_count())], "nodes bigint, edges bigint")
)


graph_query(
    "subgraph",
    f""", reach(node_id, depth) as (select node_id, 0 from fn where name = '{NAME}'
  union select e.src, reach.depth + 1 from reach join e on e.dst = reach.node_id where reach.depth < 2)
select 'center' as part, fn.qualified_name from fn join one using (node_id)
union all select 'callers', fn.qualified_name from e join one on e.dst = one.node_id join fn on fn.node_id = e.src
union all select distinct 'callees', fn.qualified_name from reach join fn using (node_id) where reach.depth > 0""",
)(
    lambda g: lookup_subgraph(stored(g))
)


def lookup_subgraph(g):
    return closure.subgraph(g, NAME, 2, true_callees=False).select("part", "qualified_name")


graph_query("page_after", "select node_id, name from fn where name > 'handle' or name = 'handle' and node_id > 0 order by name, node_id limit 50")(
    lambda g: page_after(g.functions.select("node_id", "name"), ["name", "node_id"], ["handle", 0], 50)
)


def _rounds_sql(rounds: int) -> str:
    """Label propagation, one common table a round."""
    out = ", links as materialized (select distinct s, t from (select src as s, dst as t from e where src <> dst union all select dst, src from e where src <> dst)), l0 as materialized (select node_id, node_id as community from fn)"
    for i in range(rounds):
        out += f""", l{i + 1} as materialized (select node_id, community from (select node_id, community, count(*) as n from
  (select t as node_id, community from links join l{i} on l{i}.node_id = s union all select node_id, community from l{i}) group by all) qualify row_number() over (partition by node_id order by n desc, community) = 1)"""
    return out


graph_query("communities", _rounds_sql(5) + " select a.node_id, a.community, a.community = b.community as settled from l5 a join l4 b using (node_id)")(lambda g: modules.communities(stored(g)))
graph_query(
    "drift",
    _rounds_sql(5)
    + """, c as (select community, module, count(*) as n from l5 join fn using (node_id) where module <> '' group by all),
h as (select community, module as home from c qualify row_number() over (partition by community order by n desc, module) = 1)
select module, sum(n)::bigint as functions, coalesce(sum(n) filter (where module <> home), 0)::bigint as drifted from c join h using (community) group by module""",
)(lambda g: (lambda kept: modules.drift(kept, modules.communities(kept)))(stored(g)))

# ---------------------------------------------------------------- graph patterns



def _walk_sql(name: str, least: int, most: int) -> str:
    return f""", w(a, b, h) as (select src, dst, 1 from e join fn on fn.node_id = e.src where fn.name = '{name}' union select w.a, e.dst, w.h + 1 from w join e on e.src = w.b where w.h < {most})
select distinct a, b from w where h >= {least}"""


_PATTERNS = {
    "cy_node_props": ("MATCH (f:Function {name: 'handle', exported: true}) RETURN f.node_id AS node_id, f.name AS name", "select node_id, name from fn where name = 'handle' and exported"),
    "cy_any_label_limit": ("MATCH (f {name: 'handle'}) RETURN f.node_id AS node_id, f.name AS name ORDER BY f.node_id LIMIT 3", "select node_id, name from fn where name = 'handle' order by node_id limit 3"),
    "cy_project": ("MATCH (f:Function) RETURN f.name AS name, f.module AS module", "select name, module from fn"),
    "cy_hop": (
        "MATCH (a:Function {name: 'handle'})-[:CALLS]->(b:Function {exported: true}) RETURN a.node_id AS a, b.node_id AS b",
        "select a.node_id as a, b.node_id as b from e join fn a on a.node_id = e.src join fn b on b.node_id = e.dst where a.name = 'handle' and b.exported",
    ),
    "cy_imports": ("MATCH (a)-[:IMPORTS]->(b) RETURN a.name AS a, b.name AS b", "select a.name as a, b.name as b from ae e join fn a on a.node_id = e.src join fn b on b.node_id = e.dst where e.label = 'IMPORTS'"),
    "cy_edge_var": (
        "MATCH (a)-[e:CALLS]->(b {name: 'handle'}) RETURN a.name AS caller, e.edge_id AS edge_id, e.label AS label",
        "select a.name as caller, e.edge_id, e.label from e join fn a on a.node_id = e.src join fn b on b.node_id = e.dst where b.name = 'handle'",
    ),
    "cy_var_length": (
        "MATCH (a {name: 'describe'})-[:CALLS*1..2]->(b) RETURN DISTINCT a.node_id AS a, b.node_id AS b",
        """select distinct a, b from (select e.src as a, e.dst as b from e union all select x.src, y.dst from e x join e y on y.src = x.dst where y.edge_id <> x.edge_id) p
  join fn on fn.node_id = p.a where fn.name = 'describe'""",
    ),
    "cy_var_length_2": (
        "MATCH (a {name: 'describe'})-[:CALLS*2..2]->(b) WHERE b.exported = true RETURN a.node_id AS a, b.node_id AS b",
        "select x.src as a, y.dst as b from e x join e y on y.src = x.dst and y.edge_id <> x.edge_id join fn a on a.node_id = x.src join fn b on b.node_id = y.dst where a.name = 'describe' and b.exported",
    ),
    "cy_where": ("MATCH (f:Function) WHERE f.module = 'auth' AND f.start_line > 100 RETURN f.node_id AS node_id", "select node_id from fn where module = 'auth' and start_line > 100"),
    "cy_where_not": ("MATCH (f:Function) WHERE f.receiver <> 'Task' RETURN f.node_id AS node_id", "select node_id from fn where receiver is distinct from 'Task'"),
    "cy_order_limit": (
        "MATCH (f:Function) WHERE f.name IS NOT NULL RETURN f.node_id AS node_id, f.name AS name ORDER BY f.name DESC, f.node_id LIMIT 20",
        "select node_id, name from fn where name is not null order by name desc, node_id limit 20",
    ),
    "cy_undirected": (
        "MATCH (a {name: 'describe'})-[:CALLS]-(b) RETURN a.node_id AS a, b.node_id AS b",
        "select a.node_id as a, t as b from (select src as s, dst as t from e union all select dst, src from e where src <> dst) u join fn a on a.node_id = u.s join fn b on b.node_id = u.t where a.name = 'describe'",
    ),
    "cy_optional": (
        "MATCH (f:Function {module: 'auth'}) OPTIONAL MATCH (t:Function)-[:CALLS]->(f) WHERE t.is_test = true RETURN f.node_id AS node_id, t.name AS test",
        "select f.node_id, x.name as test from fn f left join (select e.dst, t.name from e join fn t on t.node_id = e.src where t.is_test) x on x.dst = f.node_id where f.module = 'auth'",
    ),
    "cy_count": ("MATCH (a)-[:CALLS]->(b) RETURN b.module AS module, count(*) AS n", "select b.module as module, count(*) as n from e join fn a on a.node_id = e.src join fn b on b.node_id = e.dst group by b.module"),
    "cy_large_limit": ("MATCH (f:Function) RETURN f.node_id AS node_id, f.label AS label ORDER BY f.node_id LIMIT 1000", "select node_id, 'Function' as label from fn order by node_id limit 1000"),
    "cy_var_length_2_6": ("MATCH (a {name: 'describe'})-[:CALLS*2..6]->(b) RETURN DISTINCT a.node_id AS a, b.node_id AS b", _walk_sql("describe", 2, 6)),
    "cy_var_length_5_15": ("MATCH (a {name: 'describe'})-[:CALLS*5..15]->(b) RETURN DISTINCT a.node_id AS a, b.node_id AS b", _walk_sql("describe", 5, 15)),
    "cy_var_length_where": (
        "MATCH (a)-[:CALLS*1..3]->(b {name: 'describe'}) WHERE a.exported = true RETURN DISTINCT a.node_id AS a, b.node_id AS b",
        """, w(a, b, h) as (select src, dst, 1 from e join fn on fn.node_id = e.dst where fn.name = 'describe' union select e.src, w.b, w.h + 1 from w join e on e.dst = w.a where w.h < 3)
select distinct a, b from w join fn on fn.node_id = w.a where fn.exported""",
    ),
}
for _name, (_text, _sql) in _PATTERNS.items():
    graph_query(_name, _sql)(lambda g, t=_text: pattern.run(stored(g) if ":CALLS*" in t else g, t))
graph_query("cy_params", "select node_id from fn where name = 'get' and module = 'auth'")(lambda g: pattern.run(g, "MATCH (f {name: $n}) WHERE f.module = $m RETURN f.node_id AS node_id", {"n": "get", "m": "auth"}))
graph_query("cy_meta", "select count(*) as function_count, count(distinct file) as file_count from fn")(
    lambda g: pattern.run(CodeGraph(g.functions, g.edges, graph_meta(g.spark, g.functions)), "MATCH (m:GraphMeta) RETURN m.function_count AS function_count, m.file_count AS file_count")
)

# ---------------------------------------------------------------- resolution, shapes, sources


def _scoped(*columns):
    """Names and files of one repository and build apart from those of others; null stays null."""
    return [F.concat(F.col("repo_id").cast("string"), F.lit("|"), F.col("build_no").cast("string"), F.lit("|"), c).alias(c) for c in columns]


@query(
    "resolve_range_join",
    GRAPH_SQL
    + """, sites as (select distinct repo_id, build_no, caller_file, line, callee_name from ce)
select distinct concat_ws('|', c.repo_id::varchar, c.build_no::varchar, c.qualified_name) as caller_qualified, concat_ws('|', k.repo_id::varchar, k.build_no::varchar, k.qualified_name) as callee_qualified
from sites x join fn c on c.repo_id = x.repo_id and c.build_no = x.build_no and c.file = x.caller_file and x.line between c.start_line and c.end_line
join fn k on k.repo_id = x.repo_id and k.build_no = x.build_no and k.name = x.callee_name
where c.qualified_name <> k.qualified_name""",
)
def resolve_range_join(spark, d):
    functions, sites = _resolver_input(spark, d)
    return resolve.resolve(functions, sites).select("caller_qualified", "callee_qualified")


@query(
    "resolve_edges",
    GRAPH_SQL
    + """, sites as (select distinct repo_id, build_no, caller_file, line, callee_name from ce),
pairs as (select distinct c.repo_id, c.build_no, c.qualified_name as p, k.qualified_name as q from sites x
join fn c on c.repo_id = x.repo_id and c.build_no = x.build_no and c.file = x.caller_file and x.line between c.start_line and c.end_line
join fn k on k.repo_id = x.repo_id and k.build_no = x.build_no and k.name = x.callee_name where c.qualified_name <> k.qualified_name),
last as (select repo_id, build_no, qualified_name, arg_max(node_id, (file, node_id)) as id from fn where file is not null group by all)
select a.id as src, b.id as dst, 'CALLS' as label from pairs join last a on a.repo_id = pairs.repo_id and a.build_no = pairs.build_no and a.qualified_name = p
join last b on b.repo_id = pairs.repo_id and b.build_no = pairs.build_no and b.qualified_name = q""",
)
def resolve_edges(spark, d):
    functions, sites = _resolver_input(spark, d)
    functions = functions.where("file is not null")
    return resolve.edge_table(resolve.resolve(functions, sites), functions).select("src", "dst", "label")


def _resolver_input(spark, d):
    functions = code_graph(spark, d).functions.select("node_id", F.col("node_id").alias("ordinal"), *_scoped("name", "qualified_name", "file"), "language", "start_line", "end_line", F.lit(None).cast(f"array<{schema.PARAM}>").alias("parameters"))
    calls = table(spark, d, "call_edges").select(*_scoped("caller_file", "callee_name"), "line")
    return functions, calls.select(F.col("caller_file").alias("file"), "line", F.col("callee_name").alias("called_name"), F.lit(0).alias("arg_count"))


@query(
    "ext_classify",
    """select ext, language, count(*) as n_files from (select ext, case ext when '.go' then 'go' when '.java' then 'java' when '.ts' then 'typescript' when '.tsx' then 'typescript' when '.py' then 'python' else '' end as language
  from (select regexp_extract(file, '(\\.[^./]*)$', 1) as ext from source_files where file is not null)) group by ext, language""",
)
def ext_classify(spark, d):
    f = table(spark, d, "source_files").where("file is not null")
    return f.groupBy(paths.extension(F.col("file")).alias("ext"), paths.language(F.col("file")).alias("language")).agg(F.count(F.lit(1)).alias("n_files"))


@query("skipped_ext", "select ext, count(*) as n_files from (select regexp_extract(file, '(\\.[^./]*)$', 1) as ext from source_files where file is not null) where ext not in ('', '.go', '.java', '.ts', '.tsx', '.py') group by ext")
def skipped_ext(spark, d):
    f = table(spark, d, "source_files").where("file is not null")
    return walk.skipped_extensions(f.select(paths.language(F.col("file")).alias("language"), paths.extension(F.col("file")).alias("ext")))


@query("dirname_module", "select module, count(*) as n_files from (select case when contains(file, '/') then regexp_replace(file, '/[^/]*$', '') else '.' end as module from source_files where file is not null) group by module")
def dirname_module(spark, d):
    return table(spark, d, "source_files").where("file is not null").groupBy(paths.dirname(F.col("file")).alias("module")).agg(F.count(F.lit(1)).alias("n_files"))


@query(
    "walk_filter",
    """select distinct file_id, file from source_files where file is not null
  and not list_has_any(string_split(file, '/')[:-2], ['.git', '.graphloom', 'vendor', 'node_modules', 'dist', 'build', '__pycache__'])
  and not (contains(file, '/') and (starts_with(file, 'vendor') or starts_with(file, 'node_modules') or starts_with(file, '.git') or starts_with(file, 'dist') or starts_with(file, 'build') or starts_with(file, '__pycache__')))
  and not regexp_matches(string_split(file, '/')[-1], '^[^/]*\\.min\\.js$')""",
)
def walk_filter(spark, d):
    f = F.col("file")
    rows = table(spark, d, "source_files").where("file is not null")
    return rows.where(~walk.excluded_dir(f, config.DEFAULT_EXCLUDE, []) & ~walk.ignored_file(f, ["*.min.js"])).select("file_id", "file").distinct()


@query(
    "data_shape",
    """select row_id, p.n as param, p.t as type from (select row_id, unnest(list_transform(parameters, lambda x, i: {'i': i, 'n': case when coalesce(x.name, '') <> '' then x.name else '#' || (i - 1)::varchar end,
    't': case when coalesce(x.type, '') <> '' then x.type else coalesce(x.type_expr, '') end})) as p from (select distinct on (row_id) row_id, parameters from function_snapshots order by row_id, delivered_at desc))
  qualify row_number() over (partition by row_id, p.n order by p.i) = 1""",
)
def data_shape(spark, d):
    rows = table(spark, d, "function_snapshots").groupBy("row_id").agg(F.max_by("parameters", "delivered_at").alias("parameters"))
    text = lambda p, c: F.coalesce(p[c], F.lit("")).alias(c)
    plain = rows.select("row_id", F.transform(F.filter("parameters", lambda p: p.isNotNull()), lambda p: F.struct(text(p, "name"), text(p, "type"), text(p, "type_expr"))).alias("parameters"))
    return plain.select("row_id", F.explode(resolve.data_shape())).toDF("row_id", "param", "type")


def _sources(spark, d):
    """The latest scan of every file, with paths that tell repositories apart."""
    rows = table(spark, d, "source_files").where("file_id is not null and file is not null")
    last = rows.groupBy("file_id").agg(F.max_by(F.struct("repo_id", "file", "content"), "scanned_at").alias("r")).select("r.*")
    path = F.concat(F.coalesce(F.col("repo_id").cast("string"), F.lit("0")), F.lit("/"), "file")
    return last.select(path.alias("path"), paths.language(F.col("file")).alias("language"), F.encode("content", "utf-8").alias("content"))


@query("extract_functions")
def extract_functions(spark, d):
    return frames.function_table(frames.extract_files(_sources(spark, d)))


@query("extract_calls")
def extract_calls(spark, d):
    return frames.call_site_table(frames.extract_files(_sources(spark, d)))


@query("resolve_sources")
def resolve_sources(spark, d):
    extracted = materialize(frames.extract_files(_sources(spark, d)), "extracted")
    functions = frames.function_table(extracted)
    return resolve.edge_table(resolve.resolve(functions, frames.call_site_table(extracted)), functions)


@query("breaks_arity")
def breaks_arity(spark, d):
    extracted = materialize(frames.extract_files(_sources(spark, d)), "extracted")
    return resolve.mismatched_calls(frames.function_table(extracted), frames.call_site_table(extracted))


@query("import_edges")
def import_edges(spark, d):
    extracted = materialize(frames.extract_files(_sources(spark, d)), "extracted")
    return resolve.import_edges(frames.function_table(extracted), frames.import_table(extracted))


# ---------------------------------------------------------------- own source texts and a small graph, with answers written by hand

for _prefix, _language in {"go": "go", "py": "python", "java": "java", "ts": "typescript"}.items():
    query(f"golden_{_language}", goldens.expected_sql(_prefix))(lambda spark, d, p=_prefix: goldens.rendered(spark, p))


@query("golden_calls", goldens.values_sql(goldens.CALLS, ("file", "line", "called_name", "arg_count")))
def golden_calls(spark, d):
    return frames.call_site_table(goldens.project(spark)).select("file", "line", "called_name", "arg_count")


def _golden_pairs(edges, functions):
    names = functions.select(F.col("node_id").alias("id"), "qualified_name")
    both = edges.join(names.toDF("src", "caller"), "src").join(names.toDF("dst", "callee"), "dst")
    return both.select("caller", "callee")


@query("golden_edges", goldens.values_sql(goldens.RESOLVED, ("caller", "callee")))
def golden_edges(spark, d):
    extracted = goldens.project(spark)
    functions = frames.function_table(extracted)
    return _golden_pairs(resolve.edge_table(resolve.resolve(functions, frames.call_site_table(extracted)), functions), functions)


@query("golden_imports", goldens.values_sql(goldens.IMPORTED, ("caller", "callee")))
def golden_imports(spark, d):
    extracted = goldens.project(spark)
    functions = frames.function_table(extracted)
    return _golden_pairs(resolve.import_edges(functions, frames.import_table(extracted)), functions)


@query("golden_breaks", goldens.values_sql(goldens.BROKEN, ("caller", "called_name", "arg_count")))
def golden_breaks(spark, d):
    extracted = goldens.project(spark)
    found = resolve.mismatched_calls(frames.function_table(extracted), frames.call_site_table(extracted))
    return found.select(F.col("caller_qualified").alias("caller"), "called_name", "arg_count")


@query("golden_tools", goldens.values_sql([(i, name, answer) for i, (name, _, answer) in enumerate(goldens.ANSWERS)], ("request", "tool", "answer")))
def golden_tools(spark, d):
    return goldens.asked(spark)


@query("golden_build", goldens.values_sql(goldens.BUILT, ("what", "value")))
def golden_build(spark, d):
    return goldens.built(spark)
