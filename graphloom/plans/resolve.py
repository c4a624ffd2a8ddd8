"""Call resolution: call sites and function spans to call edges, with joins only.

A call belongs to every function of its file whose lines contain it (equality on the file plus a range), and
goes to every function of that name, whatever its file or language. Call sites are reduced to distinct
(caller, called name) pairs before they fan out over homonyms, so a hot name costs its distinct callers,
not its calls; adaptive execution splits what skew remains."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def enclosing_calls(functions: DataFrame, call_sites: DataFrame) -> DataFrame:
    """(caller columns, called_name, line, arg_count) of each call and function around it."""
    spans = functions.select(F.col("file").alias("_file"), F.col("name").alias("caller_name"), F.col("qualified_name").alias("caller_qualified"), F.col("language").alias("caller_language"), "start_line", "end_line")
    within = (F.col("file") == F.col("_file")) & F.col("line").between(F.col("start_line"), F.col("end_line"))
    return call_sites.join(spans, within).select(F.col("file").alias("caller_file"), "caller_name", "caller_qualified", "caller_language", "called_name", "line", "arg_count")


def resolve(functions: DataFrame, call_sites: DataFrame, same_language: bool = False) -> DataFrame:
    """Call edges (caller_file, caller_name, caller_qualified, callee_file, callee_name, callee_qualified),
    one per pair of qualified names, without self calls; the first pair in file and line order stays."""
    # both sides are reduced to distinct qualified names before they fan out over homonyms
    calls = enclosing_calls(functions, call_sites).groupBy("caller_qualified", "caller_language", "called_name").agg(F.min(F.struct("caller_file", "line", "caller_name")).alias("caller"))
    targets = functions.groupBy(F.col("qualified_name").alias("callee_qualified"), F.col("language").alias("callee_language"), F.col("name").alias("callee_name")).agg(
        F.min(F.struct(F.col("file").alias("callee_file"), F.col("start_line").alias("callee_line"))).alias("callee")
    )
    on = F.col("called_name") == F.col("callee_name")
    if same_language:
        on = on & (F.col("caller_language") == F.col("callee_language"))
    pairs = calls.join(targets, on).where(F.col("caller_qualified") != F.col("callee_qualified"))
    first = F.min(F.struct("caller.caller_file", "caller.line", "caller.caller_name", "callee.callee_file", "callee.callee_line", "callee_name")).alias("e")
    edges = pairs.groupBy("caller_qualified", "callee_qualified").agg(first)
    return edges.select("e.caller_file", "e.caller_name", "caller_qualified", "e.callee_file", "e.callee_name", "callee_qualified")


def last_ids(functions: DataFrame) -> DataFrame:
    """Qualified name to node id; of several functions of one name the last counts."""
    return functions.groupBy("qualified_name").agg(F.max_by("node_id", F.struct("file", "ordinal")).alias("node_id"))


def edge_table(call_edges: DataFrame, functions: DataFrame, label: str = "CALLS") -> DataFrame:
    """Edges between node ids; the callee's parameter types are the edge's data shape."""
    ids = last_ids(functions)
    shapes = functions.select(F.col("node_id").alias("dst"), data_shape().alias("data_shape"))
    joined = (
        call_edges.join(ids.select(F.col("qualified_name").alias("caller_qualified"), F.col("node_id").alias("src")), "caller_qualified")
        .join(ids.select(F.col("qualified_name").alias("callee_qualified"), F.col("node_id").alias("dst")), "callee_qualified")
        .join(shapes, "dst")
    )
    return joined.select(F.xxhash64("src", "dst", F.lit(label)).alias("edge_id"), "src", "dst", F.lit(label).alias("label"), "data_shape")


def data_shape():
    """Parameter name to type (or type expression) of a function's contract; unnamed ones by position."""
    named = F.transform("parameters", lambda p, i: F.struct(F.when(p["name"] != "", p["name"]).otherwise(F.concat(F.lit("#"), i.cast("string"))), F.when(p["type"] != "", p["type"]).otherwise(p["type_expr"])))
    unique = F.aggregate(named, F.expr("cast(array() as array<struct<col1:string,col2:string>>)"), lambda acc, x: F.when(F.exists(acc, lambda y: y["col1"] == x["col1"]), acc).otherwise(F.concat(acc, F.array(F.struct(x["col1"].alias("col1"), x["col2"].alias("col2"))))))
    return F.map_from_entries(unique)


def import_edges(functions: DataFrame, imports: DataFrame) -> DataFrame:
    """IMPORTS edges: the first function of each importing file to the exported functions it imports.

    ``imports`` holds (file, key) as the extractors give them. An import reaches the functions of the file, folder
    or package that its key names; one that names code outside the project reaches none."""
    by_file = Window.partitionBy("file").orderBy("start_line", "ordinal")
    heads = functions.withColumn("_n", F.row_number().over(by_file)).where("_n = 1").select("file", F.col("node_id").alias("src"))
    keys = F.array(
        F.concat(F.lit("file:"), F.regexp_replace("file", "\\.[^./]*$", "")),
        F.concat(F.lit("dir:"), F.col("module")),
        F.when((F.col("language") == "java") & (F.col("package") != ""), F.concat(F.lit("pkg:"), F.col("package"))),
    )
    targets = functions.where("exported").select(F.explode(keys).alias("key"), F.col("node_id").alias("dst"))
    pairs = imports.distinct().join(targets, "key").join(heads, "file").where("src <> dst").select("src", "dst").distinct()
    return pairs.select(F.xxhash64("src", "dst", F.lit("IMPORTS")).alias("edge_id"), "src", "dst", F.lit("IMPORTS").alias("label"), F.lit(None).cast("map<string,string>").alias("data_shape"))


def mismatched_calls(functions: DataFrame, call_sites: DataFrame) -> DataFrame:
    """Calls whose number of arguments no function of the called name takes; defaults and open ends count as such.

    Functions are reduced to one interval per name and number first, so a hot name joins as one row for each of its few forms."""
    forms = functions.select(F.col("name").alias("called_name"), "least_args", "most_args").distinct()
    bounds = forms.groupBy("called_name").agg(F.array_sort(F.collect_set(F.struct("least_args", "most_args"))).alias("forms"))
    calls = enclosing_calls(functions, call_sites).join(bounds, "called_name")
    takes = F.exists("forms", lambda f: (F.col("arg_count") >= f["least_args"]) & (f["most_args"].isNull() | (F.col("arg_count") <= f["most_args"])))
    least, most = F.array_min(F.transform("forms", lambda f: f["least_args"])), F.when(~F.exists("forms", lambda f: f["most_args"].isNull()), F.array_max(F.transform("forms", lambda f: f["most_args"])))
    return calls.where(~takes).select("caller_file", "caller_qualified", "called_name", "line", "arg_count", least.alias("least"), most.alias("most"))
