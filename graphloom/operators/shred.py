"""Deeply nested records to related flat tables, by adjacency-table shredding.

A payload becomes rows ``(key, node, parent, label, ordinal, kind, scalar)``: one per object and one
per scalar member. Object nodes joined with their scalar children and pivoted give one flat table per
entity, each row linked to its parent by key and position.

Parsing stays in the JVM (``VARIANT``); an entire record is shredded by one projection and one explode,
so the only shuffles are the one that removes repeated deliveries and the one of the join.

Defined results
    * null key: the row can't be linked and is left out; null, empty or incomplete payload: no rows.
    * one key delivered more than once: the latest complete payload counts (greatest ``order``
      column, then greatest text).
    * a member given as JSON text counts as what the text holds; an object where a list is expected is a
      list of one; null elements keep their place and give no row; scalars standing in a list of
      objects give no row.
    * a record wrapped in ``{"record": ...}`` or in a list of one counts as the record; of a longer
      list the first object counts.
    * extra members are scalars of their object (nested ones as JSON text) and disturb nothing.
    * a member named twice: the last one counts (a plan of ``adjacency`` that is run on its own needs the session's
      ``spark.sql.variant.allowDuplicateKeys`` for that; ``shred_functions`` sets it while it runs).
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.storage import materialize

NODE_TYPE = "array<struct<node:string,parent:string,label:string,ordinal:int,kind:string,scalar:string>>"


@dataclass(frozen=True)
class Entity:
    """One kind of object: the member lists (or single objects) below it that are entities too."""

    label: str
    scalars: tuple[str, ...] = ()
    children: tuple[Entity, ...] = ()
    single: bool = False  # the member holds one object, not a list
    #: for ``single``: a list standing in its place is the list of this child
    list_is: str | None = None
    tag: str = field(default="", compare=False)


_FIELD = Entity("expanded", ("name", "type", "nullable"), tag="x")
PARAM = Entity("parameters", ("name", "type", "type_expr", "nullable", "variadic"), (_FIELD,), tag="p")
RETURN_VALUE = Entity("values", ("name", "type", "type_expr", "nullable"), (_FIELD,), tag="v")
RETURN_SPEC = Entity("returns", ("multiple",), (RETURN_VALUE,), single=True, list_is="values", tag="r")
FUNCTION_RECORD = Entity(
    "record",
    ("name", "qualified_name", "file", "language", "package", "receiver", "kind", "tag", "start_line", "end_line", "exported", "contract_completeness"),
    (PARAM, RETURN_SPEC),
    tag="f",
)


def _map(v: Column) -> Column:
    return v.try_cast("map<string,variant>")


def _array(v: Column) -> Column:
    return v.try_cast("array<variant>")


def _text(v: Column) -> Column:
    return v.try_cast("string")


def _let(v: Column, f) -> Column:
    """``f(v)`` with ``v`` computed once."""
    return F.transform(F.array(v), f)[0]


def parse_complete(text: Column) -> Column:
    """The JSON value of a text that is one complete JSON document (a byte order mark aside), else null.

    The brackets make text after the document an error, which a streaming parser would not notice."""
    bare = F.regexp_replace(text, "^[\\s\\uFEFF]+", "")
    return _let(_array(F.try_parse_json(F.concat(F.lit("["), bare, F.lit("]")))), lambda items: F.when(F.size(items) == 1, items[0]))


def _inside(v: Column) -> Column:
    """What a member given as JSON text holds, else null; asked only of members that are neither list nor object."""
    return _let(_text(v), lambda t: F.when(t.rlike("^[\\s\\uFEFF]*[\\[{]"), parse_complete(t)))


def _opened(v: Column) -> Column:
    """A member as an object or list, also where it is given as JSON text."""
    return F.when(_array(v).isNotNull() | _map(v).isNotNull(), v).otherwise(_inside(v))


def _list_or_one(v: Column) -> Column:
    return F.coalesce(_array(v), F.when(_map(v).isNotNull(), F.array(v)))


def _as_list(v: Column) -> Column:
    return F.coalesce(_list_or_one(v), _let(_inside(v), _list_or_one), F.expr("cast(array() as array<variant>)"))


def _object_or_first(v: Column) -> Column:
    return F.coalesce(_map(v), _let(_array(v), lambda a: F.when(F.size(a) > 0, _map(a[0]))))


def _as_object(v: Column) -> Column:
    return F.coalesce(_object_or_first(v), _let(_inside(v), _object_or_first))


def _row(node: Column, parent: Column, label: Column, ordinal: Column, kind: str, scalar: Column) -> Column:
    return F.struct(
        node.alias("node"), parent.alias("parent"), label.alias("label"), ordinal.cast("int").alias("ordinal"), F.lit(kind).alias("kind"), scalar.cast("string").alias("scalar")
    )


def _object_nodes(value: Column, entity: Entity, node: Column, parent: Column, ordinal: Column, extra: bool, plain: bool = False) -> Column:
    """All nodes of one object: itself, its scalar members, and those of the entities below. ``plain``: its members are texts."""
    nested = [c.label for c in entity.children]

    def nodes(obj: Column) -> Column:
        scalars = F.transform(
            F.filter(F.map_entries(obj), lambda e: (~e["key"].isin(nested) if nested else F.lit(True)) if extra else e["key"].isin(*entity.scalars)),
            lambda e: _row(F.concat(node, F.lit("."), e["key"]), node, e["key"], F.lit(0), "scalar", e["value"] if plain else _text(e["value"])),
        )
        parts = [F.array(_row(node, parent, F.lit(entity.label), ordinal, "object", F.lit(None))), scalars]
        parts += [_let(obj[child.label], _members_of(child, node, extra)) for child in entity.children]
        return F.when(obj.isNull(), F.array().cast(NODE_TYPE)).otherwise(F.flatten(F.array(*parts)))

    return _let(value, nodes)


def _list_nodes(items: Column, entity: Entity, node: Column, extra: bool) -> Column:
    return F.flatten(
        F.transform(items, lambda v, i: _let(F.concat(node, F.lit("/" + entity.tag), i.cast("string")), lambda own: _object_nodes(_as_object(v), entity, own, node, i, extra)))
    )


def _items_nodes(v: Column, entity: Entity, node: Column, extra: bool) -> Column:
    """Nodes of a member that should be a list of objects.

    A cast to variants builds each of them anew, so a list that is as it should be is opened in one cast down to the
    objects' members; anything else (an object or text in its place, null or odd elements) goes step by step."""
    whole = v.try_cast(f"array<map<string,{'variant' if entity.children else 'string'}>>")
    plain = not entity.children

    def nodes(items: Column) -> Column:
        each = F.transform(items, lambda m, i: _let(F.concat(node, F.lit("/" + entity.tag), i.cast("string")), lambda own: _object_nodes(m, entity, own, node, i, extra, plain)))
        return F.when(items.isNotNull() & ~F.exists(items, lambda m: m.isNull()), F.flatten(each)).otherwise(_list_nodes(_as_list(v), entity, node, extra))

    return _let(whole, nodes)


def _member_nodes(v: Column, entity: Entity, node: Column, extra: bool) -> Column:
    if not entity.single:
        return _items_nodes(v, entity, node, extra)
    standing = next((c for c in entity.children if c.label == entity.list_is), None)

    def nodes(own: Column) -> Column:
        if standing is None:
            return _object_nodes(_as_object(v), entity, own, node, F.lit(0), extra)
        return _let(
            _opened(v),
            lambda w: F.when(
                _array(w).isNotNull(),
                F.concat(F.array(_row(own, node, F.lit(entity.label), F.lit(0), "object", F.lit(None))), _items_nodes(w, standing, own, extra)),
            ).otherwise(_object_nodes(_map(w), entity, own, node, F.lit(0), extra)),
        )

    return _let(F.concat(node, F.lit("/" + entity.tag)), nodes)


def _members_of(child: Entity, node: Column, extra: bool):
    return lambda v: _member_nodes(v, child, node, extra)


def _unwrap(v: Column, wrapper: str) -> Column:
    return _let(_as_object(v), lambda obj: F.coalesce(_as_object(obj[wrapper]), obj))


@contextlib.contextmanager
def _members_named_twice(spark: SparkSession) -> Iterator[None]:
    """While a plan runs in it, the last of two members of one name counts; the session's own setting comes back."""
    name = "spark.sql.variant.allowDuplicateKeys"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def adjacency(
    df: DataFrame, key: str, payload: str, order: str | None = None, entity: Entity = FUNCTION_RECORD, wrapper: str = "record", extra: bool = True
) -> DataFrame:
    """The adjacency table ``(key, node, parent, label, ordinal, kind, scalar)`` of a column of JSON texts.

    Every payload is parsed once, before repeated deliveries meet, and the parsed value goes through that shuffle.
    Without ``extra`` only the scalars that the entities name become rows."""
    rows = df.select(F.col(key).alias("key"), F.col(payload).alias("payload"), (F.col(order) if order else F.lit(None).cast("timestamp")).alias("at"))
    rows = rows.where(F.col("key").isNotNull() & F.col("payload").isNotNull())
    parsed = rows.select("key", "payload", "at", parse_complete(F.col("payload")).alias("v")).where(F.col("v").isNotNull())
    once = parsed.groupBy("key").agg(F.max_by("v", F.struct("at", "payload")).alias("v"))
    record = _unwrap(F.col("v"), wrapper)
    root = F.lit(entity.tag)
    nodes = once.select("key", F.explode(_object_nodes(record, entity, root, F.lit(None).cast("string"), F.lit(0), extra)).alias("n"))
    return nodes.select("key", "n.*")


def entity_table(nodes: DataFrame, entity: Entity) -> DataFrame:
    """One row per object of the entity: ``key, node, parent, ordinal`` and its scalars as columns.

    Both sides of the join are hashed by (key, node), and the pivot's aggregation keeps that partitioning."""
    objects = nodes.where((F.col("kind") == "object") & (F.col("label") == entity.label)).select("key", "node", "parent", "ordinal")
    scalars = nodes.where((F.col("kind") == "scalar") & F.col("label").isin(*entity.scalars)).select(
        F.col("key").alias("_key"), F.col("parent").alias("_node"), F.col("label").alias("_label"), "scalar"
    )
    joined = objects.join(scalars, (F.col("key") == F.col("_key")) & (F.col("node") == F.col("_node")), "left")
    return joined.groupBy("key", "node", "parent", "ordinal").agg(*[F.max(F.when(F.col("_label") == s, F.col("scalar"))).alias(s) for s in entity.scalars])


def shred_functions(df: DataFrame, key: str = "record_id", payload: str = "payload", order: str | None = "extracted_at") -> dict[str, DataFrame]:
    """Tables ``functions``, ``parameters``, ``returns`` and ``expanded`` of function records.

    functions(key, name, ...); parameters(key, pos, name, ...); returns(key, pos, ...);
    expanded(key, branch, pos, sub_pos, ...), where (key, branch, pos) names the parent row."""
    with _members_named_twice(df.sparkSession):
        nodes = materialize(adjacency(df, key, payload, order, extra=False), "nodes", by="kind")
    functions = entity_table(nodes, FUNCTION_RECORD).join(
        entity_table(nodes, RETURN_SPEC).select(F.col("key"), F.col("parent").alias("node"), "multiple"), ["key", "node"], "left"
    )
    parameters = entity_table(nodes, PARAM)
    returns = entity_table(nodes, RETURN_VALUE)
    parents = nodes.where((F.col("kind") == "object") & F.col("label").isin(PARAM.label, RETURN_VALUE.label)).select(
        F.col("key"), F.col("node").alias("parent"), F.when(F.col("label") == PARAM.label, "parameters").otherwise("returns").alias("branch"), F.col("ordinal").alias("pos")
    )
    expanded = entity_table(nodes, _FIELD).join(parents, ["key", "parent"])
    flag = lambda c: F.coalesce(F.col(c) == "true", F.lit(False)).alias(c)
    return {
        "functions": functions.select(
            F.col("key").alias(key),
            *[F.col(s) for s in FUNCTION_RECORD.scalars if s not in ("start_line", "end_line", "exported")],
            F.col("start_line").try_cast("int").alias("start_line"),
            F.col("end_line").try_cast("int").alias("end_line"),
            flag("exported"),
            flag("multiple"),
        ),
        "parameters": parameters.select(F.col("key").alias(key), F.col("ordinal").alias("pos"), "name", "type", "type_expr", flag("nullable"), flag("variadic")),
        "returns": returns.select(F.col("key").alias(key), F.col("ordinal").alias("pos"), "name", "type", "type_expr", flag("nullable")),
        "expanded": expanded.select(F.col("key").alias(key), "branch", "pos", F.col("ordinal").alias("sub_pos"), "name", "type", flag("nullable")),
        "nodes": nodes,
    }


def shredded_cases(tables: dict[str, DataFrame], key: str = "record_id") -> DataFrame:
    """The rows of all child tables as (key, branch, pos, sub_pos)."""
    own = lambda t, branch: tables[t].select(key, F.lit(branch).alias("branch"), "pos", F.lit(-1).alias("sub_pos"))
    return own("parameters", "parameters").unionByName(own("returns", "returns")).unionByName(tables["expanded"].select(key, "branch", "pos", "sub_pos"))
