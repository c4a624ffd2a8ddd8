"""Registered queries of the text operators: name -> callable(spark, folder) -> DataFrame, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.llm import leakage, packing, sentences, source_filter
from graphloom.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# ---------------------------------------------------------------- 4 source files


def _excluded(spark, d):
    return source_filter.excluded_folders(table(spark, d, "repo_configs"))


@query("p4_found")
def p4_found(spark, d):
    return source_filter.not_hand_written(table(spark, d, "source_files"), excluded=_excluded(spark, d)).select("file_id")


@query("p4_kinds")
def p4_kinds(spark, d):
    return source_filter.classify(table(spark, d, "source_files"), excluded=_excluded(spark, d)).groupBy("kind").agg(F.count(F.lit(1)).alias("n_files"))


@query(
    "p4_excluded",
    """
with latest as (select repo_id, arg_max(exclude, (coalesce(version, -1), coalesce(updated_at, timestamp '1900-01-01'))) as exclude
  from repo_configs where repo_id is not null group by repo_id)
select distinct repo_id, folder from (
  select repo_id, regexp_replace(regexp_replace(trim(e), '^(\\./)+', ''), '/+$', '') as folder
  from (select repo_id, unnest(exclude) as e from latest)) where folder <> ''""",
)
def p4_excluded(spark, d):
    return _excluded(spark, d)


# ---------------------------------------------------------------- 6 packing


@query("p6_packing")
def p6_packing(spark, d):
    return packing.pack(table(spark, d, "documents"), table(spark, d, "pack_sizes"))


@query("p6_report")
def p6_report(spark, d):
    placed = packing.pack(table(spark, d, "documents"), table(spark, d, "pack_sizes"))
    return packing.fill_report(placed, table(spark, d, "pack_sizes"))


# ---------------------------------------------------------------- 7 leakage


@query("p7_found")
def p7_found(spark, d):
    return leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"), slack=None)


@query("p7_report")
def p7_report(spark, d):
    items = table(spark, d, "eval_items")
    return leakage.leak_report(leakage.leaked_items(table(spark, d, "documents"), items, slack=None), items)


# ---------------------------------------------------------------- 8 sentences


@query("p8_found")
def p8_found(spark, d):
    return sentences.sentences(table(spark, d, "documents"))
