"""The stored graph: function and edge tables, read and written as Parquet."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import __version__, schema

SCHEMA_VERSION = 1


class NotFound(LookupError):
    """No function of the asked name."""

    def __init__(self, name: str):
        super().__init__(f'function "{name}" not found')


@dataclass(frozen=True)
class CodeGraph:
    """``functions`` needs node_id, name and what a query shows; ``edges`` src, dst and label.

    Any table with these columns will do; ``with_defaults`` adds those that are absent."""

    functions: DataFrame
    edges: DataFrame
    meta: DataFrame | None = None

    @property
    def spark(self) -> SparkSession:
        return self.functions.sparkSession

    def calls(self) -> DataFrame:
        return self.edges.where(F.col("label") == "CALLS")

    def cached(self) -> CodeGraph:
        """For services that ask many questions of one graph."""
        return replace(self, functions=self.functions.cache(), edges=self.edges.cache())

    @staticmethod
    def with_defaults(functions: DataFrame, edges: DataFrame, meta: DataFrame | None = None) -> CodeGraph:
        have = set(functions.columns)
        text = lambda v: F.lit(v).cast("string")
        defaults = {
            "label": text("Function"), "name": F.col("node_id").cast("string"), "qualified_name": F.col("name") if "name" in have else F.col("node_id").cast("string"), "file": text(""), "module": text(""),
            "start_line": F.lit(0), "end_line": F.lit(0), "ordinal": F.lit(0), "exported": F.lit(False), "is_test": F.lit(False), "contract": text(None), "contract_completeness": text(None),
        }
        out = functions
        for name, value in defaults.items():
            if name not in have:
                out = out.withColumn(name, value)
        # a missing flag counts as false
        out = out.withColumn("is_test", F.coalesce("is_test", F.lit(False)))
        if "tag" not in have:
            out = out.withColumn("tag", F.when(F.col("is_test"), "test").otherwise("application"))
        lines = edges
        if "label" not in edges.columns:
            lines = lines.withColumn("label", F.lit("CALLS"))
        if "edge_id" not in edges.columns:
            lines = lines.withColumn("edge_id", F.xxhash64("src", "dst", "label"))
        if "data_shape" not in edges.columns:
            lines = lines.withColumn("data_shape", F.lit(None).cast("map<string,string>"))
        return CodeGraph(out, lines, meta)

    # ------------------------------------------------------------ storage

    def save(self, path: str) -> None:
        """Full overwrite. Functions are clustered by name and edges by target, so that Parquet's statistics
        skip what a lookup doesn't ask for; a name or target with many rows spreads over several files."""
        self.functions.repartitionByRange("name", "file", "start_line").sortWithinPartitions("name", "file", "start_line", "ordinal").write.mode("overwrite").parquet(f"{path}/functions")
        self.edges.repartitionByRange("dst", "src").sortWithinPartitions("dst", "src").write.mode("overwrite").parquet(f"{path}/edges")
        meta = self.meta if self.meta is not None else graph_meta(self.spark, self.functions)
        meta.coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")

    @staticmethod
    def load(spark: SparkSession, path: str) -> CodeGraph:
        return CodeGraph(spark.read.parquet(f"{path}/functions"), spark.read.parquet(f"{path}/edges"), spark.read.parquet(f"{path}/meta"))

    def add_edges(self, edges: DataFrame) -> CodeGraph:
        return replace(self, edges=self.edges.unionByName(edges, allowMissingColumns=True))

    def add_functions(self, functions: DataFrame) -> CodeGraph:
        return replace(self, functions=self.functions.unionByName(functions, allowMissingColumns=True))

    def node_count(self) -> int:
        """All nodes, the graph's own record included where there is one."""
        return self.functions.count() + (self.meta.count() if self.meta is not None else 0)

    def edge_count(self) -> int:
        return self.edges.count()


def graph_meta(spark: SparkSession, functions: DataFrame, at: dt.datetime | None = None) -> DataFrame:
    """The graph's own record: one row of counts and languages."""
    stamp = at or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    counted = functions.agg(
        F.count(F.lit(1)).alias("function_count"), F.countDistinct("file").alias("file_count"), F.array_sort(F.collect_set("language" if "language" in functions.columns else F.lit(None).cast("string"))).alias("languages")
    )
    return counted.select(F.lit(SCHEMA_VERSION).cast("long").alias("schema_version"), F.lit(__version__).alias("tool_version"), F.lit(stamp).cast("timestamp").alias("build_time"), "function_count", "file_count", "languages")


def info(functions: DataFrame) -> DataFrame:
    """The result columns of function queries."""
    return functions.select(*schema.INFO)
