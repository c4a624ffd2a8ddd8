"""Extraction over a table of files: one Arrow pass gives records and call sites together."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom import schema
from graphloom.extract import LANGUAGES, extract_all
from graphloom.functions.paths import dirname
from graphloom.shipping import ship


def _extractor(strict_parity: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            rows = []
            for path, language, content in zip(files["path"], files["language"], files["content"]):
                records, calls, imports, error = [], [], [], None
                try:
                    text = content.decode("utf-8", "replace") if isinstance(content, (bytes, bytearray)) else content or ""
                    records, calls, imports = extract_all(path, language, text, strict_parity)
                except Exception as e:  # one unreadable file must not end the build
                    error = f"{type(e).__name__}: {e}"[:500]
                rows.append((path, records, calls, imports, error))
            yield pd.DataFrame(rows, columns=["file", "records", "calls", "imports", "error"])

    return run


def extract_files(files: DataFrame, strict_parity: bool = False) -> DataFrame:
    """``(file, records, calls, imports, error)``: one row per supported file."""
    ship(files.sparkSession)
    supported = files.where(F.col("language").isin(*LANGUAGES)).select("path", "language", "content")
    return supported.mapInPandas(_extractor(strict_parity), f"file string, records array<{schema.RECORD}>, calls array<{schema.CALL_SITE}>, imports array<string>, error string")


def qualified(module: Column, receiver: Column, name: Column) -> Column:
    """Qualified name of the stored graph: folder, then receiver and name."""
    return F.concat(module, F.lit("/"), F.when(receiver != "", F.concat(receiver, F.lit("."))).otherwise(""), name)


def function_table(extracted: DataFrame) -> DataFrame:
    """Function nodes with stable ids, module, stored qualified name and contract."""
    rows = extracted.select(F.explode("records").alias("r")).select("r.*")
    module = dirname(F.col("file"))
    out = rows.withColumn("module", module)
    return out.select(
        F.xxhash64("file", "ordinal").alias("node_id"),
        F.lit("Function").alias("label"),
        "name",
        qualified(F.col("module"), F.col("receiver"), F.col("name")).alias("qualified_name"),
        "file",
        F.when(F.col("package") != "", F.col("package")).otherwise(F.col("module")).alias("package"),
        "module",
        "language",
        "start_line",
        "end_line",
        "kind",
        "receiver",
        "exported",
        "tag",
        (F.col("tag") == "test").alias("is_test"),
        "contract_completeness",
        "ordinal",
        "least_args",
        "most_args",
        "parameters",
        "returns",
        F.to_json(F.struct("parameters", "returns")).alias("contract"),
    )


def call_site_table(extracted: DataFrame) -> DataFrame:
    return extracted.select("file", F.explode("calls").alias("c")).select("file", "c.line", "c.called_name", "c.arg_count")


def import_table(extracted: DataFrame) -> DataFrame:
    """``(file, key)`` of every file's imports."""
    return extracted.select("file", F.explode("imports").alias("key"))
