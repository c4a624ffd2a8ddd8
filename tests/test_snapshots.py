import datetime as dt
import random

import brute
from graphloom.operators.snapshots import contract_hash, snapshot_changes
from pyspark.sql import functions as F

FIELD = "struct<name:string,type:string,nullable:boolean>"
SCHEMA = (
    "row_id bigint, snapshot_no int, delivered_at timestamp, repo_id bigint, qualified_name string, s string, k string, h string, "
    f"parameters array<struct<name:string,type:string,type_expr:string,nullable:boolean,variadic:boolean,expanded:array<{FIELD}>>>, "
    f"returns struct<multiple:boolean,values:array<struct<name:string,type:string,type_expr:string,nullable:boolean,expanded:array<{FIELD}>>>>"
)


def param(name, type=None, type_expr=None, nullable=None, variadic=None, expanded=None):
    return {"name": name, "type": type, "type_expr": type_expr, "nullable": nullable, "variadic": variadic, "expanded": expanded}


def changes(spark, rows):
    df = spark.createDataFrame([{**r, "s": "x", "k": "y", "h": "z"} for r in rows], SCHEMA)
    out = snapshot_changes(df, "repo_id", "qualified_name", "snapshot_no", contract_hash(F.col("parameters"), F.col("returns")), "delivered_at", "row_id").collect()
    assert len(out) == len(set(out))
    return {(r.repo_id, r.qualified_name, r.snapshot_no, r.change) for r in out}


def row(i, repo, no, name, params=None, returns=None, at=1):
    return {"row_id": i, "snapshot_no": no, "delivered_at": dt.datetime(2024, 1, at) if at else None, "repo_id": repo, "qualified_name": name, "parameters": params, "returns": returns}


def test_spellings_of_one_content_are_equal(spark):
    empty = {"multiple": False, "values": []}
    full = [param("a", "", "T", False, False, [])]
    rows = [
        row(1, 1, 1, "f", [param("a", None, "T")], None), row(2, 1, 2, "f", full, empty), row(3, 1, 4, "f", full, {"multiple": True, "values": []}),
        row(4, 1, 5, "f", full, {"multiple": None, "values": None}), row(5, 1, 6, "f", None, None), row(6, 1, 7, "f", [], empty), row(7, 1, 8, "f", [param("")], empty),
    ]
    assert changes(spark, rows) == {(1, "f", 6, "changed"), (1, "f", 8, "changed")}


def test_gaps_returns_and_deliveries(spark):
    rows = [row(1, 1, 1, "a"), row(2, 1, 1, "b"), row(3, 1, 3, "b"), row(4, 1, 5, "a"), row(5, 1, 5, "b", [param("p")], at=3), row(6, 1, 5, "b", at=2), row(7, 1, 5, None), row(8, 2, 9, "a"), row(9, None, 1, "a")]
    assert changes(spark, rows) == {(1, "a", 3, "removed"), (1, "a", 5, "added"), (1, "b", 5, "changed")}


def test_random_against_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for i in range(600):
        params = rng.choice([None, [], [param(rng.choice("ab"), rng.choice([None, "", "T"]), nullable=rng.choice([None, False, True]))]])
        rows.append(row(i, rng.choice([1, 2, None]), rng.randint(1, 6), rng.choice([None, *"abcdef"]), params, at=rng.choice([None, 1, 2, 3])))
    kept = [r for r in rows if r["repo_id"] is not None]
    assert changes(spark, rows) == brute.snapshot_changes(kept)


def test_empty_table(spark):
    assert changes(spark, []) == set()
