import datetime as dt
import json

import brute
from graphloom.operators.shred import shred_functions, shredded_cases

P = [{"name": "a", "type": "T", "expanded": [{"name": "x", "type": "int"}, None, {"name": "y"}]}, None, {"name": "b"}]
R = {"values": [{"type": "int"}, {"type": "T", "expanded": {"name": "z"}}], "multiple": True}
REC = {"name": "f", "qualified_name": "m.f", "file": "m.py", "start_line": 3, "end_line": 9, "exported": True, "parameters": P, "returns": R, "extra": {"deep": [1, {"parameters": []}]}}

PAYLOADS = {
    1: json.dumps(REC),
    2: "﻿" + json.dumps({"schema": 2, "record": REC}, indent=2),
    3: json.dumps(REC | {"parameters": json.dumps(P), "returns": json.dumps(R)}),
    4: json.dumps(REC | {"parameters": P[0], "returns": R["values"]}),
    5: json.dumps([REC]),
    6: json.dumps(REC)[:-40],
    7: "",
    8: "null",
    9: json.dumps({"name": "g"}),
    10: json.dumps(REC | {"parameters": [], "returns": {}}),
    11: json.dumps(REC) + " trailing",
    12: json.dumps(REC | {"parameters": None, "returns": None}),
    13: '{"name": "h", "name": "k", "parameters": [{"name": "p"}]}',
    14: json.dumps(json.dumps(REC)),
    15: json.dumps(REC | {"parameters": "", "returns": "not json"}),
    16: json.dumps(REC | {"parameters": [json.dumps(P[0]), "text", 3, True]}),
    17: json.dumps({"name": "long", "parameters": [{"name": f"p{i}", "type": "x" * 500} for i in range(400)]}),
}


def frame(spark, rows):
    return spark.createDataFrame(rows, "record_id bigint, payload string, extracted_at timestamp, key string, node string, scalar int")


def cases(spark, rows):
    out = shredded_cases(shred_functions(frame(spark, rows))).collect()
    assert len(out) == len(set(out))
    return {tuple(r) for r in out}


def test_layouts_match_brute_force(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [(k, p, at, "clash", "clash", 1) for k, p in PAYLOADS.items()]
    rows += [(1, PAYLOADS[1], at, None, None, None), (None, PAYLOADS[1], at, None, None, None), (20, None, None, None, None, None)]
    rows += [(21, PAYLOADS[9], at, "", "", 0), (21, PAYLOADS[1], dt.datetime(2024, 2, 1), "", "", 0), (22, PAYLOADS[1], at, "", "", 0), (22, PAYLOADS[6], dt.datetime(2024, 2, 1), "", "", 0)]
    got = cases(spark, rows)
    assert got == brute.shred_cases([r[:3] for r in rows])
    assert (1, "parameters", 0, 2) in got and (1, "parameters", 1, -1) not in got and (4, "returns", 1, 0) in got
    assert not any(k in (6, 7, 8, 9, 11) for k, *_ in got)
    assert (22, "parameters", 0, -1) in got  # the later delivery is cut off


def test_flat_tables_link_to_parents(spark):
    t = shred_functions(frame(spark, [(1, PAYLOADS[2], None, None, None, None), (13, PAYLOADS[13], None, None, None, None)]))
    f = {r.record_id: r for r in t["functions"].collect()}
    assert f[1].name == "f" and f[1].start_line == 3 and f[1].exported and f[1].multiple
    assert f[13].name == "k" and f[13].end_line is None and not f[13].exported
    p = {r.pos: r for r in t["parameters"].where("record_id = 1").collect()}
    assert p[0].type == "T" and p[2].name == "b" and p[2].type is None
    x = {(r.branch, r.pos, r.sub_pos): r.name for r in t["expanded"].collect()}
    assert x == {("parameters", 0, 0): "x", ("parameters", 0, 2): "y", ("returns", 1, 0): "z"}


def test_empty_table(spark):
    assert cases(spark, []) == set()
