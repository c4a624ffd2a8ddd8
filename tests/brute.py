"""Plain-Python versions of the operators, for comparison on small inputs."""

from __future__ import annotations

import json
import re
from collections import defaultdict


def _load(text):
    def reject(_):
        raise ValueError

    return json.loads(text.lstrip("﻿ \t\r\n"), parse_constant=reject)


def _opened(v):
    if isinstance(v, str) and v.lstrip("﻿ \t\r\n")[:1] in ("{", "["):
        try:
            return _load(v)
        except ValueError:
            return None
    return v


def _listed(v):
    v = _opened(v)
    return v if isinstance(v, list) else [v] if isinstance(v, dict) else []


def shred_cases(rows):
    """rows: (record_id, payload, at) -> set of (record_id, branch, pos, sub_pos)."""
    best = {}
    for key, payload, at in rows:
        if key is None or payload is None:
            continue
        try:
            value = _load(payload)
        except ValueError:
            continue
        rank = (at is not None, at, payload)
        if key not in best or rank > best[key][0]:
            best[key] = (rank, value)
    out = set()
    for key, (_, v) in best.items():
        v = _opened(v)
        if isinstance(v, list):
            v = v[0] if v else None
            v = _opened(v)
        if not isinstance(v, dict):
            continue
        inner = _opened(v.get("record"))
        v = inner if isinstance(inner, dict) else v
        returns = _opened(v.get("returns"))
        values = returns if isinstance(returns, list) else _listed(returns.get("values")) if isinstance(returns, dict) else []
        for branch, items in (("parameters", _listed(v.get("parameters"))), ("returns", values)):
            for i, item in enumerate(items):
                item = _opened(item)
                if isinstance(item, dict):
                    out.add((key, branch, i, -1))
                    out |= {(key, branch, i, j) for j, f in enumerate(_listed(item.get("expanded"))) if isinstance(_opened(f), dict)}
    return out


def _canon_field(f):
    return (f["name"] or "", f["type"] or "", bool(f["nullable"]))


def _canon(params, returns):
    def item(e, variadic):
        return (e["name"] or "", e["type"] or "", e["type_expr"] or "", bool(e["nullable"]), bool(e["variadic"]) if variadic else None, tuple(map(_canon_field, e["expanded"] if e["expanded"] is not None else ())))

    values = tuple(item(e, False) for e in (returns["values"] if returns and returns["values"] is not None else ()))
    return tuple(item(e, True) for e in (params if params is not None else ())), values, bool(values and returns["multiple"])


def snapshot_changes(rows):
    """rows: dicts of the function_snapshots table -> set of (repo_id, qualified_name, snapshot_no, change)."""
    latest, snaps = {}, defaultdict(set)
    for r in rows:
        snaps[r["repo_id"]].add(r["snapshot_no"])
        k = (r["repo_id"], r["snapshot_no"], r["qualified_name"])
        rank = (r["delivered_at"] is not None, r["delivered_at"], r["row_id"])
        if r["qualified_name"] is not None and (k not in latest or rank > latest[k][0]):
            latest[k] = (rank, _canon(r["parameters"], r["returns"]))
    by = defaultdict(dict)
    for (repo, no, name), (_, c) in latest.items():
        by[repo, no][name] = c
    out = set()
    for repo, nos in snaps.items():
        nos = sorted(nos)
        for a, b in zip(nos, nos[1:]):
            old, new = by[repo, a], by[repo, b]
            out |= {(repo, n, b, "added") for n in new.keys() - old.keys()}
            out |= {(repo, n, b, "removed") for n in old.keys() - new.keys()}
            out |= {(repo, n, b, "changed") for n in new.keys() & old.keys() if new[n] != old[n]}
    return out


def _clean(name):
    name = re.sub(r"^[\s﻿]+|[\s﻿]+$", "", name) if name is not None else None
    return name or None


def hierarchy(links):
    """links: (caller, callee) -> {node: (root, depth, state, path)}."""
    parent, nodes = {}, set()
    for a, b in links:
        a, b = _clean(a), _clean(b)
        nodes |= {x for x in (a, b) if x}
        if a and b:
            parent[b] = max(a, parent.get(b, a))
    out = {}
    for n in nodes:
        walk, seen = [n], {n}
        while walk[-1] in parent and parent[walk[-1]] not in seen:
            walk.append(parent[walk[-1]])
            seen.add(walk[-1])
        if walk[-1] not in parent:
            out[n] = (walk[-1], len(walk) - 1, "tree", walk[::-1])
        else:
            loop = walk[walk.index(parent[walk[-1]]) :]
            out[n] = (min(loop, key=lambda s: [*map(ord, s)]), -1, "cycle" if n in loop else "below_cycle", None)
    return out
