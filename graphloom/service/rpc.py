"""JSON-RPC over lines: one request a line in, one response a line out, one after the other."""

from __future__ import annotations

import json
import sys
from typing import IO

from graphloom import __version__
from graphloom.service.tools import Tools, definitions

PROTOCOL = "2024-11-05"
LINE_LIMIT = 1 << 20


def _text(value: str) -> dict:
    return {"content": [{"type": "text", "text": value}]}


def handle(tools: Tools, request: dict) -> dict:
    """Response to one request. A tool's failure is a result whose text begins with 'Error: '."""
    base = {"jsonrpc": "2.0", "id": request.get("id")}
    method = request.get("method", "")
    if method == "initialize":
        return base | {"result": {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "graphloom", "version": __version__}}}
    if method == "tools/list":
        return base | {"result": {"tools": definitions()}}
    if method == "tools/call":
        params = request.get("params")
        if not isinstance(params, dict) or not isinstance(params.get("name", ""), str):
            return base | {"error": {"code": -32602, "message": "invalid params"}}
        args = params.get("arguments")
        try:
            return base | {"result": _text(json.dumps(tools.call(params.get("name", ""), args if isinstance(args, dict) else {})))}
        except Exception as e:
            return base | {"result": _text(f"Error: {e}")}
    return base | {"error": {"code": -32601, "message": f"method not found: {method}"}}


def serve(tools: Tools, source: IO[str] = sys.stdin, sink: IO[str] = sys.stdout, answer_notifications: bool = True) -> None:
    """Answers until the input ends; blank, overlong and malformed lines are passed over."""
    for line in source:
        if not line.strip() or len(line) > LINE_LIMIT:
            continue
        try:
            request = json.loads(line)
        except ValueError:
            continue
        if not isinstance(request, dict) or (request.get("id") is None and not answer_notifications):
            continue
        sink.write(json.dumps(handle(tools, request)) + "\n")
        sink.flush()
