"""A tool server over standard input and output: JSON-RPC 2.0, one message a line, as the Model Context Protocol has it.

Five tools ask the engine: assess, search, git_search, explain and file_profile. Nothing but answers is written
to standard output.
"""

from __future__ import annotations

import json
import os
import sys
from collections.abc import Callable
from typing import Any

from strataline.plans import facade as FC
from strataline.schema import DECISION_CLASSES, load_config

PROTOCOL = "2024-11-05"
CONFIG_NAME = ".strataline.json"
GIT_SEARCH_LIMIT = 10


def _string(text: str, **more) -> dict:
    return {"type": "string", "description": text} | more


_REPO = {"repo": _string("Repository root path")}
_LIMIT = {"type": "integer", "minimum": 1, "description": "Maximum number of results"}
TOOLS: dict[str, tuple[str, dict, list[str]]] = {
    "strataline_assess": (
        "What is known to be risky about files before they are changed: stability, ownership, patterns, risk scores.",
        {"files": {"type": "array", "items": {"type": "string"}, "description": "Paths relative to the repository"}, "change_type": _string("feat, fix, refactor, ..."), "query": _string("What the change is about")} | _REPO, ["files"],
    ),
    "strataline_search": ("Code by what it does.", {"query": _string("What to look for"), "limit": _LIMIT, "filter": _string("Only paths with this prefix")} | _REPO, ["query"]),
    "strataline_git_search": (
        "Commits by why and when.",
        {
            "query": _string("What to look for"), "after": _string("Only commits after this date (ISO 8601)"), "before": _string("Only commits before this date (ISO 8601)"), "author": _string("Only this author's"), "file": _string("Only this file's"),
            "type": _string("Only this commit type"), "decision_class": _string("Only this class", enum=list(DECISION_CLASSES)), "limit": _LIMIT, "sort": _string("Order of the hits", enum=["relevance", "date"]), "unique_commits": {"type": "boolean", "description": "One hit per commit"},
        } | _REPO, ["query"],
    ),
    "strataline_explain": ("Code together with the history behind it.", {"query": _string("Symbol, concept or question")} | _REPO, ["query"]),
    "strataline_file_profile": ("Ownership, stability, risk score and active signals of a file.", {"path": _string("Path relative to the repository")} | _REPO, ["path"]),
}


def _rows(df) -> list[dict]:
    return [json.loads(x) for x in df.toJSON().collect()]


class Server:
    """Answers messages. Engines are made once for each repository."""

    def __init__(self, spark_of: Callable[[], Any]):
        self.spark_of, self.engines = spark_of, {}

    def engine(self, repo: str | None) -> FC.Engine:
        path = os.path.abspath(repo or os.environ.get("STRATALINE_REPO") or os.getcwd())
        if path not in self.engines:
            self.engines[path] = FC.Engine(self.spark_of(), path, load_config(os.path.join(path, CONFIG_NAME)))
        return self.engines[path]

    def call(self, name: str, a: dict) -> Any:
        e = self.engine(a.get("repo"))
        if name == "strataline_assess":
            r = e.assess(a["files"], a.get("change_type"), a.get("query"))
            return {n: _rows(getattr(r, n)) for n in ("warnings", "file_profiles", "signals", "owners")}
        if name == "strataline_search":
            return {"query": a["query"], "results": _rows(e.search(a["query"], a.get("limit"), a.get("filter")))}
        if name == "strataline_git_search":
            conditions = {k: a.get(v) for k, v in (("after", "after"), ("before", "before"), ("author", "author"), ("file", "file"), ("commit_type", "type"), ("decision_class", "decision_class"))}
            hits = e.search_history(a["query"], a.get("limit") or GIT_SEARCH_LIMIT, a.get("sort") or "relevance", bool(a.get("unique_commits")), **conditions)
            return {"query": a["query"], "results": _rows(hits)}
        if name == "strataline_explain":
            code, per_file, history = e.explain(a["query"])
            return {"query": a["query"], "code": _rows(code), "file_history": _rows(per_file), "history": _rows(history)}
        found = _rows(e.file_profile(a["path"]))
        return found[0] if found else {"error": f"No profile found for {a['path']}. Run 'analyze' first."}

    def answer(self, message: Any) -> dict | None:
        """The response to one message; None for notifications."""
        if not isinstance(message, dict) or message.get("jsonrpc") != "2.0" or not isinstance(message.get("method"), str):
            return _error(message.get("id") if isinstance(message, dict) else None, -32600, "invalid request")
        number, method, params = message.get("id"), message["method"], message.get("params") or {}
        if "id" not in message:
            return None
        if method == "initialize":
            return _result(number, {"protocolVersion": params.get("protocolVersion") or PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "strataline", "version": "0.1.0"}})
        if method == "ping":
            return _result(number, {})
        if method == "tools/list":
            return _result(number, {"tools": [{"name": n, "description": text, "inputSchema": {"type": "object", "properties": given, "required": needed}} for n, (text, given, needed) in TOOLS.items()]})
        if method != "tools/call":
            return _error(number, -32601, f"unknown method: {method}")
        name, a = params.get("name"), params.get("arguments") or {}
        if name not in TOOLS:
            return _error(number, -32602, f"unknown tool: {name}")
        if wrong := misfit(TOOLS[name], a):
            return _error(number, -32602, wrong)
        try:
            text, failed = json.dumps(self.call(name, a), indent=2, ensure_ascii=False), False
        except Exception as e:  # noqa: BLE001 - a tool's failure is its answer; the server goes on
            text, failed = str(e), True
        return _result(number, {"content": [{"type": "text", "text": text}]} | ({"isError": True} if failed else {}))


_KINDS = {"string": str, "integer": int, "boolean": bool, "array": list}


def misfit(tool: tuple[str, dict, list[str]], given: dict) -> str | None:
    """What is wrong with a tool's arguments, if anything."""
    _, known, needed = tool
    if missing := [k for k in needed if given.get(k) is None]:
        return f"missing: {', '.join(missing)}"
    for k, v in given.items():
        if k in known and v is not None:
            kind = known[k]
            if not isinstance(v, _KINDS[kind["type"]]) or (kind["type"] == "integer" and isinstance(v, bool)) or v not in kind.get("enum", [v]) or (kind["type"] == "array" and not all(isinstance(x, str) for x in v)):
                return f"wrong value for {k}"
    return None


def _result(number, result: dict) -> dict:
    return {"jsonrpc": "2.0", "id": number, "result": result}


def _error(number, code: int, text: str) -> dict:
    return {"jsonrpc": "2.0", "id": number, "error": {"code": code, "message": text}}


def serve(server: Server, lines, out) -> None:
    for line in lines:
        if not line.strip():
            continue
        try:
            message = json.loads(line)
        except ValueError:
            reply = _error(None, -32700, "not JSON")
        else:
            reply = [r for r in map(server.answer, message) if r] if isinstance(message, list) else server.answer(message)
        if reply:
            out.write(json.dumps(reply, ensure_ascii=False) + "\n")
            out.flush()


def main() -> None:
    out, sys.stdout = sys.stdout, sys.stderr  # whatever else prints must not disturb the protocol

    def spark():
        from pyspark.sql import SparkSession

        return SparkSession.builder.appName("strataline-tools").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()

    serve(Server(spark), sys.stdin, out)


if __name__ == "__main__":
    main()
