"""A tool server: JSON-RPC 2.0, one message a line, and a command line over the same calls."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession

from tessella.operators import report
from tessella.operators.semantic import EMBEDDERS, HashEmbedder
from tessella.plans import index as I
from tessella.session import session
from tessella.sources import files as sources

MOST = 100
TOOLS = {
    "search": ("Find blocks for a text query", {"query": "string", "path": "string", "n": "integer"}, ["query"]),
    "similar": ("Find blocks like file#name or file:line", {"reference": "string", "path": "string", "n": "integer"}, ["reference"]),
    "status": ("Say how many files and blocks the index has", {"path": "string"}, []),
}


class Server:
    """Answers messages; the index of a call's path is brought up to date before a search."""

    def __init__(self, spark: SparkSession, root: str = "."):
        self.spark, self.root = spark, root

    def _index(self, path: str | None) -> tuple[str, I.Index]:
        root = I.find_index(path or self.root)
        if root is None:
            raise LookupError("no index; build one first")
        return root, I.Index.of_tree(self.spark, root, embedder=HashEmbedder())

    def call(self, name: str, args: dict) -> str:
        root, index = self._index(args.get("path"))
        n = max(1, min(int(args.get("n", 10)), MOST))
        if name == "status":
            return json.dumps(index.status(sources.scan(self.spark, root)).first().asDict())
        if name == "similar":
            ref = I.parse_tool_reference(args["reference"])
            found = index.similar(I.Reference(os.path.relpath(os.path.join(self.root, ref.path), root), ref.name, ref.line), n)
        else:
            index.refresh(root)
            scope = os.path.relpath(args.get("path") or root, root)
            found = index.search(args["query"], n, scope)
        return report.as_markdown(found).first()["markdown"] or "No results"

    def answer(self, line: str) -> str | None:
        """The reply to one message; None for a notification."""
        try:
            message = json.loads(line)
        except ValueError:
            return self._error(None, -32700, "not JSON")
        id_ = message.get("id") if isinstance(message, dict) else None
        if id_ is None:
            return None
        method, params = message.get("method"), message.get("params") or {}
        if method == "initialize":
            return self._result(id_, {"protocolVersion": "2024-11-05", "capabilities": {"tools": {}}, "serverInfo": {"name": "tessella", "version": "1"}})
        if method == "tools/list":
            tools = [
                {"name": k, "description": d, "inputSchema": {"type": "object", "properties": {p: {"type": t} for p, t in props.items()}, "required": need}}
                for k, (d, props, need) in TOOLS.items()
            ]
            return self._result(id_, {"tools": tools})
        if method != "tools/call":
            return self._error(id_, -32601, f"no such method: {method}")
        name, args = params.get("name"), params.get("arguments") or {}
        if name not in TOOLS or any(a not in args for a in TOOLS[name][2]):
            return self._error(id_, -32602, f"wrong call of {name}")
        try:
            return self._result(id_, {"content": [{"type": "text", "text": self.call(name, args)}]})
        except (LookupError, ValueError, OSError) as e:
            return self._error(id_, -32000, str(e))

    @staticmethod
    def _result(id_, result) -> str:
        return json.dumps({"jsonrpc": "2.0", "id": id_, "result": result})

    @staticmethod
    def _error(id_, code: int, text: str) -> str:
        return json.dumps({"jsonrpc": "2.0", "id": id_, "error": {"code": code, "message": text}})

    def run(self, lines=sys.stdin, out=sys.stdout) -> None:
        for line in lines:
            reply = self.answer(line) if line.strip() else None
            if reply:
                print(reply, file=out, flush=True)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0: found, 1: nothing found, 2: error."""
    p = argparse.ArgumentParser(prog="tessella")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("search", "build", "status", "clean", "list", "outline", "model", "serve"):
        c = sub.add_parser(name)
        if name == "search":
            c.add_argument("query")
            c.add_argument("-n", type=int, default=10)
            c.add_argument("--threshold", type=float, default=0.0)
            c.add_argument("-j", "--json", action="store_true")
            c.add_argument("-l", "--files-only", action="store_true")
            c.add_argument("--no-content", action="store_true")
            c.add_argument("-t", "--types")
            c.add_argument("--exclude", action="append")
            c.add_argument("--code-only", action="store_true")
            c.add_argument("--no-index", action="store_true")
            c.add_argument("-C", "--context", type=int, default=5)
            c.add_argument("-e", "--regex")
        c.add_argument("path", nargs="?", default=".")
        if name == "build":
            c.add_argument("--force", action="store_true")
        if name == "clean":
            c.add_argument("--recursive", action="store_true")
    a = p.parse_args(argv)
    spark = spark or session()
    try:
        return _run(spark, a)
    except (LookupError, ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


def _run(spark: SparkSession, a: argparse.Namespace) -> int:
    options = {"embedder": HashEmbedder()}
    if a.command == "build":
        print(json.dumps(I.build_tree(spark, a.path, a.force, **options)))
        return 0
    if a.command == "clean":
        print("\n".join(I.clean_tree(spark, a.path, a.recursive, **options)))
        return 0
    if a.command == "list":
        for x in I.list_indexes(spark, a.path):
            print(x["path"], "needs rebuild" if x["blocks"] is None else x["blocks"])
        return 0
    if a.command == "model":
        print("\n".join(f"{name}: {' '.join((kind.__doc__ or '').split())}" for name, kind in EMBEDDERS.items()))
        return 0
    if a.command == "serve":
        Server(spark, a.path).run()
        return 0
    root = I.find_index(a.path)
    if root is None:
        if a.command != "search" or not I.auto_build():
            raise LookupError(f"no index for {a.path}; build one first")
        I.build_tree(spark, a.path, **options)
        root = I.find_index(a.path)
    index = I.Index.of_tree(spark, root, **options)
    scope = os.path.relpath(os.path.abspath(a.path), root)
    if a.command == "status":
        print(json.dumps(index.status(sources.scan(spark, root)).first().asDict()))
        return 0
    if a.command == "outline":
        for r in index.outline(None if scope == "." else scope).orderBy("file").toLocalIterator():
            print(json.dumps({"file": r["file"], "blocks": [b.asDict() for b in r["blocks"]]}))
        return 0
    ref = I.parse_reference(a.query, lambda p: os.path.isfile(os.path.join(root, p)))
    if ref is not None:
        found = index.similar(ref, a.n, boost=True)
    else:
        if not a.no_index:
            index.refresh(root)
        found = index.search(a.query, a.n, scope, a.threshold, a.types, a.exclude, a.code_only, a.regex)
    if a.files_only:
        out = [r["file"] for r in report.files_only(found).collect()]
    elif a.json:
        out = [r["json"] for r in report.as_json(found, not a.no_content).orderBy("rank").collect()]
    else:
        out = [r["text"] for r in report.as_lines(found, 0 if a.no_content else a.context, with_score=ref is not None).orderBy("rank").collect()]
    print("[" + ",\n".join(out) + "]" if a.json else "\n".join(out))
    return 0 if out else 1


if __name__ == "__main__":
    sys.exit(main())
