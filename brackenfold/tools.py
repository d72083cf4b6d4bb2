"""The engine's calls as tools with JSON results, shared by the command line and the server."""

from __future__ import annotations

import json
from collections.abc import Callable

from brackenfold.rag import RagEngine

# Names and parameters of the tools.
TOOLS = {
    "index_path": {"path": "string"},
    "index_text": {"text": "string", "source": "string"},
    "search": {"query": "string", "top_k": "integer?"},
    "delete_source": {"source_path": "string"},
    "document_status": {"source_path": "string"},
}


def index_path(engine: RagEngine, path: str | list[str]) -> dict:
    rows = engine.index_path(path)
    counts = {r["status"]: r["count"] for r in rows.groupBy("status").count().collect()}
    details = []
    for r in rows.orderBy("source").toLocalIterator():
        if r["status"] == "indexed":
            details.append(f"{r['source']}: {r['chunks']} chunks")
        elif r["status"] == "failed":
            details.append(f"{r['source']}: {r['error']}")
    return {"status": "completed", "indexed": counts.get("indexed", 0), "skipped": counts.get("skipped", 0), "details": details}


def index_text(engine: RagEngine, text: str, source: str) -> dict:
    row = engine.index_text(text, source).first()
    return {"status": row["status"], "source": source, "chunks": row["chunks"]}


def search(engine: RagEngine, query: str, top_k: int | None = None, source: str | None = None) -> dict:
    rows = engine.search(query, 5 if top_k is None else top_k, source).collect()
    results = [{"rank": r["rank"], "score": r["score"], "source": r["source"], "chunk_index": r["chunk_index"], "text": r["text"]} for r in rows]
    return {"count": len(results), "results": results}


def delete_source(engine: RagEngine, source_path: str) -> dict:
    engine.delete_source(source_path)
    return {"status": "deleted", "source": source_path}


def document_status(engine: RagEngine, source_path: str) -> dict:
    found = engine.document_status(source_path) or {}
    return {"found": bool(found), "source": source_path, **{k: found.get(k) for k in ("content_hash", "indexed_at", "chunk_count")}}


CALLS: dict[str, Callable[..., dict]] = {"index_path": index_path, "index_text": index_text, "search": search, "delete_source": delete_source, "document_status": document_status}


def schema(name: str) -> dict:
    properties, required = {}, []
    for p, kind in TOOLS[name].items():
        if kind.endswith("?"):
            properties[p] = {"anyOf": [{"type": kind[:-1]}, {"type": "null"}]}
        else:
            properties[p] = {"type": kind}
            required.append(p)
    return {"name": name, "inputSchema": {"type": "object", "properties": properties, "required": required}}


def handle(engine: RagEngine, request: dict) -> dict | None:
    """One JSON-RPC request; None for notifications."""
    method, rid, params = request.get("method"), request.get("id"), request.get("params") or {}
    if rid is None:
        return None

    def error(code: int, message: str) -> dict:
        return {"jsonrpc": "2.0", "id": rid, "error": {"code": code, "message": message}}

    if method == "initialize":
        result = {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "brackenfold", "version": "0.1.0"}}
    elif method == "ping":
        result = {}
    elif method == "tools/list":
        result = {"tools": [schema(n) for n in TOOLS]}
    elif method == "tools/call":
        name, given = params.get("name"), params.get("arguments") or {}
        if name not in CALLS:
            return error(-32602, f"unknown tool {name}")
        wrong = set(given) - set(TOOLS[name]) or {p for p, k in TOOLS[name].items() if not k.endswith("?")} - set(given)
        if wrong:
            return error(-32602, f"wrong parameters: {', '.join(sorted(wrong))}")
        if name == "index_path":
            from brackenfold.sources.files import existing

            if not existing(engine.spark, [given["path"]]):
                return error(-32602, f"no such path: {given['path']}")
        try:
            result = {"content": [{"type": "text", "text": json.dumps(CALLS[name](engine, **given), ensure_ascii=False)}]}
        except Exception as e:  # noqa: BLE001
            return error(-32603, str(e)[:1000])
    else:
        return error(-32601, f"unknown method {method}")
    return {"jsonrpc": "2.0", "id": rid, "result": result}


def serve(engine: RagEngine, lines, out) -> None:
    """A request per line in, a response per line out."""
    for line in lines:
        if not line.strip():
            continue
        try:
            answer = handle(engine, json.loads(line))
        except ValueError as e:
            answer = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": str(e)}}
        if answer is not None:
            out.write(json.dumps(answer, ensure_ascii=False) + "\n")
            out.flush()


def format_results(results: list[dict]) -> str:
    if not results:
        return "No results found."
    return "\n".join(f"[{r['rank']}] (score: {r['score']:.4f}) [{r['source']}:{r['chunk_index']}] {r['text']}" for r in results)
