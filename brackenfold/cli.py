"""python -m brackenfold.cli serve | index | search | sources | stats | delete | models"""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import SparkSession

from brackenfold import tools
from brackenfold.functions.embed import MODELS
from brackenfold.rag import RagEngine


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="brackenfold")
    sub = top.add_subparsers(dest="command", required=True)
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("--db-path", default=".rag-db")
    common.add_argument("--cache-path", default=".rag-cache")
    common.add_argument("--model", default="Xenova/bge-small-en-v1.5")
    common.add_argument("--chunk-size", type=int, default=512)
    common.add_argument("--overlap", type=int, default=64)
    common.add_argument("--ef-construction", type=int, default=150)
    sub.add_parser("serve", parents=[common])
    sub.add_parser("index", parents=[common]).add_argument("paths", nargs="+")
    search = sub.add_parser("search", parents=[common])
    search.add_argument("query", nargs="+")
    search.add_argument("--top-k", type=int, default=5)
    search.add_argument("--source")
    sub.add_parser("sources", parents=[common])
    sub.add_parser("stats", parents=[common])
    sub.add_parser("delete", parents=[common]).add_argument("source")
    sub.add_parser("models")
    return top


def run(args: argparse.Namespace, spark: SparkSession | None, out=sys.stdout) -> int:
    say = lambda x: print(x, file=out)
    if args.command == "models":
        for m in MODELS:
            say(m)
        return 0
    engine = RagEngine.open(spark, args.db_path, embedder=args.model, chunk_size=args.chunk_size, overlap=args.overlap)
    if args.command == "serve":
        tools.serve(engine, sys.stdin, out)
    elif args.command == "index":
        done = tools.index_path(engine, args.paths)
        for line in done["details"]:
            say(line)
        say(f"Indexed: {done['indexed']}, skipped: {done['skipped']}")
    elif args.command == "search":
        say(tools.format_results(tools.search(engine, " ".join(args.query), args.top_k, args.source)["results"]))
    elif args.command == "sources":
        found = engine.list_sources()
        say("\n".join(found) if found else "No indexed sources.")
    elif args.command == "stats":
        stats, found = engine.stats(), engine.list_sources()
        say(f"Indexed chunks: {stats['live_chunk_count']}\nIndexed sources: {len(found)}")
        for x in found:
            say(f"  - {x}")
    elif args.command == "delete":
        engine.delete_source(args.source)
        say(f"Deleted: {args.source}")
    return 0


def main() -> int:
    logging.basicConfig(stream=sys.stderr)
    args = parser().parse_args()
    spark = None if args.command == "models" else SparkSession.builder.appName("brackenfold").getOrCreate()
    return run(args, spark)


if __name__ == "__main__":
    sys.exit(main())
