"""Command line: index, query, serve, stats.  Exit 1: wrong usage; 2: no match."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .operators.library import Library
from .plans.engine import Engine
from .sources.recordings import read_files


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="sonagraph", description="Identify recordings by acoustic fingerprints.")
    verbs = parser.add_subparsers(dest="verb")
    for verb, needs in (("index", True), ("query", True), ("stats", False), ("serve", False)):
        sub = verbs.add_parser(verb)
        sub.add_argument("--db", default="fingerprints.db")
        if needs:
            sub.add_argument("path", help="a WAV file, a folder or a glob")
        if verb == "serve":
            sub.add_argument("--port", type=int, default=8080)
    return parser


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = _parser()
    try:
        args = parser.parse_args(argv)
    except SystemExit as e:
        return 1 if e.code else 0
    if args.verb is None:
        parser.print_usage(sys.stderr)
        return 1
    spark = spark or SparkSession.builder.appName("sonagraph").getOrCreate()
    engine = Engine(Library.open(spark, args.db))
    if args.verb == "serve":
        from .service import serve

        serve(engine, args.port)
        return 0
    if args.verb == "stats":
        print(engine.library.stats_text())
        return 0
    files = read_files(spark, args.path)
    if args.verb == "index":
        failed = False
        for row in engine.index(files).toLocalIterator():
            print(f"error: {row['path']}: {row['error']}" if row["error"] else f"indexed {row['name']} (id {row['song_id']}): {row['peaks']} peaks, {row['hashes']} hashes")
            failed |= bool(row["error"])
        return int(failed)
    matched = False
    for row in engine.query(files).toLocalIterator():
        if row["song_id"] is None:
            print(f"no match: {row['path']}" + (f" ({row['error']})" if row["error"] else ""))
        else:
            matched = True
            print(f"match: {row['name']} ({row['votes']} votes, {100 * row['confidence']:.1f} %, at frame {row['alignment_frames']})")
    return 0 if matched else 2


if __name__ == "__main__":
    sys.exit(main())
