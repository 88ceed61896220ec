"""Command line: init, source, index, sync, search, status, doctor."""

from __future__ import annotations

import argparse
import logging
import os
import sys

from pyspark.sql import SparkSession

from .config import Config, ConfigError
from .engine import MODES, Engine
from .output import as_json, as_text, status_text


def _shown(phase: str, done: int, known: int) -> None:
    """A line of progress that the next one overwrites."""
    print(f"\r{phase}: {done} of {known} tasks\033[K", end="\n" if done == known == 1 else "", file=sys.stderr, flush=True)


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    top = argparse.ArgumentParser(prog="gleaner")
    top.add_argument("--base", default=os.path.join(os.path.expanduser("~"), ".gleaner"))
    commands = top.add_subparsers(dest="command", required=True)
    commands.add_parser("init").add_argument("--force", action="store_true")
    source = commands.add_parser("source").add_subparsers(dest="action", required=True)
    add = source.add_parser("add")
    add.add_argument("path")
    add.add_argument("--name", required=True)
    source.add_parser("list")
    source.add_parser("remove").add_argument("name")
    for name in ("index", "sync"):
        p = commands.add_parser(name)
        p.add_argument("--source", default="")
        p.add_argument("-v", "--verbose", action="store_true")
        if name == "index":
            p.add_argument("--full", action="store_true")
    find = commands.add_parser("search")
    find.add_argument("query")
    find.add_argument("--json", action="store_true")
    find.add_argument("-v", "--verbose", action="store_true")
    find.add_argument("--limit", type=int, default=10)
    find.add_argument("--mode", choices=MODES, default="hybrid")
    for name in ("source", "language", "kind", "dir"):
        find.add_argument(f"--{name}", default="")
    commands.add_parser("status")
    commands.add_parser("doctor")
    a = top.parse_args(args)
    verbose = getattr(a, "verbose", False)
    if verbose:
        logging.basicConfig(stream=sys.stderr, format="%(name)s: %(message)s")
        logging.getLogger("gleaner").setLevel(logging.DEBUG)
    spark = spark or SparkSession.builder.appName("gleaner").config("spark.ui.showConsoleProgress", str(not verbose).lower()).getOrCreate()
    engine = None
    try:
        if a.command == "init":
            Engine.init(spark, a.base, a.force)
            return 0
        engine = Engine(spark, Config.load(a.base), _shown if a.command in ("index", "sync") and sys.stderr.isatty() else None)
        if a.command == "source":
            if a.action == "add":
                engine.add_source(a.path, a.name)
            elif a.action == "remove":
                engine.remove_source(a.name)
            else:
                for x in engine.sources():
                    print(f"{x.name}\t{x.path}\t{'enabled' if x.enabled else 'disabled'}")
        elif a.command == "index":
            print(f"Indexed {engine.index(a.full, a.source)['chunk_count']} chunks")
        elif a.command == "sync":
            found = engine.sync(only=a.source)
            print(f"Synced: {found.get('new', 0)} new, {found.get('changed', 0)} changed, {found.get('deleted', 0)} deleted")
        elif a.command == "search":
            response = engine.respond(a.query, a.mode, limit=a.limit, source=a.source, language=a.language, kind=a.kind, directory=a.dir)
            print(as_json(response) if a.json else as_text(response))
        elif a.command == "status":
            print(status_text(engine.status()))
        else:
            for check, state, message, hint in engine.doctor():
                print(f"{state}\t{check}\t{message}" + (f"\t{hint}" if hint else ""))
    except KeyboardInterrupt:
        if engine:
            engine.cancel()
        print("Cancelled", file=sys.stderr)
        return 130
    except (ConfigError, FileNotFoundError, ValueError) as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
