"""Command line: init, generate, estimate, validate, pack."""

from __future__ import annotations

import argparse
import os
import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession

import lodestrata
from lodestrata.functions import outline
from lodestrata.operators import trees
from lodestrata.plans import pack as packing
from lodestrata.plans import skeleton
from lodestrata.sources import config as configuration

PRESET = [configuration.Source("src", "src", "modules"), configuration.Source("tests", "tests", "hierarchy")]


def session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.appName("lodestrata").getOrCreate()


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lodestrata", description="Analyse and package source trees with Spark.")
    top.add_argument("--version", action="version", version=lodestrata.__version__)
    top.add_argument("--verbose", "-v", action="store_true", help="show what Spark logs, too")
    commands = top.add_subparsers(dest="command", required=True)
    init = commands.add_parser("init", help="write a configuration file")
    init.add_argument("--output", default=configuration.NAMES[0])
    init.add_argument("--preset", choices=["standard"])
    init.add_argument("--force", action="store_true")
    for name in ("generate", "estimate", "validate"):
        one = commands.add_parser(name)
        one.add_argument("sources", nargs="*")
        one.add_argument("--output")
        one.add_argument("--level", choices=skeleton.pysource.LEVELS)
        one.add_argument("--format", action="append", dest="formats", choices=list(skeleton.FORMATS))
        one.add_argument("--exclude", action="append")
        one.add_argument("--symlinks", choices=skeleton.tree.SYMLINKS)
        one.add_argument("--config")
        if name == "validate":
            one.add_argument("--fix", action="store_true")
    pack = commands.add_parser("pack")
    pack.add_argument("root", nargs="?", default=".")
    pack.add_argument("--config")
    pack.add_argument("--token-tree", action="store_true")
    for f in packing.fields_of(packing.Options):
        flag = "--" + f.name.replace("_", "-")
        if f.name == "bounds":
            for bound in ("max_depth", "max_keys", "max_items", "max_headings"):
                pack.add_argument("--summary-" + bound.replace("_", "-"), type=int, dest=bound)
        elif f.type == "bool":
            pack.add_argument(flag, action=argparse.BooleanOptionalAction, default=None, dest=f.name)
        elif f.type.startswith("list"):
            pack.add_argument(flag, action="append", dest=f.name)
        else:
            pack.add_argument(flag, type=int if f.type == "int" else str, dest=f.name)
    return top


def _config(given: str | None, start: str) -> configuration.Config:
    path = given or configuration.find(start)
    return configuration.load(path) if path else configuration.Config()


def _jobs(args: argparse.Namespace) -> list[tuple[list[str], str, dict]]:
    """(sources, output, options) of each skeleton: those given, or else those of the configuration."""
    config = _config(args.config, os.getcwd())
    output = args.output or config.output
    shared = {"level": args.level or config.level, "formats": args.formats or config.formats, "exclude": args.exclude or config.exclude, "symlinks": args.symlinks or config.symlinks}
    if args.sources or not config.sources:
        return [(args.sources or ["."], output, shared)]
    jobs = []
    for source in config.sources:
        own = {k: getattr(args, k) or getattr(source, k) or v for k, v in shared.items()}
        jobs.append(([source.path], os.path.join(output, source.output or os.path.basename(source.path.rstrip("/"))), own))
    if len({os.path.normpath(j[1]) for j in jobs}) < len(jobs):
        raise configuration.ConfigError("several sources have the same output")
    return jobs


def run(argv: Sequence[str] | None = None) -> list[str]:
    """Does what the arguments say; the lines to show."""
    args = parser().parse_args(argv)
    if args.command == "init":
        if os.path.exists(args.output) and not args.force:
            raise configuration.ConfigError(f"{args.output} exists")
        made = configuration.Config(sources=PRESET if args.preset else [])
        with open(args.output, "w", encoding="utf-8") as file:
            file.write(configuration.dump(made))
        return [f"wrote {args.output}"]
    spark = session()
    if args.verbose:
        spark.sparkContext.setLogLevel("INFO")
    if args.command == "pack":
        options = _config(args.config, args.root).pack or packing.Options()
        for f in packing.fields_of(packing.Options):
            if f.name != "bounds" and (value := getattr(args, f.name)) is not None:
                setattr(options, f.name, value)
        if args.output and args.format is None:
            options.format = packing.infer_format(args.output) or options.format
        bounds = {k: v for k in ("max_depth", "max_keys", "max_items", "max_headings") if (v := getattr(args, k)) is not None}
        options.bounds = outline.Bounds(**vars(options.bounds) | bounds)
        result = packing.pack(spark, args.root, options)
        lines = [f"{a.path}: {a.bytes:,} bytes, {a.tokens:,} tokens" for a in result.artifacts]
        if args.token_tree:
            lines += trees.lines(trees.with_tokens(spark.createDataFrame(list(result.tokens_by_path.items()), "path string, n_tokens long")))
        return lines
    lines, total = [], 0
    for sources, output, o in _jobs(args):
        if args.command == "validate":
            fixed = skeleton.validate(spark, output, sources, o["exclude"], o["symlinks"], args.fix)
            lines.append(f"{output}: {'rewritten' if fixed else 'up to date'}")
            continue
        made = skeleton.generate(spark, sources, o["level"], o["exclude"], o["symlinks"])
        if args.command == "estimate":
            total += made.metadata["token_estimate"]
            lines.append(f"{', '.join(sources)} ({o['level']}): about {made.metadata['token_estimate']:,} tokens")
        else:
            skeleton.write(made, output, o["formats"])
            lines.append(f"wrote {output}")
    return lines + ([f"total: about {total:,} tokens"] if args.command == "estimate" else [])


def main(argv: Sequence[str] | None = None) -> int:
    try:
        print("\n".join(run(argv)))
    except ValueError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
