"""Command line: analyze, barrels, cycles, dead-exports, fix, cache clear."""

from __future__ import annotations

import argparse
import json
import shutil
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from modweave.api import Analysis, rendered
from modweave.functions import render
from modweave.operators.resolution import glob_pattern
from modweave.plans import codemod
from modweave.sources import config as configs
from modweave.sources.workspace import Workspace

OUT = ".modweave"
SUFFIX = {"json": "json", "html": "html", "dot": "dot", "mermaid": "mmd"}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="modweave", description=__doc__)
    p.add_argument("--root", default=".")
    p.add_argument("--config")
    p.add_argument("--include-type-edges", action="store_true")
    p.add_argument("--condition", action="append", default=[])
    p.add_argument("--no-cache", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("analyze")
    a.add_argument("--format", choices=("terminal", *SUFFIX), default="terminal")
    a.add_argument("--out")
    a.add_argument("--max-nodes", type=int, default=150)
    b = sub.add_parser("barrels")
    b.add_argument("--min-amplification", type=float, default=0.0)
    sub.add_parser("cycles")
    sub.add_parser("dead-exports")
    f = sub.add_parser("fix")
    f.add_argument("--only")
    f.add_argument("--barrel")
    f.add_argument("--write", action="store_true")
    f.add_argument("--check", action="store_true")
    c = sub.add_parser("cache")
    c.add_argument("action", choices=("clear",))
    return p


def session() -> SparkSession:
    return SparkSession.builder.appName("modweave").getOrCreate()


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    root, cache = Path(args.root).resolve(), Path(args.root) / OUT / "cache"
    if args.command == "cache":
        shutil.rmtree(cache, ignore_errors=True)
        return 0
    if not root.is_dir():
        print(f"no such directory: {root}", file=sys.stderr)
        return 2
    try:
        config = configs.load(args.config, str(root / "modweave.toml"))
    except configs.ConfigError as problem:
        print(problem, file=sys.stderr)
        return 2
    config.resolve.conditions = list(dict.fromkeys([*args.condition, *config.resolve.conditions]))
    work = Workspace.from_path(spark or session(), str(root), config)
    found = Analysis.from_workspace(work, args.include_type_edges)
    if args.command == "analyze":
        text = _analyzed(args, found, work, cache)
        if args.format == "terminal":
            print(text)
        else:
            out = Path(args.out or root / OUT)
            out.mkdir(parents=True, exist_ok=True)
            (out / f"report.{SUFFIX[args.format]}").write_text(text)
        return 0
    if args.command == "barrels":
        found = Analysis.from_workspace(work)  # type edges are always off here
        rows = [b for b in _report(args, found, work, cache)["barrels"] if b["maxAmplification"] >= args.min_amplification]
        print(render.table("Barrels", ["barrel", "sites", "cost", "excess", "worst"], [[b["barrel"], b["siteCount"], b["actualCost"], b["totalExcess"], b["maxAmplification"]] for b in rows]))
        over = [b["barrel"] for b in rows if b["maxAmplification"] > config.thresholds.max_amplification]
        if over:
            print(f"warning: amplified more than {config.thresholds.max_amplification:g} times: {', '.join(over)}", file=sys.stderr)
        return 0
    if args.command == "cycles":
        rows = _report(args, found, work, cache)["cycles"]
        print(render.table("Cycles", ["size", "shortest"], [[c["size"], " -> ".join(c["path"])] for c in rows]))
        return int(len(rows) > config.thresholds.max_cycles)
    if args.command == "dead-exports":
        rows = _report(args, found, work, cache)["deadExports"]
        print(render.table("Dead exports", ["module", "name", "confidence"], [[d["module"], d["name"], "low" if d["lowConfidence"] else "high"] for d in rows]))
        return 0
    rows = found.plan(glob_pattern(args.only) if args.only else None, args.barrel).orderBy(F.split("path", "/")).collect()
    changes = [codemod.Change(r.path, bytes(r.original), bytes(r.rewritten)) for r in rows]
    if args.write:
        for c in changes:
            (root / c.path).write_bytes(c.rewritten)
    else:
        print("".join(c.diff() for c in changes), end="")
    print(f"{len(changes)} files")
    return int(args.check and bool(changes))


def _kept(args, work: Workspace, cache: Path, name: str, compute):
    """What ``compute`` gives, kept by the workspace's fingerprint and ``name``; a file that cannot be read or written counts as a miss."""
    file = cache / f"{work.fingerprint}-{name}.json"
    if not args.no_cache:
        try:
            return json.loads(file.read_text())
        except (OSError, ValueError):
            pass
    value = json.loads(json.dumps(compute()))
    if not args.no_cache:
        try:
            cache.mkdir(parents=True, exist_ok=True)
            file.write_text(json.dumps(value))
        except OSError:
            pass
    return value


def _report(args, found: Analysis, work: Workspace, cache: Path) -> dict:
    """The analysis, which all commands and formats share."""
    return _kept(args, work, cache, f"report-{int(found.types)}", found.report)


def _analyzed(args, found: Analysis, work: Workspace, cache: Path) -> str:
    whole = _report(args, found, work, cache) if args.format in ("json", "terminal", "html") else None
    drawn = _kept(args, work, cache, f"nodes-{int(found.types)}-{args.max_nodes}", lambda: found.nodes(args.max_nodes)) if args.format in ("html", "dot", "mermaid") else None
    return rendered(args.format, whole, drawn)


if __name__ == "__main__":
    sys.exit(main())
