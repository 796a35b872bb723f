"""Commands on an archive: python -m vaultloom COMMAND ... Exit codes: 0 fine, 1 an error, 2 problems were found."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession

from .archive import Archive

BAD = {"corrupt", "unrecoverable", "missing", "modified", "mismatch", "failed", "read-error", "gone", "not found"}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="vaultloom")
    top.add_argument("--root", default=".")
    top.add_argument("--json", action="store_true")
    top.add_argument("--yes", action="store_true", help="drop files that are gone instead of marking them missing")
    sub = top.add_subparsers(dest="command", required=True)

    def add(name: str, *names: str, **flags) -> argparse.ArgumentParser:
        one = sub.add_parser(name, aliases=flags.pop("aliases", []))
        for n in names:
            one.add_argument(n, nargs="*" if n == "paths" else None)
        for flag, kind in flags.items():
            option = "--" + flag.replace("_", "-")
            if kind is bool:
                one.add_argument(option, action="store_true")
            elif kind is list:
                one.add_argument(option, action="append", default=[])
            else:
                one.add_argument(option, type=kind)
        return one

    add("init", algo=str, block_size=str, parity=str, stripe_size=str, parity_default=str, exclude=list)
    add("scan", "paths", no_accept_changes=bool, no_parity=bool)
    add("check", "paths", older_than=str, budget=str, repair=bool, aliases=["verify"])
    add("accept", "paths")
    add("repair", "paths", keep_corrupt=bool, dry_run=bool)
    add("rm", "paths", force=bool)
    for name in ("include", "exclude", "unmark"):
        add(f"parity-{name}", "paths")
    add("parity-list")
    add("parity-sync", prune=bool)
    add("status")
    add("ls", "paths", state=str, parity=bool, no_parity=bool)
    add("show", "path")
    add("history", "paths", since=str, limit=int)
    add("export", "output", format=str)
    add("import", "file", algo=str, relative_to=str, trust=bool)
    add("fsck", deep=bool, fix=bool, rebuild_from=str)
    add("config", "key", "value")
    return top


def run(spark: SparkSession, args: argparse.Namespace) -> DataFrame | None:
    if args.command == "init":
        given = {k: v for k in ("algo", "block_size", "parity", "stripe_size", "parity_default", "exclude") if (v := getattr(args, k))}
        Archive.init(spark, args.root, **given)
        return None
    a, paths = Archive(spark, args.root), [os.path.abspath(p) for p in getattr(args, "paths", [])] or None
    match args.command:
        case "scan":
            return a.scan(paths, not args.no_accept_changes, not args.no_parity, "yes" if args.yes else "no")
        case "check" | "verify":
            return a.check(paths, args.older_than, args.budget, args.repair)
        case "accept":
            return a.accept(paths or [a.root])
        case "repair":
            return a.repair(paths, args.keep_corrupt, args.dry_run)
        case "rm":
            return a.rm(paths or [], args.force) if paths else None
        case "parity-include" | "parity-exclude" | "parity-unmark":
            mode = args.command.removeprefix("parity-")
            a.mark(paths or [a.root], None if mode == "unmark" else mode)
        case "parity-list":
            return a.coverage()
        case "parity-sync":
            a.parity_sync(args.prune)
        case "status":
            return a.status()
        case "ls":
            return a.ls(paths, args.state, True if args.parity else False if args.no_parity else None)
        case "show":
            return a.show(os.path.abspath(args.path))
        case "history":
            return a.history(paths[0] if paths else None, args.since, args.limit or 200)
        case "export":
            a.export(args.output, args.format or "sum")
        case "import":
            return a.import_list(args.file, args.algo, args.relative_to or "", args.trust)
        case "fsck":
            if args.rebuild_from:
                a.rebuild(args.rebuild_from)
            return a.fsck(args.deep, args.fix)
        case "config":
            kind = type(getattr(a.config, args.key))
            a.set_config(args.key, tuple(json.loads(args.value)) if kind is tuple else kind(args.value))
    return None


def main() -> int:
    args = parser().parse_args()
    spark = SparkSession.builder.appName("vaultloom").getOrCreate()
    try:
        rows = run(spark, args)
    except (OSError, ValueError, RuntimeError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    bad = False
    for r in rows.toLocalIterator() if rows is not None else ():
        d = r.asDict()
        word = d.get("outcome", d.get("new_state", "ok" if d.get("finding", "ok") == "ok" else "missing"))
        bad |= word in BAD and args.command in ("scan", "check", "verify", "repair", "import", "fsck")
        if word not in ("unchanged", "ok") or args.command not in ("scan", "check", "verify"):
            print(json.dumps(d, default=str) if args.json else "\t".join("" if x is None else str(x) for x in d.values()))
    return 2 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
