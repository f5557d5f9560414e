"""Commands: init, index, find, bench, lint."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from textweave.operators import lint as checks
from textweave.plans import find, index
from textweave.plans.config import NAME, find_root, load_config
from textweave.plans.log import event
from textweave.sources.gold import load_gold
from textweave.sources.schemas import discover


def session() -> SparkSession:
    return SparkSession.builder.appName("textweave").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="textweave")
    p.add_argument("--root")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("init")
    ix = sub.add_parser("index")
    ix.add_argument("--full", action="store_true")
    ix.add_argument("--compact", action="store_true")
    f = sub.add_parser("find")
    f.add_argument("query", nargs="+")
    f.add_argument("-k", type=int, default=8)
    for flag in ("--lexical", "--strict", "--json", "--no-refresh"):
        f.add_argument(flag, action="store_true")
    b = sub.add_parser("bench")
    b.add_argument("gold")
    b.add_argument("-k", type=int, default=8)
    b.add_argument("--json", action="store_true")
    li = sub.add_parser("lint")
    li.add_argument("--strict", action="store_true")
    li.add_argument("--json", action="store_true")
    return p


def init(root: Path) -> int:
    """A settings file with the databases found, and a line that keeps the index out of version control."""
    path = root / NAME
    if not path.exists():
        found = [p for p, _ in discover(str(root))]
        path.write_text(f"databases = {json.dumps(found)}\n\n[semantic]\nenabled = true\n")
    ignore = root / ".gitignore"
    lines = ignore.read_text().splitlines() if ignore.exists() else []
    if ".textweave/" not in lines:
        ignore.write_text("\n".join([*lines, ".textweave/"]) + "\n")
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    root = Path(a.root) if a.root else find_root()
    if a.command == "init":
        return init(root)
    config, spark = load_config(root), spark or session()
    if a.command == "index":
        if a.full:
            print("built: {} prose, {} code, {} tables".format(*index.build(spark, config)[:3]))
        else:
            print(find.ensure_fresh(spark, config))
        if a.compact:
            index.compact(spark, config)
        event(config, "index", full=a.full)
        return 0
    if a.command == "lint":
        rows = [r.asDict() for r in find.findings(spark, config).collect()]
        errors = any(r["severity"] == "error" for r in rows)
        if a.json:
            print(json.dumps(rows, indent=2, ensure_ascii=False))
            return 0
        shown = [r for r in rows if r["severity"] == "error"] if a.strict else rows
        for r in shown:
            print(f"{r['severity']:<6}{r['check']:<22}{r['path']}: {r['message']}")
        print(", ".join(f"{sum(r['severity'] == s for r in rows)} {s}" for s in checks.SEVERITIES))
        return int(errors)
    print(find.ensure_fresh(spark, config, not getattr(a, "no_refresh", False)), file=sys.stderr)
    if a.command == "bench":
        report = find.bench(spark, config, load_gold(spark, a.gold), a.k)
        print(json.dumps(report, indent=2) if a.json else find.format_report(report))
        return 0
    notes: list[str] = []
    text = " ".join(a.query)
    hits = [r.asDict() for r in find.search(index.current(spark, config), config, text, a.k, a.lexical, a.strict, notes).collect()]
    for note in notes:
        print(note, file=sys.stderr)
    event(config, "find", query=text, hits=len(hits))
    if a.json:
        print(json.dumps(hits, indent=2, ensure_ascii=False))
    else:
        for h in hits:
            print(f"{h['rank']}. {h['relpath']}  {h['title']}  [{h['kind']}] {h['score']}")
            if h["snippet"] and h["snippet"] != h["title"]:
                print(f"   {h['snippet']}")
    return 0 if hits else 1


if __name__ == "__main__":
    sys.exit(main())
