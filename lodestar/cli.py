"""Command line: report, diff and duplicates."""

from __future__ import annotations

import argparse
import importlib
import subprocess
import sys

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession


class _Parser(argparse.ArgumentParser):
    def error(self, message: str):
        raise ValueError(f"{message}\n{self.format_usage().strip()}")


def parser() -> argparse.ArgumentParser:
    p = _Parser(prog="lodestar")
    sub = p.add_subparsers(dest="command", required=True)
    r = sub.add_parser("report", help="findings between two revisions")
    r.add_argument("--repo", required=True)
    r.add_argument("--base", required=True)
    r.add_argument("--head", required=True)
    r.add_argument("--format", default="markdown", choices=["markdown", "json", "pr-comment", "html"])
    d = sub.add_parser("diff", help="entity changes between two revisions")
    d.add_argument("--repo", default=".")
    d.add_argument("--from", dest="base", default="HEAD~1")
    d.add_argument("--to", dest="head", default="HEAD")
    d.add_argument("--json", action="store_true")
    d.add_argument("--html", action="store_true")
    c = sub.add_parser("duplicates", help="clones in a working tree")
    c.add_argument("--repo", default=".")
    for x in (d, c):
        x.add_argument("--prompt", action="store_true")
        x.add_argument("--explain", metavar="MODULE:FUNCTION", help="a function from prompt to text")
    for x in (r, d, c):
        x.add_argument("--path", action="append", default=[])
        x.add_argument("-o", "--output")
    return p


def narrator(name: str):
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def save(content: str, output: str | None, ending: str, spark: SparkSession) -> None:
    """Write to the file named or one named by the time, and say which."""
    from lodestar.functions import text

    path = output or f"lodestar-{spark.range(1).select(text.filename_stamp()).first()[0]}.{ending}"
    with open(path, "w", encoding="utf-8") as f:
        f.write(content)
    print(f"Saved to: {path}", file=sys.stderr)


def show(content: str, output: str | None) -> None:
    if output:
        with open(output, "w", encoding="utf-8") as f:
            f.write(content)
    else:
        sys.stdout.write(content)


def run(args: argparse.Namespace, spark: SparkSession) -> None:
    from lodestar.plans import report
    from lodestar.sources import git, parse

    if args.command == "report":
        show(report.render(report.analyze_repo(spark, args.repo, args.base, args.head, args.path), args.format) + "\n", args.output)
    elif args.command == "diff":
        diff = report.entity_changes(git.files_at(spark, args.repo, args.base, args.path), git.files_at(spark, args.repo, args.head, args.path))
        m = report.manifest(diff, args.base, args.head)
        m = report.explained(m, narrator(args.explain)) if args.explain else m
        said = f"\n{m['summary']}\n" if m["summary"] else ""
        if args.json:
            save(report.manifest_json(m) + "\n", args.output, "json", spark)
        elif args.prompt:
            save(report.diff_prompt(m) + said, args.output, "md", spark)
        elif args.html:
            save(report.diff_html(m), args.output, "html", spark)
        else:
            show(report.listing(m) + said, args.output)
    else:
        groups = report.duplicates(parse.parse_files(git.working_tree(spark, args.repo, args.path), "entities"))
        listing = report.duplicates_listing(groups)
        if args.explain:
            listing += "\n".join(["", *report.advice(groups, narrator(args.explain)), ""])
        if args.prompt:
            sys.stdout.write(listing)
            save(report.duplicates_prompt(groups), args.output, "md", spark)
        else:
            show(listing, args.output)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0, or 1 after a message on what was wrong."""
    try:
        args = parser().parse_args(argv)
        run(args, spark or SparkSession.builder.getOrCreate())
    except subprocess.CalledProcessError as e:
        print((e.stderr or b"").decode(errors="replace").strip() or str(e), file=sys.stderr)
        return 1
    except (argparse.ArgumentError, ImportError, AttributeError, OSError, ValueError, PySparkException) as e:
        print(str(e), file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
