"""Command line: build an archive, show what one holds, tell what kind of source a path is."""

from __future__ import annotations

import argparse
import datetime as dt
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def session() -> SparkSession:
    spark = SparkSession.builder.appName("postquarry").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="postquarry")
    commands = parser.add_subparsers(dest="command", required=True)
    build = commands.add_parser("build", help="read sources and publish")
    build.add_argument("sources", nargs="+")
    build.add_argument("-o", "--out", required=True)
    build.add_argument("--account", action="append", default=[])
    build.add_argument("--no-accounts", action="store_true")
    build.add_argument("--prefix", default="")
    build.add_argument("--prune", action="store_true")
    build.add_argument("--force", action="store_true")
    build.add_argument("--kind")
    build.add_argument("--limit", type=int, default=0, help="end reading after so many messages")
    build.add_argument("--no-year-folders", action="store_true")
    build.add_argument("--title", default="Archive")
    build.add_argument("--news-host", default="", help="name of a news server to show beside the folders")
    build.add_argument("--allow-remote-images", action="store_true")
    for part in (parser, build):
        part.add_argument("-v", "--verbose", action="store_true", default=argparse.SUPPRESS, help="show the engine's log")
        part.add_argument("-q", "--quiet", action="store_true", default=argparse.SUPPRESS, help="print nothing but errors")
    info = commands.add_parser("info", help="messages by folder of a published archive")
    info.add_argument("out")
    find = commands.add_parser("detect", help="kind of each source")
    find.add_argument("paths", nargs="+")
    args = parser.parse_args(argv)
    try:
        return {"build": _build, "info": _info, "detect": _detect}[args.command](args)
    except KeyboardInterrupt:
        return 130


def _missing(paths: list[str]) -> bool:
    lost = [p for p in paths if not Path(p).exists()]
    for p in lost:
        print(f"no such path: {p}", file=sys.stderr)
    return bool(lost)


def _build(args: argparse.Namespace) -> int:
    from postquarry.plans.publish import build, export_json

    if _missing(args.sources):
        return 2
    spark, now = session(), dt.datetime.now(dt.timezone.utc).isoformat(timespec="seconds")
    if getattr(args, "verbose", False):
        spark.sparkContext.setLogLevel("INFO")
    try:
        stats = build(
            spark, args.sources, args.out, now, accounts=args.account, by_account=not args.no_accounts, prefix=args.prefix, prune=args.prune, force=args.force, kind=args.kind, limit=args.limit,
            by_year=not args.no_year_folders, block_remote=not args.allow_remote_images,
        )
        export_json(spark, args.out, title=args.title, built=now, news_host=args.news_host)
    except RuntimeError as e:
        print(e, file=sys.stderr)
        return 1
    if not getattr(args, "quiet", False):
        print(stats.summary())
    return 1 if stats.errors else 0


def _info(args: argparse.Namespace) -> int:
    from postquarry.operators.manifest import load

    if _missing([args.out]):
        return 2
    rows = load(session(), f"{args.out}/manifest")
    if rows is None:
        print("no archive here", file=sys.stderr)
        return 1
    for r in rows.groupBy("folder").agg(F.count("*").alias("n")).orderBy("folder").toLocalIterator():
        print(f"{r['n']:8d}  {r['folder']}")
    return 0


def _detect(args: argparse.Namespace) -> int:
    from postquarry.sources.mailbox import detect

    if _missing(args.paths):
        return 2
    for p in args.paths:
        print(f"{detect(p)}\t{p}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
