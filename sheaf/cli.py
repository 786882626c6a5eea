"""spark-submit entry: read a table of captures or a folder of HTML files, and sections or more of what is stored."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf import api
from sheaf.sources import captures as C

COMMANDS = ("read", "extract", "section", "more")


def count(value: str) -> int:
    """A whole number of zero or more."""
    if not value.isascii() or not value.isdigit():
        raise argparse.ArgumentTypeError(f"{value!r} is not a whole number of zero or more")
    return int(value)


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="sheaf", description=__doc__)
    commands = out.add_subparsers(dest="command", required=True)
    about = {
        "read": "results of a Parquet table of captures, by the recipe that each URL takes",
        "extract": "results of HTML files, as they are",
        "section": "sections of stored captures: a table of (handle, anchor) says which",
        "more": "stored captures read again, whole: a table of (handle) says which",
    }
    for name in COMMANDS:
        own = commands.add_parser(name, help=about[name])
        own.add_argument("source", help="a folder of HTML files" if name == "extract" else "a Parquet table of captures")
        if name in ("section", "more"):
            own.add_argument("wanted", help="a Parquet table of handles")
        own.add_argument("target", help="a new folder")
        if name == "extract":
            own.add_argument("--url", required=True, help="what file names are appended to")
        if name in ("read", "extract"):
            own.add_argument("--budget", type=count, metavar="N", help="tokens of content for each result")
            own.add_argument("--full", action="store_true", help="all content, whatever the budget")
        if name == "read":
            own.add_argument("--tiers", action="store_true", help="captures have a tier: one result for each URL, of the one that counts")
            own.add_argument("--signed-in", action="store_true", help="with --tiers: only what was captured signed in")
        own.add_argument("--json", action="store_true", help="JSON lines in place of Parquet")
    return out


def results_of(o: argparse.Namespace, spark: SparkSession) -> DataFrame:
    budget = None if getattr(o, "full", False) else getattr(o, "budget", None)
    if o.command == "extract":
        return api.extract_files(C.html_files(spark, o.source, o.url), budget)
    if o.command == "read" and o.tiers:
        return api.read_tiers(spark.read.parquet(o.source), budget, F.lit(o.signed_in))
    rows = C.capture_table(spark, o.source)
    if o.command == "read":
        return api.read(rows, budget)
    wanted = spark.read.parquet(o.wanted)
    return api.sections_of(api.snapshots(rows), wanted) if o.command == "section" else api.read_more(api.snapshots(rows), wanted)


def main(args: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    """Run a command. A path alone is read. What can't be done is said on the error stream, with status 1."""
    import sys

    given = list(sys.argv[1:] if args is None else args)
    if given and given[0] not in (*COMMANDS, "-h", "--help"):
        given.insert(0, "read")
    own = parser()
    o = own.parse_args(given)
    spark = spark or SparkSession.builder.getOrCreate()
    try:
        results = results_of(o, spark)
        (C.as_json(results).write.mode("errorifexists").text(o.target) if o.json else results.write.mode("errorifexists").parquet(o.target))
    except (ValueError, TypeError, api.AnalysisException) as e:
        own.exit(1, f"sheaf: {str(e).splitlines()[0]}\n")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
