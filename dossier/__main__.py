"""Command line: ask questions of a corpus, discover filings, ingest documents.

Exit codes: 0 done, 2 wrong settings or arguments, 1 failed at run time.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier import schemas
from dossier.config import Settings
from dossier.operators.merges import Table
from dossier.plans.engine import Engine, lexeme_index
from dossier.plans.ingest import Ingest, discover
from dossier.sources import blobs, submissions


def tables(spark: SparkSession, root: str) -> dict[str, Table]:
    return {n: Table(spark, f"{root}/{n}", s) for n, s in (("companies", schemas.COMPANIES), ("filings", schemas.FILINGS), ("jobs", schemas.JOBS), ("chunks", schemas.CHUNKS))}


def report(events: DataFrame) -> str:
    """The answer, its sources and a footer of what the rails know, for a single request."""
    rows = events.orderBy("seq").collect()  # the events of one question
    answer = "".join(r["text"] or "" for r in events.filter("event = 'token'").orderBy("seq").select(F.get_json_object("data", "$.text").alias("text")).collect())
    rest = {r["event"]: r["data"] for r in rows if r["event"] != "token"}
    return f"{answer}\n\nSources: {rest.get('citations')}\n{rest.get('meta')}\n{rest.get('done')}"


def run(args: argparse.Namespace, spark: SparkSession) -> None:
    t = tables(spark, args.root)
    if args.command == "ask":
        chunks = t["chunks"].read().join(t["filings"].read().select("filing_id", "ticker", "filing_type", F.year("period_end").alias("period_year")), "filing_id")
        engine = Engine(chunks, t["companies"].read().select("ticker", "name"), lexeme_index(chunks), "hashed-64")
        print(report(engine.ask(spark.createDataFrame([("cli", args.question)], "request_id string, question string"))))
    elif args.command == "discover":
        subs = submissions.read(spark, args.submissions)
        none = spark.createDataFrame([], f"cik string, name string, block {submissions.BLOCK}")
        merged, outcome = discover(subs, none, t["companies"].read(), t["filings"].read())
        outcome.show()
        t["filings"].replace(merged)
    else:
        print(Ingest(t["filings"], t["jobs"], t["chunks"]).run(blobs.read(spark, args.blobs), args.limit))


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser("dossier")
    parser.add_argument("--root", required=True, help="folder of the tables")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("ask").add_argument("question")
    commands.add_parser("discover").add_argument("submissions")
    ingest = commands.add_parser("ingest")
    ingest.add_argument("blobs")
    ingest.add_argument("--limit", type=int)
    try:
        args = parser.parse_args(argv)
        Settings()
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2
    try:
        run(args, SparkSession.builder.appName("dossier").getOrCreate())
    except Exception as e:  # noqa: BLE001
        print(f"{type(e).__name__} during {args.command}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
