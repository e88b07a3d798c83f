"""Filing listings as a Spark source: spark.read or readStream of "filing_listings".

A batch read has one partition for each filer; a stream's batch has one for each filer with news between two offsets of
the feed. Options: transport ("module:function", called on the workers for an object with listing(cik) and
page(name), which return JSON text, and for streams latest() and changes(after, upto)), ciks (by commas), per_second (the
origin's limit for all), slots (tasks that may run at once; each keeps to its share of the limit), attempts, from_date and to_date (overflow pages
outside aren't fetched). A filer that still fails after its attempts fails the job, which can be run again.

Rows are cik, name (null for the filer's main listing, else the page's) and body; landed() makes the tables of dossier.sources.submissions.
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from dossier.sources.blobs import retrying
from dossier.sources.submissions import BLOCK, FROM, PAGE, TO

_last = [0.0]


def paced(interval: float) -> None:
    """Waits until `interval` seconds have passed since this worker's last request; a worker runs one task at a time."""
    now = time.monotonic()
    wait = max(0.0, _last[0] + interval - now)
    if wait:
        time.sleep(wait)
    _last[0] = now + wait


class Filer(InputPartition):
    def __init__(self, cik: str) -> None:
        super().__init__(cik)
        self.cik = cik


class _Reading:
    """What batch and stream readers share."""

    def __init__(self, options: dict[str, str]) -> None:
        self.where = options["transport"]
        self.interval = float(options.get("slots", "1")) / float(options.get("per_second", "10"))
        self.attempts = int(options.get("attempts", "3"))
        self.least_s = float(options.get("least_s", "2"))
        self.window = options.get("from_date", FROM), options.get("to_date", TO)

    def transport(self) -> Any:
        module, _, name = self.where.partition(":")
        return getattr(importlib.import_module(module), name)()

    def rows(self, cik: str) -> Iterator[tuple[str, str | None, str]]:
        own = self.transport()

        def get(name: str | None) -> str:
            paced(self.interval)
            return own.listing(cik) if name is None else own.page(name)

        fetch = retrying(get, self.attempts, self.least_s)
        body = fetch(None)
        yield cik, None, body
        low, high = self.window
        for page in (json.loads(body).get("filings") or {}).get("files") or []:
            begin, end = (str(page.get(k) or "") for k in ("filingFrom", "filingTo"))
            unusable = len(begin) != 10 or len(end) != 10
            if unusable or (end >= low and begin <= high):
                yield cik, page["name"], fetch(page["name"])


class ListingReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.reading = _Reading(options)
        self.ciks = list(dict.fromkeys(c.strip() for c in options.get("ciks", "").split(",") if c.strip()))

    def partitions(self) -> list[InputPartition]:
        return [Filer(c) for c in self.ciks] or [Filer("")]

    def read(self, partition: Filer) -> Iterator[tuple]:
        return self.reading.rows(partition.cik) if partition.cik else iter(())


class ListingStream(DataSourceStreamReader):
    """Offsets are places in the feed: {"at": n}."""

    def __init__(self, options: dict[str, str]) -> None:
        self.reading = _Reading(options)

    def initialOffset(self) -> dict:
        return {"at": 0}

    def latestOffset(self) -> dict:
        return {"at": self.reading.transport().latest()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [Filer(c) for c in dict.fromkeys(self.reading.transport().changes(start["at"], end["at"]))] or [Filer("")]

    def read(self, partition: Filer) -> Iterator[tuple]:
        return self.reading.rows(partition.cik) if partition.cik else iter(())

    def commit(self, end: dict) -> None:
        pass


class FilingListings(DataSource):
    @classmethod
    def name(cls) -> str:
        return "filing_listings"

    def schema(self) -> str:
        return "cik string, name string, body string"

    def reader(self, schema: Any) -> DataSourceReader:
        return ListingReader(dict(self.options))

    def streamReader(self, schema: Any) -> DataSourceStreamReader:
        return ListingStream(dict(self.options))


def landed(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The source's rows as submissions (cik, filings) and overflow pages (cik, name, block)."""
    main = rows.filter("name is null").select("cik", F.from_json("body", f"struct<filings: struct<recent: {BLOCK}, files: array<{PAGE}>>>").alias("j"))
    more = rows.filter("name is not null").select("cik", "name", F.from_json("body", BLOCK).alias("block"))
    return main.select("cik", "j.filings"), more
