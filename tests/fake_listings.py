"""A transport of made-up listings that fails at first for some filers; imported by the workers."""

from __future__ import annotations

import json

from dossier.sources.blobs import StatusError

TRIED: dict[str, int] = {}


def block(cik: str, n: int, year: int) -> dict:
    return {"form": ["10-K", "8-K"] * n, "filingDate": [f"{year}-0{k + 1}-01" for k in range(2 * n)], "reportDate": [f"{year - 1}-12-31"] * (2 * n), "accessionNumber": [f"{cik}-{year}-{k}" for k in range(2 * n)], "primaryDocument": ["a.htm"] * (2 * n)}


class Fake:
    def listing(self, cik: str) -> str:
        TRIED[cik] = TRIED.get(cik, 0) + 1
        if cik.endswith("3") and TRIED[cik] == 1:
            raise StatusError(503)
        if cik.endswith("9"):
            raise StatusError(404)
        files = [{"name": f"{cik}-old", "filingFrom": "2000-01-01", "filingTo": "2001-01-01"}, {"name": f"{cik}-more", "filingFrom": "2022-01-01", "filingTo": "2022-12-31"}, {"name": f"{cik}-odd", "filingFrom": "", "filingTo": None}]
        return json.dumps({"filings": {"recent": block(cik, 2, 2024), "files": files if cik.endswith("1") else []}})

    def page(self, name: str) -> str:
        assert not name.endswith("-old"), "a page outside the window isn't fetched"
        return json.dumps(block(name.split("-")[0], 1, 2022))

    def latest(self) -> int:
        return 4

    def changes(self, after: int, upto: int) -> list[str]:
        return [f"000000000{k}" for k in range(after + 1, upto + 1)]


def make() -> Fake:
    return Fake()
