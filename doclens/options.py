"""Options of a conversion, checked before anything is read; and the status a document ends with."""

from __future__ import annotations

import re
from dataclasses import dataclass, fields
from enum import IntEnum

MAX_PAGE = 100_000
FORMATS = ("md", "html", "both")


class Status(IntEnum):
    OK, FAILED, VISUAL_ORDER, UNVERIFIED, NO_TEXT, MISSING_TOOL, REFUSED = range(7)


@dataclass(frozen=True)
class Pages:
    """Closed intervals as written; they are never expanded."""

    ranges: tuple[tuple[int, int, str], ...]

    def has(self, n: int) -> bool:
        return any(a <= n <= b for a, b, _ in self.ranges)

    def beyond(self, count: int) -> list[str]:
        return [label for _, b, label in self.ranges if b > count]

    def condition(self, page: str = "page"):
        """The same as a predicate that reaches the scan."""
        from functools import reduce

        from pyspark.sql import functions as F

        return reduce(lambda x, y: x | y, (F.col(page).between(a, b) for a, b, _ in self.ranges))


def parse_pages(spec: str) -> Pages:
    """Such as 1,4-6. ValueError names the part that is empty, misshapen, below 1, reversed or beyond MAX_PAGE."""
    out = []
    for part in map(str.strip, spec.split(",")):
        m = re.fullmatch(r"(\d+)(?:\s*-\s*(\d+))?", part)
        if not m:
            raise ValueError(f"pages: {part!r} is not a page or a range")
        a, b = int(m[1]), int(m[2] or m[1])
        if a < 1 or b < a or b > MAX_PAGE:
            raise ValueError(f"pages: {part!r} must rise, from 1 to {MAX_PAGE}")
        out.append((a, b, part))
    return Pages(tuple(out))


@dataclass(frozen=True)
class ConvertOptions:
    pages: Pages | None = None
    format: str = "both"
    force: bool = False
    ingest: bool = False
    verify: bool = False
    report: bool = False
    notes: bool = True
    lang: str = "heb+eng"

    @classmethod
    def of(cls, **given) -> ConvertOptions:
        """Unknown names and values raise ValueError; a report implies verification; pages may be a string."""
        if unknown := set(given) - {f.name for f in fields(cls)}:
            raise ValueError(f"unknown option: {', '.join(sorted(unknown))}")
        if given.get("format", "both") not in FORMATS:
            raise ValueError(f"format must be one of {', '.join(FORMATS)}")
        if isinstance(given.get("pages"), str):
            given["pages"] = parse_pages(given["pages"])
        if given.get("report"):
            given["verify"] = True
        return cls(**given)


def ocr_arguments(pages: list[int], lang: str, sidecar: str, source: str, target: str) -> list[str]:
    """Arguments for a recogniser that adds a text layer to the given pages only."""
    return ["-l", lang, "--pages", ",".join(map(str, pages)), "--skip-text", "--output-type", "pdf", "--optimize", "0", "--sidecar", sidecar, source, target]
