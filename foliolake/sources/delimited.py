"""CSV and TSV: one section with one table."""

from __future__ import annotations

import csv

from .common import Parsed, SourceError, decoded, rectangular, stem_of, table, title_of


def delimiter(text: str, tab: bool) -> str:
    if tab:
        return "\t"
    try:
        return csv.Sniffer().sniff(text[:8192], ",\t;|").delimiter
    except csv.Error:
        return ","


def summary(lead: list[str], headers: list[str], rows: list[list[str]]) -> str:
    """The text under which a table is found by search."""
    text = [*lead, "Columns: " + ", ".join(headers)]
    if rows:
        text += ["Data:", *(" | ".join(r) for r in rows)]
    return "\n".join(text)


def parse(data: bytes, path: str) -> Parsed:
    text = decoded(data)
    rows = [r for r in csv.reader(text.splitlines(), delimiter=delimiter(text, path.lower().endswith(".tsv"))) if any(c.strip() for c in r)]
    if not rows:
        raise SourceError("no rows")
    headers, body = rectangular([[c.strip() for c in r] for r in rows])
    title = title_of(path)
    out = Parsed(title)
    out.add(title, 1, summary([f"File: {stem_of(path)}"], headers, body), [table("tbl_001", headers, body)])
    return out
