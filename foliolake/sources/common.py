"""What the document parsers share: their result, names, and errors."""

from __future__ import annotations

import re
from dataclasses import dataclass, field


#: Where a name in camel case or a number in it begins.
_SEAM = re.compile("(?<=[a-z])(?=[A-Z])|(?<=[A-Za-z])(?=[0-9])")


class SourceError(Exception):
    """A file that cannot be turned into sections; it becomes an error row and not a failed job."""


@dataclass
class Parsed:
    """Sections of one file in reading order, as rows of plain values."""

    title: str
    sections: list[dict] = field(default_factory=list)

    def add(self, title: str, level: int, text: str, tables: list[dict] | None = None, images: list[dict] | None = None) -> dict:
        row = {"title": title, "level": level, "text": text, "tables": tables or [], "images": images or []}
        self.sections.append(row)
        return row


def table(table_id: str, headers: list[str], rows: list[list[str]], caption: str | None = None) -> dict:
    return {"table_id": table_id, "caption": caption, "headers": headers, "rows": rows}


def rectangular(grid: list[list[str]]) -> tuple[list[str], list[list[str]]]:
    """Header and data of a grid: empty headers at the end go, rows get the header's width."""
    n = max((i for i, h in enumerate(grid[0], 1) if h.strip()), default=0)
    return grid[0][:n], [(r + [""] * n)[:n] for r in grid[1:]]


def stem_of(path: str) -> str:
    name = re.split(r"[/\\]", path)[-1]
    return name.rsplit(".", 1)[0] if "." in name[1:] else name


def identifier(path: str) -> str:
    """The slug of a file's stem: camel case and digits are split, other signs become hyphens."""
    parts = re.split("[^a-z0-9]+", _SEAM.sub("-", stem_of(path)).lower())
    return "-".join(filter(None, parts))


def title_of(path: str, camel: bool = False) -> str:
    s = stem_of(path)
    if camel:
        s = _SEAM.sub(" ", s)
    return re.sub(r"[-_\s]+", " ", s).strip().title()


def decoded(data: bytes) -> str:
    """UTF-8 with or without a mark, else Latin-1."""
    for name in ("utf-8-sig", "latin-1"):
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            continue
    raise SourceError("undecodable text")
