"""Word-processor files in the zipped XML form: sections by heading styles or by what looks like a heading."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

from .common import Parsed, SourceError, table, title_of

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_TITLE = "{http://purl.org/dc/elements/1.1/}title"


def level_of(style: str) -> int | None:
    """Heading level of a style name."""
    if style in ("Title", "Subtitle"):
        return 1 if style == "Title" else 2
    found = re.fullmatch(r"heading\s*([0-9])", style.strip().lower())
    return min(max(int(found[1]), 1), 6) if found else None


def looks_like_heading(text: str, bold: int, total: int) -> bool:
    """A short paragraph that is all capitals, mostly bold, or a label with a final colon."""
    if not 0 < len(text) <= 100:
        return False
    capitals = any(map(str.isalpha, text)) and text.upper() == text
    label = text.endswith(":") and not any(s in text[:-1] for s in ".?!")
    return capitals or total > 0 and 2 * bold > total or label


def _text(node) -> str:
    out = []
    for e in node.iter():
        if e.tag == f"{_W}t":
            out.append(e.text or "")
        elif e.tag == f"{_W}tab":
            out.append("\t")
        elif e.tag in (f"{_W}br", f"{_W}cr"):
            out.append("\n")
    return "".join(out)


def _on(properties, name: str) -> bool:
    e = properties.find(f"{_W}{name}") if properties is not None else None
    return e is not None and e.get(f"{_W}val", "1") not in ("0", "false")


def _grid(node) -> list[list[str]]:
    """Rows of a table; merged cells repeat their text across and down."""
    rows: list[list[str]] = []
    for tr in node.findall(f"{_W}tr"):
        row: list[str] = []
        for tc in tr.findall(f"{_W}tc"):
            properties = tc.find(f"{_W}tcPr")
            wide, merge = 1, None
            if properties is not None:
                span = properties.find(f"{_W}gridSpan")
                wide = int(span.get(f"{_W}val", 1)) if span is not None else 1
                merge = properties.find(f"{_W}vMerge")
            text = "\n".join(_text(p) for p in tc.findall(f"{_W}p")).strip()
            for _ in range(wide):
                above = rows[-1][len(row)] if rows and len(row) < len(rows[-1]) else ""
                row.append(above if merge is not None and merge.get(f"{_W}val") != "restart" else text)
        rows.append(row)
    width = max(map(len, rows), default=0)
    return [r + [""] * (width - len(r)) for r in rows]


def parse(data: bytes, path: str) -> Parsed:
    try:
        z = zipfile.ZipFile(io.BytesIO(data))
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        names = {}
        if "word/styles.xml" in z.namelist():
            for s in ElementTree.fromstring(z.read("word/styles.xml")).iter(f"{_W}style"):
                name = s.find(f"{_W}name")
                names[s.get(f"{_W}styleId")] = name.get(f"{_W}val") if name is not None else s.get(f"{_W}styleId")
        core = ElementTree.fromstring(z.read("docProps/core.xml")).findtext(_TITLE) if "docProps/core.xml" in z.namelist() else None
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
        raise SourceError(f"not a word-processor file: {e}") from e
    out, now, number, first_title = Parsed(""), None, 0, None
    for block in body:
        if block.tag == f"{_W}p":
            properties = block.find(f"{_W}pPr")
            style = properties.find(f"{_W}pStyle") if properties is not None else None
            style = names.get(style.get(f"{_W}val"), style.get(f"{_W}val")) if style is not None else "Normal"
            text = _text(block).strip()
            if not text:
                continue
            level = level_of(style)
            if level == 1 and first_title is None:
                first_title = text
            runs = [(len(_text(r)), _on(r.find(f"{_W}rPr"), "b")) for r in block.iter(f"{_W}r")]
            if level is not None:
                now = out.add(text, level, "")
            elif looks_like_heading(text, sum(n for n, b in runs if b), sum(n for n, _ in runs)):
                now = out.add(text.rstrip(":").strip(), 1, "")
            else:
                now = now or out.add("Introduction", 1, "")
                now["text"] += f"- {text}\n" if "List" in style else f"{text}\n\n"
        elif block.tag == f"{_W}tbl":
            number += 1
            grid = _grid(block)
            if grid and any(c.strip() for c in grid[0]):
                now = now or out.add("Tables", 1, "")
                now["tables"].append(table(f"tbl_{number:03d}", grid[0], grid[1:]))
    for s in out.sections:
        s["text"] = s["text"].strip()
    out.title = (core or "").strip() or first_title or title_of(path)
    return out
