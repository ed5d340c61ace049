"""Spreadsheets in the zipped XML form: a section per sheet, its tables told apart by their headers."""

from __future__ import annotations

import datetime
import io
import re
import zipfile
from xml.etree import ElementTree

from .common import Parsed, SourceError, rectangular, table, title_of
from .delimited import summary

Rows = list[list[str]]
_M = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_BUILTIN_DATES = frozenset((14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47))


def _numeric(cell: str) -> bool:
    try:
        float(re.sub(r"[,$%€£\s]", "", cell))
    except ValueError:
        return False
    return True


def split_tables(rows: Rows) -> list[tuple[list[str], Rows]]:
    """(header, data) of the tables of a sheet; a header begins a new one only after a mostly numeric row."""
    full = [[c.strip() for c in r if c.strip()] for r in rows]
    share = [sum(map(_numeric, f)) / len(f) if f else 0 for f in full]
    begin = next((i for i, f in enumerate(full) if len(f) >= 2), 0)
    out: list[tuple[list[str], Rows]] = []
    after_data = False
    for i in range(begin, len(rows)):
        header = len(full[i]) >= 2 and 1 - share[i] >= 0.5 and sum(map(len, full[i])) <= 50 * len(full[i])
        if not out or header and after_data:
            out.append((rows[i], []))
            after_data = False
        else:
            out[-1][1].append(rows[i])
            after_data = bool(full[i]) and share[i] >= 0.5
    return out


def _shown(value: str, is_date: bool) -> str:
    """A number as a spreadsheet library would print it."""
    number = float(value)
    if is_date:
        moment = datetime.datetime(1899, 12, 30) + datetime.timedelta(days=number)
        return str(moment.replace(microsecond=0))
    return str(int(number)) if number == int(number) and "." not in value and "E" not in value.upper() else str(number)


def _sheets(data: bytes):
    """(name, rows of strings) of each sheet."""
    z = zipfile.ZipFile(io.BytesIO(data))
    names = set(z.namelist())
    load = lambda n: ElementTree.fromstring(z.read(n))
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{_M}t"))
    shared = [text(si) for si in load("xl/sharedStrings.xml").iter(f"{_M}si")] if "xl/sharedStrings.xml" in names else []
    dates: list[bool] = []
    if "xl/styles.xml" in names:
        styles = load("xl/styles.xml")
        own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in styles.iter(f"{_M}numFmt")}
        for xf in styles.findall(f"{_M}cellXfs/{_M}xf"):
            code = int(xf.get("numFmtId", 0))
            dates.append(code in _BUILTIN_DATES or bool(re.search(r"[dyhs]|mmm", re.sub(r'"[^"]*"|\[[^\]]*\]', "", own.get(code, "").lower()))))
    targets = {r.get("Id"): r.get("Target") for r in load("xl/_rels/workbook.xml.rels")}
    for sheet in load("xl/workbook.xml").iter(f"{_M}sheet"):
        target = targets[sheet.get(f"{_R}id")].lstrip("/")
        rows = []
        for row in load(target if target.startswith("xl/") else f"xl/{target}").iter(f"{_M}row"):
            cells: list[str] = []
            for c in row.iter(f"{_M}c"):
                at = 0
                for letter in re.match(r"[A-Z]+", c.get("r") or "A")[0]:
                    at = at * 26 + ord(letter) - 64
                at = at if c.get("r") else len(cells) + 1
                kind, value = c.get("t", "n"), c.findtext(f"{_M}v")
                if kind == "inlineStr":
                    shown = text(c)
                elif value is None:
                    shown = ""
                elif kind == "s":
                    shown = shared[int(value)]
                elif kind == "b":
                    shown = str(value == "1")
                elif kind == "n":
                    style = int(c.get("s", 0))
                    shown = _shown(value, style < len(dates) and dates[style])
                else:
                    shown = value
                cells += [""] * (at - len(cells) - 1) + [shown]
            rows.append(cells)
        yield sheet.get("name"), rows


def parse(data: bytes, path: str) -> Parsed:
    if path.lower().endswith(".xls"):
        raise SourceError("the binary workbook form is not supported; save it as .xlsx")
    try:
        sheets = list(_sheets(data))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
        raise SourceError(f"not a workbook: {e}") from e
    out, number = Parsed(title_of(path)), 0
    for name, rows in sheets:
        rows = [r for r in rows if any(c.strip() for c in r)]
        if not rows:
            continue
        width = max(map(len, rows))
        tables, texts = [], []
        for header, body in split_tables([r + [""] * (width - len(r)) for r in rows]):
            headers, body = rectangular([header, *body])
            if not headers:
                continue
            number += 1
            tables.append(table(f"tbl_{number:03d}", headers, body))
            texts.append(summary([f"Sheet: {name}", f"Table: {tables[-1]['table_id']}"], headers, body))
        if tables:
            out.add(name, 1, "\n\n".join(texts), tables)
    if not out.sections:
        raise SourceError("the workbook has no data")
    return out
