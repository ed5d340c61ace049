"""Reading folders of documents: one plan from files to raw sections.

``spark.read.format("binaryFile")`` lists the files; parsers run per file inside
``mapInPandas``. A file that no parser takes or that fails in whatever way becomes an
error row; :func:`read_folder` leaves files of unknown formats out.
Parsers are looked up in order of registration, the latest first, so formats can
be replaced or added (for PDF or OCR with a library of the user's choice).
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .. import model
from . import delimited, html, markdown, word, workbook
from .common import Parsed, SourceError, identifier

Parser = Callable[[bytes, str], Parsed]
_PARSERS: list[tuple[str, tuple[str, ...], Parser]] = [
    ("md", (".md", ".markdown"), markdown.parse),
    ("html", (".html", ".htm"), html.parse),
    ("csv", (".csv", ".tsv"), delimited.parse),
    ("xlsx", (".xlsx", ".xls"), workbook.parse),
    ("docx", (".docx",), word.parse),
]


def register(name: str, extensions: tuple[str, ...], parser: Parser, position: int = 0) -> None:
    """Puts a parser before the others (or at ``position``)."""
    _PARSERS.insert(position, (name, tuple(e.lower() for e in extensions), parser))


def unregister(name: str) -> bool:
    before = len(_PARSERS)
    _PARSERS[:] = [p for p in _PARSERS if p[0] != name]
    return len(_PARSERS) < before


def find(path: str) -> tuple[str, Parser] | None:
    """(format, parser) for a path, or None."""
    low = path.lower()
    return next(((name, parser) for name, ends, parser in _PARSERS if low.endswith(ends)), None)


def supported() -> list[str]:
    return sorted({e for _, ends, _ in _PARSERS for e in ends})


def prefer(name: str) -> None:
    """Puts a registered parser before the others, as where two of them read one format."""
    chosen = [p for p in _PARSERS if p[0] == name]
    if not chosen:
        raise ValueError(f"no parser {name!r}; registered are {[p[0] for p in _PARSERS]}")
    _PARSERS[:] = chosen + [p for p in _PARSERS if p[0] != name]


def read_folder(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Raw sections of all supported files below ``path``."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = reader.option("pathGlobFilter", glob).load(path) if glob else reader.load(path)
    return sections_of(files.where(" OR ".join(f"lower(path) LIKE '%{e}'" for e in supported())))


def sections_of(files: DataFrame) -> DataFrame:
    """Raw sections of (path, content) rows; a file that fails or that no parser takes gives one row with its error."""
    parsers = list(_PARSERS)  # travels with the plan, so workers see what was registered on the driver

    def run(batches):
        names = model.RAW_SECTIONS.names
        for files_ in batches:
            rows = []
            for path, data in zip(files_["path"], files_["content"]):
                name, parser = next(((n, p) for n, ends, p in parsers if path.lower().endswith(ends)), (None, None))
                base = (identifier(path), None, path, name)
                try:
                    if parser is None:
                        raise SourceError("no parser takes this format")
                    parsed = parser(bytes(data), path)
                except Exception as e:  # a broken file may raise anything, and must not end the job
                    why = str(e) if isinstance(e, SourceError) else f"{type(e).__name__}: {e}"
                    rows.append((*base, None, None, None, None, None, None, why))
                    continue
                for i, s in enumerate(parsed.sections):
                    rows.append((base[0], parsed.title, path, name, i, s["title"], s["level"], s["text"], s["tables"], s["images"], None))
            yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(run, model.RAW_SECTIONS)
