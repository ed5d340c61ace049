"""Functions for SQL: what the Column builders give, under names that ``spark.sql`` knows."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

#: Scalar functions as SQL, so they stay inside the plan.
SCALARS = {
    "folio_words": ("t STRING", "ARRAY<STRING>", r"regexp_extract_all(lower(coalesce(t, '')), '\\S+', 0)"),
    "folio_terms": ("t STRING", "ARRAY<STRING>", r"regexp_extract_all(lower(coalesce(t, '')), '[a-z0-9\\-]{2,}', 0)"),
    "folio_normalised": ("t STRING", "STRING", "trim(regexp_replace(lower(t), '[^a-z0-9]+', ' '))"),
    "folio_token_estimate": ("t STRING", "INT", r"CAST(floor(size(regexp_extract_all(lower(coalesce(t, '')), '\\S+', 0)) * 1.3D) AS INT)"),
    "folio_jaccard": ("a ARRAY<STRING>, b ARRAY<STRING>", "DOUBLE", "size(array_intersect(a, b)) / greatest(size(array_union(a, b)), 1)"),
}


class Passages:
    """Rows of a text's passages."""

    def eval(self, text: str, size: int, overlap: int):
        from ..operators.chunks import passages

        yield from enumerate(passages(text, size, overlap))


class Figures:
    """Rows of a text's key figures."""

    def eval(self, text: str):
        from ..operators.enrich import figures

        yield from figures(text)


TABLES = {"folio_passages": (Passages, "idx: int, passage: string"), "folio_figures": (Figures, "label: string, value: string, unit: string")}


def register(spark: SparkSession) -> list[str]:
    """Makes all functions known to the session; their names."""
    for name, (arguments, kind, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
    for name, (rows, schema) in TABLES.items():
        spark.udtf.register(name, F.udtf(rows, returnType=schema))
    return [*SCALARS, *TABLES]
