"""Secret scanning with linking of multipart credentials.

Base patterns (assignments, access identifiers, long hexadecimal runs) are
reported wherever they match. Weak candidates - short assigned values, account
names, bare 40-character keys, addresses with a host - mean nothing alone.
They are reported only where an interval join finds a complementary part within
``SCOPE`` code points: an account or endpoint needs a secret near it, a weak
secret needs an identifier or an endpoint. The join runs over the sorted parts
of one document (binary searches on their starts and ends), so it needs no
shuffle, and its cost follows the number of parts and not of pairs.

Defined cases: a null text is empty and has no spans; a very long text is scanned whole; every row is scanned on
its own, so repeated or null identifiers do not matter; an empty table gives an
empty result; columns other than the identifier and the text are not read.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import arrow_bytes

NAME = "op7_secret_spans"
SCOPE = 300
#: In the order in which spans with one start are listed; the first three are base kinds.
KINDS = ("assign", "access", "hex", "account", "key", "endpoint")

_I = re.I | re.A
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", _I)
_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_ACCOUNT = re.compile(r"""(?<![a-z0-9_])(user(?:name)?|login|account|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.@-]{3,})""", _I)
_ACCOUNT_HINTS = ("user", "login", "account", "client", "access")
_KEY = re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/])")
_ENDPOINT = re.compile(r"(?:[a-z][a-z0-9+.-]{1,15})://[^\s\"'<>]+|(?<![a-z0-9.-])(?:host|endpoint|server|url)[\"']?\x20*[:=]\x20*[\"']?[a-z0-9.-]+\.[a-z]{2,}", _I)
_ENDPOINT_HINTS = ("://", "host", "endpoint", "server", "url")
WEAK_VALUE = 6  # an assigned value of 6 to 11 characters is a weak secret


def parts(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, weak spans) of a text, as (start, end, kind) in code points."""
    low = text.lower()
    base, weak = [], []
    if any(h in low for h in _HINTS):
        for m in _ASSIGN.finditer(text):
            size = len(m[2])
            if size >= 12:
                base.append((m.start(), m.end(), "assign"))
            elif size >= WEAK_VALUE:
                weak.append((m.start(), m.end(), "key"))
    if "AKIA" in text:
        base += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    base += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    if any(h in low for h in _ACCOUNT_HINTS):
        weak += [(m.start(), m.end(), "account") for m in _ACCOUNT.finditer(text)]
    if any(h in low for h in _ENDPOINT_HINTS):
        weak += [(m.start(), m.end(), "endpoint") for m in _ENDPOINT.finditer(text)]
    for m in _KEY.finditer(text):
        if any(c.isdigit() for c in m[0]) and any(c.isupper() for c in m[0]) and any(c.islower() for c in m[0]):
            weak.append((m.start(), m.end(), "key"))
    return base, weak


def _near(asking: list[tuple[int, int, str]], others: list[tuple[int, int, str]], scope: int) -> np.ndarray:
    """For each asking span, whether a span of ``others`` that does not overlap it lies within ``scope`` of it."""
    if not asking or not others:
        return np.zeros(len(asking), bool)
    start, end = (np.array([x[i] for x in asking]) for i in (0, 1))
    first, last = (np.sort(np.array([x[i] for x in others])) for i in (0, 1))
    before = np.searchsorted(last, start, "right") - np.searchsorted(last, start - scope, "left")
    after = np.searchsorted(first, end + scope, "right") - np.searchsorted(first, end, "left")
    return (before > 0) | (after > 0)


def link(base: list[tuple[int, int, str]], weak: list[tuple[int, int, str]], scope: int = SCOPE) -> list[tuple[int, int, str]]:
    """The weak spans whose complement is near: secrets for accounts and endpoints, either of these for weak keys."""
    if not weak:
        return []
    of = lambda spans, *kinds: [x for x in spans if x[2] in kinds]
    taken = np.array(sorted((a, b) for a, b, _ in base)).reshape(-1, 2)
    reach = np.maximum.accumulate(taken[:, 1])

    def free(x):  # a weak span inside a base span says nothing new
        i = np.searchsorted(taken[:, 0], x[0], "right") - 1
        return i < 0 or reach[i] < x[1]

    weak = [x for x in weak if free(x)]
    identities = of(base, "access") + of(weak, "account", "endpoint")
    keys = of(weak, "key")
    found = [x for x, ok in zip(keys, _near(keys, identities, scope)) if ok]
    strong = of(base, "assign", "hex") + found
    named = of(weak, "account", "endpoint")
    return found + [x for x, ok in zip(named, _near(named, strong, scope)) if ok]


def _listed(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    return sorted(set(spans), key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def scan(docs: DataFrame, *, scope: int = SCOPE, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, base and linked: spans (start, end, kind, value) of every document, in code points with exclusive ends."""
    arrow_bytes(docs.sparkSession)
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("value", T.StringType())]))
    schema = T.StructType([T.StructField("doc_id", docs.schema[ident].dataType), T.StructField("base", span), T.StructField("linked", span)])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("value", pa.string())]))

    def find(batches):
        for b in batches:
            columns = ([], [])
            for t in b.column("text").to_pylist():
                strong, weak = parts(t) if t else ([], [])
                for column, spans in zip(columns, (strong, link(strong, weak, scope))):
                    column.append([{"start": a, "end": e, "kind": k, "value": t[a:e]} for a, e, k in _listed(spans)])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, kind) for c in columns)], names=schema.names)

    return docs.select(F.col(ident).alias("doc_id"), F.col(text).alias("text")).mapInArrow(find, schema)


def redact(docs: DataFrame, *, scope: int = SCOPE, text: str = "text", mask: str = "[secret]") -> DataFrame:
    """``docs`` with every reported span of the text replaced by ``mask``; a null text stays null."""
    arrow_bytes(docs.sparkSession)
    at = docs.columns.index(text)

    def clean(t: str | None) -> str | None:
        if not t:
            return t
        strong, weak = parts(t)
        out, done = [], 0
        for a, e, _ in _listed(strong + link(strong, weak, scope)):
            if a >= done:
                out += [t[done:a], mask]
            done = max(done, e)
        return "".join([*out, t[done:]])

    def run(batches):
        for b in batches:
            yield b.set_column(at, b.schema.field(at), pa.array([clean(t) for t in b.column(at).to_pylist()], b.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of base spans, their digest, and all spans with the linked ones, for every document."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    spell = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    rank = lambda s: F.array_position(F.array(*map(F.lit, KINDS)), s["kind"])
    every = F.array_sort(F.concat("base", "linked"), lambda a, b: F.when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1)).otherwise(F.when(rank(a) < rank(b), -1).when(rank(a) > rank(b), 1).otherwise(0)))
    return found.select("doc_id", *map(count, KINDS[:3]), F.sha2(spell(F.col("base")).cast("binary"), 256).alias("base_sha256"), spell(every).alias("spans"))


SQL = None  # the SQL engine has no match positions; tests compare with a plain scan
