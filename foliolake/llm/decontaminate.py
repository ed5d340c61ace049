"""Benchmark decontamination with suffix arrays over training shards.

Every shard of about ``SHARD_BYTES`` of documents gets a suffix array over its
words: prefix doubling orders all suffixes by their first ``DEPTH`` words, or by
as many as a longer window has. Every suffix of every test item is then
binary-searched in it, one more word at a time, which yields all places where
it matches a window or more. Neighbouring suffixes of an item that match at
neighbouring places are one verbatim match: these runs are the longest matches
and their locations, and everything else (hit words, items, documents to be
removed) is derived from them. Items come to the workers in
blocks of a checked size; each further block is a further pass over the
documents, so no broadcast grows with the benchmark.

Words are compared by 64-bit hashes. Defined cases: null and empty texts have
no words and match nothing; null items are skipped; an item that occurs twice
counts once; a null item identifier is written as the empty string. Repeated
documents are judged row by row. Empty tables give empty or clean results.
Other columns pass through :func:`decontaminate` untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import Scratch, arrow_bytes, fresh, trimmed
from .words import byte_blocks, hash_words

NAME = "op1_decontaminate"
WINDOW, DEPTH = 10, 16
#: Most bytes of item texts in one broadcast; what is beyond goes into further passes.
BLOCK_BYTES = 32 << 20
#: Bytes of texts in a shard; a longer document is a shard of its own.
SHARD_BYTES = 4 << 20


class Shard:
    """The suffix array of a block of documents, over word hashes, in the order of at least ``depth`` words."""

    def __init__(self, texts: list[bytes], depth: int = DEPTH):
        self.depth = max(DEPTH, depth)
        words, self.bounds = hash_words(texts, "alnum")
        self.vocabulary, rank = np.unique(words, return_inverse=True)
        self.words = rank.astype(np.int64) + 1
        del words, rank
        n = len(self.words)
        self.end = np.repeat(self.bounds[1:], np.diff(self.bounds))  # of the document that a word belongs to
        self.rank, step = self.words, 1
        while step < self.depth and n:
            follow = np.zeros(n, np.int64)
            inside = np.arange(n) + step < self.end
            follow[inside] = self.rank[np.flatnonzero(inside) + step]
            key = self.rank * (n + 1) + follow
            order = np.argsort(key)
            change = np.empty(n, np.int64)
            change[0] = 1
            np.not_equal(key[order[1:]], key[order[:-1]], out=change[1:], casting="unsafe")
            self.rank = np.empty(n, np.int64)
            self.rank[order] = np.cumsum(change)
            step *= 2
            self.suffixes = order
        if not n:
            self.suffixes = np.zeros(0, np.int64)

    def _bound(self, lo: np.ndarray, hi: np.ndarray, depth: int, word: np.ndarray, right: bool) -> np.ndarray:
        """First place in [lo, hi) of the array whose word at ``depth`` is not below (right: is above) ``word``."""
        lo, hi = lo.copy(), hi.copy()
        while (busy := np.flatnonzero(lo < hi)).size:
            mid = (lo[busy] + hi[busy]) >> 1
            at = self.suffixes[mid] + depth
            seen = np.where(at < self.end[self.suffixes[mid]], self.words[np.minimum(at, len(self.words) - 1)], 0)
            below = seen <= word[busy] if right else seen < word[busy]
            lo[busy] = np.where(below, mid + 1, lo[busy])
            hi[busy] = np.where(below, hi[busy], mid)
        return lo

    def search(self, items: np.ndarray, start: np.ndarray, stop: np.ndarray, want: int | None = None):
        """Longest matches of item suffixes ``items[start:stop]``, up to ``depth`` words: (length, lo, hi) in the array.

        With ``want`` the range is that of matches of min(want, stop - start) words, empty where there is none.
        """
        most = np.minimum(stop - start, self.depth if want is None else want)
        where = np.searchsorted(self.vocabulary, items)
        known = np.zeros(len(items), np.int64)
        if len(self.vocabulary):
            hit = self.vocabulary[np.minimum(where, len(self.vocabulary) - 1)] == items
            known[hit] = where[hit] + 1
        length = np.zeros(len(start), np.int64)
        lo, hi = np.zeros(len(start), np.int64), np.full(len(start), len(self.suffixes))
        live = np.flatnonzero(most > 0)
        for depth in range(int(most.max(initial=0))):
            live = live[most[live] > depth]
            word = known[start[live] + depth]
            live, word = live[word > 0], word[word > 0]
            if not live.size:
                break
            a = self._bound(lo[live], hi[live], depth, word, False)
            b = self._bound(a, hi[live], depth, word, True)
            found = a < b
            live, a, b = live[found], a[found], b[found]
            lo[live], hi[live], length[live] = a, b, depth + 1
        if want is not None:
            hi = np.where(length == most, hi, lo)
        return length, lo, hi

    def places(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which range, word position) of every suffix in the ranges."""
        size = hi - lo
        which = np.repeat(np.arange(len(lo)), size)
        within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        return which, self.suffixes[np.repeat(lo, size) + within]


def _item_blocks(items: DataFrame, item: str, text: str, most: int) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """(identifiers, word hashes, word bounds) of blocks of items, one at a time on the driver."""
    rows, size = [], 0
    for r in items.where(F.col(text).isNotNull()).select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("i"), F.col(text).alias("t")).toLocalIterator():
        if rows and size + len(r.t) > most:
            yield [i for i, _ in rows], *hash_words([t for _, t in rows], "alnum")
            rows, size = [], 0
        rows.append((r.i, r.t.encode()))
        size += len(r.t)
    if rows:
        yield [i for i, _ in rows], *hash_words([t for _, t in rows], "alnum")


def longest_matches(docs: DataFrame, items: DataFrame, *, min_words: int = WINDOW, ident: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, item_word, doc_word, n_words: for every place of the longest matches of item suffixes.

    Matches begin with at least ``min_words`` words in common and are then extended word by word.
    """
    arrow_bytes(docs.sparkSession)
    slim = docs.select(F.col(ident).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    schema = T.StructType([T.StructField("doc_id", docs.schema[ident].dataType), T.StructField("item_id", T.StringType()), *(T.StructField(n, T.LongType()) for n in ("item_word", "doc_word", "n_words"))])
    spark, found = docs.sparkSession, None
    for block in _item_blocks(items, item, item_text, block_bytes):
        held = spark.sparkContext.broadcast(block)

        def scan(batches, held=held):
            names, words, bounds = held.value
            start = np.arange(len(words))
            stop = np.repeat(bounds[1:], np.diff(bounds))
            owner = np.repeat(np.arange(len(names)), np.diff(bounds))
            for batch in batches:
                for first, some in byte_blocks(batch.column("text").to_pylist()):
                    shard = Shard(some, min_words)
                    length, lo, hi = shard.search(words, start, stop)
                    keep = np.flatnonzero(length >= min_words)
                    which, at = shard.places(lo[keep], hi[keep])
                    suffix, size = keep[which], length[keep][which]
                    known = np.searchsorted(shard.vocabulary, words)
                    known = np.where(shard.vocabulary[np.minimum(known, max(len(shard.vocabulary) - 1, 0))] == words, known + 1, 0) if len(shard.vocabulary) else np.zeros(len(words), np.int64)
                    more = np.arange(len(at))
                    while more.size:
                        p, q = at[more] + size[more], suffix[more] + size[more]
                        ok = (p < shard.end[at[more]]) & (q < stop[suffix[more]])
                        more, p, q = more[ok], p[ok], q[ok]
                        same = shard.words[p] == known[q]
                        more = more[same]
                        size[more] += 1
                    doc = np.searchsorted(shard.bounds, at, "right") - 1
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(doc + first)), pa.array([names[o] for o in owner[suffix].tolist()], pa.string()), pa.array(suffix - bounds[owner[suffix]]), pa.array(at - shard.bounds[doc]), pa.array(size)], names=schema.names)

        part = slim.mapInArrow(scan, schema)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else spark.createDataFrame([], schema)


def _shards(batches, text: str, most: int = SHARD_BYTES):
    """Batches joined until their texts have ``most`` bytes."""
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.column(text).nbytes
        if size >= most:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _runs(doc: np.ndarray, at: np.ndarray, suffix: np.ndarray, owner: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
    """Matched windows (document, word in the shard, word in the items, item, words) as maximal verbatim matches, by document and place."""
    diagonal = suffix - at
    order = np.lexsort((at, diagonal, owner, doc))
    doc, at, suffix, owner, size, diagonal = (x[order] for x in (doc, at, suffix, owner, size, diagonal))
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (owner[1:] != owner[:-1]) | (diagonal[1:] != diagonal[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(doc))) - 1 + size[first]
    order = np.lexsort((at[first], doc[first]))
    first, length = first[order], length[order]
    return doc[first], at[first], suffix[first], owner[first], length


_FOUND = ("words", "spans", "items", "longest", "place", "item")


def _annotate(docs: DataFrame, items: DataFrame, *, window: int, text: str, item: str, item_text: str, block_bytes: int):
    """``docs`` with the number of words, hit words as spans, item ids, and the longest match (words, place, item) added; the names of these columns."""
    spark = docs.sparkSession
    arrow_bytes(spark)
    names_ = [fresh(docs, f"__{x}") for x in _FOUND]
    n, spans, ids, longest, place, which_item = names_
    scratch, step = None, 0
    zero = F.lit(0).cast("long")
    out = docs.withColumns({n: zero, spans: F.lit(b""), ids: F.array().cast("array<string>"), longest: zero, place: F.lit(None).cast("long"), which_item: F.lit(None).cast("string")})
    schema, columns = out.schema, docs.columns
    blocks = _item_blocks(items, item, item_text, block_bytes)
    block, more = next(blocks, ([], np.zeros(0, np.uint64), np.zeros(1, np.int64))), True
    while more:
        held = spark.sparkContext.broadcast(block)

        def scan(batches, held=held):
            names, words, bounds = held.value
            sizes = np.diff(bounds)
            first = np.repeat(bounds[:-1], sizes)
            stop = np.repeat(bounds[1:], sizes)
            start = np.arange(len(words))
            start = start[(start + window <= stop) | (start == first)]  # an item's whole windows; a short item is one
            owner = np.searchsorted(bounds, start, "right") - 1
            stop = np.minimum(stop[start], start + window)
            for batch in _shards(batches, text):
                counts, columns_ = [], [batch.column(c).to_pylist() for c in names_[1:]]
                for at0, some in byte_blocks([(t or "").encode() for t in batch.column(text).to_pylist()], SHARD_BYTES):
                    shard = Shard(some, window)
                    counts += np.diff(shard.bounds).tolist()
                    _, lo, hi = shard.search(words, start, stop, window)
                    which, at = shard.places(lo, hi)
                    if not len(at):
                        continue
                    doc = np.searchsorted(shard.bounds, at, "right") - 1
                    doc, at, suffix, who, length = _runs(doc, at, start[which], owner[which], stop[which] - start[which])
                    cut = np.searchsorted(doc, np.arange(len(some) + 1))
                    for i in np.flatnonzero(cut[:-1] < cut[1:]).tolist():
                        one = slice(cut[i], cut[i + 1])
                        begin = at[one] - shard.bounds[i]
                        row = at0 + i
                        pairs = np.stack([begin, begin + length[one]], 1)
                        if before := columns_[0][row]:
                            pairs = np.concatenate([np.frombuffer(before, "<i8").reshape(-1, 2), pairs])
                        columns_[0][row] = _merge(pairs).astype("<i8").tobytes()
                        here = [names[o] for o in who[one].tolist()]
                        columns_[1][row] = sorted({*(columns_[1][row] or []), *here})
                        # of equally long matches the first one, then the smallest item
                        old = (-columns_[2][row], columns_[3][row] or 0, columns_[4][row] or "")
                        best = min(old, *zip((-length[one]).tolist(), begin.tolist(), here))
                        columns_[2][row], columns_[3][row], columns_[4][row] = -best[0], best[1], best[2]
                types = (pa.binary(), pa.list_(pa.string()), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(counts, pa.int64()), *(pa.array(c, t) for c, t in zip(columns_, types))], names=[*columns, *names_])

        out = out.mapInArrow(trimmed(scan), schema)
        block = next(blocks, None)
        if more := block is not None:
            scratch = scratch or Scratch(spark)
            out, step = scratch.save(out, f"pass{step}"), step + 1
            held.unpersist()  # what it gave is written
            if step > 1:
                scratch.drop(f"pass{step - 2}")
    return out, names_


def _merge(pairs: np.ndarray) -> np.ndarray:
    """Union of half-open spans, as disjoint sorted ones."""
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    reach = np.maximum.accumulate(pairs[:, 1])
    new = np.flatnonzero(np.append(True, pairs[1:, 0] > reach[:-1]))
    return np.stack([pairs[new, 0], reach[np.append(new[1:], len(pairs)) - 1]], 1)


def hits(docs: DataFrame, items: DataFrame, *, window: int = WINDOW, ident: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """What the verbatim matches of a window or more say of every document.

    doc_id, n_words, n_hit, item_ids, spans (word ranges that matches cover), and of the longest match its words, its place
    in the document and its item (0 and nulls without one).
    """
    slim = docs.select(F.col(ident).alias("doc_id"), F.col(text).alias("text"))
    out, (n, spans, ids, longest, place, which) = _annotate(slim, items, window=window, text="text", item=item, item_text=item_text, block_bytes=block_bytes)
    long = T.LongType()
    schema = T.StructType([out.schema["doc_id"], *(T.StructField(x, long) for x in ("n_words", "n_hit")), T.StructField("item_ids", T.ArrayType(T.StringType())), T.StructField("spans", T.ArrayType(T.ArrayType(long))), *(T.StructField(x, long) for x in ("longest_words", "longest_at")), T.StructField("longest_item", T.StringType())])

    def unpack(batches):
        for b in batches:
            pairs = [np.frombuffer(x, "<i8").reshape(-1, 2) for x in b.column(spans).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column(n), pa.array([int((p[:, 1] - p[:, 0]).sum()) for p in pairs], pa.int64()), b.column(ids), pa.array([p.tolist() for p in pairs], pa.list_(pa.list_(pa.int64()))), b.column(longest), b.column(place), b.column(which)], names=schema.names)

    return out.drop("text").mapInArrow(unpack, schema)


def decontaminate(docs: DataFrame, items: DataFrame, *, window: int = WINDOW, text: str = "text", item: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that hold no window of any item, with their columns."""
    out, (_, spans, *_) = _annotate(docs, items, window=window, text=text, item=item, item_text=item_text, block_bytes=block_bytes)
    return out.where(F.octet_length(spans) == 0).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that verbatim matches of ten words and more cover, and the longest match."""
    found = hits(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "longest_words", F.coalesce("longest_at", F.lit(-1).cast("long")).alias("longest_at"), F.coalesce("longest_item", F.lit("")).alias("longest_item"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH item AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS key
  FROM (SELECT item_id, w, least(len(w), {WINDOW}) AS size, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS i FROM item WHERE len(w) > 0)
),
doc AS (SELECT doc_id, {_WORDS} AS w FROM documents),
place AS (
  SELECT doc_id, size, s, array_to_string(w[s:s + size - 1], ' ') AS key
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM doc, (SELECT DISTINCT size FROM win) WHERE len(w) >= size)
),
found AS (SELECT doc_id, item_id, i, s, size FROM place JOIN win USING (size, key)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + size)) AS p FROM found) GROUP BY doc_id),
who AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id),
lined AS (SELECT *, s - row_number() OVER (PARTITION BY doc_id, item_id, i - s ORDER BY s) AS run FROM found),
verbatim AS (SELECT doc_id, item_id, min(s) - 1 AS pos, count(*) - 1 + any_value(size) AS n FROM lined GROUP BY doc_id, item_id, i - s, run),
top AS (SELECT doc_id, n, pos, item_id FROM verbatim QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, pos, item_id) = 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
       coalesce(n, 0) AS longest_words, coalesce(pos, -1) AS longest_at, coalesce(item_id, '') AS longest_item
FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN who USING (doc_id) LEFT JOIN top USING (doc_id)
"""
