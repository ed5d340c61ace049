"""Near-duplicates by MinHash signatures and a multi-index Hamming join.

Every document is its set of distinct word shingles. Documents with one set are
one class, whose smallest identifier stands for it, so thousands of copies are
one row from here on. Signatures have ``K`` minima of ``32`` bits each. They
are cut into chunks of three; a pair that differs in at most ``T`` = 23 of the
36 places has, by the pigeonhole principle, a chunk with at most one error, so
indexing each chunk once for every place that may be wrong finds all pairs
within T. At a similarity of exactly 0.7 a pair differs in more than T places
with probability 6e-6, at 0.75 with 2e-7; that is the only loss.

What shares an index key is narrowed by exact tests before any pair is made:

* a key that one class has is dropped;
* a class of whose shingles more than 30 % occur in no other candidate cannot
  reach 0.7 with anything and is dropped, which empties the large buckets that
  a common passage makes;
* in each bucket all members are first compared with its smallest one only; the
  components of the confirmed links then tell which members are settled;
* a second round compares members of different components, within the size
  ratio that 0.7 allows and within T places. Members carry a bitmap with a place
  for each shingle: bits that only one of two has bound what they share, and
  pairs that cannot reach 0.7 by that go no further; the others are confirmed as before.

Links are confirmed on the full sets. No number of partners or candidates is
capped. Keys are range-partitioned together with the identifier, so a key that
a third of all rows has is spread over many partitions; the second round cuts
its bucket into blocks and compares each pair of blocks in a task of its own.
Sets are computed where the documents are read, for the candidates that a bit
table of at most ``BITS`` bits lets through, so texts are never shuffled.

Defined cases: null and empty texts (or white space alone) have an empty set,
are linked with nothing and are kept. Rows with a null identifier are left out
of the links, have no component and are kept. Repeated rows with one identifier
are reported each and stay or go together. Empty tables give empty results, and extra
columns pass through.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .scratch import Scratch, arrow_bytes, fresh, trimmed
from .words import byte_blocks, hash_words, mix

NAME = "op6_minhash_links"
SHINGLE, K, CHUNK, T = 5, 36, 3, 23
PERCENT = 70
#: Most bits of the broadcast table of candidates; beyond it, more sets are computed that a join then drops.
BITS = 1 << 27
#: Members of a bucket that the second round compares in one task, and most bytes of a member's bitmap; larger sets have a weaker bound.
BLOCK, MARKS = 4096, 1024
_PLACE = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_seeds = np.random.default_rng(5)
_ODD = _seeds.integers(1, 1 << 62, K, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = _seeds.integers(1, 1 << 63, K, np.int64).astype(np.uint64)
_CHUNKS = [[c * CHUNK + i for i in range(CHUNK) if i != wrong] for c in range(K // CHUNK) for wrong in range(CHUNK)]


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text."""
    words, bounds = hash_words(texts, "space")
    whole = mix(sum((words[i : len(words) - SHINGLE + 1 + i] * _PLACE[i] for i in range(SHINGLE)), np.uint64(0))) if len(words) >= SHINGLE else words[:0]
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= SHINGLE:
            out.append(np.unique(whole[a : b - SHINGLE + 1]))
        elif b > a:
            out.append(mix(np.array([(words[a:b] * np.array(_PLACE[: b - a])).sum() + np.uint64(b - a)], np.uint64)))
        else:
            out.append(words[:0])
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """b-bit minima of non-empty sets, one row of K each."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), K), np.uint32)
    for j in range(K):
        least = np.minimum.reduceat((flat ^ _XOR[j]) * _ODD[j], starts)
        out[:, j] = (least * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32)
    return out


def index_keys(signature: np.ndarray) -> np.ndarray:
    """The 64-bit multi-index keys of signatures, one row each: a chunk, its tolerated place, and the other values."""
    s = signature.astype(np.uint64)
    return np.stack([mix((s[:, a] << np.uint64(32) | s[:, b]) * _PLACE[0] + np.uint64(n)) for n, (a, b) in enumerate(_CHUNKS)], 1).view(np.int64)


def _sketch(batches):
    """Document rows to (id, n, digest, signature)."""
    for batch in batches:
        sizes, digests, signs = [], [], []
        for _, some in byte_blocks(batch.column("t").to_pylist()):
            sets = shingle_sets(some)
            full = [s for s in sets if len(s)]
            rows = iter(signatures(full) if full else ())
            for s in sets:
                sizes.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                signs.append(next(rows).tobytes() if len(s) else None)
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(signs, pa.binary())], names=["id", "n", "digest", "signature"])


def bitmap(shingles: np.ndarray) -> bytes:
    """A bit for each shingle by its lowest bits, in a power of two of bytes, one a shingle or more and ``MARKS`` at the most."""
    size = min(MARKS, max(8, 1 << (len(shingles) - 1).bit_length()))
    out = np.zeros(8 * size, bool)
    out[(shingles & np.uint64(8 * size - 1)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little").tobytes()


class Bitmaps:
    """Bitmaps of sets whose sizes differ by less than a factor of two, so pairs are compared in the width of one of them."""

    def __init__(self, marks: list[bytes], n: np.ndarray):
        self.n, self.width = n, np.array([len(m) for m in marks])
        self.at, self.rows = {}, {}
        for w in np.unique(self.width).tolist():
            whole = [np.frombuffer(b"".join(marks[i] for i in np.flatnonzero(self.width == size)), np.uint64) for size in (w, 2 * w)]
            self.at[w] = np.full(len(marks), -1)
            own = np.concatenate([np.flatnonzero(self.width == w), np.flatnonzero(self.width == 2 * w)])
            self.at[w][own] = np.arange(len(own))
            # half a bitmap of twice the width laid over the other is the one of this width
            self.rows[w] = np.concatenate([whole[0].reshape(-1, w // 8), np.bitwise_or.reduce(whole[1].reshape(-1, 2, w // 8), 1)])

    def able(self, i: int, others: np.ndarray) -> np.ndarray:
        """Those of ``others`` that may reach the similarity with ``i``: a bit that one has alone is a shingle that they do not share."""
        out = np.zeros(len(others), bool)
        common = np.minimum(self.width[others], self.width[i])
        for w in np.unique(common).tolist():
            here = np.flatnonzero(common == w)
            x, y = self.rows[w][self.at[w][i]], self.rows[w][self.at[w][others[here]]]
            n = self.n[others[here]]
            most = np.minimum(self.n[i] - np.bitwise_count(x & ~y).sum(1, dtype=np.int64), n - np.bitwise_count(y & ~x).sum(1, dtype=np.int64))
            out[here] = 100 * most >= PERCENT * (self.n[i] + n - most)
        return others[out]


def _marks(batches):
    """Sets to (id, signature, marks)."""
    for batch in batches:
        sets = [np.frombuffer(s, np.uint64) for s in batch.column("shingles").to_pylist()]
        if sets:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([r.tobytes() for r in signatures(sets)], pa.binary()), pa.array([bitmap(s) for s in sets], pa.binary())], names=["id", "signature", "marks"])


def _explode_keys(batches):
    for batch in batches:
        if batch.num_rows:
            keys = index_keys(np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint32).reshape(-1, K))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), batch.column("id").take(pa.array(np.repeat(np.arange(batch.num_rows), len(_CHUNKS))))], names=["key", "id"])


def _shared_keys(batches):
    """Rows sorted by key and id, without keys that occur once.

    A lone row of a partition's first or last key stays and is marked: the neighbouring partition may have its equal.
    """
    first = tail = None
    paired = False  # whether the row held back equals the one before it

    def emit(keys, ids, edge):
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(ids), pa.array(edge)], names=["key", "id", "edge"])

    for batch in batches:
        if not batch.num_rows:
            continue
        keys, ids = batch.column("key").to_numpy(), batch.column("id").to_numpy()
        if first is None:
            first = keys[0]
        else:
            keys, ids = np.concatenate([tail[0], keys]), np.concatenate([tail[1], ids])
        same = keys[1:] == keys[:-1]
        shared = np.append(paired, same) | np.append(same, False)
        keep = shared | (keys == first)
        keep[-1] = False
        yield emit(keys[keep], ids[keep], ~shared[keep])
        paired = bool(same[-1]) if len(same) else False
        tail = keys[-1:], ids[-1:]
    if tail is not None:
        yield emit(*tail, np.array([not paired]))


def _cells(batches):
    """Streams runs of equal (key, x, y) of rows sorted by them."""
    held, now = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        cell = np.stack([batch.column(c).to_numpy() for c in ("key", "x", "y")], 1)
        cut = np.flatnonzero(np.append(True, (cell[1:] != cell[:-1]).any(1)))
        for a, b in zip(cut, np.append(cut[1:], len(cell))):
            if held and now != tuple(cell[a]):
                yield pa.Table.from_batches(held)
                held = []
            now = tuple(cell[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _across(batches):
    """Pairs of a cell's members in different components within T places, the ratio of sizes and the bound of the bitmaps; a cell has one block or two."""
    for table in _cells(batches):
        ids, n, comp, block = (table.column(c).to_numpy() for c in ("id", "n", "component", "block"))
        two = table.column("x")[0] != table.column("y")[0]
        names, inverse, count = np.unique(comp, return_inverse=True, return_counts=True)
        if len(names) < 2:
            continue
        sign = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint32).reshape(-1, K)
        order = np.argsort(n, kind="stable")
        ids, n, inverse, sign, block = ids[order], n[order], inverse[order], sign[order], block[order]
        marks = table.column("marks").to_pylist()
        maps = Bitmaps([marks[i] for i in order], n)
        largest = count.argmax()
        a, b = [], []
        for i in np.flatnonzero(inverse != largest):  # members of the largest component need no comparison among themselves
            lo = np.searchsorted(n, -(-n[i] * PERCENT // 100))
            hi = np.searchsorted(n, n[i] * 100 // PERCENT, "right")
            other = inverse[lo:hi]
            wanted = (other != inverse[i]) & ((other == largest) | (np.arange(lo, hi) > i))
            if two:
                wanted &= block[lo:hi] != block[i]
            cand = lo + np.flatnonzero(wanted)
            cand = maps.able(i, cand[(sign[cand] != sign[i]).sum(1) <= T])
            a.append(np.full(len(cand), ids[i]))
            b.append(ids[cand])
        if a:
            a, b = np.concatenate(a), np.concatenate(b)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def _in_cells(rest: DataFrame, block: int = BLOCK) -> DataFrame:
    """Members of buckets with the blocks (x, y) that they meet in; a bucket of one block is one cell."""
    large = rest.groupBy("key").count().where(F.col("count") > block).select("key", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    own = rest.join(large, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    cells = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return cells.select("key", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "id", "n", "component")


def _bits(candidates: DataFrame) -> tuple[np.ndarray, list]:
    """(bit table of the candidates' identifiers, function from an identifier to its two places)."""
    size = 1 << 16
    while size < min(16 * candidates.count(), BITS):
        size *= 2
    places = lambda c: [F.pmod(F.xxhash64(c, F.lit(k)), F.lit(size)) for k in (1, 2)]
    at = candidates.select(F.explode(F.array(*places(F.col("least")))).alias("at"))
    word = at.groupBy(F.shiftright("at", 6).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 AS int))")).alias("v"))
    found = word.toArrow()  # as many rows as the table has words, at most
    table = np.zeros(size >> 6, np.int64)
    table[found.column("w").to_numpy()] = found.column("v").to_numpy()
    return table, places


def _confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity; hubs are split by skew joins."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))

    def check(batches):
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= PERCENT * (len(x) + len(y) - both):
                    keep.append(i)
            yield batch.take(pa.array(keep, pa.int64())).select(["a", "b"])

    return pairs.join(left, "a").join(right, "b").mapInArrow(trimmed(check), "a long, b long")


def near_groups(docs: DataFrame, *, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n (size of the set), component for every row of ``docs``; identifiers are integers."""
    spark = docs.sparkSession
    arrow_bytes(spark)
    scratch = Scratch(spark)
    slim = docs.select(F.col(ident).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t"))
    sketch = scratch.save(slim.mapInArrow(trimmed(_sketch), "id long, n long, digest binary, signature binary"), "sketch")
    # one identifier may have several texts; its representative is a class and not the identifier
    classes = scratch.save(sketch.where("id IS NOT NULL AND digest IS NOT NULL").groupBy("digest").agg(F.min("id").alias("least"), F.first("n").alias("n"), F.first("signature").alias("signature")).withColumn("id", F.xxhash64("digest")), "classes")

    keys = classes.select("id", "signature").mapInArrow(trimmed(_explode_keys), "key long, id long")
    shared = keys.repartitionByRange("key", "id").sortWithinPartitions("key", "id").mapInArrow(_shared_keys, "key long, id long, edge boolean")
    shared = scratch.save(shared, "shared")
    # two keys of a partition at most are marked, so what is broadcast is bounded by the number of partitions
    marked = F.broadcast(shared.where("edge").select("key").distinct())
    alone = shared.join(marked, "key", "left_semi").groupBy("key").agg(F.count("*").alias("c")).where("c = 1").select("key")
    shared = shared.join(F.broadcast(alone), "key", "left_anti").select("key", "id")
    shared = scratch.save(shared, "keys")

    scratch.drop("shared")
    candidates = scratch.save(shared.select("id").distinct().join(classes.select("id", "least", "digest"), "id"), "candidates")
    table, places = _bits(candidates)
    held = spark.sparkContext.broadcast(table)

    def load(batches):
        seen = set()  # copies of one row have one set
        for batch in batches:
            hit = np.ones(batch.num_rows, bool)
            for c in ("p", "q"):
                at = batch.column(c).to_numpy()
                hit &= (held.value[at >> 6] >> (at & 63) & 1).astype(bool)
            texts = batch.column("t").take(pa.array(np.flatnonzero(hit))).to_pylist()
            rows = {}
            for _, some in byte_blocks(texts):
                for s in shingle_sets(some):
                    raw = s.tobytes()
                    digest = hashlib.blake2b(raw, digest_size=16).digest()
                    if digest not in seen:
                        rows[digest] = raw
            seen.update(rows)
            yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.binary()), pa.array([len(r) // 8 for r in rows.values()], pa.int64()), pa.array(list(rows.values()), pa.binary())], names=["digest", "n", "shingles"])

    p, q = places(F.col("id"))
    loaded = slim.where("id IS NOT NULL").select("t", p.alias("p"), q.alias("q")).mapInArrow(trimmed(load), "digest binary, n long, shingles binary")
    sets = scratch.save(loaded.join(candidates.select("id", "digest"), "digest").select("id", "n", "shingles"), "sets")
    held.unpersist()
    scratch.drop("candidates")

    def spread(batches):
        for batch in batches:
            each = [np.frombuffer(s, np.int64) for s in batch.column("shingles").to_pylist()]
            if each:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(each)), batch.column("id").take(pa.array(np.repeat(np.arange(len(each)), [len(e) for e in each])))], names=["h", "id"])

    lonely = sets.mapInArrow(trimmed(spread), "h long, id long").groupBy("h").agg(F.count("*").alias("c"), F.min("id").alias("id")).where("c = 1").groupBy("id").agg(F.count("*").alias("lonely"))
    able = sets.select("id", "n").join(lonely, "id", "left").where(100 * (F.col("n") - F.coalesce("lonely", F.lit(0))) >= PERCENT * F.col("n")).select("id", "n").distinct()
    able = scratch.save(able, "able")
    narrow = scratch.save(sets.join(able.select("id"), "id", "left_semi"), "narrow")
    scratch.drop("sets")
    members = shared.join(able, "id")
    leaders = members.groupBy("key").agg(F.min("id").alias("b"), F.count("*").alias("c")).where("c > 1").select("key", "b")
    members = scratch.save(members.join(leaders, "key"), "members")
    scratch.drop("keys", "able")
    stars = members.where("id <> b").select(F.col("id").alias("a"), "b").distinct()
    links = scratch.save(_confirm(stars, narrow), "links")
    joined = components(links, scratch, "round1_")

    placed = members.select("key", "id", "n").join(joined.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    open_keys = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key")
    marks = narrow.mapInArrow(trimmed(_marks), "id long, signature binary, marks binary").groupBy("id").agg(F.first("signature").alias("signature"), F.first("marks").alias("marks"))
    rest = placed.join(open_keys, "key", "left_semi")
    # what members carry is joined last, so it travels once
    pairs = _in_cells(rest).join(marks, "id").repartition("key", "x", "y").sortWithinPartitions("key", "x", "y").mapInArrow(trimmed(_across), "a long, b long").distinct()
    more = scratch.save(_confirm(pairs, narrow), "more")
    scratch.drop("members", "narrow")
    final = components(links.unionByName(more), scratch, "round2_")

    named = classes.select("id", "least", "digest").join(final.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    lowest = named.groupBy("component").agg(F.min("least").alias("smallest"))
    label = named.join(lowest, "component").select("digest", "smallest")
    out = sketch.select("id", "n", "digest").join(label, "digest", "left")
    return out.select("id", "n", F.when(F.col("id").isNotNull(), F.coalesce("smallest", "id")).alias("component"), "digest")


def near_dedup(docs: DataFrame, *, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their columns: the smallest identifier of each group, and rows without one."""
    groups = near_groups(docs, ident=ident, text=text)
    gone = groups.where(F.col("id") != F.col("component")).select(F.col("id").alias(key := fresh(docs, "__id"))).distinct()
    return docs.join(gone, docs[ident].cast("long") == gone[key], "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under links of Jaccard similarity 0.7 and more."""
    groups = near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return groups.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


SQL = """
WITH RECURSIVE word AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
),
shingle AS (
  SELECT DISTINCT doc_id, hash(array_to_string(w[s:s + least(len(w), 5) - 1], chr(31))) AS h
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS s FROM word WHERE len(w) > 0)
),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
pair AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM shingle a JOIN shingle b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2
),
link AS (
  SELECT x, y FROM pair JOIN size p ON p.doc_id = x JOIN size q ON q.doc_id = y WHERE 100 * common >= 70 * (p.n + q.n - common)
),
edge AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (
  SELECT doc_id AS root, doc_id AS node FROM documents
  UNION
  SELECT root, y FROM reach JOIN edge ON x = node
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, min(node) AS component_id, d.doc_id = min(node) AS kept
FROM documents d JOIN reach ON root = d.doc_id LEFT JOIN size s ON s.doc_id = d.doc_id GROUP BY d.doc_id, n
"""
