"""Token counts that follow edits.

A document keeps a segment tree over blocks of its pre-tokens: the leaves have the
characters and tokens of ``LEAF`` pre-tokens each, the nodes above their sums.
:func:`build_trees` writes the leaves once; :func:`apply_edits` reads them and
never encodes a document again. Merges never cross pre-tokens, so an edit can
change only the pre-tokens that it touches and, because the split looks ahead,
those next to them: these leaves are split and encoded anew together with their
boundary context, until the outermost pre-tokens are as before. The leaves are
replaced, nodes with too many children are divided, and sums change on the path
to the root only. Each leaf holds its own piece of the text, so an edit copies
neither the text nor the tree.

Edits are rows (doc_id, seq, start, length, insert): at code point ``start``
remove ``length`` code points and insert a text; they apply in the order of
``seq``. They are sorted into runs per document beside the document itself, so
a document with very many edits is a stream and not a group in memory.

Defined cases: null texts and inserts are empty; start and length are clipped
to the text; edits without a document of their identifier are ignored, edits
with a null identifier too; rows with one identifier all get its edits; ties in
``seq`` apply in the order of start, length and insert; a text without a stored
tree, or with one of another text, is counted first. Very long texts are deeper
trees. Empty tables give empty results, and other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .pretokens import blocks, encoder
from .scratch import Scratch, arrow_bytes, trimmed

NAME = "op10_edit_token_counts"
#: Pre-tokens in a leaf of the tree, and children of a node.
LEAF, FAN = 64, 16
#: Characters below which a region is split by the pattern and not by array operations.
SHORT = 20_000


class Leaf:
    """A piece of text with its characters and tokens."""

    __slots__ = ("parent", "text", "chars", "tokens")

    def __init__(self, text: str, tokens: int):
        self.parent, self.text, self.chars, self.tokens = None, text, len(text), tokens


class Node:
    """At most ``FAN`` children with the sums of their characters and tokens."""

    __slots__ = ("parent", "children", "chars", "tokens")

    def __init__(self, children: list):
        self.parent, self.children = None, children
        for c in children:
            c.parent = self
        self.chars, self.tokens = sum(c.chars for c in children), sum(c.tokens for c in children)


class SegmentTree:
    """Leaves in order under nodes of sums; all leaves have one depth."""

    def __init__(self, leaves: list[Leaf]):
        level: list = leaves or [Leaf("", 0)]
        while len(level) > 1 or isinstance(level[0], Leaf):
            level = [Node(level[i : i + FAN]) for i in range(0, len(level), FAN)]
        self.root = level[0]

    def find(self, at: int) -> tuple[Leaf, int]:
        """(leaf, first character of it) of the leaf that holds character ``at``; the last leaf for the end."""
        node, before = self.root, 0
        while isinstance(node, Node):
            for child in node.children:
                if at < before + child.chars:
                    break
                before += child.chars
            else:
                before -= child.chars
            node = child
        return node, before

    def beside(self, leaf: Leaf, step: int) -> Leaf | None:
        """The leaf after (1) or before (-1) a leaf."""
        node = leaf
        while node.parent is not None:
            line = node.parent.children
            i = line.index(node) + step
            if 0 <= i < len(line):
                node = line[i]
                while isinstance(node, Node):
                    node = node.children[0 if step > 0 else -1]
                return node
            node = node.parent
        return None

    def _add(self, node, chars: int, tokens: int) -> None:
        while node is not None:
            node.chars += chars
            node.tokens += tokens
            node = node.parent

    def change(self, leaf: Leaf, text: str, tokens: int) -> None:
        chars, more = len(text) - leaf.chars, tokens - leaf.tokens
        leaf.text = text
        self._add(leaf, chars, more)

    def remove(self, leaf: Leaf) -> None:
        self._add(leaf, -leaf.chars, -leaf.tokens)
        node = leaf
        while node.parent is not None and len(node.parent.children) == 1:
            node = node.parent
        if node.parent is None:  # the last leaf of all stays, without text
            leaf.text = ""
        else:
            node.parent.children.remove(node)

    def insert_after(self, leaf: Leaf, fresh: Leaf) -> None:
        line = leaf.parent.children
        line.insert(line.index(leaf) + 1, fresh)
        fresh.parent = leaf.parent
        self._add(leaf.parent, fresh.chars, fresh.tokens)
        node = leaf.parent
        while len(node.children) > FAN:  # divided, and so may be the nodes above
            above, half = node.parent, len(node.children) // 2
            right = Node(node.children[half:])
            del node.children[half:]
            node.chars -= right.chars
            node.tokens -= right.tokens
            if above is None:
                self.root = Node([node, right])
                break
            above.children.insert(above.children.index(node) + 1, right)
            right.parent = above
            node = above

    def leaves(self):
        stack = [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, Leaf):
                yield node
            else:
                stack += reversed(node.children)


def leaf_sums(sizes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """(characters, tokens) of as few blocks of at most ``LEAF`` pre-tokens as there can be, about equal ones, a row each."""
    blocks_ = -(-len(sizes) // LEAF)
    at = np.arange(0, len(sizes), -(-len(sizes) // max(blocks_, 1)) or 1)
    return np.stack([np.add.reduceat(sizes, at), np.add.reduceat(counts, at)], 1).astype("<i4") if len(at) else np.zeros((0, 2), "<i4")


class CountedText:
    """A text as a tree of counted leaves; ``edit`` keeps both up to date. ``sums`` are stored leaves, else the text is counted."""

    def __init__(self, text: str, ranks: str | None = None, sums: np.ndarray | None = None):
        self.coder, self.encoded, leaves = encoder(ranks), 0, []
        if sums is None or int(sums[:, 0].sum()) != len(text):
            (sizes, counts), = self._count([text])
            self.encoded, sums = len(text), leaf_sums(sizes, counts)
        at = 0
        for chars, tokens in sums.tolist():
            leaves.append(Leaf(text[at : at + chars], tokens))
            at += chars
        self.tree = SegmentTree(leaves)

    def _count(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(sizes, tokens) of the pre-tokens of each text."""
        starts, index, bounds, at = self.coder.pretokens(texts, added=True)
        counts = self.coder.counts(index)
        return [(np.diff(np.append(starts[a:b], e)), counts[a:b]) for a, b, e in zip(bounds[:-1], bounds[1:], at[1:])]

    @property
    def tokens(self) -> int:
        return self.tree.root.tokens

    @property
    def chars(self) -> int:
        return self.tree.root.chars

    @property
    def text(self) -> str:
        return "".join(leaf.text for leaf in self.tree.leaves())

    def edit(self, start: int, length: int, insert: str) -> None:
        tree, n = self.tree, self.chars
        start = min(max(start, 0), n)
        stop = min(start + max(length, 0), n)
        # the leaves that the edit touches, then ones before and after them as context
        first, left = tree.find(max(start - 1, 0))
        held = [first]
        right = left + first.chars
        while right < stop:
            held.append(tree.beside(held[-1], 1))
            right += held[-1].chars
        back = on = 1  # leaves to add on either side
        while True:
            for _ in range(back):
                if (before := tree.beside(held[0], -1)) is None:
                    break
                held.insert(0, before)
                left -= before.chars
            for _ in range(on):
                if (after := tree.beside(held[-1], 1)) is None:
                    break
                held.append(after)
            whole = "".join(leaf.text for leaf in held)
            a, b = start - left, stop - left
            region = whole[:a] + insert + whole[b:]
            at_start, after = tree.beside(held[0], -1) is None, tree.beside(held[-1], 1)
            # the old ends are split with the new region, each with two signs that follow it, as white space looks ahead
            ahead = after.text[:2] if after is not None else ""
            texts = (region, held[0].text, held[-1].text)
            follows = (ahead, held[1].text[:2] if len(held) > 1 else ahead, ahead)
            split = self.coder.short_pretokens if len(region) < SHORT else lambda t: self._count([t])[0]
            new, head, tail = (self._before(split(t + f), len(t)) for t, f in zip(texts, follows))
            self.encoded += len(region)
            keep = len(whole) - b
            # the outermost pre-tokens must be as before, else white space or a contraction reaches further; an added token reaches `reach` characters
            reach = self.coder.reach
            headed = new is not None and (at_start or a >= reach and self._same_head(head, new[0], a))
            tailed = new is not None and (after is None or keep >= reach and self._same_tail(tail, new[0], keep))
            if headed and tailed:
                break
            back, on = 0 if headed or new is None else max(2 * back, 1), 0 if tailed else max(2 * on, 1)
        sums, done, fresh = leaf_sums(*new), 0, []
        for chars, tokens in sums.tolist():
            fresh.append((region[done : done + chars], tokens))
            done += chars
        for leaf, (text, tokens) in zip(held, fresh):
            tree.change(leaf, text, tokens)
        last = held[min(len(held), len(fresh)) - 1]
        for text, tokens in fresh[len(held) :]:
            tree.insert_after(last, leaf := Leaf(text, tokens))
            last = leaf
        for leaf in held[len(fresh) :]:
            tree.remove(leaf)

    @staticmethod
    def _before(pair: tuple[np.ndarray, np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray] | None:
        """The pre-tokens of the first ``size`` characters; None where one reaches beyond."""
        ends = np.cumsum(pair[0])
        n = int(np.searchsorted(ends, size, "right"))
        return (pair[0][:n], pair[1][:n]) if (ends[n - 1] if n else 0) == size else None

    @staticmethod
    def _same_head(old, new: np.ndarray, unchanged: int) -> bool:
        """Whether the region's first pre-token ends before the edit with the size that it had."""
        return old is not None and len(old[0]) > 0 and len(new) > 1 and new[0] == old[0][0] and new[0] < unchanged

    @staticmethod
    def _same_tail(old, new: np.ndarray, unchanged: int) -> bool:
        """Whether the region's last two pre-tokens begin after the edit with the sizes that they had."""
        return old is not None and len(old[0]) > 1 and len(new) > 2 and list(new[-2:]) == list(old[0][-2:]) and int(new[-2:].sum()) < unchanged


def count_tokens(docs: DataFrame, *, ranks: str | None = None, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_pretokens, n_tokens of every row."""
    arrow_bytes(docs.sparkSession)
    schema = T.StructType([T.StructField("doc_id", docs.schema[ident].dataType), T.StructField("n_pretokens", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def count(batches):
        coder = encoder(ranks)
        for batch in batches:
            pre, tokens = [], []
            for _, some in blocks([t or "" for t in batch.column("text").to_pylist()]):
                _, index, bounds, _ = coder.pretokens(some, added=True)
                ends = np.concatenate([[0], np.cumsum(coder.counts(index))])
                pre.append(np.diff(bounds))
                tokens.append(np.diff(ends[bounds]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), pa.int64()) for c in (pre, tokens))], names=schema.names)

    return docs.select(F.col(ident).alias("doc_id"), F.col(text).alias("text")).mapInArrow(count, schema)


def build_trees(docs: DataFrame, *, ranks: str | None = None, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, digest (of the text), leaves: the characters and tokens of the leaves of every row's tree, packed."""
    arrow_bytes(docs.sparkSession)
    schema = T.StructType([T.StructField("doc_id", docs.schema[ident].dataType), T.StructField("digest", T.LongType()), T.StructField("leaves", T.BinaryType())])

    def build(batches):
        coder = encoder(ranks)
        for batch in batches:
            out = []
            for _, some in blocks([t or "" for t in batch.column("text").to_pylist()]):  # many documents at once
                begin, index, bounds, chars = coder.pretokens(some, added=True)
                counts, ends = coder.counts(index), np.append(begin, chars[-1])
                for j in range(len(some)):
                    a, b = bounds[j], bounds[j + 1]
                    out.append(leaf_sums(np.diff(np.append(ends[a:b], chars[j + 1])), counts[a:b]).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digest"), pa.array(out, pa.binary())], names=schema.names)

    return docs.select(F.col(ident).alias("doc_id"), F.col(text).alias("text"), _digest(text).alias("digest")).mapInArrow(trimmed(build), schema)


def _digest(text: str):
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def _follow(ranks: str | None):
    """Each document's trees, its texts, and its edits in order to its counts before and after."""

    def run(batches):
        now, trees, held = None, {}, {}  # identifier, leaves by digest, [counted text, tokens before, edits, rows] by digest

        def close():
            return [(now, b, c.tokens, k, c.encoded, c.chars) for c, b, k, rows in held.values() for _ in range(rows)]

        def ready(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (kind, *[pa.int64()] * 5))], names=["doc_id", "n_tokens", "n_tokens_edited", "n_edits", "n_encoded", "n_chars_edited"])

        kind = None
        for batch in batches:
            kind = batch.schema.field("doc_id").type
            columns = (batch.column(c).to_pylist() for c in ("doc_id", "tag", "digest", "leaves", "start", "length", "text"))
            done = []
            for ident, tag, digest, leaves, start, length, text in zip(*columns):
                if ident != now:
                    done += close()
                    now, trees, held = ident, {}, {}
                if tag == 0:
                    trees[digest] = np.frombuffer(leaves, "<i4").reshape(-1, 2)
                elif tag == 1:
                    if digest in held:  # repeated rows are edited once
                        held[digest][3] += 1
                    else:
                        counted = CountedText(text or "", ranks, trees.get(digest))
                        held[digest] = [counted, counted.tokens, 0, 1]
                else:
                    for each in held.values():
                        each[0].edit(int(start or 0), int(length or 0), text or "")
                        each[2] += 1
            if now is None:  # rows without an identifier have no edits, so none of them waits
                done += close()
                held = {}
            if done:
                yield ready(done)
        if held:
            yield ready(close())

    return run


def apply_edits(docs: DataFrame, edits: DataFrame, trees: DataFrame | None = None, *, ranks: str | None = None, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_tokens_edited, n_edits, n_encoded (code points encoded again), n_chars_edited of every row.

    ``trees`` is what :func:`build_trees` gave for ``docs``, or a table of it from before; without it, trees are built first.
    """
    spark = docs.sparkSession
    arrow_bytes(spark)
    if trees is None:
        trees = Scratch(spark).save(build_trees(docs, ranks=ranks, ident=ident, text=text), "trees")
    kind = docs.schema[ident].dataType
    empty = {"digest": "long", "leaves": "binary", "seq": "long", "start": "long", "length": "long", "text": "string"}

    def rows(df: DataFrame, tag: int, **given) -> DataFrame:
        return df.select(F.col(ident if tag else "doc_id").cast(kind).alias("doc_id"), F.lit(tag).alias("tag"), *(given.get(n, F.lit(None)).cast(t).alias(n) for n, t in empty.items()))

    # a tree for each text, whatever the number of its copies under one identifier
    kept = rows(trees.where("doc_id IS NOT NULL"), 0, digest=F.col("digest"), leaves=F.col("leaves"))
    bodies = rows(docs, 1, digest=_digest(text), text=F.col(text))
    changes = rows(edits.where(F.col(ident).isNotNull()), 2, seq=F.col("seq"), start=F.col("start"), length=F.col("length"), text=F.col("insert"))
    schema = T.StructType([T.StructField("doc_id", kind), *(T.StructField(n, T.LongType()) for n in ("n_tokens", "n_tokens_edited", "n_edits", "n_encoded", "n_chars_edited"))])
    ordered = kept.unionByName(bodies).unionByName(changes).repartition("doc_id").sortWithinPartitions("doc_id", "tag", "seq", "start", "length", "text")
    return ordered.mapInArrow(trimmed(_follow(ranks)), schema)


def sample_edits(docs: DataFrame, *, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """Three edits of every document, computed from its identifier and length: a replacement, a deletion and an insertion."""
    n = F.char_length(F.coalesce(F.col(text), F.lit(""))).cast("long")
    size = F.greatest(n, F.lit(1).cast("long"))
    spot = lambda k: F.pmod(F.xxhash64(F.col(ident), F.lit(k)), size)
    row = lambda seq, start, length, insert: F.struct(F.lit(seq).cast("long").alias("seq"), start.alias("start"), F.lit(length).cast("long").alias("length"), F.lit(insert).alias("insert"))
    changes = F.array(row(1, spot(1), 12, " we're 2024's  new\n"), row(2, spot(2), 30, ""), row(3, spot(3), 0, "inserted words, and more "))
    return docs.select(ident, F.explode(changes).alias("e")).select(ident, "e.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents before and after three edits each."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return apply_edits(docs, sample_edits(docs))


SQL = None  # SQL has no byte-level BPE; tests compare with encoding the edited texts anew
