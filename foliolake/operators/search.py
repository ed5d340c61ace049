"""Lexical search: many questions against many sections in one plan.

Sections are (doc_id, sec_idx, tokens); questions are (qid, tokens). Only terms
that some question has leave the section rows, so what is shuffled follows the
matches and not the corpus, and terms are counted inside their row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.folder import held
from ..functions.small import few, small
from ..functions.text import counted

K1, B = 1.2, 0.75
#: Most asked terms that are looked for inside a row; more are joined.
LISTED = 1000


def top_k(scored: DataFrame, k: int, by: list[str] | None = None, score: str = "score") -> DataFrame:
    """The ``k`` best rows for each ``by`` with their rank from 1; ties, which scores that differ by the order of a sum are too, by document and section."""
    order = Window.partitionBy(*(by or ["qid"])).orderBy(F.round(score, 9).desc(), "doc_id", "sec_idx")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _asked(questions: DataFrame):
    """qid, term of the questions, and what marks a table with no more rows than that for broadcast, if they are few."""
    asked = questions.select("qid", F.explode(F.array_distinct("tokens")).alias("term"))
    mark = F.broadcast if few(asked) else lambda df: df
    return mark(asked), mark


class Live:
    """Statistics of (doc_id, sec_idx, tokens) that are counted at each search.

    The asked terms of each section and its sizes are written in one pass over the texts, a short row for each
    section; hits and totals are read from there.
    """

    def __init__(self, sections: DataFrame):
        self.sections, self.sized = sections, None

    def hits(self, asked: DataFrame, mark) -> DataFrame:
        """doc_id, sec_idx, length, distinct, term, tf of the terms that are asked for."""
        listed = [r.term for r in asked.select("term").distinct().limit(LISTED + 1).collect()]
        if len(listed) <= LISTED:
            found = counted(F.filter("tokens", lambda t: t.isin(listed)))
            self.sized = held(self.sections.select("doc_id", "sec_idx", F.size("tokens").alias("length"), F.size(F.array_distinct("tokens")).alias("distinct"), found.alias("found")), "search")
            return self.sized.select("doc_id", "sec_idx", "length", "distinct", F.inline("found")).withColumn("tf", F.col("tf").cast("long"))
        terms = mark(asked.select("term").distinct())
        # sizes first, as what stands beside a generator is computed for each of its rows
        sized = self.sections.select("doc_id", "sec_idx", F.size("tokens").alias("length"), F.size(F.array_distinct("tokens")).alias("distinct"), "tokens")
        # the outer form makes no filter on the tokens, which would compute them twice
        rows = sized.select("doc_id", "sec_idx", "length", "distinct", F.explode_outer("tokens").alias("term"))
        return rows.join(terms, "term").groupBy("doc_id", "sec_idx", "length", "distinct", "term").agg(F.count("*").alias("tf"))

    def totals(self, by: list[str]) -> DataFrame:
        """…by, n (sections), mean (length)."""
        sized = self.sized if self.sized is not None else self.sections.select("doc_id", F.size("tokens").alias("length"))
        return sized.groupBy(*by).agg(F.count("*").alias("n"), F.avg("length").alias("mean"))

    def frequencies(self, by: list[str]) -> DataFrame:
        """…by, term, df of all terms."""
        # the outer form makes no filter on the tokens, which would compute them twice
        each = self.sections.select(*by, F.explode_outer(F.array_distinct("tokens")).alias("term"))
        return each.groupBy(*by, "term").agg(F.count("*").alias("df")).where("term IS NOT NULL")

    def postings(self) -> DataFrame:
        return self.sections.select("doc_id", "sec_idx", F.inline(counted(F.col("tokens"))))

    def mean_idf(self, by: list[str]) -> DataFrame:
        """…by, mean_idf over all terms."""
        return _joined(self.frequencies(by), self.totals(by), by).groupBy(*by).agg(F.avg(_raw_idf()).alias("mean_idf"))

    def norms(self, by: list[str], sublinear: bool = False, most: float = 1.0) -> DataFrame:
        """doc_id, sec_idx, norm of the tf-idf weights, without terms that more than a share of ``most`` of the sections have."""
        idf = _rare(_joined(self.frequencies(by), self.totals(by), by), most).select(*by, "term", _smooth_idf().alias("idf"))
        # a share of the vocabulary is held by each task, so the postings need no sort
        return self.postings().join(idf.hint("shuffle_hash"), [*by, "term"]).groupBy("doc_id", "sec_idx").agg(F.sqrt(F.sum((_damped("tf", sublinear) * F.col("idf")) ** 2)).alias("norm"))


def _damped(tf: str, sublinear: bool) -> Column:
    return 1 + F.ln(tf) if sublinear else F.col(tf)


def _rare(df: DataFrame, most: float) -> DataFrame:
    return df if most >= 1 else df.where(F.col("df") <= F.col("n") * most)


def _source(sections):
    return Live(sections) if isinstance(sections, DataFrame) else sections


def _raw_idf() -> Column:
    return F.ln(F.col("n") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)


def _smooth_idf() -> Column:
    return F.ln((F.col("n") + 1) / (F.col("df") + 1)) + 1


def _joined(df: DataFrame, totals: DataFrame, by: list[str]) -> DataFrame:
    return df.join(totals, by) if by else df.crossJoin(F.broadcast(totals))  # one row of totals


def _scope(per_document: bool) -> list[str]:
    return ["doc_id"] if per_document else []


def bm25(sections, questions: DataFrame, *, per_document: bool = False, k1: float = K1, b: float = B) -> DataFrame:
    """qid, doc_id, sec_idx, score with idf = ln((N - n + 0.5) / (n + 0.5)), at least 1e-6.

    ``sections`` are (doc_id, sec_idx, tokens) or a stored index (``index.Stored``). Statistics are of all
    sections or, with ``per_document``, of the section's own document.
    """
    source, (asked, mark), by = _source(sections), _asked(questions), _scope(per_document)
    hits = source.hits(asked, mark)
    df = _joined(hits.groupBy(*by, "term").agg(F.count("*").alias("df")), source.totals(by), by)
    joined = hits.join(df if by else mark(df), [*by, "term"])
    idf = F.greatest(F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    return joined.withColumn("w", weight).join(asked, "term").groupBy("qid", "doc_id", "sec_idx").agg(F.sum("w").alias("score"))


def bm25_okapi(sections, questions: DataFrame, *, per_document: bool = True, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """qid, doc_id, sec_idx, score over the best score of the question in the document.

    A negative idf = ln((N - n + 0.5) / (n + 0.5)) is replaced by ``epsilon`` times the mean idf of all terms of the scope.
    """
    by = _scope(per_document)
    scored = _okapi(_source(sections), questions, by, k1, b, epsilon)
    best = scored.groupBy("qid", *by).agg(F.max("score").alias("best"))
    return scored.join(best, ["qid", *by]).select("qid", "doc_id", "sec_idx", (F.col("score") / (F.col("best") + 1e-8)).alias("score"))


def _okapi(source, questions: DataFrame, by: list[str], k1: float, b: float, epsilon: float) -> DataFrame:
    asked, mark = _asked(questions)
    hits = source.hits(asked, mark)
    df = _joined(hits.groupBy(*by, "term").agg(F.count("*").alias("df")), source.totals(by), by)
    known = _joined(df, source.mean_idf(by), by)
    joined = hits.join(known if by else mark(known), [*by, "term"]).withColumn("idf", _raw_idf())
    weight = F.when(F.col("idf") < 0, F.col("mean_idf") * epsilon).otherwise(F.col("idf")) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    return joined.withColumn("w", weight).join(asked, "term").groupBy("qid", "doc_id", "sec_idx").agg(F.sum("w").alias("score"))


def bm25_two_queries(sections, questions: DataFrame, *, per_document: bool = True, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """qid, doc_id, sec_idx, score: the larger of the unscaled Okapi scores of a question's words and of its content words.

    ``questions`` are (qid, tokens, content); where ``content`` is empty the words stand for it. A word that a
    question repeats counts each time.
    """
    source, by = _source(sections), _scope(per_document)
    both = questions.select("qid", F.explode(F.array(F.struct(F.lit("w").alias("form"), F.col("tokens").alias("tokens")), F.struct(F.lit("c").alias("form"), F.when(F.size("content") > 0, F.col("content")).otherwise(F.col("tokens")).alias("tokens")))).alias("f"))
    # a form of a question is a question of its own; repeated words are weighed by their number
    each = both.select(F.struct("qid", F.col("f.form").alias("form")).alias("qid"), F.explode("f.tokens").alias("term")).groupBy("qid", "term").agg(F.count("*").alias("times"))
    asked = small(each)
    mark = F.broadcast if few(each) else lambda df: df
    hits = source.hits(asked, mark)
    df = _joined(hits.groupBy(*by, "term").agg(F.count("*").alias("df")), source.totals(by), by)
    known = _joined(df, source.mean_idf(by), by)
    joined = hits.join(known if by else mark(known), [*by, "term"]).withColumn("idf", _raw_idf())
    weight = F.when(F.col("idf") < 0, F.col("mean_idf") * epsilon).otherwise(F.col("idf")) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    scored = joined.withColumn("w", weight).join(asked, "term").groupBy("qid", "doc_id", "sec_idx").agg(F.sum(F.col("w") * F.col("times")).alias("score"))
    return scored.groupBy(F.col("qid.qid").alias("qid"), "doc_id", "sec_idx").agg(F.max("score").alias("score"))


def tfidf(sections, questions: DataFrame, *, per_document: bool = False, sublinear: bool = False, most: float = 1.0) -> DataFrame:
    """qid, doc_id, sec_idx, score: cosine of tf times ln((1 + N) / (1 + n)) + 1; terms that no section has do not count.

    ``sublinear`` takes 1 + ln(tf), and ``most`` leaves out terms that a larger share of the sections have (not with a stored index).
    """
    source, by = _source(sections), _scope(per_document)
    asked = questions.select("qid", F.explode("tokens").alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qtf"))
    mark = F.broadcast if few(asked) else lambda df: df
    hits = source.hits(asked, mark)
    idf = _rare(_joined(hits.groupBy(*by, "term").agg(F.count("*").alias("df")), source.totals(by), by), most).select(*by, "term", _smooth_idf().alias("idf"))
    qw = mark(asked).join(idf, "term").withColumn("qw", _damped("qtf", sublinear) * F.col("idf"))
    qn = qw.groupBy("qid", *by).agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qnorm"))
    dots = hits.join(qw.select("qid", *by, "term", "qw", "idf"), [*by, "term"]).groupBy("qid", "doc_id", "sec_idx").agg(F.sum(_damped("tf", sublinear) * F.col("idf") * F.col("qw")).alias("dot"))
    norms = source.norms(by, sublinear, most) if sublinear or most < 1 else source.norms(by)
    return dots.join(norms, ["doc_id", "sec_idx"]).join(qn, ["qid", *by]).select("qid", "doc_id", "sec_idx", (F.col("dot") / (F.col("norm") * F.col("qnorm"))).alias("score"))


def overlap(sections, questions: DataFrame) -> DataFrame:
    """qid, doc_id, sec_idx, score: Jaccard similarity of token sets, for sections that share a token."""
    asked, mark = _asked(questions)
    sizes = questions.select("qid", F.size(F.array_distinct("tokens")).alias("q"))
    shared = _source(sections).hits(asked, mark).join(asked, "term").groupBy("qid", "doc_id", "sec_idx", F.col("distinct").alias("d")).agg(F.count("*").alias("s"))
    return shared.join(mark(sizes), "qid").select("qid", "doc_id", "sec_idx", (F.col("s") / (F.col("q") + F.col("d") - F.col("s"))).alias("score"))


PROVIDERS = {"bm25": bm25_okapi, "tfidf": tfidf, "keyword": overlap}


def provider(name: str = "bm25"):
    """A scoring function by name."""
    if name not in PROVIDERS:
        raise ValueError(f"unknown search provider {name!r}; choose from {sorted(PROVIDERS)}")
    return PROVIDERS[name]
