"""Scores of answers against references by numbers, words and phrases, and reports over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import RETRIEVAL_STOP, let, plain_tokens

_STEPS = ((0.70, 10), (0.55, 9), (0.40, 8), (0.28, 7), (0.18, 6), (0.10, 5), (0.04, 3))
MISSING = r"^not found in (the )?context"


def _numbers(c: Column) -> Column:
    joined = F.regexp_replace(F.regexp_replace(c, ",", ""), r"(?<=[0-9])\s+(?=[0-9]{3}(?![a-z0-9_]))", "")
    raw = F.regexp_extract_all(joined, F.lit(r"(?:^|[^a-z0-9_])([0-9][0-9.]*)"), F.lit(1))
    return F.transform(raw, lambda x: x.try_cast("double"))


def _close(a: Column, b: Column) -> Column:
    """Within six percent of the reference number."""
    return F.coalesce(F.abs(a - b) / F.greatest(F.abs(a), F.lit(0.001)) < 0.06, F.lit(False))


def ratios(candidate: Column, reference: Column) -> tuple[Column, Column, Column, Column]:
    """(numbers, words, phrases, whether the reference has numbers), each share from 0 to 1."""
    cand, ref = F.lower(F.trim(candidate)), F.lower(F.trim(reference))
    wanted = _numbers(F.regexp_replace(ref, r"§\s*[0-9.]+|(?<![a-z0-9_])section\s+[0-9.]+", " "))
    have = _numbers(cand)
    # let: else each number of the reference takes the answer apart again
    hits = let(have, lambda h: F.size(F.filter(wanted, lambda r: F.exists(h, lambda c: _close(r, c)))))
    recall = hits / F.greatest(F.size(wanted), F.lit(1))
    result = F.regexp_extract(ref, r"=\s*([0-9][0-9, ]*[0-9]|[0-9])", 1)
    settled = (result != "") & F.exists(have, lambda c: _close(F.regexp_replace(result, "[, ]", "").try_cast("double"), c))
    num = F.greatest(recall, settled.cast("double"))
    keys = F.array_distinct(F.filter(plain_tokens(ref), lambda w: (F.length(w) > 2) & ~w.isin(RETRIEVAL_STOP)))
    kw = F.size(F.array_intersect(keys, plain_tokens(cand))) / F.greatest(F.size(keys), F.lit(1))
    phrases = F.filter(F.transform(F.split(ref, r"[;|:\-–]"), lambda p: F.trim(p)), lambda p: (F.length(p) > 4) & (F.length(p) < 60))
    said = F.size(F.filter(phrases, lambda p: cand.contains(p))) / F.greatest(F.size(phrases), F.lit(1))
    return num, kw, said, F.size(wanted) > 0


def score(candidate: Column, reference: Column) -> Column:
    """0 to 10."""

    def points_of(r: Column) -> Column:
        num, kw, has = r["num"], r["kw"], r["has"]
        combined = 0.5 * num + 0.3 * kw + 0.2 * r["said"]
        steps = F.lit(0)
        for least, points in reversed(_STEPS):
            steps = F.when(combined >= least, points).otherwise(steps)
        return F.when((num >= 0.75) & (kw >= 0.45), 10).when(~has & (kw >= 0.6), 10).when(~has & (kw >= 0.4), 9).otherwise(steps)

    # the shares are computed once and not for each step
    shares = F.struct(*(c.alias(n) for n, c in zip(("num", "kw", "said", "has"), ratios(candidate, reference))))
    return F.when(F.lower(F.trim(candidate)).rlike(MISSING), 0).otherwise(let(shares, points_of))


def report(results: DataFrame, by: list[str]) -> DataFrame:
    """…by, questions, mean score, pass rate (7 and more), tokens and mean time of (score, tokens, ms)."""
    return results.groupBy(*by).agg(F.count("*").alias("n_questions"), F.avg("score").alias("avg_score"), F.avg((F.col("score") >= 7).cast("double")).alias("pass_rate"), F.sum("tokens").alias("tokens"), F.avg("ms").alias("avg_ms"))


def layer_report(answers: DataFrame) -> DataFrame:
    """layer_used, answers and their share, and tokens."""
    total = answers.agg(F.count("*").alias("total"))
    return answers.groupBy("layer_used").agg(F.count("*").alias("n"), F.sum("tokens_used").alias("tokens")).crossJoin(F.broadcast(total)).select("layer_used", "n", (F.col("n") / F.col("total")).alias("share"), "tokens")


def markdown(rows: DataFrame, title: str) -> str:
    """A report as a Markdown table; reports have one row for each group."""
    head = "| " + " | ".join(rows.columns) + " |"
    shown = lambda v: "" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(map(shown, r)) + " |" for r in rows.orderBy(*rows.columns[:1]).toLocalIterator()]
    return "\n".join([f"# {title}", "", head, "|" + " --- |" * len(rows.columns), *lines, ""])


def write_reports(spark, path: str, **reports: DataFrame) -> None:
    """Each report as JSON lines in ``path``/name and as one Markdown file in ``path``/name.md."""
    for name, rows in reports.items():
        rows.coalesce(1).write.mode("overwrite").json(f"{path}/{name}")
        spark.createDataFrame([(markdown(rows, name),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{name}.md")
