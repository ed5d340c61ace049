"""Filter and aggregate queries over tables of string cells; nothing is answered that the table does not hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalised, parsed_number, unit

OPS = ("avg", "count", "max", "min", "sum")
_KEY = ["doc_id", "section_id", "table_id"]
#: Words that ask for an aggregate, in the order in which they are tried.
INTENTS = tuple((op, tuple(signs.split("|"))) for op, signs in dict(sum="altogether|combined|sum of|total", count="count|how many|number of", avg="average|mean ", max="highest|largest|maximum|most", min="least|lowest|minimum|smallest").items())


def cells(sections: DataFrame) -> DataFrame:
    """The long form: doc_id, section_id, table_id, row_idx, col_idx, header, cell; short rows have empty cells."""
    each = sections.select("doc_id", F.col("id").alias("section_id"), F.explode("tables").alias("t"))
    rows = each.select("doc_id", "section_id", "t.table_id", "t.headers", F.posexplode("t.rows").alias("row_idx", "row"))
    wide = rows.select(*_KEY, "row_idx", "row", F.posexplode("headers").alias("col_idx", "header"))
    return wide.select(*_KEY, "row_idx", "col_idx", "header", F.coalesce(F.try_element_at("row", F.col("col_idx") + 1), F.lit("")).alias("cell"))


def header_score(header: Column, name: Column) -> Column:
    """How well a header answers to a name: 2 for equality, else word overlap, raised where one contains the other."""
    h, n = normalised(header), normalised(name)
    ht, nt = (F.array_distinct(F.split(x, " ")) for x in (h, n))
    shared = F.size(F.array_intersect(ht, nt))
    overlap = shared / F.size(F.array_union(ht, nt))
    within = h.contains(n) | n.contains(h)
    score = F.when(shared > 0, F.when(within, F.greatest(overlap, F.lit(0.6))).otherwise(overlap)).when(h.contains(n), 0.5).otherwise(0.0)
    return F.when((h == "") | (n == ""), F.lit(0.0)).when(h == n, 2.0).otherwise(score)


def resolve(headers: DataFrame, names: DataFrame) -> DataFrame:
    """For tables (…key, col_idx, header) and asked names (…key, name): the best column that scores 0.3 or more, the first of ties."""
    pairs = names.join(headers, _KEY).withColumn("score", header_score(F.col("header"), F.col("name"))).where("score >= 0.3")
    best = F.max_by(F.struct("col_idx", "header", "score"), F.struct("score", -F.col("col_idx")))
    return pairs.groupBy(*_KEY, "name").agg(best.alias("b")).select(*_KEY, "name", "b.*")


def matches(cell: Column, op: str, value) -> Column:
    """Whether a cell passes a filter: eq and contains on normalised text, gt and lt on parsed numbers; unknown operators pass nothing."""
    if op == "eq":
        return normalised(cell) == normalised(F.lit(str(value)))
    if op == "contains":
        needle = normalised(F.lit(str(value)))
        return (needle != "") & normalised(cell).contains(needle)
    if op in ("gt", "lt"):
        left, right = parsed_number(cell), parsed_number(F.lit(str(value)))
        return F.coalesce(left > right if op == "gt" else left < right, F.lit(False))
    return F.lit(False)


def _column(long: DataFrame, name: str) -> DataFrame:
    """Cells of the column that ``name`` resolves to in each table."""
    heads = long.select(*_KEY, "col_idx", "header").distinct()
    found = resolve(heads, heads.select(*_KEY).distinct().withColumn("name", F.lit(name)))
    return long.join(found.select(*_KEY, "col_idx"), [*_KEY, "col_idx"])


def filter_rows(long: DataFrame, column: str, op: str, value) -> DataFrame:
    """Rows (…key, row_idx) of every table that pass; none where the column does not resolve."""
    return _column(long, column).where(matches(F.col("cell"), op, value)).select(*_KEY, "row_idx")


def numeric_column(long: DataFrame, name: str) -> DataFrame:
    """…key, row_idx, value of the cells that are numbers, in the column that ``name`` resolves to."""
    return _column(long, name).select(*_KEY, "row_idx", parsed_number(F.col("cell")).alias("value")).where("value IS NOT NULL")


def _folded(cells: DataFrame, column: str) -> DataFrame:
    """For every table, the folds of the column that ``column`` resolves to (null where none does); one pass over the cells.

    The best column is chosen from the folds, which are few rows.
    """
    # folding a cell costs less than comparing its header, so every column is folded and headers are compared afterwards
    num = cells.select(*_KEY, "col_idx", "header", "row_idx", parsed_number(F.col("cell")).alias("x"), unit(F.col("cell")).alias("u"))
    column_key = [*_KEY, "col_idx", "header"]
    by_unit = num.groupBy(*column_key, "u").agg(F.sum("x").alias("s"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("rows"), F.count("x").alias("numbers"), F.min(F.when(F.col("x").isNotNull(), F.col("row_idx"))).alias("first"))
    common = F.when(F.col("u").isNotNull() & (F.col("numbers") > 0), F.struct("numbers", -F.col("first")))
    by_column = by_unit.groupBy(*column_key).agg(F.sum("s").alias("sum"), F.min("lo").alias("min"), F.max("hi").alias("max"), (F.sum("s") / F.nullif(F.sum("numbers"), F.lit(0))).alias("avg"), F.sum("rows").cast("double").alias("count"), F.sum("rows").alias("rows"), F.sum("numbers").alias("numbers"), F.max_by("u", common).alias("unit"))
    by_column = by_column.withColumn("score", header_score(F.col("header"), F.lit(column)))
    folds = F.when(F.col("score") >= 0.3, F.struct(*OPS, "rows", "numbers", "unit"))
    return by_column.groupBy(*_KEY).agg(F.max_by(folds, F.struct("score", -F.col("col_idx"))).alias("b"))


def aggregate(long: DataFrame, op: str, column: str, where: tuple[str, str, object] | None = None) -> DataFrame:
    """…key, ok, op, value, unit, n_rows, skipped, reason for every table.

    count counts selected rows whatever they hold; the others fold the cells that are numbers and
    fail where there are none. The unit is the most frequent one, the earliest of ties.
    """
    op = op.lower()
    if op not in OPS:
        nothing = F.lit(0).cast("long")
        return long.select(*_KEY).distinct().select(*_KEY, F.lit(False).alias("ok"), F.lit(op).alias("op"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("string").alias("unit"), nothing.alias("n_rows"), nothing.alias("skipped"), F.lit(f"unknown operation {op}").alias("reason"))
    if where is None:
        out, usable = _folded(long, column).withColumn("has", F.col("b").isNotNull()), F.lit(True)
    else:
        # a table's headers are few: they decide which cells of the rest are needed
        heads = long.select(*_KEY, "col_idx", "header").distinct()
        asked = heads.select(*_KEY).distinct()
        names = asked.select(*_KEY, F.explode(F.array(F.lit(column), F.lit(where[0]))).alias("name")).distinct()
        found = resolve(heads, names)
        known = asked.join(found.groupBy(*_KEY).agg(F.max((F.col("name") == column).cast("int")).alias("has"), F.max((F.col("name") == where[0]).cast("int")).alias("has_filter")), _KEY, "left")
        rows = long.join(found.where(F.col("name") == where[0]).select(*_KEY, "col_idx"), [*_KEY, "col_idx"]).where(matches(F.col("cell"), *where[1:])).select(*_KEY, "row_idx")
        chosen = long.join(found.where(F.col("name") == column).select(*_KEY, "col_idx"), [*_KEY, "col_idx"]).join(rows, [*_KEY, "row_idx"], "left_semi")
        out = known.join(_folded(chosen, column), _KEY, "left").withColumns({"has": F.coalesce("has", F.lit(0)) == 1, "has_filter": F.coalesce("has_filter", F.lit(0)) == 1})
        usable = F.col("has_filter")
    has, numbers = F.col("has"), F.coalesce("b.numbers", F.lit(0))
    ok = has & usable & (F.lit(op == "count") | (numbers > 0))
    reason = F.when(~has, f"no column for {column}").when(~usable, f"no column for {where[0] if where else ''}").when(~ok, "no numbers").otherwise("")
    value = F.when(ok, F.coalesce(f"b.{op}", F.lit(0.0) if op == "count" else F.lit(None).cast("double")))
    rows = F.coalesce("b.rows", F.lit(0)).cast("long") if op == "count" else numbers.cast("long")
    skipped = F.lit(0).cast("long") if op == "count" else (F.coalesce("b.rows", F.lit(0)) - numbers).cast("long")
    zero = F.lit(0).cast("long")
    return out.select(*_KEY, ok.alias("ok"), F.lit(op).alias("op"), value.alias("value"), F.when(ok, F.col("b.unit")).alias("unit"), F.when(ok, rows).otherwise(zero).alias("n_rows"), F.when(ok, skipped).otherwise(zero).alias("skipped"), reason.alias("reason"))


def intent(question: Column) -> Column:
    """The aggregate that a question asks for, or null."""
    low = F.concat(F.lit(" "), F.lower(question), F.lit(" "))
    out = F.lit(None).cast("string")
    for op, signs in reversed(INTENTS):
        hit = F.lit(False)
        for s in signs:
            hit = hit | low.contains(s)
        out = F.when(hit, op).otherwise(out)
    return out


def answer_by_table(questions: DataFrame, long: DataFrame) -> DataFrame:
    """qid, …key, op, header, value, n_rows: aggregates that questions ask for, of columns whose header they name.

    ``questions`` are (qid, doc_id, section_id, question). A table is passed over when the question
    names a value of one of its text columns, as it then asks for a part of the rows.
    """
    asked = questions.withColumn("op", intent(F.col("question"))).where("op IS NOT NULL").withColumn("q", F.array_distinct(F.split(normalised(F.col("question")), " ")))
    typed = long.withColumn("x", parsed_number(F.col("cell")))
    columns = typed.groupBy(*_KEY, "col_idx", "header").agg(F.count("x").alias("numbers"), F.sum("x").alias("sum"), F.min("x").alias("min"), F.max("x").alias("max"), F.avg("x").alias("avg"), F.count("*").cast("double").alias("count"))
    words = typed.join(columns.where("numbers = 0").select(*_KEY, "col_idx"), [*_KEY, "col_idx"]).select(*_KEY, F.explode(F.split(normalised(F.col("cell")), " ")).alias("w")).where("length(w) > 3").distinct()
    named = asked.select("qid", "doc_id", "section_id", F.explode("q").alias("w")).join(words, ["doc_id", "section_id", "w"]).select("qid", *_KEY).distinct()
    pairs = asked.join(columns.where("numbers > 0"), ["doc_id", "section_id"]).withColumn("overlap", F.size(F.array_intersect("q", F.split(normalised(F.col("header")), " ")))).where("overlap > 0")
    free = pairs.join(named, ["qid", *_KEY], "left_anti")
    value = F.coalesce(*[F.when(F.col("op") == o, F.col(o)) for o in OPS])
    best = Window.partitionBy("qid").orderBy("table_id", F.desc("overlap"), "col_idx")
    return free.withColumn("rank", F.row_number().over(best)).where("rank = 1").select("qid", *_KEY, "op", "header", value.alias("value"), F.when(F.col("op") == "count", F.col("count").cast("long")).otherwise(F.col("numbers")).alias("n_rows"))


def render(rows: DataFrame, budget: int = 1500) -> DataFrame:
    """…key, text of tables from (…key, headers, row_idx, row): header and rows up to ``budget`` characters, at least one row.

    Rows are a prefix, so a running sum of their lengths decides.
    """
    order = Window.partitionBy(*_KEY).orderBy("row_idx")
    sized = rows.withColumn("head", F.array_join("headers", " | ")).withColumn("line", F.array_join("row", " | "))
    sized = sized.withColumn("used", F.sum(F.length("line") + 1).over(order) + F.length("head")).withColumn("n", F.row_number().over(order))
    kept = F.when((F.col("used") <= budget) | (F.col("n") == 1), F.struct("n", "line"))
    out = sized.groupBy(*_KEY).agg(F.first("head").alias("head"), F.array_sort(F.collect_list(kept)).alias("lines"), F.count("*").alias("rows"))
    more = F.col("rows") - F.size("lines")
    body = F.concat_ws("\n", F.col("head"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n"))
    return out.select(*_KEY, F.concat(F.lit("Table "), "table_id", F.lit(":\n"), body, F.when(more > 0, F.concat(F.lit("\n… (+"), more.cast("string"), F.lit(" more rows)"))).otherwise("")).alias("text"))
