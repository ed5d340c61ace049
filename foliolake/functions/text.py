"""Text functions as Column expressions; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words without content in questions, for retrieval.
RETRIEVAL_STOP = sorted(set("according an and annual are be been being by can cannot could describe describes described did do does doesnt dont for from global had has have how in is it its may might must of on or report said say says shall should that the these this those to was were what which will with would year a at".split()))
#: Words that never become keywords.
KEYWORD_STOP = sorted(set("""a about above all also an and any are as at be been being below between by can could did do does each else for from had has
 have how if in into is it it's its may might more most must new no not now of on only or other our over per report say says should so some such
 than that the their them then these they this those to under use used using via was we were what when where which who whom why will with within would""".split()))
#: Filler words of questions and figure labels, and modifiers that a label may have or lack.
FILLERS = sorted(set("a an and are as at be by did do does for from how in is it its many much of on or our per that the there this to was we were what which with you your".split()))
MODIFIERS = sorted(set("amount annual average avg count daily gross mean median monthly net number overall total value yearly".split()))


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once per row: lambdas inside see a variable and not the expression."""
    return F.element_at(F.transform(F.array(value), use), 1)


def counted(tokens: Column) -> Column:
    """(term, tf) of the distinct tokens of an array, from its sorted runs; no shuffle is needed."""

    def runs(s: Column) -> Column:
        heads = F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (F.get(s, i - 1) != x), i)), lambda i: i.isNotNull())
        return let(heads, lambda h: F.transform(h, lambda at, j: F.struct(F.get(s, at).alias("term"), (F.coalesce(F.get(h, j + 1), F.size(s)) - at).alias("tf"))))

    return let(F.sort_array(tokens), runs)  # array_sort calls a comparator for each pair


def words(c: Column) -> Column:
    """Lower-cased tokens between white space; punctuation stays attached."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"\S+"), F.lit(0))


def terms(c: Column) -> Column:
    """Retrieval tokens: letters, digits and hyphens of ASCII, longer than one character."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[a-z0-9\-]{2,}"), F.lit(0))


def question_terms(c: Column) -> Column:
    """Distinct content terms of a question: longer than two characters and no stop words."""
    return F.array_distinct(F.filter(terms(c), lambda w: (F.length(w) > 2) & ~w.isin(RETRIEVAL_STOP)))


def keyword_terms(c: Column) -> Column:
    """Candidates for keywords, in order and with repetitions."""
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[a-z0-9][a-z0-9\-]{2,}"), F.lit(0)), lambda w: ~w.isin(KEYWORD_STOP))


def plain_tokens(c: Column) -> Column:
    """Runs of ASCII letters and digits, lower-cased."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def singular_tokens(c: Column) -> Column:
    """Plain tokens without a plural s."""
    cut = lambda w: F.when((F.length(w) > 3) & w.endswith("s") & ~w.endswith("ss"), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w)
    return F.transform(plain_tokens(c), cut)


def normalised(c: Column) -> Column:
    """Lower case, every run of other signs one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def sentences(c: Column, least: int = 16) -> Column:
    """Sentences of at least ``least`` characters."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), r"(?<=[.!?])\s+"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    return F.filter(parts, lambda s: F.length(s) >= least)


def token_estimate(c: Column) -> Column:
    """1.3 tokens for every word, rounded down."""
    return F.floor(F.size(words(c)) * 1.3).cast("int")


def _magnitude(low: Column, sizes: tuple[tuple[str, float], ...], use) -> Column:
    """``use(number text, scale)`` with the first magnitude word of ``sizes`` that ``low`` has taken out and turned into a scale."""
    names = "|".join(w for w, _ in sizes)

    def scaled(found: Column) -> Column:
        # of several words only the largest counts and is removed
        best = F.element_at(F.filter(F.array(*[F.lit(w) for w, _ in sizes]), lambda w: F.array_contains(found, w)), 1)
        scale = lambda w: F.coalesce(*[F.when(w == n, F.lit(x)) for n, x in sizes], F.lit(1.0))
        return let(best, lambda w: use(F.regexp_replace(low, F.concat(F.lit("(?<![a-z0-9_])"), w, F.lit("(?![a-z0-9_])")), F.lit(" ")), scale(w)))

    found = F.regexp_extract_all(low, F.lit(rf"(?<![a-z0-9_])({names})(?![a-z0-9_])"), F.lit(1))
    return F.when(low.rlike(names), let(found, lambda f: F.when(F.size(f) > 0, scaled(f)).otherwise(use(low, F.lit(1.0))))).otherwise(use(low, F.lit(1.0)))


def parsed_number(c: Column) -> Column:
    """The number in a table cell, or null: separators, magnitude words and a final k are understood."""

    def number(text: Column, scale: Column) -> Column:
        clean = F.regexp_replace(F.replace(text, F.lit(","), F.lit("")), r"(?<=[0-9])\s+(?=[0-9]{3}(?![a-z0-9_]))", "")
        found = F.regexp_extract(clean, r"-?[0-9]+(?:\.[0-9]+)?k?", 0)
        return let(found, lambda x: F.rtrim(x, F.lit("k")).try_cast("double") * F.when(x.endswith("k"), 1e3).otherwise(1.0)) * scale

    blank = ("", "n/a", "na", "-", "–", "—", "tbd", "none", "null")
    sizes = (("billion", 1e9), ("million", 1e6), ("thousand", 1e3))
    return let(F.lower(F.trim(c)), lambda low: F.when(~low.isin(*blank), _magnitude(low, sizes, number)))


def parsed_figure(c: Column) -> Column:
    """The number in a key figure, or null: like :func:`parsed_number` with trillions, but without blanks and joined groups."""

    def number(text: Column, scale: Column) -> Column:
        found = F.regexp_extract(F.replace(text, F.lit(","), F.lit("")), r"-?[0-9]+(?:\.[0-9]+)?k?", 0)
        return let(found, lambda x: F.rtrim(x, F.lit("k")).try_cast("double") * F.when(x.endswith("k"), 1e3).otherwise(1.0)) * scale

    sizes = (("trillion", 1e12), ("billion", 1e9), ("million", 1e6), ("thousand", 1e3))
    return let(F.lower(F.trim(c)), lambda low: _magnitude(low, sizes, number))


def unit(c: Column) -> Column:
    """The sign that a cell's number carries, or null."""
    return F.when(c.contains("%"), "%").when(c.contains("$"), "$").when(F.lower(F.trim(c)).endswith("x"), "x")


def escaped(c: Column) -> Column:
    """Text for HTML content and attributes."""
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(sign), F.lit(name))
    return c


def slug(c: Column) -> Column:
    """Document identifier of a file name without extension."""
    c = F.regexp_replace(c, "([a-z])([A-Z])", "$1-$2")
    c = F.regexp_replace(c, "([A-Za-z])([0-9])", "$1-$2")
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def file_title(c: Column, split_camel: bool = False) -> Column:
    """Readable title of a file name without extension: separators become spaces, words are capitalised."""
    if split_camel:
        c = F.regexp_replace(F.regexp_replace(c, "([a-z])([A-Z])", "$1 $2"), "([A-Za-z])([0-9])", "$1 $2")
    spaced = F.trim(F.regexp_replace(c, r"[\-_\s]+", " "))
    # a letter after any other sign is raised, which initcap alone does after spaces only
    pieces = F.regexp_extract_all(spaced, F.lit("[A-Za-z]+|[^A-Za-z]+"), F.lit(0))
    return F.array_join(F.transform(pieces, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, F.lit(2), F.length(p))))), "")


def json_block(c: Column) -> Column:
    """The JSON in a model's reply: a fenced block, else the widest bracketed stretch, else the trimmed reply."""
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)```", 1)
    bare = F.regexp_extract(c, r"(?s)(\[.*\]|\{.*\})", 1)
    return F.regexp_replace(F.when(fenced != "", fenced).when(bare != "", bare).otherwise(c), r"^\s+|\s+$", "")


def jaccard(a: Column, b: Column) -> Column:
    """Size of the intersection over the size of the union, 0 for two empty sets."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))
