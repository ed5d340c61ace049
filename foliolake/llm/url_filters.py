"""Temporal URL filters: dated list entries, validity intervals, and an as-of join with captures.

List rows (list, action, key, day, op) add or remove a key; a key is a host, one
of its parent domains, or a host with leading path segments. The events of a key
are reduced to one per day and become disjoint validity intervals. A capture asks
for all keys of its address as of its fetch day. The join runs on key and month
bucket, so a key with a long history meets few intervals; the list is broadcast
only after its bytes were summed, and otherwise both sides are shuffled with a
salt, so a host that has a third of all captures is spread over many tasks.

The most specific active key decides; an allowing entry beats a blocking one on
the same key. Defined cases: null or unparsable addresses and captures without a
day match nothing and are allowed; list rows with a null in key, day or op are
ignored; if a key is added and removed on one day, the removal wins; repeated
list rows count once; repeated captures are judged one by one; very long addresses
have as many keys as labels and path segments. Empty tables give empty or
allowing results. Extra columns of captures pass through whatever their names:
where one is called like a result column, :func:`evaluate` gives that result a name with
underscores, and :func:`blocked_removed` returns the columns of its captures alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Scratch, fresh

NAME = "op2_url_filters"
BUCKET_DAYS, SALTS = 32, 16
#: Most bytes of interval rows (keys, names of lists and 64 more a row) that are broadcast.
BROADCAST_BYTES = 64 << 20
_FOREVER = "9999-12-31"


def host_of(url: Column) -> Column:
    """The lower-cased host of an absolute address, without user, port and final dot; empty where there is none."""
    return F.rtrim(F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))), F.lit("."))


def keys_of(url: Column) -> Column:
    """All keys that may list an address: the host, its parent domains, and the host with each leading path."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    steps = F.filter(F.split(F.coalesce(F.regexp_extract(url, r"^[^:]*://[^/?#]*([^?#]*)", 1), F.lit("")), "/"), lambda s: s != "")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    paths = F.when(F.size(steps) > 0, F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(steps, F.lit(1), i), "/")))).otherwise(F.array().cast("array<string>"))
    return F.when(host != "", F.concat(domains, paths)).otherwise(F.array().cast("array<string>"))


def intervals(entries: DataFrame) -> DataFrame:
    """list, action, key, since, until (exclusive): when each entry was in force."""
    used = entries.where("key IS NOT NULL AND day IS NOT NULL AND op IN ('add', 'remove')")
    host = F.substring_index("key", "/", 1)
    key = F.concat(F.lower(host), F.expr("substring(key, length(substring_index(key, '/', 1)) + 1)"))  # paths keep their case, as in keys_of
    # one event per day first, so the window below has at most as many rows as the history has days
    daily = used.groupBy("list", "action", key.alias("key"), F.col("day").cast("date").alias("day")).agg(F.max("op").alias("op"))
    w = Window.partitionBy("list", "action", "key").orderBy("day")
    return daily.withColumn("until", F.coalesce(F.lead("day").over(w), F.to_date(F.lit(_FOREVER)))).where("op = 'add'").select("list", "action", "key", F.col("day").alias("since"), "until")


def _bucket(day: Column) -> Column:
    return F.floor(F.datediff(day, F.to_date(F.lit("1970-01-01"))) / BUCKET_DAYS).cast("int")


def evaluate(captures: DataFrame, entries: DataFrame, *, url: str = "url", day: str = "fetched", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``captures`` with verdict (block or allow), rule (the deciding key or null) and n_active (entries in force) added."""
    return _judged(captures, entries, url, day, broadcast_bytes)[0]


def _judged(captures: DataFrame, entries: DataFrame, url: str, day: str, broadcast_bytes: int) -> tuple[DataFrame, str]:
    """The captures with the three columns, and the name of the verdict."""
    scratch = Scratch(captures.sparkSession)
    row = fresh(captures, "__row")
    # numbered and written once: verdicts come back to the rows by this number
    numbered = scratch.save(captures.withColumn(row, F.monotonically_increasing_id()), "captures")
    span = numbered.select(F.min(_bucket(F.col(day))), F.max(_bucket(F.col(day)))).first()
    asked = numbered.select(F.col(row).alias("row"), F.col(day).alias("day"), F.explode(keys_of(F.col(url))).alias("key")).withColumn("bucket", _bucket(F.col("day")))
    valid = intervals(entries)
    lo, hi = (F.lit(x if x is not None else 0) for x in span)
    pieces = valid.withColumn("from", F.greatest(_bucket(F.col("since")), lo)).withColumn("to", F.least(_bucket(F.date_sub("until", 1)), hi)).where("`from` <= `to`").withColumn("bucket", F.explode(F.sequence("from", "to"))).select("list", "action", "key", "since", "until", "bucket")
    pieces = scratch.save(pieces, "pieces")  # measured and joined, but computed once
    active = (F.col("day") >= F.col("since")) & (F.col("day") < F.col("until"))
    size = pieces.select(F.sum(F.octet_length("key") + F.coalesce(F.octet_length("list"), F.lit(0)) + 64)).first()[0] or 0
    if size <= broadcast_bytes:
        found = asked.join(F.broadcast(pieces), ["key", "bucket"]).where(active)
    else:
        salted = pieces.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
        found = asked.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(salted, ["key", "bucket", "salt"]).where(active)
    rank = F.struct(F.length("key").alias("size"), (F.col("action") == "allow").cast("int").alias("allow"), F.col("key").alias("key"))
    best = found.groupBy("row").agg(F.max(rank).alias("hit"), F.count("*").alias("n"))
    names = []
    for name in ("verdict", "rule", "n_active"):
        names.append(fresh(captures, name))
    verdict = F.when(F.col("hit").isNotNull() & (F.col("hit.allow") == 0), "block").otherwise("allow")
    result = best.select(F.col("row").alias(key := fresh(captures, "__at")), verdict.alias(names[0]), F.col("hit.key").alias(names[1]), F.col("n").cast("long").alias(names[2]))
    joined = numbered.join(result, numbered[row] == result[key], "left")
    out = joined.select(*(numbered[c] for c in captures.columns), F.coalesce(result[names[0]], F.lit("allow")).alias(names[0]), result[names[1]], F.coalesce(result[names[2]], F.lit(0).cast("long")).alias(names[2]))
    return out, names[0]


def blocked_removed(captures: DataFrame, entries: DataFrame, *, url: str = "url", day: str = "fetched", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The captures that were allowed when fetched, with their columns."""
    judged, verdict = _judged(captures, entries, url, day, broadcast_bytes)
    return judged.where(F.col(verdict) == "allow").select(*captures.columns)


def sample_captures(pages: DataFrame) -> DataFrame:
    """page_id, url and a fetch day computed from the identifier; every third page has its first path segment in capitals."""
    shouted = F.concat(F.regexp_extract("url", "^([^:]*://[^/?#]*)", 1), F.upper(F.regexp_extract("url", "^[^:]*://[^/?#]*(/[^/?#]*)?", 1)), F.regexp_extract("url", "^[^:]*://[^/?#]*(?:/[^/?#]*)?(.*)$", 1))
    url = F.when((F.col("page_id") % 3 == 0) & F.col("url").rlike("^[^:]*://[^/?#]*/"), shouted).otherwise(F.col("url"))
    return pages.select("page_id", url.alias("url"), F.date_add(F.to_date(F.lit("2023-01-01")), F.pmod(F.col("page_id") * 37, F.lit(900)).cast("int")).alias("fetched"))


def sample_entries(pages: DataFrame) -> DataFrame:
    """A dated list over all hosts of the pages, computed from their digests."""
    host = pages.select(host_of(F.col("url")).alias("host")).where("host <> ''").distinct()
    host = host.withColumn("x", F.conv(F.substring(F.md5("host"), 1, 6), 16, 10).cast("int")).withColumn("domain", F.regexp_replace("host", r"^[^.]*\.", ""))
    day = lambda shift: F.date_add(F.to_date(F.lit("2023-01-01")), (F.col("x") % 500 + shift).cast("int"))
    event = lambda name, action, key, shift, op: F.struct(F.lit(name).alias("list"), F.lit(action).alias("action"), key.alias("key"), day(shift).alias("day"), F.lit(op).alias("op"))
    name, domain = F.col("host"), F.col("domain")
    sets = [
        (4, [event("hosts", "block", name, shift, op) for shift, op in ((0, "add"), (90, "remove"), (200, "add"))]),
        (3, [event("domains", "block", domain, shift, op) for shift, op in ((50, "add"), (120, "remove"))]),
        (5, [event("exceptions", "allow", name, 20, "add")]),
        (7, [event("paths", "block", F.concat(name, F.lit("/en")), 10, "add"), event("paths", "block", F.concat(F.upper(name), F.lit("/EN")), 30, "add")]),
    ]
    chosen = [F.when(F.col("x") % m == 0, F.array(*events)).otherwise(F.slice(F.array(*events), 1, 0)) for m, events in sets]
    return host.select(F.inline(F.concat(*chosen)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page as of its fetch day."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return evaluate(sample_captures(pages), sample_entries(pages)).select("page_id", host_of(F.col("url")).alias("host"), F.col("fetched").cast("string").alias("fetched"), "verdict", "rule", "n_active")


SQL = r"""
WITH raw AS (
  SELECT page_id, CASE WHEN page_id % 3 = 0 AND regexp_matches(url, '^[^:]*://[^/?#]*/')
    THEN regexp_extract(url, '^([^:]*://[^/?#]*)', 1) || upper(regexp_extract(url, '^[^:]*://[^/?#]*(/[^/?#]*)?', 1)) || regexp_extract(url, '^[^:]*://[^/?#]*(?:/[^/?#]*)?(.*)$', 1) ELSE url END AS url
  FROM pages
),
page AS (
  SELECT page_id, url, rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '.') AS host,
         DATE '2023-01-01' + CAST(page_id * 37 % 900 AS INTEGER) AS fetched,
         list_filter(string_split(regexp_extract(url, '^[^:]*://[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> '') AS steps
  FROM raw
),
host AS (SELECT DISTINCT host, regexp_replace(host, '^[^.]*\.', '') AS domain, CAST('0x' || md5(host)[1:6] AS INTEGER) AS x FROM page WHERE host <> ''),
event AS (
  SELECT 'hosts' AS list, 'block' AS action, host AS key, x % 500 + s AS d, op FROM host, (VALUES (0, 'add'), (90, 'remove'), (200, 'add')) v(s, op) WHERE x % 4 = 0
  UNION ALL SELECT 'domains', 'block', domain, x % 500 + s, op FROM host, (VALUES (50, 'add'), (120, 'remove')) v(s, op) WHERE x % 3 = 0
  UNION ALL SELECT 'exceptions', 'allow', host, x % 500 + 20, 'add' FROM host WHERE x % 5 = 0
  UNION ALL SELECT 'paths', 'block', host || '/en', x % 500 + 10, 'add' FROM host WHERE x % 7 = 0
  UNION ALL SELECT 'paths', 'block', host || '/EN', x % 500 + 30, 'add' FROM host WHERE x % 7 = 0
),
daily AS (SELECT list, action, key, d, max(op) AS op FROM event GROUP BY ALL),
valid AS (
  SELECT list, action, key, DATE '2023-01-01' + CAST(d AS INTEGER) AS since,
         coalesce(DATE '2023-01-01' + CAST(lead(d) OVER (PARTITION BY list, action, key ORDER BY d) AS INTEGER), DATE '9999-12-31') AS until, op
  FROM daily
),
asked AS (
  SELECT page_id, fetched, unnest(list_concat(
    list_transform(range(1, len(string_split(host, '.')) + 1), lambda i: array_to_string(string_split(host, '.')[i:], '.')),
    list_transform(range(1, len(steps) + 1), lambda i: host || '/' || array_to_string(steps[1:i], '/')))) AS key
  FROM page WHERE host <> ''
),
found AS (SELECT page_id, action, key FROM asked JOIN valid USING (key) WHERE op = 'add' AND fetched >= since AND fetched < until),
best AS (
  SELECT page_id, arg_max(key, (len(key), action = 'allow')) AS rule, arg_max(action, (len(key), action = 'allow')) AS action, count(*) AS n FROM found GROUP BY page_id
)
SELECT page_id, host, CAST(fetched AS VARCHAR) AS fetched, CASE WHEN action = 'block' THEN 'block' ELSE 'allow' END AS verdict, rule, coalesce(n, 0) AS n_active
FROM page LEFT JOIN best USING (page_id)
"""
