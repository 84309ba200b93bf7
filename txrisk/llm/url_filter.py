"""URL filters: a temporal join of captures and dated list entries.

A list is a log of dated actions on rules: a rule (a host with everything below
it, a path prefix of a host, or one exact URL) is added or removed on a date.
The log becomes validity intervals, half open: from an addition to the next
removal.  A capture is blocked if a rule that matches its URL was active when it
was fetched; the most specific rule is reported (URL, then longest path, then
longest host).

A URL expands into its few keys (its host and parent hosts, its path prefixes,
itself), which meet the rules in an equi-join on (key, month): intervals are cut
at month ends first, so a capture only meets what was active in its own month,
however long a rule's history is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from txrisk.llm.common import table

#: Date when intervals without a removal end.
OPEN_END = "9999-12-31"


def url_host(url: Column) -> Column:
    """Lower-case host without user, port, path, query and fragment (null: no host)."""
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    host = F.lower(F.regexp_replace(F.regexp_replace(rest, r"^.*@", ""), r":[0-9]*$", ""))
    return F.when(F.length(host) > 0, F.rtrim(F.trim(host), F.lit(".")))


def url_path(url: Column) -> Column:
    """Path without query and fragment, at least ``/``."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(F.length(path) > 0, path).otherwise(F.lit("/"))


def url_keys(url: Column) -> Column:
    """Array of (key, rank): ``h:`` hosts, ``p:`` host and path prefix, ``u:`` the URL; higher rank: more specific."""
    host, path = url_host(url), url_path(url)
    labels = F.split(host, r"\.")
    hosts = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.struct(
            F.concat(F.lit("h:"), F.array_join(F.slice(labels, F.size(labels) - i + 1, i), ".")).alias("key"),
            i.cast("long").alias("rank")))
    parts = F.filter(F.split(path, "/"), lambda p: F.length(p) > 0)
    paths = F.when(F.size(parts) > 0, F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda i: F.struct(
            F.concat(F.lit("p:"), host, F.lit("/"), F.array_join(F.slice(parts, 1, i), "/")).alias("key"),
            (F.lit(1_000_000) + i).cast("long").alias("rank"))))
    exact = F.array(F.struct(F.concat(F.lit("u:"), url).alias("key"), F.lit(2_000_000_000).cast("long").alias("rank")))
    none = F.array().cast("array<struct<key:string,rank:bigint>>")
    return F.concat(F.when(host.isNotNull(), hosts).otherwise(none),
                    F.when(host.isNotNull(), F.coalesce(paths, none)).otherwise(none),
                    F.when(url.isNotNull(), exact).otherwise(none))


def rule_key(kind: Column, value: Column) -> Column:
    """Key of a rule: kind host, path or url (others: null, never matching)."""
    return (F.when(kind == "host", F.concat(F.lit("h:"), F.lower(value)))
            .when(kind == "path", F.concat(F.lit("p:"), value))
            .when(kind == "url", F.concat(F.lit("u:"), value)))


def validity(log: DataFrame) -> DataFrame:
    """(key, category, valid_from, valid_to) of a log (key, category, at, action: add or remove).

    Each category of a key is an entry of its own, which only its own removal
    ends.  Its actions of one date are taken in the order add, remove.  An
    addition while it is active starts a new interval; a removal without one has
    no effect.
    """
    turn = Window.partitionBy("key", "category").orderBy("at", "action")
    ends = log.filter("key IS NOT NULL AND at IS NOT NULL AND action IN ('add', 'remove')").withColumn(
        "next", F.lead("at").over(turn))
    return (ends.filter("action = 'add'")
            .select("key", "category", F.col("at").alias("valid_from"),
                    F.coalesce("next", F.lit(OPEN_END).cast("date")).alias("valid_to"))
            .filter("valid_from < valid_to"))


def apply_lists(captures: DataFrame, log: DataFrame, key: str = "page_id", url: str = "url",
                fetched: str = "fetched") -> DataFrame:
    """``key``, url, fetched, host, blocked, rule, category: one row per capture.

    Null and unparsable URLs have no host (an unparsable one still has its own
    key), null dates are outside every interval: such captures are kept.
    Repeated captures keep one row each (rows of the same id and url and date give
    the same result); an empty table or list blocks nothing; other columns are
    not read.  Among equally specific matches the smallest category is reported.
    """
    spans = validity(log)
    month = lambda c: F.trunc(c, "month")
    # one row: at most as many months as the calendar has, however many captures
    seen = captures.agg(F.collect_set(month(F.col(fetched))).alias("months"))
    # a rule enters the months of its span in which there are captures
    cut = (spans.join(F.broadcast(seen))
           .withColumn("month", F.explode(F.filter(
               "months", lambda m: (m >= month(F.col("valid_from"))) & (m < F.col("valid_to")))))
           .select("key", "month", "category", "valid_from", "valid_to"))
    asked = (captures.filter(F.col(fetched).isNotNull()).select(F.col(url).alias("url"), F.col(fetched).alias("at"))
             .distinct().withColumn("k", F.explode(url_keys(F.col("url"))))
             .select("url", "at", F.col("k.key").alias("key"), F.col("k.rank").alias("rank"),
                     month(F.col("at")).alias("month")))
    hit = (asked.join(cut, ["key", "month"]).filter("valid_from <= at AND at < valid_to")
           .groupBy("url", "at").agg(F.min(F.struct((-F.col("rank")).alias("r"), "category", "key")).alias("best"))
           .select(F.col("url").alias("hit_url"), F.col("at").alias("hit_at"), F.col("best.key").alias("rule"),
                   F.col("best.category").alias("category")))
    rows = captures.select(F.col(key).alias("id"), F.col(url).alias("url"), F.col(fetched).alias("at"))
    return (rows.join(hit, (F.col("url") == F.col("hit_url")) & (F.col("at") == F.col("hit_at")), "left")
            .select(F.col("id").alias(key), "url", F.col("at").alias("fetched"),
                    url_host(F.col("url")).alias("host"), F.col("rule").isNotNull().alias("blocked"),
                    "rule", "category"))


# -- the registered query: captures and a list log derived from the given pages -----------------

_CAPTURES = """
SELECT page_id, url, CAST('2023-01-01' AS DATE) + CAST(page_id % 700 AS INTEGER) AS fetched FROM pages
"""

#: A third of the hosts is listed and dropped again, some twice; one path in 5 and one URL in 23 is listed for good.
#: (days after a host's first listing, action)
_HOST_STEPS = [(0, "add"), (60, "remove"), (120, "add"), (400, "remove")]

_LOG = "\nUNION ALL\n".join([*(f"""
SELECT DISTINCT 'host' AS kind, host AS value,
       CASE WHEN length(host) % 2 = 0 THEN 'spam' ELSE 'malware' END AS category,
       CAST('2023-01-01' AS DATE) + CAST(length(host) * 37 % 500 + {days} AS INTEGER) AS day, '{action}' AS action
FROM hosts WHERE length(host) % 3 = 0""" for days, action in _HOST_STEPS), """
SELECT 'path', host || '/' || part, 'section', CAST('2023-01-01' AS DATE) + CAST(min(page_id) % 300 AS INTEGER), 'add'
FROM hosts WHERE length(host) % 5 = 0 AND part <> '' GROUP BY host, part""", """
SELECT 'url', url, 'reported', CAST('2023-01-01' AS DATE) + CAST(page_id % 650 AS INTEGER), 'add'
FROM hosts WHERE page_id % 23 = 0
"""])


def op2_temporal_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    hosts = pages.select("page_id", "url", url_host(F.col("url")).alias("host"),
                         F.split_part(url_path(F.col("url")), F.lit("/"), F.lit(2)).alias("part"))
    log = spark.sql(_LOG.replace("FROM hosts", "FROM {hosts}"), hosts=hosts)
    captures = spark.sql(_CAPTURES.replace("FROM pages", "FROM {pages}"), pages=pages)
    log = log.select(rule_key(F.col("kind"), F.col("value")).alias("key"), "category", F.col("day").alias("at"), "action")
    return apply_lists(captures, log).withColumn("fetched", F.col("fetched").cast("string"))


OP2_SQL = f"""
WITH hosts AS (
  SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host,
         split_part(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/', 2) AS part FROM pages),
log AS ({_LOG}),
spans AS (
  SELECT * FROM (
    SELECT *, lead(day, 1, DATE '{OPEN_END}') OVER (PARTITION BY kind, value, category ORDER BY day, action, category) AS until
    FROM log) AS l WHERE action = 'add' AND day < until),
captures AS (SELECT c.*, h.host, h.part FROM ({_CAPTURES}) AS c JOIN hosts AS h USING (page_id, url)),
matched AS (
  SELECT c.page_id, s.category,
         CASE s.kind WHEN 'host' THEN 'h:' WHEN 'path' THEN 'p:' ELSE 'u:' END || s.value AS rule,
         CASE s.kind WHEN 'url' THEN 3000000 WHEN 'path' THEN 1000000 ELSE 0 END + length(s.value) AS rank
  FROM captures AS c JOIN spans AS s ON c.fetched >= s.day AND c.fetched < s.until AND (
       (s.kind = 'url' AND s.value = c.url)
    OR (s.kind = 'path' AND s.value = c.host || '/' || c.part)
    OR (s.kind = 'host' AND (c.host = s.value OR ends_with(c.host, '.' || s.value))))),
best AS (SELECT page_id, min({{'r': -rank, 'category': category, 'rule': rule}}) AS b FROM matched GROUP BY page_id)
SELECT c.page_id, c.url, CAST(c.fetched AS VARCHAR) AS fetched, c.host, b.b IS NOT NULL AS blocked, b.b.rule AS rule, b.b.category AS category
FROM captures AS c LEFT JOIN best AS b USING (page_id)
"""
