"""URL filtering by dated lists: a temporal join of captures with the entries active when they were fetched.

A list is a log of dated changes: on a day an entry - a domain (with all below it) or a host with the first segment of
its path - is added with a category, or removed.  The log becomes validity intervals [from, to).  Captures are reduced
to their distinct (host, segment, day), each of these to the keys that could list it, and the as-of join is an equality
on the key with a range on the day.  Keys that very many captures share, such as a top-level domain, are counted first:
those that the list doesn't have go at once, and those that it has are salted.  The most specific active entry decides;
verdicts then meet the captures again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motionframe.llm.common import table, written

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]+)"
SEGMENT = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)"
EPOCH = "2024-01-01"
HOT_ROWS = 100_000
HOT_KEYS = 10_000


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and final dot; empty where there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1)), r"\.$", "")


def segment_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), SEGMENT, 1)


def intervals(log: DataFrame) -> DataFrame:
    """(entry, category, from_day, to_day) of a log (entry, day, action, category): each addition until the next change.

    Several changes of one entry on a day: the last in the order of action and category holds, so that a removal wins.
    A change without entry or day is void.
    """
    order = Window.partitionBy("entry").orderBy("day")
    last = log.where(F.col("entry").isNotNull() & F.col("day").isNotNull()).groupBy("entry", "day")
    last = last.agg(F.max(F.struct("action", "category")).alias("c")).select("entry", "day", "c.action", "c.category")
    spans = last.withColumn("to_day", F.lead("day").over(order)).where("action = 'add'")
    return spans.select("entry", "category", F.col("day").alias("from_day"), F.coalesce("to_day", F.lit("9999-12-31").cast("date")).alias("to_day"))


def keys_of(host: Column, segment: Column) -> Column:
    """The host, each domain above it, and the host with the path's first segment."""
    labels = F.split(host, r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.array_distinct(F.concat(above, F.array(F.concat(host, F.lit("/"), segment))))


def url_filter(captures: DataFrame, log: DataFrame, id_col: str = "page_id", url_col: str = "url", day_col: str = "day") -> DataFrame:
    """page_id, host, day, entry, category, kept: one row per capture.

    kept is false where an entry was active on the day of the fetch; entry is then the longest such key, category its
    category.  A null or hostless URL, and a capture without day, meets no entry and is kept.  Repeated captures, and those
    without id, are answered as they come.  Of equally long entries the greatest in code point order decides, and of its
    categories the greatest.  Long URLs are read whole.  Empty tables are fine; other columns are ignored.
    """
    rows = captures.select(captures[id_col].alias("page_id"), captures[url_col].alias("url"), captures[day_col].cast("date").alias("day"))
    rows = rows.select("page_id", host_of(F.col("url")).alias("host"), segment_of(F.col("url")).alias("segment"), "day")
    spans = written(intervals(log.select("entry", F.col("day").cast("date").alias("day"), "action", "category")), "intervals")
    fetched = written(rows.where("host <> '' AND day IS NOT NULL").select("host", "segment", "day").distinct(), "fetched")
    asked = fetched.withColumn("entry", F.explode(keys_of(F.col("host"), F.col("segment"))))
    active = salted(asked, spans).where("from_day <= day AND day < to_day")
    best = F.max(F.struct(F.length("entry").alias("n"), "entry", "category")).alias("b")
    verdicts = written(active.groupBy("host", "segment", "day").agg(best).select("host", "segment", "day", "b.entry", "b.category"), "verdicts")
    return rows.join(verdicts, ["host", "segment", "day"], "left").select(
        "page_id", "host", "day", "entry", "category", F.col("entry").isNull().alias("kept")
    )


def salted(asked: DataFrame, spans: DataFrame, hot_rows: int = HOT_ROWS, hot_keys: int = HOT_KEYS) -> DataFrame:
    """asked with the spans of its entry.  At most hot_keys entries are hot, whatever the data: those that are asked for by
    more than hot_rows rows and more than one row in hot_keys."""
    counts = written(asked.groupBy("entry").count().where(F.col("count") > min(hot_rows, 1000)), "key-counts")
    least = max(hot_rows, (asked.count() if counts.where(F.col("count") > hot_rows).count() > hot_keys else 0) // hot_keys)
    listed = spans.select("entry").distinct().withColumn("listed", F.lit(True))
    hot = counts.where(F.col("count") > least).join(listed, "entry", "left")
    hot = written(hot.select("entry", "listed", F.ceil(F.col("count") / least).cast("int").alias("salts")), "hot-keys")
    cold = asked.join(F.broadcast(hot), "entry", "left_anti").join(spans, "entry")
    known = hot.where("listed").select("entry", "salts")
    warm = asked.join(F.broadcast(known), "entry").withColumn("salt", F.pmod(F.xxhash64("host", "segment", "day"), F.col("salts")).cast("int"))
    dealt = spans.join(F.broadcast(known), "entry").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    return cold.unionByName(warm.drop("salts").join(dealt.drop("salts"), ["entry", "salt"]).drop("salt"))


def dated_log(pages: DataFrame) -> DataFrame:
    """The query's list, by a rule over the hosts seen: two of three hosts are added at some day, half of them removed
    90 days on and a third of these added again after 120; their domains of two labels are added late in the year, and
    hosts with the segment "de" on day 200."""
    host = pages.select(host_of(F.col("url")).alias("host")).where("host <> ''").distinct()
    k = F.length("host") * 37 + F.ascii("host") * 11 + F.ascii(F.substring("host", 5, 1)) * 7
    host = host.withColumn("k", k)
    change = lambda when, start, action, category: host.where(when).select(
        F.col("host").alias("entry"), (F.lit(EPOCH).cast("date") + (F.col("k") % 200 + start).cast("int")).alias("day"),
        F.lit(action).alias("action"), category.alias("category"),
    )
    kind = F.when(F.col("k") % 2 == 0, "spam").otherwise("adult")
    domains = host.select(F.substring_index("host", ".", -2).alias("entry")).distinct().select(
        "entry", (F.lit(EPOCH).cast("date") + (340 + F.length("entry")).cast("int")).alias("day"), F.lit("add").alias("action"), F.lit("domain").alias("category")
    )
    german = host.where("k % 5 = 0").select(
        F.concat("host", F.lit("/de")).alias("entry"), (F.lit(EPOCH).cast("date") + F.lit(200)).alias("day"), F.lit("add").alias("action"), F.lit("path").alias("category")
    )
    return (
        change("k % 3 > 0", 0, "add", kind).union(change("k % 3 > 0 AND k % 2 = 0", 90, "remove", kind))
        .union(change("k % 3 > 0 AND k % 6 = 2", 120, "add", F.lit("again"))).union(domains).union(german)
    )


def op7_url_filter(spark, sf_dir: str) -> DataFrame:
    """Every page, fetched on day page_id modulo 366 of 2024."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    day = F.lit(EPOCH).cast("date") + (F.col("page_id") % 366).cast("int")
    return url_filter(pages.withColumn("day", day), dated_log(pages)).withColumn("day", F.col("day").cast("string"))


SQL = r"""
WITH p AS (
  SELECT page_id, regexp_replace(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]+)', 1)), '\.$', '') AS host,
    regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)', 1) AS segment,
    DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS day FROM pages),
h AS (SELECT DISTINCT host, length(host) * 37 + ascii(host) * 11 + ascii(substring(host, 5, 1)) * 7 AS k FROM p WHERE host <> ''),
log AS (
  SELECT host AS entry, DATE '2024-01-01' + CAST(k % 200 AS INTEGER) AS day, 'add' AS action, CASE WHEN k % 2 = 0 THEN 'spam' ELSE 'adult' END AS category FROM h WHERE k % 3 > 0
  UNION ALL SELECT host, DATE '2024-01-01' + CAST(k % 200 + 90 AS INTEGER), 'remove', 'spam' FROM h WHERE k % 3 > 0 AND k % 2 = 0
  UNION ALL SELECT host, DATE '2024-01-01' + CAST(k % 200 + 120 AS INTEGER), 'add', 'again' FROM h WHERE k % 3 > 0 AND k % 6 = 2
  UNION ALL SELECT DISTINCT d, DATE '2024-01-01' + CAST(340 + length(d) AS INTEGER), 'add', 'domain' FROM (SELECT array_to_string(string_split(host, '.')[-2:], '.') AS d FROM h)
  UNION ALL SELECT host || '/de', DATE '2024-01-01' + 200, 'add', 'path' FROM h WHERE k % 5 = 0),
c AS (SELECT entry, day, max(row(action, category)) AS c FROM log GROUP BY entry, day),
i AS (SELECT entry, c[1] AS action, c[2] AS category, day AS f, coalesce(lead(day) OVER (PARTITION BY entry ORDER BY day), DATE '9999-12-31') AS t FROM c),
a AS (
  SELECT DISTINCT p.host, p.segment, p.day, i.entry, i.category FROM p JOIN i ON i.action = 'add' AND i.f <= p.day AND p.day < i.t
    AND p.host <> '' AND (i.entry = p.host OR i.entry = p.host || '/' || p.segment OR ends_with(p.host, '.' || i.entry))),
b AS (SELECT *, row_number() OVER (PARTITION BY host, segment, day ORDER BY length(entry) DESC, entry DESC, category DESC) AS n FROM a)
SELECT p.page_id, p.host, CAST(p.day AS VARCHAR) AS day, b.entry, b.category, b.entry IS NULL AS kept
FROM p LEFT JOIN b ON b.n = 1 AND b.host = p.host AND b.segment = p.segment AND b.day = p.day
"""
