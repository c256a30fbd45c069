"""Captures judged by dated URL lists: what a list held at the time of each fetch.

DataFrame functions only. Entries (domain, list, action, day) add a domain or take it off; a domain
covers its subdomains. Entries become validity intervals; an as-of join finds, for each host and
day that has captures, the entries of the host's domains in force on that day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grovespark.llm.common import staged, table

FIRST_DAY = "2024-01-01"


def host_of(url: Column) -> Column:
    """The host of a URL in lower case, without user, port and final dots; null if there is none."""
    found = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)
    return F.nullif(F.regexp_replace(F.lower(found), r"\.+$", ""), F.lit(""))


def intervals(entries: DataFrame) -> DataFrame:
    """Validity intervals (domain, list, since, until) of entries (domain, list, action, day), until exclusive or null.

    The last entry of a day stands ('remove' beats 'add' on one day); repeated entries change nothing.
    Entries with a null are ignored.
    """
    days = entries.dropna(subset=["domain", "list", "action", "day"]).groupBy("domain", "list", "day").agg(F.max("action").alias("action"))
    order = Window.partitionBy("domain", "list").orderBy("day")
    changes = days.withColumn("_was", F.lag("action").over(order)).where(F.col("_was").isNull() | (F.col("_was") != F.col("action")))
    return changes.withColumn("until", F.lead("day").over(order)).where("action = 'add'").select("domain", "list", F.col("day").alias("since"), "until")


def judge(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures (page_id, url, day) with host, blocked, domain, list and since of the entry in force.

    Captures are first reduced to distinct hosts and days, so a host with a third of them adds one row
    a day. Each host's domains meet the intervals of their name as one ordered sequence of changes and
    days; the last change before a day decides. Of several entries in force the longest domain, then
    the first list, is named. A capture without url, host or day is not blocked; rows that repeat are
    judged alike.
    """
    judged = captures.select("page_id", "url", "day", host_of(F.col("url")).alias("host"))
    seen = staged(judged.select("host", "day").dropna().distinct(), "seen")
    labels = F.split("host", r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    asked = seen.select("host", "day", F.explode(domains).alias("domain"))
    days = asked.select("domain", "day").distinct()
    terms = staged(intervals(entries), "terms")
    lists = terms.select("domain", "list").distinct()
    changes = terms.select("domain", "list", F.col("since").alias("day"), F.lit(0).alias("rank"), F.struct("since", "until").alias("term"))
    asks = days.hint("merge").join(lists, "domain").select("domain", "list", "day", F.lit(1).alias("rank"), F.lit(None).cast("struct<since: date, until: date>").alias("term"))
    order = Window.partitionBy("domain", "list").orderBy("day", "rank").rowsBetween(Window.unboundedPreceding, 0)
    active = (
        changes.union(asks)
        .withColumn("term", F.last("term", ignorenulls=True).over(order))
        .where("rank = 1 AND term IS NOT NULL AND (term.until IS NULL OR day < term.until)")
        .select("domain", "list", "day", F.col("term.since").alias("since"))
    )
    best = F.min(F.struct((-F.length("domain")).alias("k"), "domain", "list", "since")).alias("hit")
    # file sizes say little of what is exploded or repeats, so no side is broadcast by them
    verdict = asked.hint("merge").join(active, ["domain", "day"]).groupBy("host", "day").agg(best)
    return judged.join(verdict, ["host", "day"], "left").select(
        "page_id", "url", "host", "day", F.col("hit").isNotNull().alias("blocked"), F.col("hit.domain").alias("domain"), F.col("hit.list").alias("list"), F.col("hit.since").alias("since")
    )


def _number(value: Column, at: int) -> Column:
    return F.conv(F.substring(F.md5(value), at, 4), 16, 10).cast("int")


def captures_of(pages: DataFrame) -> DataFrame:
    """Pages as captures; the table has no fetch time, so a day of 2024 follows from page_id."""
    return pages.select("page_id", "url", F.date_add(F.lit(FIRST_DAY).cast("date"), F.expr("cast(pmod(page_id * 37, 366) AS int)")).alias("day"))


def entries_of(pages: DataFrame) -> DataFrame:
    """A dated list over the hosts of pages and their parent domains, by digests of their names.

    One in four names was added on a day of 2024 and taken off again up to 255 days later; half of
    these came back 30 days after that.
    """
    host = staged(pages.select(host_of(F.col("url")).alias("host")).dropna().distinct(), "hosts")
    names = host.union(host.select(F.regexp_extract("host", r"([^.]+\.[^.]+\.[^.]+)$", 1)).where("host <> ''")).distinct()
    name = F.col("host")
    start = F.date_add(F.lit(FIRST_DAY).cast("date"), _number(name, 5) % 366)
    off = F.date_add(start, 1 + _number(name, 9) % 255)
    picked = names.where(_number(name, 1) % 4 == 0).select(
        name.alias("domain"), F.when(_number(name, 13) % 2 == 0, "adult").otherwise("spam").alias("list"), start.alias("start"), off.alias("off"), (_number(name, 17) % 2 == 0).alias("again")
    )
    add = picked.select("domain", "list", F.lit("add").alias("action"), F.col("start").alias("day"))
    remove = picked.select("domain", "list", F.lit("remove").alias("action"), F.col("off").alias("day"))
    again = picked.where("again").select("domain", "list", F.lit("add").alias("action"), F.date_add("off", 30).alias("day"))
    return add.union(remove).union(again)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every capture of the pages table judged by the list in force on its day."""
    pages = table(spark, sf_dir, "pages")
    return judge(captures_of(pages), entries_of(pages)).withColumns({"day": F.col("day").cast("string"), "since": F.col("since").cast("string")})


ORACLE_SQL = r"""
WITH c AS (
  SELECT page_id, url, DATE '2024-01-01' + (((page_id * 37) % 366 + 366) % 366)::INT AS day,
    nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)', 1)), '\.+$', ''), '') AS host
  FROM pages),
names AS (
  SELECT DISTINCT host AS name FROM c WHERE host IS NOT NULL
  UNION SELECT DISTINCT regexp_extract(host, '([^.]+\.[^.]+\.[^.]+)$', 1) FROM c WHERE regexp_extract(host, '([^.]+\.[^.]+\.[^.]+)$', 1) <> ''),
num AS (
  SELECT name, ('0x' || substr(md5(name), 1, 4))::INT AS a, ('0x' || substr(md5(name), 5, 4))::INT AS b, ('0x' || substr(md5(name), 9, 4))::INT AS c,
    ('0x' || substr(md5(name), 13, 4))::INT AS d, ('0x' || substr(md5(name), 17, 4))::INT AS e FROM names),
p AS (
  SELECT name AS domain, CASE WHEN d % 2 = 0 THEN 'adult' ELSE 'spam' END AS list, DATE '2024-01-01' + b % 366 AS start,
    DATE '2024-01-01' + b % 366 + 1 + c % 255 AS off, e % 2 = 0 AS again FROM num WHERE a % 4 = 0),
t AS (
  SELECT domain, list, start AS since, off AS until FROM p
  UNION ALL SELECT domain, list, off + 30, NULL FROM p WHERE again),
h AS (
  SELECT c.page_id, t.domain, t.list, t.since, row_number() OVER (PARTITION BY c.page_id ORDER BY length(t.domain) DESC, t.domain, t.list) AS k
  FROM c JOIN t ON (c.host = t.domain OR ends_with(c.host, '.' || t.domain)) AND c.day >= t.since AND (t.until IS NULL OR c.day < t.until))
SELECT c.page_id, c.url, c.host, strftime(c.day, '%Y-%m-%d') AS day, h.domain IS NOT NULL AS blocked, h.domain, h.list, strftime(h.since, '%Y-%m-%d') AS since
FROM c LEFT JOIN h ON h.page_id = c.page_id AND h.k = 1
"""
