"""URL filters by a temporal list join, in DataFrame operations alone.

A list is a log of dated entries: a host or parent domain was added to or
removed from a category on a day.  Entries become validity intervals
[valid_from, valid_to); each capture is judged by the entries active on the
day it was fetched, on its host or any parent domain of it.

The as-of join runs on distinct pairs of host and day, which are counted
together before the shuffle, so a host that holds a third of all captures is
one row for each day; the verdicts go back to the captures through a join that
broadcasts a table of checked size or else salts its keys.

Rules: of several entries for one pattern, category and day, removal wins;
adding what is listed or removing what is not changes nothing.  Entries with
a null pattern, category or day are ignored.  A capture with a null or
unparsable url, or a null day, matches nothing.  Rows that repeat are judged
one by one.  Empty lists match nothing; empty captures give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fragmill.llm.runtime import cut, join_small, maybe_broadcast

#: A capture in this category is allowed whatever else lists it.
ALLOW = "allow"


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and closing dot, an IPv6 address in its brackets; null if there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[0-9A-Fa-f:.]+\]|[^/?#:@\[\]]+)", 1))
    return F.nullif(F.regexp_replace(host, r"\.+$", ""), F.lit(""))


def suffixes(host: Column) -> Column:
    """The host and its parent domains, longest first; an address is itself alone."""
    labels = F.split(host, r"\.")
    return F.when(host.rlike(r"^\[|^[0-9]+(\.[0-9]+){3}$"), F.array(host)).otherwise(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), ".")))


def intervals(entries: DataFrame) -> DataFrame:
    """pattern, category, valid_from and valid_to (null: still listed) of ``entries(pattern, category, action, listed_on)``.

    ``action`` is add or remove.
    """
    daily = entries.where("pattern IS NOT NULL AND category IS NOT NULL AND listed_on IS NOT NULL AND action IN ('add', 'remove')")
    daily = daily.groupBy(F.lower("pattern").alias("pattern"), "category", "listed_on").agg(F.max("action").alias("action"))
    order = Window.partitionBy("pattern", "category").orderBy("listed_on")
    before = F.coalesce(F.lag("action").over(order), F.lit("remove"))
    changes = daily.withColumn("before", before).where("action <> before").withColumn("valid_to", F.lead("listed_on").over(order))
    return changes.where("action = 'add'").select("pattern", "category", F.col("listed_on").alias("valid_from"), "valid_to")


def screen(captures: DataFrame, entries: DataFrame, url: str = "url", day: str = "fetched_on") -> DataFrame:
    """``captures`` with host, pattern (the longest that is active), categories (sorted, comma-joined), n_active and blocked.

    Columns of these names in ``captures`` are replaced; all others stay.
    """
    own = [c for c in captures.columns if c not in ("host", "pattern", "categories", "n_active", "blocked")]
    rows = captures.select(*own, host_of(F.col(url)).alias("host")).withColumn("__at", F.when(F.col("host").isNotNull() & F.col(day).isNotNull(), F.concat_ws(" ", "host", F.col(day).cast("string"))))
    asked = rows.where("__at IS NOT NULL").select("host", F.col(day).alias("day"), "__at").distinct()
    probes = asked.select("__at", "day", F.explode(suffixes(F.col("host"))).alias("pattern"))
    # A short list is broadcast; else rows of a common suffix are split over tasks, as both sides are plain exchanges.
    active = probes.join(maybe_broadcast(cut(intervals(entries))), "pattern").where("day >= valid_from AND (valid_to IS NULL OR day < valid_to)")
    longest = F.max(F.struct(F.length("pattern").alias("n"), "pattern"))
    found = active.groupBy("__at").agg(longest.alias("top"), F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"), F.count("*").alias("n_active"), F.max((F.col("category") == ALLOW).cast("int")).alias("allowed"))
    found = cut(found.select("__at", F.col("top.pattern").alias("pattern"), "categories", "n_active", (F.col("allowed") == 0).alias("blocked")))
    out = join_small(rows, found, "__at", "left")
    return out.withColumns({"n_active": F.coalesce("n_active", F.lit(0)).cast("long"), "blocked": F.coalesce("blocked", F.lit(False))}).drop("__at")


def sample_list(pages: DataFrame) -> DataFrame:
    """A dated list over the hosts of ``pages`` and their parents, by fixed rules on their names."""
    hosts = pages.select(host_of(F.col("url")).alias("pattern")).where("pattern IS NOT NULL").distinct()
    # The host has been counted once; its parents are rows of a table of distinct hosts.
    parents = hosts.select(F.expr("substring(pattern, instr(pattern, '.') + 1)").alias("pattern")).where("instr(pattern, '.') > 0").distinct()
    k = F.expr("(ascii(substring(pattern, 3, 1)) * 7 + length(pattern) * 31) % 100")

    def entry(rows: DataFrame, when: Column, category: str, *events: tuple[str, Column]) -> DataFrame:
        log = F.array(*[F.struct(F.lit(action).alias("action"), F.date_add(F.lit("2024-01-01").cast("date"), day.cast("int")).alias("listed_on")) for action, day in events])
        return rows.where(when).select("pattern", F.lit(category).alias("category"), F.explode(log).alias("e")).select("pattern", "category", "e.*")

    spam = entry(hosts, F.col("pattern").rlike("spam|pill"), "spam", ("add", F.lit(0)))
    adult = entry(hosts, k < 20, "adult", ("add", k * 5), ("remove", k * 5 + 90), ("add", k * 5 + 200))
    allow = entry(hosts, (k >= 20) & (k < 26), ALLOW, ("add", F.lit(100)))
    malware = entry(parents, k < 15, "malware", ("add", F.lit(30)), ("add", F.lit(60)), ("remove", F.lit(250)))
    return spam.unionByName(adult).unionByName(allow).unionByName(malware)


def op3(pages: DataFrame) -> DataFrame:
    """Pages carry no date: the day of capture is page_id modulo 365 days after 2024-01-01."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 365).cast("int"))
    captures = pages.select("page_id", "url", day.alias("fetched_on"))
    out = screen(captures, cut(sample_list(pages)))
    return out.select("page_id", "host", F.col("fetched_on").cast("string").alias("fetched_on"), "pattern", "categories", "n_active", "blocked")


ORACLE = r"""
WITH p AS (
  SELECT row_number() OVER () AS r, page_id, DATE '2024-01-01' + CAST(page_id % 365 AS INTEGER) AS fetched_on,
         nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '\.+$', ''), '') AS host
  FROM pages),
h AS (SELECT DISTINCT host AS pattern FROM p WHERE host IS NOT NULL),
u AS (SELECT DISTINCT substring(pattern, instr(pattern, '.') + 1) AS pattern FROM h WHERE instr(pattern, '.') > 0),
hk AS (SELECT pattern, (coalesce(ascii(substring(pattern, 3, 1)), 0) * 7 + length(pattern) * 31) % 100 AS k FROM h),
uk AS (SELECT pattern, (coalesce(ascii(substring(pattern, 3, 1)), 0) * 7 + length(pattern) * 31) % 100 AS k FROM u),
e AS (
  SELECT pattern, 'spam' AS category, 'add' AS action, 0 AS d FROM hk WHERE regexp_matches(pattern, 'spam|pill')
  UNION ALL SELECT pattern, 'adult', 'add', k * 5 FROM hk WHERE k < 20
  UNION ALL SELECT pattern, 'adult', 'remove', k * 5 + 90 FROM hk WHERE k < 20
  UNION ALL SELECT pattern, 'adult', 'add', k * 5 + 200 FROM hk WHERE k < 20
  UNION ALL SELECT pattern, 'allow', 'add', 100 FROM hk WHERE k >= 20 AND k < 26
  UNION ALL SELECT pattern, 'malware', 'add', 30 FROM uk WHERE k < 15
  UNION ALL SELECT pattern, 'malware', 'add', 60 FROM uk WHERE k < 15
  UNION ALL SELECT pattern, 'malware', 'remove', 250 FROM uk WHERE k < 15),
s AS (SELECT pattern, category, action, DATE '2024-01-01' + CAST(d AS INTEGER) AS listed_on FROM e),
active AS (
  SELECT r, s.pattern, s.category FROM p JOIN s ON (p.host = s.pattern OR ends_with(p.host, '.' || s.pattern)) AND s.listed_on <= p.fetched_on
  QUALIFY row_number() OVER (PARTITION BY r, s.pattern, s.category ORDER BY s.listed_on DESC, s.action DESC) = 1 AND action = 'add'),
g AS (
  SELECT r, arg_max(pattern, (length(pattern), pattern)) AS pattern, array_to_string(list_sort(list(DISTINCT category)), ',') AS categories,
         count(*) AS n_active, NOT bool_or(category = 'allow') AS blocked
  FROM active GROUP BY r)
SELECT page_id, host, CAST(fetched_on AS VARCHAR) AS fetched_on, pattern, categories, coalesce(n_active, 0) AS n_active, coalesce(blocked, false) AS blocked
FROM p LEFT JOIN g USING (r)
"""
