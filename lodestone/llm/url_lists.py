"""URL filters as a temporal list join.

List entries are dated events: at a time, an action ('add' or 'remove') sets whether a pattern is listed. Successive
events of one pattern become validity intervals [start, end). Each capture is then held, as of its fetch time, against
the entries that were active at that moment: the host and its parent domains, and each entry with a '/' that host and
path start with, be it a directory, a page or a part of a name. Path entries hold for their own host, not its subdomains.
Matching is an equi-join on these keys with the interval as a further condition, so it never compares all captures with
all entries, and a hot host is split like any skewed join key. For entries that do not end in '/', the list tells for
each directory how long its entries are, and a capture in it has its prefixes of these lengths as keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: The path of a URL.
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def intervals(events: DataFrame) -> DataFrame:
    """events: (pattern, listed_at, action, category). Gives (pattern, category, start, end), end null while still listed.

    Of events of one pattern, category and time, 'remove' wins. Repeated 'add's do not start anew, a 'remove' of what is
    not listed does nothing, and rows with nulls in pattern, time or action, or other actions, are left out. A null
    category is a category. Hosts of patterns are taken in lower case and without trailing dot, as those of captures are."""
    named = F.concat(F.regexp_replace(F.lower(F.substring_index("pattern", "/", 1)), r"\.$", ""), F.regexp_extract("pattern", "(?s)(/.*)?$", 1))
    moments = events.withColumn("pattern", named).where("pattern is not null and listed_at is not null and action in ('add', 'remove')").groupBy("pattern", "category", "listed_at").agg(F.max("action").alias("action"))
    order = W.partitionBy("pattern", "category").orderBy("listed_at")
    changed = moments.withColumn("was", F.lag("action").over(order)).where("action <> coalesce(was, 'remove')")
    return changed.withColumn("end", F.lead("listed_at").over(order)).where("action = 'add'").select("pattern", "category", F.col("listed_at").alias("start"), "end")


def host(url: Column) -> Column:
    """Lower-case host without user, port and trailing dot; an IPv6 address keeps its brackets; null if the URL has none."""
    found = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:\[]+)", 1)
    return F.nullif(F.regexp_replace(found, r"\.$", ""), F.lit(""))


def patterns(url: Column) -> Column:
    """Keys that an entry may name: the host and its parents of two labels or more (an IPv6 address has none), then host
    plus each leading directory of the path below the top, ending in '/'. Empty for a URL without a host."""
    labels = F.when(host(url).startswith("["), F.array(host(url))).otherwise(F.split(host(url), r"\."))
    n = F.size(labels)
    domains = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, n), "."))
    path = F.regexp_extract(url, PATH, 1)
    parts = F.split(path, "/")
    prefixes = F.transform(F.filter(F.sequence(F.lit(2), F.greatest(F.size(parts) - 1, F.lit(2))), lambda i: i < F.size(parts)), lambda i: F.concat(host(url), F.array_join(F.slice(parts, 1, i), "/"), F.lit("/")))
    return F.when(host(url).isNull(), F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(domains, prefixes)))


def _keyed(captures: DataFrame, url: str, entries: DataFrame) -> DataFrame:
    """captures with each key (pattern) that an entry may name: those of patterns(), the host's top directory, and the
    prefixes of host and path that are as long as an entry in their directory."""
    page = F.concat(host(F.col(url)), F.regexp_extract(url, PATH, 1))
    top = F.filter(F.array(F.concat(F.substring_index(page, "/", 1), F.lit("/"))), lambda t: page.startswith(t))
    keys = captures.withColumn("pattern", F.explode(F.array_distinct(F.concat(patterns(F.col(url)), F.coalesce(top, F.array().cast("array<string>"))))))
    folder = F.regexp_extract("pattern", "(?s)^(.*/)[^/]+$", 1)
    sizes = entries.select(folder.alias("folder"), F.length("pattern").alias("size")).where("folder <> ''").groupBy("folder").agg(F.collect_set("size").alias("sizes"))
    inside = keys.withColumnRenamed("pattern", "folder").join(sizes, "folder").withColumn("page", page)
    longer = inside.withColumn("size", F.explode("sizes")).where("size <= length(page)").withColumn("pattern", F.expr("substring(page, 1, size)"))
    # a prefix belongs to one directory: of those that reach into the next one, this one has no entries
    longer = longer.where(F.regexp_extract("pattern", "(?s)^(.*/)[^/]+$", 1) == F.col("folder"))
    return keys.unionByName(longer.select(*captures.columns, "pattern"))


def active_entries(captures: DataFrame, events: DataFrame, key: str = "page_id", url: str = "url", fetched: str = "fetched_at") -> DataFrame:
    """(key, pattern, category, start, end): every entry that was active for a capture when it was fetched. Captures with
    a null URL or time meet none. Rows that repeat a key give their entries once each."""
    entries = intervals(events)
    keys = _keyed(captures.select(captures[key].alias("_key"), captures[fetched].alias("_at"), captures[url].alias("_url")), "_url", entries)
    met = keys.join(entries, "pattern").where("_at >= start and (end is null or _at < end)")
    return met.select(F.col("_key").alias(key), "pattern", "category", "start", "end").distinct()


def judge(captures: DataFrame, events: DataFrame, key: str = "page_id", url: str = "url", fetched: str = "fetched_at") -> DataFrame:
    """One row per distinct (key, url, fetch time): host, n_active, the most specific active pattern (longest, then least
    in order) with its category, and kept (no entry is active). Only these columns are read. Null keys are kept apart
    from others and judged like them."""
    rows = captures.select(captures[key].alias("k"), captures[url].alias("u"), captures[fetched].alias("at")).distinct()
    entries = intervals(events)
    met = _keyed(rows, "u", entries).join(entries, "pattern").where("at >= start and (end is null or at < end)")
    # counts and the best entry are combined before the shuffle by capture
    best = met.groupBy("k", "u", "at").agg(F.count(F.lit(1)).alias("n_active"), F.min(F.struct((-F.length("pattern")).alias("l"), F.col("pattern").alias("pattern"), F.coalesce("category", F.lit("")).alias("category"))).alias("b"))
    same = F.expr("r.k <=> b.k and r.u <=> b.u and r.at <=> b.at")
    return rows.alias("r").join(best.alias("b"), same, "left").select(F.col("r.k").alias(key), F.col("r.u").alias(url), F.col("r.at").alias(fetched), host(F.col("r.u")).alias("host"), F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"), F.col("b.b.pattern").alias("pattern"), F.col("b.b.category").alias("category"), F.col("n_active").isNull().alias("kept"))


#: Hosts and paths on the list of the production query, when, and why. Fixed values.
LISTED = (
    ("casino-win.example.com", "2023-02-01", "add", "gambling"), ("free-bets.example.com", "2023-01-01", "add", "gambling"), ("free-bets.example.com", "2023-07-01", "remove", "gambling"),
    ("free-bets.example.com", "2023-10-01", "add", "gambling"), ("cheap-pills.example.com", "2023-03-15", "add", "pharmacy"), ("example.net", "2023-06-01", "add", "parked"),
    ("example.net", "2023-06-20", "remove", "parked"), ("tionble.example.org/en/", "2023-04-01", "add", "scraped"), ("blog.tionsh.example.com/fr/", "2023-05-01", "add", "scraped"),
    ("blog.tionsh.example.com/fr/", "2023-09-01", "remove", "scraped"), ("ththan.example.com", "2023-08-01", "remove", "unlisted"), ("thering.example.org", "2023-11-01", "add", "spam"),
)


def listed(spark) -> DataFrame:
    return spark.createDataFrame(list(LISTED), "pattern string, day string, action string, category string").select("pattern", F.to_timestamp("day").cast("timestamp_ntz").alias("listed_at"), "action", "category")


def drawn_list(pages: DataFrame, url: str = "url") -> DataFrame:
    """A list that grows with the pages, as the tables hold none: of their distinct hosts, top directories, directories and
    pages, those whose MD5 sum begins with 0, dated by the sum; those whose sum goes on below 8 are removed again later."""
    sites = pages.select(host(F.col(url)).alias("host"), F.regexp_extract(url, PATH, 1).alias("path")).where("host is not null").distinct()
    parts = {"host": F.col("host"), "top": F.concat("host", F.lit("/")), "directory": F.concat("host", F.regexp_extract("path", "^(.*/)[^/]*$", 1)), "page": F.concat("host", "path")}
    named = F.array(*[F.struct(F.lit(k).alias("category"), p.alias("pattern")) for k, p in parts.items()])
    each = sites.select(F.explode(named).alias("e")).select("e.*").where("category = 'host' or contains(pattern, '/')").distinct()
    each = each.withColumn("sum", F.md5(F.concat_ws("|", "category", "pattern"))).where("startswith(sum, '0')")
    number = lambda at, size: F.conv(F.substring("sum", at, size), 16, 10).cast("int")
    added = F.expr("timestamp_ntz'2023-01-01 00:00:00'") + F.make_dt_interval(days=number(3, 4) % 365)
    events = F.array(F.struct(added.alias("listed_at"), F.lit("add").alias("action")), F.when(F.substring("sum", 2, 1) < "8", F.struct((added + F.make_dt_interval(days=F.lit(1) + number(7, 4) % 90)).alias("listed_at"), F.lit("remove").alias("action"))))
    return each.select("pattern", "category", F.explode(events).alias("e")).where("e is not null").select("pattern", "e.listed_at", "e.action", "category")


def fetched_at(key: Column) -> Column:
    """The tables have no fetch times: pages are taken as fetched through 2023, 37 minutes apart, round and round."""
    return F.expr("timestamp_ntz'2023-01-01 00:00:00'") + F.make_dt_interval(mins=F.pmod(key * 37, F.lit(525600)).cast("int"))


_VALUES = ", ".join(f"('{p}', TIMESTAMP '{d} 00:00:00', '{a}', '{c}')" for p, d, a, c in LISTED)
ORACLE = rf"""
WITH pg AS (SELECT DISTINCT page_id, url, TIMESTAMP '2023-01-01 00:00:00' + to_minutes((page_id * 37) % 525600) AS fetched_at,
       nullif(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:\[]+)', 1), '\.$', ''), '') AS host,
       regexp_extract(url, '{PATH}', 1) AS path FROM pages),
nm AS (SELECT 'host' AS category, host AS pattern FROM pg UNION SELECT 'top', host || '/' FROM pg UNION SELECT 'directory', host || regexp_extract(path, '^(.*/)[^/]*$', 1) FROM pg UNION SELECT 'page', host || path FROM pg),
sm AS (SELECT *, md5(category || '|' || pattern) AS sum FROM nm WHERE pattern IS NOT NULL AND (category = 'host' OR contains(pattern, '/')) AND starts_with(md5(category || '|' || pattern), '0')),
ad AS (SELECT *, TIMESTAMP '2023-01-01 00:00:00' + to_days(('0x' || substr(sum, 3, 4))::INT % 365) AS added FROM sm),
ev AS (SELECT pattern, listed_at, action, category FROM (VALUES {_VALUES}) v(pattern, listed_at, action, category) UNION ALL SELECT pattern, added, 'add', category FROM ad
       UNION ALL SELECT pattern, added + to_days(1 + ('0x' || substr(sum, 7, 4))::INT % 90), 'remove', category FROM ad WHERE substr(sum, 2, 1) < '8'),
mo AS (SELECT pattern, category, listed_at, max(action) AS action FROM ev GROUP BY ALL),
ch AS (SELECT * FROM (SELECT *, lag(action) OVER (PARTITION BY pattern, category ORDER BY listed_at) AS was FROM mo) WHERE action <> coalesce(was, 'remove')),
iv AS (SELECT * FROM (SELECT *, lead(listed_at) OVER (PARTITION BY pattern, category ORDER BY listed_at) AS stop FROM ch) WHERE action = 'add'),
hit AS (SELECT pg.page_id, pg.url, pg.fetched_at, iv.pattern, iv.category FROM pg JOIN iv ON
          (pg.host = iv.pattern OR ends_with(pg.host, '.' || iv.pattern) OR (contains(iv.pattern, '/') AND starts_with(pg.host || pg.path, iv.pattern)))
          AND pg.fetched_at >= iv.listed_at AND (iv.stop IS NULL OR pg.fetched_at < iv.stop)),
b AS (SELECT page_id, url, fetched_at, count(*) AS n_active, arg_min(pattern, [printf('%05d', 10000 - length(pattern)), pattern, category]) AS pattern,
      arg_min(category, [printf('%05d', 10000 - length(pattern)), pattern, category]) AS category FROM hit GROUP BY ALL)
SELECT pg.page_id, pg.url, pg.fetched_at, pg.host, coalesce(n_active, 0)::BIGINT AS n_active, b.pattern, b.category, n_active IS NULL AS kept
FROM pg LEFT JOIN b ON pg.page_id IS NOT DISTINCT FROM b.page_id AND pg.url IS NOT DISTINCT FROM b.url AND pg.fetched_at IS NOT DISTINCT FROM b.fetched_at
"""
