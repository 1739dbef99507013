"""Line deduplication by site-relative frequency.

A line is boilerplate on a host if more than a given ratio of the host's pages have it. Pages of equal text count once,
so that copies of a page do not turn its own lines into boilerplate. Built from DataFrame functions alone. Lines and pages
are compared by 64-bit hashes: among n different ones of a host, any two agree with a chance of about n squared / 2^65.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.session import staged

RATIO, LEAST_PAGES = 0.01, 5
#: A host's lines are dealt by hash to so many short lists, of which a look-up scans one.
SLOTS = 128
#: White space that does not tell lines apart, at either end.
EDGES = " \t\r\x0b\f"


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(EDGES))


def _slot(line: Column) -> Column:
    return F.pmod(line, F.lit(SLOTS)).cast("int")


def _listed(line: Column) -> Column:
    mark = F.xxhash64(line)
    return F.array_contains(F.get("_lodestone_bad", _slot(mark)), mark)


def boilerplate(docs: DataFrame, text: str = "text", host: str = "source", ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(host, bad): for each host, hashes of its boilerplate lines, in SLOTS lists. A page with k lines can raise k lines
    towards the ratio, so a host has at most (lines per page) / ratio of them, whatever its size. Null texts are no pages."""
    pages = docs.where(docs[text].isNotNull()).select(docs[host].alias("host"), F.xxhash64(docs[text]).alias("page"), F.split(docs[text], "\n").alias("lines"))
    each = pages.select("host", "page", F.explode(F.array_distinct(F.transform(F.filter("lines", lambda x: _trimmed(x) != ""), lambda x: F.xxhash64(_trimmed(x))))).alias("line"))
    seen = each.groupBy("host", "line", "page").agg(F.lit(1).alias("one")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= least_pages)
    total = pages.groupBy("host", "page").agg(F.lit(1).alias("one")).groupBy(F.col("host").alias("of")).agg(F.count(F.lit(1)).alias("total"))
    bad = seen.join(total, F.expr("host <=> of")).where(F.col("pages") > ratio * F.col("total"))
    dealt = bad.groupBy("host", _slot(F.col("line")).alias("slot")).agg(F.collect_set("line").alias("lines"))
    found = dealt.groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct("slot", "lines"))).alias("slots"))
    return found.select("host", F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda i: F.coalesce(F.try_element_at("slots", i), F.array().cast("array<bigint>"))).alias("bad"))


def drop_boilerplate(docs: DataFrame, text: str = "text", host: str = "source", ratio: float = RATIO, least_pages: int = LEAST_PAGES, counts: bool = False) -> DataFrame:
    """docs with the boilerplate lines of each host taken out of ``text``; ``counts`` adds n_lines and n_dropped (longs).

    Lines are compared without white space at their ends. Blank lines stay. A text that loses all lines becomes empty;
    null stays null and empty stays empty, with 0 lines dropped. A null host is a host of its own. Rows are never
    dropped, and rows that repeat are treated alike. Other columns stay, whatever their names; with ``counts``, columns
    of those two names are replaced.
    """
    bad = staged(boilerplate(docs, text, host, ratio, least_pages), "boilerplate").select(F.col("host").alias("_lodestone_host"), F.col("bad").alias("_lodestone_bad"))
    # the planner knows the size of what was staged: a small list is broadcast, a large one joined by shuffles
    joined = docs.join(bad, docs[host].eqNullSafe(bad["_lodestone_host"]), "left")
    lines = F.split(docs[text], "\n")
    kept = F.filter(lines, lambda x: (_trimmed(x) == "") | ~_listed(_trimmed(x)))
    clean = F.when(F.col("_lodestone_bad").isNull(), docs[text]).otherwise(F.array_join(kept, "\n"))
    out = [clean.alias(c) if c == text else docs[c] for c in docs.columns if not (counts and c in ("n_lines", "n_dropped"))]
    if counts:
        n = F.coalesce(F.size(lines), F.lit(0)).cast("long")
        n = F.when(docs[text].isNull(), F.lit(0).cast("long")).otherwise(n)
        dropped = F.when(docs[text].isNull() | F.col("_lodestone_bad").isNull(), F.lit(0).cast("long")).otherwise((F.size(lines) - F.size(kept)).cast("long"))
        out += [n.alias("n_lines"), dropped.alias("n_dropped")]
    return joined.select(*out)


ORACLE = f"""
WITH d AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
x AS (SELECT DISTINCT source, text AS page, trim(line, E' \\t\\r\\x0b\\x0c') AS line FROM (SELECT source, text, unnest(lines) AS line FROM d) WHERE trim(line, E' \\t\\r\\x0b\\x0c') <> ''),
seen AS (SELECT source, line, count(*) AS pages FROM x GROUP BY source, line),
total AS (SELECT source, count(DISTINCT text) AS total FROM d GROUP BY source),
bad AS (SELECT s.source, list(s.line) AS bad FROM seen s JOIN total t ON s.source IS NOT DISTINCT FROM t.source WHERE pages >= {LEAST_PAGES} AND pages > {RATIO} * total GROUP BY s.source),
k AS (SELECT doc_id, text, len(lines) AS n, list_filter(lines, lambda l: trim(l, E' \\t\\r\\x0b\\x0c') = '' OR NOT list_contains(coalesce(bad, []), trim(l, E' \\t\\r\\x0b\\x0c'))) AS kept
      FROM d LEFT JOIN bad ON d.source IS NOT DISTINCT FROM bad.source)
SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE n END AS n_lines, CASE WHEN text IS NULL THEN 0 ELSE n - len(kept) END AS n_dropped,
       sha256(array_to_string(kept, chr(10))) AS text_sha256
FROM k
"""
