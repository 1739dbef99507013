"""Window functions over keys of any size: lag and lead, places, rings, and nearest known values.

A window that is partitioned by a key sends all rows of the key to one task. Here rows are dealt out by ranges of (key,
order) instead, so a key with a third of all rows lies in many tasks, and a window runs within a range. What it would see
beyond the range's ends comes from small tables: only keys that lie in more than one range (one a boundary, besides hot
ones) hand rows or sums on, and of those only the few rows at each range's ends.

``order`` has to tell the rows of a key apart wherever the result depends on it. A null key is a key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.session import staged


def in_ranges(df: DataFrame, key: str, order: list[str], count: int | None = None) -> DataFrame:
    """The rows with their ``_range``: staged, numbered in order of (key, order)."""
    dealt = df.repartitionByRange(count, key, *order) if count else df.repartitionByRange(key, *order)
    return staged(dealt.withColumn("_range", F.spark_partition_id()), "ranges")


def spanning(rows: DataFrame, key: str) -> DataFrame:
    """(_key): the keys that lie in more than one range; they begin or end one, so there are at most as many as ranges."""
    ends = rows.groupBy("_range").agg(F.min(F.struct(key)).alias("low"), F.max(F.struct(key)).alias("high"))
    pieces = ends.select("_range", F.explode(F.array("low", "high")).alias("end")).select("_range", F.col(f"end.{key}").alias("_key")).distinct()
    return staged(pieces.groupBy("_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_key"), "spanning")


def _of(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return rows.join(keys, rows[key].eqNullSafe(keys["_key"]), "left_semi")


def _halo(rows: DataFrame, spans: DataFrame, key: str, order: list[str], columns: list[str], n: int, before: bool) -> DataFrame:
    """Of each piece of a spanning key, the n rows that stand before (or after) it in other ranges, under the piece's
    range. Each piece hands on its n outermost rows; the rows next to a piece are among those next to its own outermost."""
    held = list(dict.fromkeys([key, *order, *columns]))
    turn = [F.col(c).desc() if before else F.col(c).asc() for c in order]
    outer = _of(rows, spans, key).select("_range", *held).withColumn("_n", F.row_number().over(W.partitionBy("_range", key).orderBy(*turn))).where(F.col("_n") <= n)
    along = W.partitionBy(key).orderBy("_range", *order)
    beside = F.collect_list(F.struct(*held)).over(along.rowsBetween(-n, -1) if before else along.rowsBetween(1, n))
    inner = W.partitionBy(key, "_range").orderBy(F.col("_n").desc())  # the outermost row that lies deepest in its piece
    found = outer.withColumn("_beside", beside).withColumn("_deep", F.row_number().over(inner)).where("_deep = 1")
    return found.select("_range", F.explode("_beside").alias("_row")).select("_range", "_row.*")


def lagged(df: DataFrame, key: str, order: list[str], columns: dict[str, tuple[str, int]], count: int | None = None) -> DataFrame:
    """df with new columns: name to (column, n), that column's value n rows before in the key's order, or -n rows after for
    a negative n; null beyond the ends."""
    rows = in_ranges(df, key, order, count)
    spans = spanning(rows, key)
    sources = [c for c, _ in columns.values()]
    back, fore = max([n for _, n in columns.values()] + [0]), max([-n for _, n in columns.values()] + [0])
    every = rows.withColumn("_halo", F.lit(False))
    for n, before in ((back, True), (fore, False)):
        if n:
            every = every.unionByName(_halo(rows, spans, key, order, sources, n, before).withColumn("_halo", F.lit(True)), allowMissingColumns=True)
    along = W.partitionBy("_range", key).orderBy(*order)
    out = every.select("*", *[F.lag(c, n).over(along).alias(name) if n >= 0 else F.lead(c, -n).over(along).alias(name) for name, (c, n) in columns.items()])
    return out.where("not _halo").select(*[c for c in df.columns if c not in columns], *columns)


def placed(df: DataFrame, key: str, order: list[str], name: str, count: int | None = None) -> DataFrame:
    """df with the place of each row in its key, from 1."""
    rows = in_ranges(df, key, order, count)
    sizes = _of(rows, spanning(rows, key), key).groupBy(key, "_range").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select(F.col(key).alias("_key"), F.col("_range").alias("_at"), (F.sum("n").over(W.partitionBy(key).orderBy("_range")) - F.col("n")).alias("_before"))
    own = F.row_number().over(W.partitionBy("_range", key).orderBy(*order))
    here = rows.withColumn("_own", own)
    met = here.join(before, here[key].eqNullSafe(before["_key"]) & (here["_range"] == before["_at"]), "left")
    return met.select(*[rows[c] for c in df.columns if c != name], (F.col("_own") + F.coalesce("_before", F.lit(0))).cast("long").alias(name))


def ringed(df: DataFrame, key: str, order: list[str], column: str, name: str, count: int | None = None) -> DataFrame:
    """df with ``column`` of the next row of the key; the last row gets the first one's."""
    rows = in_ranges(df, key, order, count)
    spans = spanning(rows, key)
    every = rows.withColumn("_halo", F.lit(False)).unionByName(_halo(rows, spans, key, order, [column], 1, False).withColumn("_halo", F.lit(True)), allowMissingColumns=True)
    along = W.partitionBy("_range", key).orderBy(*order)
    firsts = _of(rows, spans, key).groupBy(key).agg(F.min_by(F.struct(F.col(column).alias("v")), F.struct(*order)).alias("_first")).select(F.col(key).alias("_key"), "_first")
    next_ = F.lead(F.struct(F.col(column).alias("v"))).over(along)
    here = every.select("*", next_.alias("_next"), F.first(F.struct(F.col(column).alias("v"))).over(along).alias("_here")).where("not _halo")
    met = here.join(firsts, here[key].eqNullSafe(firsts["_key"]), "left")
    return met.select(*[here[c] for c in df.columns if c != name], F.coalesce("_next", "_first", "_here")["v"].alias(name))


def filled(df: DataFrame, key: str, order: list[str], column: str, before: str, after: str, count: int | None = None) -> DataFrame:
    """df with the last value of ``column`` that is known at or before a row, and the first at or after it."""
    rows = in_ranges(df, key, order, count)
    known = _of(rows, spanning(rows, key), key).where(F.col(column).isNotNull())
    value, place = F.struct(F.col(column).alias("v")), F.struct(*order)
    ends = known.groupBy(key, "_range").agg(F.max_by(value, place).alias("_last"), F.min_by(value, place).alias("_first"))
    pieces = _of(rows, spanning(rows, key), key).select(key, "_range").distinct().withColumnsRenamed({key: "_key", "_range": "_at"})
    met = pieces.join(ends, pieces["_key"].eqNullSafe(ends[key]) & (pieces["_at"] == ends["_range"]), "left")
    # the first known value that follows is the last one in reverse: Spark reads a frame without an end anew for each row
    along, back = W.partitionBy("_key").orderBy("_at"), W.partitionBy("_key").orderBy(F.col("_at").desc())
    outer = met.select("_key", "_at", F.last("_last", True).over(along.rowsBetween(W.unboundedPreceding, -1)).alias("_in"), F.last("_first", True).over(back.rowsBetween(W.unboundedPreceding, -1)).alias("_out"))
    own, turned = W.partitionBy("_range", key).orderBy(*order), W.partitionBy("_range", key).orderBy(*[F.desc(c) for c in order])
    here = rows.select("*", F.last(column, True).over(own.rowsBetween(W.unboundedPreceding, 0)).alias("_b"), F.last(column, True).over(turned.rowsBetween(W.unboundedPreceding, 0)).alias("_a"))
    both = here.join(outer, here[key].eqNullSafe(outer["_key"]) & (here["_range"] == outer["_at"]), "left")
    return both.select(*[here[c] for c in df.columns if c not in (before, after)], F.coalesce("_b", F.col("_in")["v"]).alias(before), F.coalesce("_a", F.col("_out")["v"]).alias(after))


def nearest(wanted: DataFrame, known: DataFrame, key: str, ident: str, at: str, reach: float) -> DataFrame:
    """(ident, other, distance): for each wanted row the known one of its key whose ``at`` is nearest, if that is at most
    ``reach`` away; ties by the smaller ident. Rows are sorted once and look at their neighbours: no pairs are formed."""
    points = known.where(F.col(at).isNotNull()).groupBy(key, at).agg(F.min(ident).alias("_other"))
    places = points.select(key, at, F.lit(0).alias("_kind"), F.lit(None).cast(dict(wanted.dtypes)[ident]).alias(ident), F.struct(F.col(at).alias("at"), F.col("_other").alias("other")).alias("_point"))
    asked = wanted.where(F.col(at).isNotNull()).select(key, at, F.lit(1).alias("_kind"), ident)
    rows = filled(places.unionByName(asked, allowMissingColumns=True), key, [at, "_kind", ident], "_point", "_low", "_high").where("_kind = 1")
    near = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(at) - F.col(c)["at"]).alias("distance"), F.col(c)["other"].alias("other")))
    best = rows.select(ident, F.array_min(F.array_compact(F.array(near("_low"), near("_high")))).alias("m")).where(F.col("m")["distance"] <= reach)
    return best.select(ident, F.col("m")["other"].alias("other"), F.col("m")["distance"].alias("distance"))
