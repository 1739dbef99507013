"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws an exponential key, divided by its quality weight; the smallest keys of a source are its weighted
sample without replacement. A source whose target exceeds its size gives complete epochs first; the rest of the target is
a prefix, by key, of the source's documents.

No source is ever sorted as a whole: the range of its keys is cut into ``BINS`` bins, sums over bins show which bin the
target cuts, and the keys met in that bin are the range of the next of ``ROUNDS`` rounds. Only the documents of the last
bin are put in order, whatever the weights.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.session import staged

#: Sources in order take these weights in turn.
TURNS = (5.0, 2.0, 1.0)
SHARE, EPOCHS, BINS, ROUNDS = 1.5, 2, 1024, 3
SEED = "mix-1"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """From 0.1 for texts full of symbols to 1 for plain ones."""
    plain = F.length(F.translate(text, "#*$%&|<>!", ""))
    return F.coalesce(F.greatest(F.lit(0.1), 1 - 4.0 * (F.length(text) - plain) / F.nullif(F.length(text), F.lit(0))), F.lit(0.1))


def uniform(key: Column, seed: str = SEED) -> Column:
    """In (0, 1), from 52 bits of an MD5 sum: the same on every run and engine."""
    return (F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), key.cast("string")).cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def targets(sizes: DataFrame, share: float = SHARE, epochs: int = EPOCHS, turns: tuple[float, ...] = TURNS) -> DataFrame:
    """(source, source_size) to (source, source_size, target): ``share`` of all sizes by weight, no source above
    ``epochs`` times its size, the excess going to the others by weight. One row a source; its windows hold all sources,
    never documents."""
    turn = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weighted = sizes.withColumn("w", F.element_at(F.array(*[F.lit(t) for t in turns]), (turn % len(turns) + 1).cast("int"))).withColumn("most", F.col("source_size") * float(epochs))
    by_level = W.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    level = (F.lit(share) * F.sum("source_size").over(W.partitionBy()) - F.coalesce(F.sum("most").over(by_level.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("w").over(by_level.rowsBetween(0, W.unboundedFollowing))
    levels = weighted.withColumn("level", level).withColumn("fits", F.col("level") <= F.col("most") / F.col("w"))
    found = F.min(F.when(F.col("fits"), F.struct(F.col("most") / F.col("w"), F.col("level").alias("level")))).over(W.partitionBy())["level"]
    return levels.withColumn("found", found).select("source", "source_size", F.coalesce(F.least(F.col("most"), F.col("found") * F.col("w")), F.col("most")).alias("target"))


def _cut(rows: DataFrame, told: DataFrame, bins: int, rounds: int) -> DataFrame:
    """(of, low, high, before): per source whose target a document cuts, the least range of keys found to hold it, and the
    sizes before that range. told: (of, rest), the words that are left to take. One row a source and bin is all that
    windows see."""
    ranges = rows.groupBy("source").agg(F.min("drawn").alias("low"), F.max("drawn").alias("high")).withColumn("before", F.lit(0).cast("long"))
    ranges = staged(ranges.join(told.where("rest > 0"), F.expr("source <=> of")).select("of", "low", "high", "before", "rest"), "ranges")
    for _ in range(rounds):
        inside = rows.select("source", "size", "drawn").join(ranges, F.expr("source <=> of and drawn between low and high"))
        place = F.when(F.col("high") > F.col("low"), F.least(F.lit(bins - 1), F.floor((F.col("drawn") - F.col("low")) / (F.col("high") - F.col("low")) * bins).cast("int"))).otherwise(0)
        filled = inside.groupBy("of", "before", "rest", place.alias("bin")).agg(F.sum("size").alias("whole"), F.min("drawn").alias("low"), F.max("drawn").alias("high"))
        sums = filled.withColumn("upto", F.col("before") + F.sum("whole").over(W.partitionBy("of").orderBy("bin"))).where("upto > rest")
        least = sums.groupBy("of", "rest").agg(F.min(F.struct("bin", "low", "high", (F.col("upto") - F.col("whole")).alias("before"))).alias("cut"))
        ranges = staged(least.select("of", "cut.low", "cut.high", "cut.before", "rest"), "ranges")
    return ranges.drop("rest")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weight: Column | None = None, seed: str = SEED, share: float = SHARE, epochs: int = EPOCHS, bins: int = BINS, rounds: int = ROUNDS, carry: bool = False) -> DataFrame:
    """Per row of docs: key, size (words), source, source_size, target, copies and taken (= copies * size); with
    ``carry``, a struct ``row`` of all columns of docs, and ``copies``.

    Complete epochs come first, then documents by key as long as half of each still lies within the target, so a source
    is off by at most half a document. A null source is a source of its own, last in order; null and empty texts have
    size 0. Equal keys are put in order of their ids, sizes and text hashes. Rows that repeat an id draw the same number
    and are otherwise rows like others; null ids draw one number. The draw depends on seed and id alone, so reruns agree.
    """
    drawn = -F.log(uniform(docs[key], seed)) / (weight if weight is not None else quality_weight(docs[text]))
    whole = [F.struct(*[docs[c] for c in docs.columns]).alias("row")] if carry else []
    # texts are read once; what follows reads a few numbers a row
    rows = staged(docs.select(docs[key].alias("id"), docs[source].alias("source"), n_words(docs[text]).alias("size"), drawn.alias("drawn"), F.xxhash64(docs[text]).alias("mark"), *whole), "sized")
    told = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), share, epochs)
    told = told.withColumn("epochs", F.when(F.col("source_size") > 0, F.least(F.lit(float(epochs)), F.floor(F.col("target") / F.col("source_size")))).otherwise(0.0).cast("long"))
    told = told.withColumn("rest", F.when(F.col("epochs") < epochs, F.col("target") - F.col("epochs") * F.col("source_size")).otherwise(0.0))
    told = staged(told.withColumnRenamed("source", "of"), "targets")
    cut = _cut(rows, told.select("of", "rest"), bins, rounds)
    told = staged(told.join(cut.withColumnRenamed("of", "cut_of"), F.expr("of <=> cut_of"), "left").drop("cut_of"), "targets")
    rows = rows.join(told, F.expr("source <=> of")).drop("of").withColumn("at_cut", F.coalesce(F.expr("drawn between low and high"), F.lit(False)))
    ahead = F.col("before") + F.sum("size").over(W.partitionBy("source").orderBy("drawn", "id", "size", "mark").rowsBetween(W.unboundedPreceding, 0))
    edge = rows.where("at_cut").withColumn("more", (ahead - F.col("size") / 2 <= F.col("rest")).cast("long"))
    sure = rows.where("not at_cut").withColumn("more", ((F.col("rest") > 0) & F.coalesce(F.col("drawn") < F.col("low"), F.lit(True))).cast("long"))
    out = sure.unionByName(edge).withColumn("copies", F.col("epochs") + F.col("more"))
    if carry:
        return out.select("row", "copies")
    return out.select(F.col("id").alias(key), "size", F.col("source").alias(source), "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, with all its columns, whatever their names."""
    taken = mix(docs, carry=True, **settings).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("nth")).select("row.*")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         -ln((('0x' || substr(md5('mix-1|' || doc_id::VARCHAR), 1, 13))::BIGINT + 0.5) / 4503599627370496.0)
         / CASE WHEN coalesce(length(text), 0) = 0 THEN 0.1
                ELSE greatest(0.1, 1 - 4.0 * (length(text) - length(translate(text, '#*$%&|<>!', ''))) / length(text)) END AS drawn
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, 2.0::DOUBLE * source_size AS most FROM s),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / sum(w) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT level FROM l WHERE level <= most / w ORDER BY most / w, level LIMIT 1),
t AS (SELECT source, source_size, coalesce(least(most, (SELECT level FROM f) * w), most) AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN least(2, floor(target / source_size))::BIGINT ELSE 0 END AS epochs FROM t),
r AS (SELECT *, CASE WHEN epochs < 2 THEN target - epochs * source_size ELSE 0 END AS rest FROM e),
c AS (SELECT d.*, r.source_size, r.target, r.epochs, r.rest, sum(d.size) OVER (PARTITION BY d.source ORDER BY d.drawn, d.doc_id ROWS UNBOUNDED PRECEDING) AS upto
      FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source, source_size, target, epochs + CASE WHEN rest > 0 AND upto - size / 2.0 <= rest THEN 1 ELSE 0 END AS copies,
       (epochs + CASE WHEN rest > 0 AND upto - size / 2.0 <= rest THEN 1 ELSE 0 END) * size AS taken
FROM c
"""
