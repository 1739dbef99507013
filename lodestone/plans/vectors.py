"""Queries over vector collections: nearest neighbours, evaluation, running averages of vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import vector as V
from lodestone.operators import folds
from lodestone.operators.collection import VectorIndex, top_k
from lodestone.plans.record import query
from lodestone.session import table

_COS = "list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[])"


def _scored(where: str = "q.vec_id % 20 = 0", more: str = "true") -> str:
    return f"SELECT q.vec_id AS query_id, c.vec_id AS id, {_COS} AS score, c.label FROM embeddings q, embeddings c WHERE {where} AND {more}"


def _ranked(where: str = "q.vec_id % 20 = 0", more: str = "true") -> str:
    return f"SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id))::BIGINT AS rank FROM ({_scored(where, more)}) s"


def _hits(spark: SparkSession, d: str, k: int, threshold: float | None = None, skip_self: bool = False) -> DataFrame:
    """Queries are the vectors whose id is divisible by 20; all vectors are searched."""
    points = table(spark, d, "embeddings").select("vec_id", "embedding")
    queries = points.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    return top_k(points, queries, k, threshold, ident="vec_id", vector="embedding", skip_self=skip_self)


@query("indexed_topk")
def indexed_topk(spark: SparkSession, d: str) -> DataFrame:
    """cosine_topk by way of an index over all vectors; its recall is measured in the tests."""
    points = table(spark, d, "embeddings").select("vec_id", "embedding")
    index = VectorIndex(points, "vec_id", "embedding")
    queries = points.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    return index.search(index.stored(), queries, 3).withColumn("score", F.round("score", 6))


@query("cosine_topk", f"SELECT query_id, id, round(score, 6) AS score, rank FROM ({_ranked()}) r WHERE rank <= 3")
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d, 3).withColumn("score", F.round("score", 6))


@query("cosine_topk_threshold", f"SELECT query_id, id, round(score, 6) AS score, rank FROM ({_ranked(more=f'{_COS} >= 0.1')}) r WHERE rank <= 10")
def cosine_topk_threshold(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d, 10, 0.1).withColumn("score", F.round("score", 6))


@query("topk_join_catalog", f"SELECT query_id, id, round(score, 6) AS score, rank, p_name, p_brand FROM ({_ranked()}) r JOIN part ON p_partkey = id % 200 WHERE rank <= 3")
def topk_join_catalog(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: recognise query vectors and look their matches up in the catalog."""
    return _hits(spark, d, 3).withColumn("score", F.round("score", 6)).join(table(spark, d, "part").select("p_partkey", "p_name", "p_brand"), F.col("id") % 200 == F.col("p_partkey")).drop("p_partkey")


@query("match_threshold_filter", f"SELECT query_id, id, round(score, 6) AS score FROM ({_ranked(more='q.vec_id <> c.vec_id')}) r WHERE rank = 1 AND score > 0.35")
def match_threshold_filter(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d, 1, skip_self=True).where("score > 0.35").select("query_id", "id", F.round("score", 6).alias("score"))


@query("best_match", f"SELECT query_id, arg_max(id, [score, -id]) AS id FROM ({_scored(more='q.vec_id <> c.vec_id')}) s GROUP BY query_id")
def best_match(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d, 1, skip_self=True).select("query_id", "id")


@query("matches_top3_desc", f"SELECT query_id, id, rank FROM ({_ranked(more='q.vec_id <> c.vec_id')}) r WHERE rank <= 3")
def matches_top3_desc(spark: SparkSession, d: str) -> DataFrame:
    hits = _hits(spark, d, 5, skip_self=True).groupBy("query_id").agg(F.collect_list(F.struct((-F.col("score")).alias("order"), "id")).alias("m"))
    return hits.select("query_id", F.posexplode(F.slice(F.sort_array("m"), 1, 3)).alias("pos", "m")).select("query_id", "m.id", (F.col("pos") + 1).cast("long").alias("rank"))


@query("recall_at_k", f"""WITH r AS ({_ranked(more='q.vec_id <> c.vec_id')}), t AS (SELECT r.*, e.label AS target FROM r JOIN embeddings e ON e.vec_id = query_id WHERE rank <= 5)
    , h AS (SELECT query_id, target, max(CASE WHEN rank = 1 AND label = target THEN 1 ELSE 0 END) AS h1, max(CASE WHEN label = target THEN 1 ELSE 0 END) AS h5 FROM t GROUP BY ALL)
    SELECT target AS label, round(avg(h1), 6) AS recall_1, round(avg(h5), 6) AS recall_5 FROM h GROUP BY target""")
def recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "embeddings").select("vec_id", "label")
    hits = _hits(spark, d, 5, skip_self=True).join(labels.select(F.col("vec_id").alias("id"), "label"), "id").join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("target")), "query_id")
    same = F.col("label") == F.col("target")
    each = hits.groupBy("query_id", "target").agg(F.max((same & (F.col("rank") == 1)).cast("int")).alias("h1"), F.max(same.cast("int")).alias("h5"))
    return each.groupBy(F.col("target").alias("label")).agg(F.round(F.avg("h1"), 6).alias("recall_1"), F.round(F.avg("h5"), 6).alias("recall_5"))


@query("euclidean_distance", "SELECT c.vec_id, round(list_distance(c.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS distance FROM embeddings c, embeddings q WHERE q.vec_id = 0")
def euclidean_distance(spark: SparkSession, d: str) -> DataFrame:
    points = table(spark, d, "embeddings").select("vec_id", "embedding")
    first = points.where("vec_id = 0").select(F.col("embedding").alias("q"))
    return points.crossJoin(F.broadcast(first)).select("vec_id", F.round(V.euclidean(F.col("embedding"), F.col("q")), 6).alias("distance"))


@query("l2_normalize", """SELECT vec_id, CASE WHEN vec_id = 3 THEN NULL ELSE round(embedding[1]::DOUBLE * (label + 1) / sqrt(list_dot_product(list_transform(embedding, lambda x: x::DOUBLE * (label + 1)), list_transform(embedding, lambda x: x::DOUBLE * (label + 1)))), 6) END AS first_value FROM embeddings""")
def l2_normalize(spark: SparkSession, d: str) -> DataFrame:
    scaled = F.transform("embedding", lambda x: F.when(F.col("vec_id") == 3, F.lit(0.0)).otherwise(x.cast("double") * (F.col("label") + 1)))
    vectors = table(spark, d, "embeddings").select("vec_id", scaled.alias("v"))
    return vectors.select("vec_id", F.round(V.l2_normalize(F.col("v"))[0], 6).alias("first_value"))


@query("gated_ewma_vector", """WITH RECURSIVE r AS (SELECT label, vec_id, embedding::DOUBLE[] AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM embeddings),
    f AS (SELECT label, k, vec_id AS t, v AS z, 1::BIGINT AS n FROM r WHERE k = 1
          UNION ALL SELECT f.label, r.k, CASE WHEN r.vec_id - f.t > 15 THEN r.vec_id ELSE f.t END,
            CASE WHEN r.vec_id - f.t > 15 THEN [0.1::DOUBLE * r.v[i] + 0.9::DOUBLE * f.z[i] for i in range(1, 65)] ELSE f.z END, f.n + CASE WHEN r.vec_id - f.t > 15 THEN 1 ELSE 0 END
          FROM f JOIN r ON r.label = f.label AND r.k = f.k + 1),
    l AS (SELECT label, max(k) AS k FROM f GROUP BY label)
    SELECT f.label, f.n, round(f.z[1], 6) AS first_value, round(list_sum(f.z), 6) AS total FROM f JOIN l ON f.label = l.label AND f.k = l.k""")
def gated_ewma_vector(spark: SparkSession, d: str) -> DataFrame:
    f = folds.gated_ewma(table(spark, d, "embeddings"), "label", "vec_id", "embedding", 15)
    return f.select("label", "n", F.round(F.col("z")[0], 6).alias("first_value"), F.round(F.aggregate("z", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("alpha_blend", "SELECT a.vec_id, round(list_sum([a.embedding[i]::DOUBLE * 0.25 + b.embedding[i]::DOUBLE * 0.75 for i in range(1, 65)]), 6) AS total FROM embeddings a, embeddings b WHERE b.vec_id = 1")
def alpha_blend(spark: SparkSession, d: str) -> DataFrame:
    points = table(spark, d, "embeddings").select("vec_id", "embedding")
    back = points.where("vec_id = 1").select(F.col("embedding").alias("back"))
    mixed = points.crossJoin(F.broadcast(back)).select("vec_id", V.lerp(F.col("embedding"), F.col("back"), 0.25).alias("m"))
    return mixed.select("vec_id", F.round(F.aggregate("m", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("clip_values", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: greatest(0, least(0.1, x::DOUBLE)))), 6) AS total FROM embeddings")
def clip_values(spark: SparkSession, d: str) -> DataFrame:
    clipped = F.transform("embedding", lambda x: V.clip(x.cast("double"), 0.0, 0.1))
    return table(spark, d, "embeddings").select("vec_id", F.round(F.aggregate(clipped, F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("response_nested_json", f"SELECT query_id, count(*) AS n, arg_max(id, -rank) AS first_id, round(max(score), 6) AS best FROM ({_ranked()}) r WHERE rank <= 3 GROUP BY query_id")
def response_nested_json(spark: SparkSession, d: str) -> DataFrame:
    """Matches are nested, encoded as JSON, and read back."""
    hits = _hits(spark, d, 3)
    nested = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("matches"))
    sent = nested.select("query_id", F.to_json(F.struct("query_id", "matches")).alias("json"))
    got = sent.select("query_id", F.from_json("json", "query_id long, matches array<struct<rank:long,id:long,score:double>>").alias("r"))
    return got.select("query_id", F.size("r.matches").cast("long").alias("n"), F.col("r.matches")[0]["id"].alias("first_id"), F.round(F.col("r.matches")[0]["score"], 6).alias("best"))


@query("arrays_zip_join", "SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], list_reverse(embedding::DOUBLE[])), 6) AS product FROM embeddings")
def arrays_zip_join(spark: SparkSession, d: str) -> DataFrame:
    """Elements are joined by position with those of the same vector backwards."""
    pairs = F.arrays_zip(F.col("embedding").alias("a"), F.reverse("embedding").alias("b"))
    vectors = table(spark, d, "embeddings").select("vec_id", pairs.alias("p"))
    return vectors.select("vec_id", F.round(F.aggregate("p", F.lit(0.0), lambda s, x: s + x["a"].cast("double") * x["b"].cast("double")), 6).alias("product"))


@query("pairwise_label_pairs", "SELECT (a.label = b.label) AS same_label, count(*) AS n FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id GROUP BY 1")
def pairwise_label_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs are counted from the sizes of labels; none is formed."""
    sizes = table(spark, d, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    both = sizes.agg((F.sum(F.col("n") * (F.col("n") - 1)) / 2).cast("long").alias("same"), F.sum("n").alias("all"))
    other = (F.col("all") * (F.col("all") - 1) / 2).cast("long") - F.col("same")
    return both.select(F.explode(F.array(F.struct(F.lit(True).alias("same_label"), F.col("same").alias("n")), F.struct(F.lit(False).alias("same_label"), other.alias("n")))).alias("r")).select("r.*").where("n > 0")
