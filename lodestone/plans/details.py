"""Queries of single rules: keyed retrieval, symbols in texts, parsing, gates, tensors as arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import geometry as G
from lodestone.functions import tensors as N
from lodestone.functions import text as T
from lodestone.operators import catalog, folds
from lodestone.operators.collection import top_k
from lodestone.plans.record import query
from lodestone.plans.shapes import parts, quads
from lodestone.session import spread, table


@query("retrieve_by_ids", "SELECT vec_id, label FROM embeddings WHERE vec_id % 7 = 0")
def retrieve_by_ids(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "part").select((F.col("p_partkey") * 7).alias("vec_id")).union(spark.createDataFrame([(-7,), (7,), (None,)], "vec_id long"))
    more = table(spark, d, "embeddings").where("vec_id % 7 = 0").select("vec_id")
    return catalog.retrieved(table(spark, d, "embeddings"), ids.union(more), "vec_id", ["label"])


@query("retrieve_with_vectors", "SELECT vec_id, round(embedding[1]::DOUBLE, 6) AS first_value FROM embeddings WHERE vec_id IN (SELECT p_partkey * 3 FROM part)")
def retrieve_with_vectors(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "part").select((F.col("p_partkey") * 3).alias("vec_id"))
    return catalog.retrieved(table(spark, d, "embeddings"), ids, "vec_id", ["embedding"]).select("vec_id", F.round(F.col("embedding")[0].cast("double"), 6).alias("first_value"))


@query("bool_parse", "SELECT p_partkey, lower(CASE p_partkey % 5 WHEN 0 THEN 'Y' WHEN 1 THEN 'Yes' WHEN 2 THEN 'TRUE' WHEN 3 THEN 'no' ELSE '' END) IN ('y', 'yes', 'true') AS flag FROM part")
def bool_parse(spark: SparkSession, d: str) -> DataFrame:
    word = F.element_at(F.array(*map(F.lit, ("Y", "Yes", "TRUE", "no", ""))), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", T.truthy(word).alias("flag"))


@query("default_projection", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 AND p_name <> '' THEN p_name ELSE 'Unknown' END AS name FROM part")
def default_projection(spark: SparkSession, d: str) -> DataFrame:
    name = F.when(F.col("p_partkey") % 3 == 0, "").when(F.col("p_partkey") % 3 == 2, F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", T.or_default(name, "Unknown").alias("name"))


@query("option_parse", "SELECT p_partkey, CASE WHEN p_partkey % 4 < 2 THEN NULL ELSE p_brand END AS model, CASE WHEN p_size > 10 THEN p_size - 10 END AS scale FROM part")
def option_parse(spark: SparkSession, d: str) -> DataFrame:
    word = F.when(F.col("p_partkey") % 4 == 0, "None").when(F.col("p_partkey") % 4 == 1, "no").otherwise(F.col("p_brand"))
    return table(spark, d, "part").select("p_partkey", T.unless_none(word).alias("model"), T.positive(F.col("p_size") - 10).alias("scale"))


@query("forced_probability", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.0::DOUBLE END AS p FROM part")
def forced_probability(spark: SparkSession, d: str) -> DataFrame:
    forced = F.when(F.col("p_partkey") % 3 == 0, True).when(F.col("p_partkey") % 3 == 1, False)
    return table(spark, d, "part").select("p_partkey", forced.cast("int").cast("double").alias("p"))


@query("path_extension", r"SELECT DISTINCT url, lower(regexp_extract(url, '(\.[^./]+)$', 1)) AS extension FROM pages")
def path_extension(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("url", T.extension(F.col("url")).alias("extension")).distinct()


@query("uuid_normalise", r"SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 THEN regexp_replace(md5(p_partkey::VARCHAR), '(.{8})(.{4})(.{4})(.{4})(.{12})', '\1-\2-\3-\4-\5') END AS id FROM part")
def uuid_normalise(spark: SparkSession, d: str) -> DataFrame:
    mark = F.md5(F.col("p_partkey").cast("string"))
    dashed = F.concat_ws("-", *[F.substring(mark, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    written = F.when(F.col("p_partkey") % 5 == 0, F.concat(mark, F.lit("!"))).when(F.col("p_partkey") % 5 == 1, mark).when(F.col("p_partkey") % 5 == 2, F.concat(F.lit(" {"), F.upper(dashed), F.lit("} "))).otherwise(F.upper(dashed))
    return table(spark, d, "part").select("p_partkey", T.uuid(written).alias("id"))


#: The symbols that the queries know are taken from the parts: letters but W, and numbers below 6.
_SYMBOLS = """SELECT '{' || chr((65 + p_partkey % 26)::INT) || '}' AS token, 'symbols/' || chr((65 + p_partkey % 26)::INT) || '.svg' AS uri FROM part WHERE p_partkey % 26 <> 22
    UNION SELECT '{' || (p_size % 9) || '}', 'symbols/' || (p_size % 9) || '.svg' FROM part WHERE p_size % 9 < 6"""
_TEXTS = "SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN '' ELSE '{' || (p_size % 9) || '}' || left(p_name, 3) || '{T}' || CASE p_partkey % 6 WHEN 1 THEN '{W}' WHEN 2 THEN 'a{' WHEN 3 THEN '{{2}}' ELSE '' END END AS text FROM part"
_TOKENS = r"regexp_extract_all(text, '\{[^}]*\}|[\s\S]')"


def texts() -> Column:
    """With known and unknown symbols, and braces that nothing closes or opens."""
    last = F.element_at(F.array(*map(F.lit, ("", "{W}", "a{", "{{2}}", "", ""))), (F.col("p_partkey") % 6 + 1).cast("int"))
    return F.when(F.col("p_partkey") % 6 == 0, "").otherwise(F.concat(F.lit("{"), (F.col("p_size") % 9).cast("string"), F.lit("}"), F.left("p_name", F.lit(3)), F.lit("{T}"), last))


def symbols(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    named = lambda c: F.struct(F.concat(F.lit("{"), c, F.lit("}")).alias("symbol"), F.concat(F.lit("symbols/"), c, F.lit(".svg")).alias("svg_uri"))
    letter, number = F.char((65 + F.col("p_partkey") % 26)), (F.col("p_size") % 9).cast("string")
    records = part.where("p_partkey % 26 <> 22").select(named(letter).alias("s")).union(part.where("p_size % 9 < 6").select(named(number).alias("s")))
    return catalog.symbology(records.select("s.*"))


@query("symbol_substitution", f"""WITH t AS (SELECT p_partkey, unnest({_TOKENS}) AS token, generate_subscripts({_TOKENS}, 1) - 1 AS pos FROM ({_TEXTS}) x), s AS ({_SYMBOLS})
    SELECT p_partkey, pos::INT AS pos, coalesce(uri, t.token) AS item FROM t LEFT JOIN s ON t.token = s.token""")
def symbol_substitution(spark: SparkSession, d: str) -> DataFrame:
    return catalog.substituted(table(spark, d, "part").select("p_partkey", texts().alias("text")), "p_partkey", "text", symbols(spark, d))


@query("augmented_matches", f"""WITH t AS (SELECT p_partkey, unnest({_TOKENS}) AS token, generate_subscripts({_TOKENS}, 1) AS pos FROM ({_TEXTS}) x), s AS ({_SYMBOLS}),
    i AS (SELECT p_partkey, string_agg(coalesce(uri, t.token), '|' ORDER BY pos) AS items FROM t LEFT JOIN s ON t.token = s.token GROUP BY p_partkey)
    SELECT p.p_partkey, CASE WHEN p.p_partkey % 4 = 1 THEN 'kept' ELSE coalesce(i.items, '') END AS oracle_text FROM part p LEFT JOIN i ON p.p_partkey = i.p_partkey""")
def augmented_matches(spark: SparkSession, d: str) -> DataFrame:
    """A match that already has its extra data keeps it."""
    rows = table(spark, d, "part").select("p_partkey", texts().alias("text"), F.when(F.col("p_partkey") % 4 == 1, F.array(F.lit("kept"))).alias("extra"))
    out = catalog.augmented(rows, "p_partkey", "text", "extra", symbols(spark, d))
    return out.select("p_partkey", F.array_join("extra", "|").alias("oracle_text"))


@query("print_gate", """WITH RECURSIVE r AS (SELECT user_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
    f AS (SELECT user_id, k, us AS t, 1::BIGINT AS n FROM r WHERE k = 1 UNION ALL SELECT f.user_id, r.k, CASE WHEN r.us - f.t > 7200000000 THEN r.us ELSE f.t END, f.n + CASE WHEN r.us - f.t > 7200000000 THEN 1 ELSE 0 END FROM f JOIN r ON r.user_id = f.user_id AND r.k = f.k + 1)
    SELECT user_id, max(n)::BIGINT AS printed FROM f GROUP BY user_id""")
def print_gate(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return folds.gated_ewma(events, "user_id", "us", "us", 2 * 3600 * 1e6).select("user_id", F.col("n").alias("printed"))


@query("message_counters", "SELECT conv_id, count(CASE WHEN role = 'user' THEN 1 END) AS sent, count(CASE WHEN role <> 'user' THEN 1 END) AS received FROM conversations GROUP BY conv_id")
def message_counters(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("sent"), F.count_if(F.col("role") != "user").alias("received"))


@query("query_by_stored_id", "SELECT query_id, id, round(score, 6) AS score FROM (SELECT q.vec_id AS query_id, c.vec_id AS id, list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS score FROM embeddings q, embeddings c WHERE q.vec_id % 20 = 0) s WHERE score >= 0.1 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 3000")
def query_by_stored_id(spark: SparkSession, d: str) -> DataFrame:
    """The vectors of stored ids, searched with their own among the results."""
    points = table(spark, d, "embeddings").select("vec_id", "embedding")
    own = catalog.retrieved(points, points.where("vec_id % 20 = 0").select("vec_id"), "vec_id", ["embedding"]).withColumnRenamed("vec_id", "query_id")
    return top_k(points, own, 3000, 0.1, ident="vec_id", vector="embedding").select("query_id", "id", F.round("score", 6).alias("score"))


@query("label_slices", "SELECT vec_id, vec_id AS id_label, label AS set_label, len(embedding[1 : vec_id % 5]) AS n, round(coalesce(list_sum(embedding[1 : vec_id % 5]::DOUBLE[]), 0), 6) AS total FROM embeddings")
def label_slices(spark: SparkSession, d: str) -> DataFrame:
    labels = F.array(F.col("vec_id"), F.lit(-1).cast("long"), F.col("label").cast("long"))
    prefix = F.slice("embedding", F.lit(1), (F.col("vec_id") % 5).cast("int"))
    rows = table(spark, d, "embeddings").select("vec_id", labels.alias("l"), prefix.alias("p"))
    return rows.select("vec_id", F.col("l")[0].alias("id_label"), F.col("l")[2].cast("int").alias("set_label"), F.size("p").cast("long").alias("n"), F.round(N.total(F.col("p")), 6).alias("total"))


@query("dict_merge", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE p_brand END AS x, p_name AS y, (CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 3 END)::INT AS n FROM part")
def dict_merge(spark: SparkSession, d: str) -> DataFrame:
    left = F.create_map(F.lit("x"), F.col("p_brand"), F.lit("y"), F.col("p_name"))
    right = F.create_map(F.when(F.col("p_partkey") % 2 == 0, F.lit("x")).otherwise(F.lit("z")), F.col("p_type"))
    merged = table(spark, d, "part").select("p_partkey", T.merged(left, right).alias("m"))
    return merged.select("p_partkey", F.col("m")["x"].alias("x"), F.col("m")["y"].alias("y"), F.size("m").alias("n"))


@query("channels_first", "SELECT vec_id, round(list_sum([embedding[((i % 16) * 4 + i // 16) + 1]::DOUBLE * i for i in range(64)]), 6) AS weighted FROM embeddings")
def channels_first(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as images of 4 x 4 pixels and 4 channels."""
    turned = table(spark, d, "embeddings").select("vec_id", N.channels_first(F.col("embedding"), 16, 4).alias("v"))
    return turned.select("vec_id", F.round(N.total(F.transform("v", lambda x, i: x.cast("double") * i)), 6).alias("weighted"))


@query("area_fill", "SELECT vec_id, list_transform([0, 1, 2, 3], lambda c: round(list_avg([embedding[i * 4 + c + 1]::DOUBLE for i in range(16) if i % 4 < 2]), 6))[c + 1] AS mean, c::INT AS channel FROM embeddings, (SELECT unnest([0, 1, 2, 3]) AS c) n")
def area_fill(spark: SparkSession, d: str) -> DataFrame:
    """The mean colour of the left half of each image, by channel."""
    pixels = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("at", "v")).where(F.floor(F.col("at") / 4) % 4 < 2)
    return pixels.groupBy("vec_id", (F.col("at") % 4).alias("channel")).agg(F.round(F.avg(F.col("v").cast("double")), 6).alias("mean"))


@query("row_concat_padded", "SELECT vec_id, round(list_sum([CASE WHEN i < vec_id % 7 THEN embedding[i + 1]::DOUBLE ELSE 0 END * (i + 1) for i in range(8)]) + list_sum([CASE WHEN i < vec_id % 3 THEN embedding[i + 1]::DOUBLE ELSE 0 END * (i + 9) for i in range(8)]), 6) AS weighted FROM embeddings")
def row_concat_padded(spark: SparkSession, d: str) -> DataFrame:
    """Two rows of pixels of unlike lengths, padded to eight and put side by side."""
    row = lambda n: N.padded(F.slice("embedding", F.lit(1), (F.col("vec_id") % n).cast("int")), 8)
    rows = table(spark, d, "embeddings").select("vec_id", F.concat(row(7), row(3)).alias("v"))
    return rows.select("vec_id", F.round(N.total(F.transform("v", lambda x, i: x * (i + 1))), 6).alias("weighted"))


@query("image_bytes", "SELECT vec_id, c::INT AS channel, (((trunc(embedding[3 - c]::DOUBLE * 2550)::BIGINT % 256) + 256) % 256)::INT AS byte FROM embeddings, (SELECT unnest([0, 1, 2]) AS c) n")
def image_bytes(spark: SparkSession, d: str) -> DataFrame:
    """Of one pixel, times ten so that values wrap: truncated bytes without clipping, blue first."""
    pixel = F.slice("embedding", 1, 3)
    rows = table(spark, d, "embeddings").select("vec_id", F.posexplode(N.bytes_bgr(F.transform(pixel, lambda x: x.cast("double") * 10))).alias("channel", "byte"))
    return rows.select("vec_id", "channel", "byte")


@query("segments", "SELECT p_partkey, i::INT AS label, round(p_retailprice * (i + 1), 6) AS x, round(1.0::DOUBLE / (i + 1), 6) AS conf FROM part, (SELECT unnest([0, 1]) AS i) n WHERE p_partkey % 3 <> 0 AND p_partkey % 5 <> 0")
def segments(spark: SparkSession, d: str) -> DataFrame:
    """A frame without masks or without boxes has no segments."""
    masks = F.when(F.col("p_partkey") % 3 != 0, F.array(F.col("p_retailprice"), F.col("p_retailprice") * 2))
    boxes = F.when(F.col("p_partkey") % 5 != 0, F.array(F.lit(1.0), F.lit(0.5)))
    return N.segments(table(spark, d, "part").select("p_partkey", masks.alias("masks"), boxes.alias("boxes")), "masks", "boxes").select("p_partkey", "label", F.round("mask", 6).alias("x"), F.round("box", 6).alias("conf"))


@query("point_set_distance", "SELECT p_partkey, round((0 + 3 + sqrt((3 + p_partkey % 5) ^ 2 + (p_partkey % 5) ^ 2) + 0) / 4, 6) AS distance FROM part")
def point_set_distance(spark: SparkSession, d: str) -> DataFrame:
    """Each skewed quad against a rectangle that is 3 narrower."""
    plain = G.array_of(G.point(0.0, 0.0), G.point(F.col("w") - 3, 0.0), G.point(F.col("w") - 3, F.col("h")), G.point(0.0, F.col("h")))
    return quads(spark, d).select("p_partkey", F.round(G.mean_distance(F.col("q"), plain), 6).alias("distance"))


@query("box_difference", "SELECT p_partkey, round(w * h - greatest(0, least(w, 30) - 5) * greatest(0, least(h, 100) - 50), 6) AS difference, w >= 30 AND h >= 100 AS holds FROM (SELECT p_partkey, p_size::DOUBLE AS w, p_retailprice / 10 AS h FROM part) t")
def box_difference(spark: SparkSession, d: str) -> DataFrame:
    """The area of each box outside a fixed one, and whether it holds that one."""
    box = lambda x0, y0, x1, y1: F.struct(*[F.lit(v).cast("double").alias(n) if not isinstance(v, Column) else v.alias(n) for n, v in (("x0", x0), ("y0", y0), ("x1", x1), ("y1", y1))])
    rows = parts(spark, d).select("p_partkey", box(0.0, 0.0, F.col("p_size").cast("double"), F.col("p_retailprice") / 10).alias("a"), box(5.0, 50.0, 30.0, 100.0).alias("b"))
    return rows.select("p_partkey", F.round(G.box_area(F.col("a")) - G.box_overlap(F.col("a"), F.col("b")), 6).alias("difference"), G.box_holds(F.col("a"), F.col("b")).alias("holds"))


@query("round_rect_mask", "WITH s AS (SELECT p_partkey, p_size AS w, p_size % 11 + 3 AS h, ceil(greatest(p_size, p_size % 11 + 3) * 0.2)::INT AS r FROM part) SELECT p_partkey, r AS radius, (SELECT count(*) FROM range(w) x(x), range(h) y(y) WHERE (greatest(0, r - 1 - x, x - (w - r)) ^ 2 + greatest(0, r - 1 - y, y - (h - r)) ^ 2) <= r * r) AS inside FROM s")
def round_rect_mask(spark: SparkSession, d: str) -> DataFrame:
    """Pixels inside a rectangle with round corners, whose radius is a fifth of the longer side."""
    sizes = spread(table(spark, d, "part").select("p_partkey", "p_size")).select("p_partkey", F.col("p_size").alias("w"), (F.col("p_size") % 11 + 3).alias("h"))
    return sizes.select("p_partkey", N.corner_radius(F.col("w"), F.col("h"), 0.2).alias("radius"), F.aggregate(N.round_mask(F.col("w"), F.col("h"), 0.2), F.lit(0).cast("long"), lambda a, x: a + x.cast("long")).alias("inside"))
