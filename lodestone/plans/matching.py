"""Queries that match and place things: polygons against polygons, cards onto images, detections to tracks, hardest examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import geometry as G
from lodestone.functions import sampling as S
from lodestone.operators import assignment, catalog, mining, placement, synth
from lodestone.plans.record import query
from lodestone.plans.relational import duck_draw
from lodestone.plans.shapes import SKEWED, quads
from lodestone.session import spread, table


def turned_square() -> Column:
    """A square per part, turned by as many degrees as its key."""
    turn = F.radians((F.col("p_partkey") % 90).cast("double"))
    half = (F.col("p_partkey") % 23).cast("double") + 7.25
    cx, cy = (F.col("p_partkey") % 41).cast("double") + 0.375, (F.col("p_partkey") % 67).cast("double") + 40.125
    corner = lambda a, b: G.point(cx + half * (a * F.cos(turn) - b * F.sin(turn)), cy + half * (a * F.sin(turn) + b * F.cos(turn)))
    return G.array_of(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1))


@query("polygon_overlap", f"""WITH {SKEWED},
    sq AS (SELECT p_partkey, radians((p_partkey % 90)::DOUBLE) AS t, (p_partkey % 23)::DOUBLE + 7.25 AS s, (p_partkey % 41)::DOUBLE + 0.375 AS cx, (p_partkey % 67)::DOUBLE + 40.125 AS cy FROM part),
    sv AS (SELECT p_partkey, i, cx + s * (a * cos(t) - b * sin(t)) AS x, cy + s * (a * sin(t) + b * cos(t)) AS y FROM sq, (VALUES (0::BIGINT, -1, -1), (1, 1, -1), (2, 1, 1), (3, -1, 1)) n(i, a, b)),
    ea AS (SELECT v.p_partkey AS id, v.x AS px, v.y AS py, u.x AS qx, u.y AS qy FROM v JOIN v u ON u.p_partkey = v.p_partkey AND u.i = (v.i + 1) % 4),
    eb AS (SELECT v.p_partkey AS id, v.x AS px, v.y AS py, u.x AS qx, u.y AS qy FROM sv v JOIN sv u ON u.p_partkey = v.p_partkey AND u.i = (v.i + 1) % 4),
    ina AS (SELECT b.p_partkey AS id, b.x, b.y FROM sv b JOIN ea e ON e.id = b.p_partkey GROUP BY b.p_partkey, b.i, b.x, b.y HAVING min((qx - px) * (b.y - py) - (qy - py) * (b.x - px)) >= 0),
    inb AS (SELECT a.p_partkey AS id, a.x, a.y FROM v a JOIN eb e ON e.id = a.p_partkey GROUP BY a.p_partkey, a.i, a.x, a.y HAVING min((qx - px) * (a.y - py) - (qy - py) * (a.x - px)) >= 0),
    k AS (SELECT ea.id, ea.px, ea.py, ea.qx - ea.px AS rx, ea.qy - ea.py AS ry, eb.px AS ox, eb.py AS oy, eb.qx - eb.px AS sx, eb.qy - eb.py AS sy FROM ea JOIN eb ON ea.id = eb.id),
    x AS (SELECT *, ((ox - px) * sy - (oy - py) * sx) / (rx * sy - ry * sx) AS f, ((ox - px) * ry - (oy - py) * rx) / (rx * sy - ry * sx) AS g FROM k WHERE rx * sy - ry * sx <> 0),
    pts AS (SELECT * FROM ina UNION ALL SELECT * FROM inb UNION ALL SELECT id, px + f * rx, py + f * ry FROM x WHERE f BETWEEN 0 AND 1 AND g BETWEEN 0 AND 1),
    m AS (SELECT *, avg(x) OVER (PARTITION BY id) AS mx, avg(y) OVER (PARTITION BY id) AS my FROM pts),
    o AS (SELECT *, coalesce(lead(x) OVER w, first(x) OVER w) AS nx, coalesce(lead(y) OVER w, first(y) OVER w) AS ny FROM m WINDOW w AS (PARTITION BY id ORDER BY atan2(y - my, x - mx), x, y)),
    s AS (SELECT id, abs(sum((x - mx) * (ny - my) - (nx - mx) * (y - my))) / 2 AS shared FROM o GROUP BY id),
    ha AS (SELECT id, count(*) AS n FROM ina GROUP BY id), hb AS (SELECT id, count(*) AS n FROM inb GROUP BY id),
    ar AS (SELECT id, abs(sum(px * qy - qx * py)) / 2 AS a FROM ea GROUP BY id)
    SELECT ar.id AS p_partkey, round(coalesce(shared, 0), 4) AS shared, round(a - coalesce(shared, 0), 4) AS outside, coalesce(ha.n, 0) = 4 AS holds, coalesce(hb.n, 0) = 4 AS held FROM ar LEFT JOIN s ON s.id = ar.id LEFT JOIN ha ON ha.id = ar.id LEFT JOIN hb ON hb.id = ar.id""")  # fmt: skip
def polygon_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Each skewed quad against a turned square: what they share, what of the quad lies outside, and which holds which."""
    pairs = quads(spark, d).select("p_partkey", "q", turned_square().alias("s"))
    shared = pairs.withColumn("shared", G.shared_area(F.col("q"), F.col("s")))
    return shared.select("p_partkey", F.round("shared", 4).alias("shared"), F.round(G.area(F.col("q")) - F.col("shared"), 4).alias("outside"), G.holds(F.col("q"), F.col("s")).alias("holds"), G.holds(F.col("s"), F.col("q")).alias("held"))


def attempts(spark: SparkSession, d: str, n: int = 5) -> DataFrame:
    """Cards of eight to an image, each with n drawn places and sizes."""
    ident = F.col("p_partkey") * 10 + F.col("attempt")
    rows = spread(table(spark, d, "part").select("p_partkey")).select("p_partkey", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("attempt")).select("p_partkey", F.floor(F.col("p_partkey") / 8).alias("image"), ident.alias("ident"))
    u = lambda name: S.uniform(name, F.col("ident"))
    w = F.sqrt(S.log_uniform("place_area", F.col("ident"), 0.02, 0.3) * 409600.0 / 1.4)
    return rows.select("p_partkey", "image", "ident", G.rectangle(u("place_x") * 640, u("place_y") * 640, w, w * 1.4).alias("card"))


def _duck_uniform(name: str) -> str:
    return f"({duck_draw(name, 'ident')} / 4294967296.0::DOUBLE)"


_SHARED = "greatest(0, least(k.vx1, o.x1) - greatest(k.vx0, o.x0)) * greatest(0, least(k.vy1, o.y1) - greatest(k.vy0, o.y0))"


@query("sequential_placement", f"""WITH RECURSIVE t AS (SELECT p_partkey, p_partkey // 8 AS image, p_partkey * 10 + a AS ident FROM part, (SELECT unnest(range(1, 6)) AS a) n),
    z AS (SELECT *, sqrt(exp(ln(0.02::DOUBLE) + {_duck_uniform('place_area')} * (ln(0.3::DOUBLE) - ln(0.02::DOUBLE))) * 409600.0::DOUBLE / 1.4::DOUBLE) AS w, {_duck_uniform('place_x')} * 640 AS cx, {_duck_uniform('place_y')} * 640 AS cy FROM t),
    c AS (SELECT p_partkey, image, ident, cx - w / 2 AS x0, cy - w * 1.4::DOUBLE / 2 AS y0, cx + w / 2 AS x1, cy + w * 1.4::DOUBLE / 2 AS y1 FROM z),
    v AS (SELECT *, greatest(x0, 0) AS vx0, greatest(y0, 0) AS vy0, least(x1, 640) AS vx1, least(y1, 640) AS vy1, (x1 - x0) * (y1 - y0) AS area FROM c),
    k AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY ident) AS n FROM v WHERE (vx1 - vx0) * (vy1 - vy0) >= 0.7 * area),
    g AS (SELECT image, 0::BIGINT AS n, []::STRUCT(item BIGINT, ident BIGINT, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE)[] AS taken FROM (SELECT DISTINCT image FROM k) i
        UNION ALL SELECT g.image, k.n, CASE WHEN len(list_filter(g.taken, lambda o: o.item = k.p_partkey
            OR (k.vx1 - k.vx0) * (k.vy1 - k.vy0) - {_SHARED} < 0.5 * k.area OR (o.x1 - o.x0) * (o.y1 - o.y0) - {_SHARED} < 0.5 * (o.x1 - o.x0) * (o.y1 - o.y0)
            OR (k.vx0 <= o.x0 AND k.vy0 <= o.y0 AND k.vx1 >= o.x1 AND k.vy1 >= o.y1) OR (o.x0 <= k.vx0 AND o.y0 <= k.vy0 AND o.x1 >= k.vx1 AND o.y1 >= k.vy1))) = 0
            THEN list_append(g.taken, {{'item': k.p_partkey, 'ident': k.ident, 'x0': k.x0, 'y0': k.y0, 'x1': k.x1, 'y1': k.y1}}) ELSE g.taken END FROM g JOIN k ON k.image = g.image AND k.n = g.n + 1),
    l AS (SELECT image, arg_max(taken, n) AS taken FROM g GROUP BY image), r AS (SELECT image, unnest(taken) AS o FROM l)
    SELECT image, o.item AS p_partkey, (o.ident % 10)::BIGINT AS attempt, round((o.x0 + o.x1) / 2, 4) AS x, round((o.y0 + o.y1) / 2, 4) AS y FROM r""")  # fmt: skip
def sequential_placement(spark: SparkSession, d: str) -> DataFrame:
    """Which attempt puts each card onto its image, card after card, without hiding those before."""
    placed = placement.place(attempts(spark, d), "image", "p_partkey", "ident", "card", 640.0, 640.0, least_in_image=0.7)
    centre = G.center(F.col("card"))
    return placed.select("image", "p_partkey", (F.col("ident") % 10).alias("attempt"), F.round(centre["x"], 4).alias("x"), F.round(centre["y"], 4).alias("y"))


_CORNER = "sqrt((l.cx {a} l.w / 2 - (r.cx {a} r.w / 2)) ** 2 + (l.cy {b} l.h / 2 - (r.cy {b} r.h / 2)) ** 2)"
_MEAN = " + ".join(_CORNER.format(a=a, b=b) for a, b in (("-", "-"), ("+", "-"), ("+", "+"), ("-", "+")))


@query("one_to_one_assignment", f"""WITH RECURSIVE c AS (SELECT p_partkey, p_brand, ({duck_draw('seen_x')} % 1000)::DOUBLE AS cx, ({duck_draw('seen_y')} % 1000)::DOUBLE AS cy, p_size::DOUBLE AS w, p_size * 1.4::DOUBLE AS h FROM part),
    p AS (SELECT l.p_brand, l.p_partkey AS left_id, r.p_partkey AS right_id, ({_MEAN}) / 4 AS distance FROM c l JOIN c r ON l.p_brand = r.p_brand AND l.p_partkey % 2 = 0 AND r.p_partkey % 2 = 1),
    k AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY distance, left_id, right_id) AS n FROM p WHERE distance < 150),
    g AS (SELECT DISTINCT p_brand, 0::BIGINT AS n, []::BIGINT[] AS ls, []::BIGINT[] AS rs FROM k
        UNION ALL SELECT p_brand, n, CASE WHEN free THEN list_append(ls, left_id) ELSE ls END, CASE WHEN free THEN list_append(rs, right_id) ELSE rs END
        FROM (SELECT g.p_brand, k.n, ls, rs, left_id, right_id, NOT list_contains(ls, left_id) AND NOT list_contains(rs, right_id) AS free FROM g JOIN k ON k.p_brand = g.p_brand AND k.n = g.n + 1) s),
    l AS (SELECT p_brand, arg_max(ls, n) AS ls, arg_max(rs, n) AS rs FROM g GROUP BY p_brand), m AS (SELECT p_brand, unnest(ls) AS left_id, unnest(rs) AS right_id FROM l)
    SELECT m.p_brand, m.left_id, m.right_id, round(p.distance, 6) AS distance FROM m JOIN p ON p.left_id = m.left_id AND p.right_id = m.right_id""")  # fmt: skip
def one_to_one_assignment(spark: SparkSession, d: str) -> DataFrame:
    """Parts with even keys as detections and those with odd keys as tracks, a brand being a frame."""
    at = lambda name: (S.draw(name, F.col("p_partkey")) % 1000).cast("double")
    size = F.col("p_size").cast("double")
    sets = table(spark, d, "part").select("p_partkey", "p_brand", G.rectangle(at("seen_x"), at("seen_y"), size, size * 1.4).alias("points"))
    found = assignment.assigned(sets.where("p_partkey % 2 = 0"), sets.where("p_partkey % 2 = 1"), ["p_brand"], "p_partkey", "points", 150.0)
    return found.select("p_brand", "left_id", "right_id", F.round("distance", 6).alias("distance"))


@query("batch_hard_mining", """WITH b AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, ((row_number() OVER (ORDER BY vec_id) - 1) // 32)::BIGINT AS batch FROM embeddings),
    p AS (SELECT a.batch, a.vec_id, a.label, o.vec_id AS other, a.label = o.label AS same, round(list_cosine_similarity(a.v, o.v), 12) AS s FROM b a JOIN b o ON a.batch = o.batch AND a.vec_id <> o.vec_id)
    SELECT b.batch, b.vec_id, b.label, arg_min(other, [s, other]) FILTER (same) AS positive, round(min(s) FILTER (same), 6) AS positive_score, arg_max(other, [s, -other]) FILTER (NOT same) AS negative, round(max(s) FILTER (NOT same), 6) AS negative_score
    FROM b LEFT JOIN p ON p.batch = b.batch AND p.vec_id = b.vec_id GROUP BY b.batch, b.vec_id, b.label""")  # fmt: skip
def batch_hard_mining(spark: SparkSession, d: str) -> DataFrame:
    """Batches of 32 vectors in order of their ids: the hardest partner of the same label and of another one."""
    points = table(spark, d, "embeddings").select("vec_id", "label", "embedding")
    index = catalog.dense_index(points, "vec_id", "i").select("vec_id", F.floor(F.col("i") / 32).alias("batch"))
    found = mining.hardest(points.join(index, "vec_id"), "batch", "vec_id", "label", "embedding")
    return found.withColumn("positive_score", F.round("positive_score", 6)).withColumn("negative_score", F.round("negative_score", 6))


@query("synthetic_samples")
def synthetic_samples(spark: SparkSession, d: str) -> DataFrame:
    """One image for each part of a split: parts as cards, pages as backgrounds; keypoints as label texts."""
    part = table(spark, d, "part")
    samples = synth.splits_of(part, "p_partkey", 0.1, 0.1).select("split", F.col("p_partkey").alias("i"))
    made = synth.generated(samples, part, table(spark, d, "pages"), "p_partkey", "url", seed=42, most=5, attempts=4, least_in_image=0.7)
    texts = synth.label_texts(made).withColumnRenamed("split", "of_split")
    names = made.select("split", "background", "degrees", F.size("cards").cast("long").alias("n_polygons"), F.format_string("image_%04d", "i").alias("name"))
    return names.join(texts, (names["split"] == texts["of_split"]) & (names["name"] == texts["name"])).select(names["split"], names["name"], "background", "degrees", "n_polygons", "label")
