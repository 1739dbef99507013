"""Queries over polygons and seeded draws."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import geometry as G
from lodestone.functions import sampling as S
from lodestone.functions import text as T
from lodestone.operators import ranges
from lodestone.operators.boxes import overlapping_ids
from lodestone.plans.record import query
from lodestone.plans.relational import duck_draw
from lodestone.session import spread, table



def width() -> Column:
    return F.col("p_size").cast("double")


def height() -> Column:
    return F.col("p_retailprice") / 10


def shift() -> Column:
    return (F.col("p_partkey") % 5).cast("double")


M = ((1.1, 0.2, 3.0), (0.1, 0.9, -2.0), (0.0005, 0.0002, 1.0))


def parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")


def quads(spark: SparkSession, d: str, skewed: bool = True) -> DataFrame:
    """A quad a part, one corner displaced."""
    k = shift() if skewed else F.lit(0.0)
    return parts(spark, d).select("p_partkey", width().alias("w"), height().alias("h"), G.array_of(G.point(0.0, 0.0), G.point(width(), 0.0), G.point(width() + k, height() + k), G.point(0.0, height())).alias("q"))


#: The same vertices in DuckDB: v(i, x, y) for each part.
_DUCK = """p AS (SELECT p_partkey, p_size::DOUBLE AS w, p_retailprice / 10 AS h, ({k})::DOUBLE AS k FROM part),
    v AS (SELECT p_partkey, w, h, i, CASE i WHEN 0 THEN 0 WHEN 1 THEN w WHEN 2 THEN w + k ELSE 0 END AS x, CASE i WHEN 2 THEN h + k WHEN 3 THEN h ELSE 0 END AS y FROM p, (SELECT unnest([0, 1, 2, 3])::BIGINT AS i) n)"""
SKEWED, PLAIN = _DUCK.format(k="p_partkey % 5"), _DUCK.format(k="0")
#: Corners of a skewed quad, as columns.
_CORNERS = "c AS (SELECT p_partkey, 0::DOUBLE AS x0, 0::DOUBLE AS y0, w AS x1, 0::DOUBLE AS y1, w + k AS x2, h + k AS y2, 0::DOUBLE AS x3, h AS y3 FROM p)"


def _exploded(df: DataFrame, points: Column) -> DataFrame:
    return df.select("p_partkey", F.posexplode(points).alias("i", "p")).select("p_partkey", F.col("i").cast("long").alias("i"), F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


@query("homography_points", f"WITH {PLAIN} SELECT p_partkey, i, round((1.1 * x + 0.2 * y + 3.0) / (0.0005 * x + 0.0002 * y + 1.0), 6) AS x, round((0.1 * x + 0.9 * y - 2.0) / (0.0005 * x + 0.0002 * y + 1.0), 6) AS y FROM v")
def homography_points(spark: SparkSession, d: str) -> DataFrame:
    return _exploded(quads(spark, d, False), G.homography(F.col("q"), M))


@query("rotate_points", f"WITH {PLAIN} SELECT p_partkey, i, round(cos(radians(30)) * x + sin(radians(30)) * y + (1 - cos(radians(30))) * w / 2 - sin(radians(30)) * h / 2, 6) AS x, round(-sin(radians(30)) * x + cos(radians(30)) * y + sin(radians(30)) * w / 2 + (1 - cos(radians(30))) * h / 2, 6) AS y FROM v")
def rotate_points(spark: SparkSession, d: str) -> DataFrame:
    return _exploded(quads(spark, d, False), G.rotate(F.col("q"), F.lit(30.0), F.col("w") / 2, F.col("h") / 2))


@query("translate_points", f"WITH {PLAIN} SELECT p_partkey, i, round(x + 1.5, 6) AS x, round(y - w, 6) AS y FROM v")
def translate_points(spark: SparkSession, d: str) -> DataFrame:
    return _exploded(quads(spark, d, False), G.translate(F.col("q"), F.lit(1.5), -F.col("w")))


@query("corner_jitter", f"WITH {PLAIN}, u AS (SELECT *, {duck_draw('corner', '(p_partkey * 4 + i)')} / 4294967296.0 AS u FROM v) SELECT p_partkey, i, round(w / 2 + (x - w / 2) * (0.9 + 0.2 * u), 6) AS x, round(h / 2 + (y - h / 2) * (0.9 + 0.2 * u), 6) AS y FROM u")
def corner_jitter(spark: SparkSession, d: str) -> DataFrame:
    shares = F.array(*[S.uniform("corner", F.col("p_partkey") * 4 + i) for i in range(4)])
    return _exploded(quads(spark, d, False), G.corner_jitter(F.col("q"), shares, 0.1, F.col("w") / 2, F.col("h") / 2))


_AREA = "abs(x0 * y1 - x1 * y0 + x1 * y2 - x2 * y1 + x2 * y3 - x3 * y2 + x3 * y0 - x0 * y3) / 2"


@query("poly_area_shoelace", f"WITH {SKEWED}, {_CORNERS} SELECT p_partkey, round({_AREA}, 6) AS area FROM c")
def poly_area_shoelace(spark: SparkSession, d: str) -> DataFrame:
    return quads(spark, d).select("p_partkey", F.round(G.area(F.col("q")), 6).alias("area"))


@query("poly_center", f"WITH {SKEWED} SELECT p_partkey, round(avg(x), 6) AS x, round(avg(y), 6) AS y FROM v GROUP BY p_partkey")
def poly_center(spark: SparkSession, d: str) -> DataFrame:
    return quads(spark, d).select("p_partkey", G.center(F.col("q")).alias("c")).select("p_partkey", F.round("c.x", 6).alias("x"), F.round("c.y", 6).alias("y"))


@query("poly_expand", f"WITH {SKEWED}, m AS (SELECT p_partkey, avg(x) AS cx, avg(y) AS cy FROM v GROUP BY p_partkey) SELECT v.p_partkey, i, round(x + round_even((x - cx) * 0.05, 0), 6) AS x, round(y + round_even((y - cy) * 0.05, 0), 6) AS y FROM v JOIN m ON v.p_partkey = m.p_partkey")
def poly_expand(spark: SparkSession, d: str) -> DataFrame:
    return _exploded(quads(spark, d), G.expand(F.col("q"), 0.05))


def _turn(a: int, b: int, c: int) -> str:
    return f"((x{b} - x{a}) * (y{c} - y{b}) - (y{b} - y{a}) * (x{c} - x{b}) >= 0)"


_TURNS = [_turn(0, 1, 2), _turn(1, 2, 3), _turn(2, 3, 0), _turn(3, 0, 1)]


@query("poly_is_convex", f"WITH {SKEWED.replace('p_partkey % 5', '-(p_partkey % 5) * 12')}, {_CORNERS} SELECT p_partkey, ({' AND '.join(_TURNS)}) OR NOT ({' OR '.join(_TURNS)}) AS convex FROM c")
def poly_is_convex(spark: SparkSession, d: str) -> DataFrame:
    dent = -shift() * 12
    bent = parts(spark, d).select("p_partkey", G.array_of(G.point(0.0, 0.0), G.point(width(), 0.0), G.point(width() + dent, height() + dent), G.point(0.0, height())).alias("q"))
    return bent.select("p_partkey", G.is_convex(F.col("q")).alias("convex"))


_MID = "sqrt(((x{a} + x{b}) / 2 - (x{c} + x{e}) / 2) ** 2 + ((y{a} + y{b}) / 2 - (y{c} + y{e}) / 2) ** 2)"


@query("quad_flip_upright", f"""WITH {SKEWED.replace('p_retailprice / 10', 'p_retailprice / 50')}, {_CORNERS}, f AS (SELECT *, {_MID.format(a=0, b=1, c=2, e=3)} > {_MID.format(a=1, b=2, c=3, e=0)} AS tall FROM c)
    SELECT p_partkey, tall AS rolled, round(CASE WHEN tall THEN x1 ELSE x0 END, 6) AS x, round(CASE WHEN tall THEN y1 ELSE y0 END, 6) AS y FROM f""")
def quad_flip_upright(spark: SparkSession, d: str) -> DataFrame:
    h = F.col("p_retailprice") / 50
    base = parts(spark, d).select("p_partkey", G.array_of(G.point(0.0, 0.0), G.point(width(), 0.0), G.point(width() + shift(), h + shift()), G.point(0.0, h)).alias("q"))
    return base.select("p_partkey", G.is_tall(F.col("q")).alias("rolled"), G.flip_upright(F.col("q"))[0].alias("p")).select("p_partkey", "rolled", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


@query("edge_angle_deg", "SELECT p_partkey, round(degrees(atan2(p_retailprice - 900, p_size::DOUBLE)), 6) AS angle FROM part")
def edge_angle_deg(spark: SparkSession, d: str) -> DataFrame:
    return parts(spark, d).select("p_partkey", F.round(G.edge_angle(F.lit(0.0), F.lit(900.0), width(), F.col("p_retailprice")), 6).alias("angle"))


@query("line_interpolate", "SELECT p_partkey, round(p_size * 0.25, 6) AS x, round(p_retailprice / 10 * 0.25, 6) AS y FROM part")
def line_interpolate(spark: SparkSession, d: str) -> DataFrame:
    return parts(spark, d).select("p_partkey", G.interpolate(G.point(0.0, 0.0), G.point(width(), height()), 0.25).alias("p")).select("p_partkey", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


@query("points_to_string", f"WITH {SKEWED} SELECT p_partkey, string_agg(x::BIGINT::VARCHAR || ',' || trunc(y)::BIGINT::VARCHAR, ' ' ORDER BY i) AS points FROM v GROUP BY p_partkey")
def points_to_string(spark: SparkSession, d: str) -> DataFrame:
    return quads(spark, d).select("p_partkey", G.to_text(F.col("q")).alias("points"))


@query("label_line_format", f"WITH {PLAIN} SELECT p_partkey, (p_partkey % 3)::VARCHAR || ' ' || string_agg(printf('%.10f', x / 640) || ' ' || printf('%.10f', y / 640), ' ' ORDER BY i) AS line, bool_or(x > 640 OR y > 640) AS outside FROM v GROUP BY p_partkey")
def label_line_format(spark: SparkSession, d: str) -> DataFrame:
    return quads(spark, d, False).select("p_partkey", T.label_line(F.col("p_partkey") % 3, F.col("q")).alias("line"), F.exists("q", lambda p: (p["x"] > 640) | (p["y"] > 640)).alias("outside"))


_WH = "WITH s AS (SELECT p_partkey, (p_size + 20)::DOUBLE AS w, (p_size * 2 + 30)::DOUBLE AS h FROM part)"


def frame_w() -> Column:
    return (F.col("p_size") + 20).cast("double")


def frame_h() -> Column:
    return (F.col("p_size") * 2 + 30).cast("double")



@query("cover_inside_scale", f"{_WH} SELECT p_partkey, round(greatest(640, 480) / least(h, w) * sqrt((480.0 / 640) ** 2 + (640.0 / 640) ** 2), 6) AS cover, round(480 / sqrt(h * h + w * w), 6) AS inside FROM s")
def cover_inside_scale(spark: SparkSession, d: str) -> DataFrame:
    """Scales at which a rotated picture covers an output of 480 x 640, or fits into it at any angle."""
    most = 640.0
    cover = math.hypot(480 / most, 640 / most) * most / F.least(frame_w(), frame_h())
    return parts(spark, d).select("p_partkey", F.round(cover, 6).alias("cover"), F.round(480.0 / F.sqrt(frame_h() * frame_h() + frame_w() * frame_w()), 6).alias("inside"))


@query("crop_box_math", f"{_WH}, r AS (SELECT *, least(192 / h, 128 / w) AS crop, ceil(greatest(0.02 * h, 0.02 * w))::BIGINT AS border FROM s) SELECT p_partkey, trunc(h * crop)::BIGINT AS new_h, trunc(w * crop)::BIGINT AS new_w, (192 - trunc(h * crop)::BIGINT) // 2 AS top, (128 - trunc(w * crop)::BIGINT) // 2 AS left_edge, border FROM r")
def crop_box_math(spark: SparkSession, d: str) -> DataFrame:
    r = F.least(192.0 / frame_h(), 128.0 / frame_w())
    new_h, new_w = (frame_h() * r).cast("long"), (frame_w() * r).cast("long")
    return parts(spark, d).select("p_partkey", new_h.alias("new_h"), new_w.alias("new_w"), F.floor((192 - new_h) / 2).alias("top"), F.floor((128 - new_w) / 2).alias("left_edge"), F.ceil(F.greatest(0.02 * frame_h(), 0.02 * frame_w())).alias("border"))


@query("rotate_bounds", f"{_WH} SELECT p_partkey, trunc(h * abs(sin(radians(35))) + w * abs(cos(radians(35))))::BIGINT AS new_w, trunc(h * abs(cos(radians(35))) + w * abs(sin(radians(35))))::BIGINT AS new_h FROM s")
def rotate_bounds(spark: SparkSession, d: str) -> DataFrame:
    s, c = abs(math.sin(math.radians(35))), abs(math.cos(math.radians(35)))
    return parts(spark, d).select("p_partkey", (frame_h() * s + frame_w() * c).cast("long").alias("new_w"), (frame_h() * c + frame_w() * s).cast("long").alias("new_h"))


@query("dewarp_dst_points", f"{_WH} SELECT p_partkey, round(-0.025 * w, 6) AS left_edge, round(-0.025 * h, 6) AS top, round(1.025 * w, 6) AS right_edge, round(1.025 * h, 6) AS bottom FROM s")
def dewarp_dst_points(spark: SparkSession, d: str) -> DataFrame:
    """The target rectangle, 5 % larger than the picture around its centre."""
    grown = lambda v: (1.05 * v - 0.025 * v)
    return parts(spark, d).select("p_partkey", F.round(-0.025 * frame_w(), 6).alias("left_edge"), F.round(-0.025 * frame_h(), 6).alias("top"), F.round(grown(frame_w()), 6).alias("right_edge"), F.round(grown(frame_h()), 6).alias("bottom"))


@query("card_keypoints", f"{_WH}, m AS (SELECT *, 0.03 * greatest(w, h) AS m FROM s) SELECT p_partkey, round(m, 6) AS top_x0, round(m, 6) AS top_y0, round(w - m, 6) AS top_x1, round(h * 0.5 - m, 6) AS top_y1, round(h * 0.5 + m, 6) AS bottom_y0, round(w * h - 0.2 * w * 0.5 * h, 6) AS u_area FROM m")
def card_keypoints(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of the two halves of a card with a margin, and the area of the card without a notch from below."""
    m = 0.03 * F.greatest(frame_w(), frame_h())
    z = F.lit(0.0)
    outline = [(z, z), (frame_w(), z), (frame_w(), frame_h()), (0.6 * frame_w(), frame_h()), (0.6 * frame_w(), 0.5 * frame_h()), (0.4 * frame_w(), 0.5 * frame_h()), (0.4 * frame_w(), frame_h()), (z, frame_h())]
    u = G.array_of(*[G.point(x, y) for x, y in outline])
    return parts(spark, d).select("p_partkey", u.alias("u"), m.alias("m"), frame_w().alias("w"), frame_h().alias("h")).select("p_partkey", F.round("m", 6).alias("top_x0"), F.round("m", 6).alias("top_y0"), F.round(F.expr("w - m"), 6).alias("top_x1"), F.round(F.expr("h * 0.5D - m"), 6).alias("top_y1"), F.round(F.expr("h * 0.5D + m"), 6).alias("bottom_y0"), F.round(G.area(F.col("u")), 6).alias("u_area"))


@query("lerp_color", "SELECT event_id, trunc(255 * (1 - least(1, greatest(0, value / 100))) + 16 * least(1, greatest(0, value / 100)))::BIGINT AS red FROM events")
def lerp_color(spark: SparkSession, d: str) -> DataFrame:
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("value") / 100))
    return table(spark, d, "events").select("event_id", (255 * (1 - t) + 16 * t).cast("long").alias("red"))


@query("bbox_overlap_join", "WITH b AS (SELECT p_partkey, p_size::DOUBLE AS x0, p_size + 3.0 AS x1, p_retailprice AS y0, p_retailprice + 20 AS y1 FROM part) SELECT a.p_partkey AS id, b.p_partkey AS other_id FROM b a JOIN b ON a.p_partkey < b.p_partkey AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1")
def bbox_overlap_join(spark: SparkSession, d: str) -> DataFrame:
    """Distinct boxes meet in the grid cells that they touch; their copies are paired at the end."""
    box = F.struct(width().alias("x0"), (width() + 3.0).alias("x1"), F.col("p_retailprice").alias("y0"), (F.col("p_retailprice") + 20.0).alias("y1"))
    return overlapping_ids(parts(spark, d).select("p_partkey", box.alias("box")), "p_partkey", "box")


_FLAG = duck_draw("swap")


@query("bernoulli_swap", f"SELECT p_partkey, {_FLAG} / 4294967296.0::DOUBLE < 0.05 AS swapped FROM part")
def bernoulli_swap(spark: SparkSession, d: str) -> DataFrame:
    return parts(spark, d).select("p_partkey", S.bernoulli("swap", F.col("p_partkey"), 0.05).alias("swapped"))


@query("forced_swap", f"SELECT p_partkey, {_FLAG} / 4294967296.0::DOUBLE < CASE p_partkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 ELSE 0.2 END AS swapped FROM part")
def forced_swap(spark: SparkSession, d: str) -> DataFrame:
    """A third of the pairs is told to swap, a third not to, the rest swaps by chance."""
    flag = F.when(F.col("p_partkey") % 3 == 0, True).when(F.col("p_partkey") % 3 == 1, False)
    return parts(spark, d).select("p_partkey", S.bernoulli_of("swap", F.col("p_partkey"), S.forced(flag, 0.2)).alias("swapped"))


@query("hash_choice", f"SELECT p_partkey, ['none', 'blur', 'noise', 'tint'][({duck_draw('choice')} % 4 + 1)::INT] AS choice FROM part")
def hash_choice(spark: SparkSession, d: str) -> DataFrame:
    return parts(spark, d).select("p_partkey", S.choice("choice", F.col("p_partkey"), F.array(*map(F.lit, ("none", "blur", "noise", "tint")))).alias("choice"))


@query("shuffled_order", f"SELECT p_brand, p_partkey, (row_number() OVER (PARTITION BY p_brand ORDER BY {duck_draw('shuffle')}, p_partkey))::BIGINT AS place FROM part")
def shuffled_order(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_brand", "p_partkey", S.draw("shuffle", F.col("p_partkey")).alias("draw"))
    return ranges.placed(rows, "p_brand", ["draw", "p_partkey"], "place").select("p_brand", "p_partkey", "place")


@query("seeded_sample", f"SELECT p_partkey FROM part ORDER BY {duck_draw('sample')}, p_partkey LIMIT 100")
def seeded_sample(spark: SparkSession, d: str) -> DataFrame:
    return parts(spark, d).orderBy(S.draw("sample", F.col("p_partkey")), "p_partkey").limit(100).select("p_partkey")


@query("weighted_source_mix", f"SELECT p_partkey, CASE WHEN {duck_draw('source')} % 2 = 0 THEN 'coco' ELSE 'ilsvrc' END AS source, {duck_draw('empty')} / 4294967296.0::DOUBLE < 0.1 AS background_only FROM part")
def weighted_source_mix(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("p_partkey")
    return parts(spark, d).select("p_partkey", F.when(S.draw("source", key) % 2 == 0, "coco").otherwise("ilsvrc").alias("source"), S.bernoulli("empty", key, 0.1).alias("background_only"))


@query("explode_random_count", f"SELECT p_partkey, unnest(range(1, 2 + {duck_draw('count')} % 9))::BIGINT AS card FROM part")
def explode_random_count(spark: SparkSession, d: str) -> DataFrame:
    return parts(spark, d).select("p_partkey", F.explode(F.sequence(F.lit(1), 1 + S.draw("count", F.col("p_partkey")) % 9)).alias("card"))


@query("log_uniform_sample", f"SELECT p_partkey, round(exp(ln(0.01::DOUBLE) + {duck_draw('area')} / 4294967296.0::DOUBLE * (ln(0.9::DOUBLE) - ln(0.01::DOUBLE))), 6) AS area FROM part")
def log_uniform_sample(spark: SparkSession, d: str) -> DataFrame:
    return parts(spark, d).select("p_partkey", F.round(S.log_uniform("area", F.col("p_partkey"), 0.01, 0.9), 6).alias("area"))


_ATTEMPT = duck_draw("attempt", "(p_partkey * 10 + a)")


@query("rejection_first_accept", f"WITH c AS (SELECT p_partkey, a, {_ATTEMPT} / 4294967296.0::DOUBLE AS u FROM part, (SELECT unnest(range(1, 11)) AS a) n) SELECT p_partkey, min(CASE WHEN u < 0.15 THEN a END)::BIGINT AS attempt FROM c GROUP BY p_partkey")
def rejection_first_accept(spark: SparkSession, d: str) -> DataFrame:
    tries = F.array(*[F.when(S.uniform("attempt", F.col("p_partkey") * 10 + a) < 0.15, F.lit(a)) for a in range(1, 11)])
    return parts(spark, d).select("p_partkey", F.array_min(tries).cast("long").alias("attempt"))


@query("orient_quad")
def orient_quad(spark: SparkSession, d: str) -> DataFrame:
    import pandas as pd

    from lodestone.operators.synth import oriented_quad

    def run(parts_):
        for part in parts_:
            rows = [(k, *oriented_quad([(p["x"], p["y"]) for p in q]).ravel().astype(int).tolist()) for k, q in zip(part["p_partkey"], part["q"])]
            yield pd.DataFrame(rows, columns=["p_partkey", *(f"{c}{i}" for i in range(4) for c in "xy")])

    return spread(quads(spark, d).select("p_partkey", "q")).mapInPandas(run, "p_partkey long, " + ", ".join(f"{c}{i} long" for i in range(4) for c in "xy"))


_GH = "((x0 - x1 + x2 - x3) * (y3 - y2) - (x3 - x2) * (y0 - y1 + y2 - y3)) / det AS g, ((x1 - x2) * (y0 - y1 + y2 - y3) - (x0 - x1 + x2 - x3) * (y1 - y2)) / det AS h"
_ADJOINT = ("(e - f * h) * 128", "(c * h - b) * 128", "(b * f - c * e) * 128", "(f * g - d) * 192", "(a - c * g) * 192", "(c * d - a * f) * 192", "d * h - e * g", "b * g - a * h", "a * e - b * d")


@query("perspective_matrix", f"""WITH {SKEWED}, {_CORNERS}, n AS (SELECT *, (x1 - x2) * (y3 - y2) - (x3 - x2) * (y1 - y2) AS det FROM c WHERE x1 > 0 AND y3 > 0), k AS (SELECT *, {_GH} FROM n),
    u AS (SELECT p_partkey, g, h, x1 - x0 + g * x1 AS a, x3 - x0 + h * x3 AS b, x0 AS c, y1 - y0 + g * y1 AS d, y3 - y0 + h * y3 AS e, y0 AS f FROM k)
    SELECT p_partkey, {", ".join(f"round(({v}) / (a * e - b * d), 6) AS m{i}" for i, v in enumerate(_ADJOINT))} FROM u""")  # fmt: skip
def perspective(spark: SparkSession, d: str) -> DataFrame:
    """Of each quad: the matrix that takes it to a rectangle of 128 x 192."""
    m = quads(spark, d).where("w > 0 and h > 0").select("p_partkey", G.homography_to_rectangle(F.col("q"), 128.0, 192.0).alias("m"))
    return m.select("p_partkey", *[F.round(F.col("m")[i], 6).alias(f"m{i}") for i in range(9)])
