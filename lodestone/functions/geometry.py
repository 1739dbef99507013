"""Column functions over polygons: arrays of structs (x, y) of doubles, vertices in order."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def point(x: Column | float, y: Column | float) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.struct(lit(x).cast("double").alias("x"), lit(y).cast("double").alias("y"))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value computed once however often it is used: Spark shares no results within lambdas."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _each(points: Column, of: Callable[[Column], Column]) -> Column:
    return F.transform(points, of)


def translate(points: Column, dx: Column, dy: Column) -> Column:
    return _each(points, lambda p: point(p["x"] + dx, p["y"] + dy))


def homography(points: Column, m: Sequence[Sequence[float]]) -> Column:
    """Homogeneous 3 x 3 transform; null coordinates where a point goes to infinity."""

    def moved(p: Column) -> Column:
        row = [p["x"] * r[0] + p["y"] * r[1] + r[2] for r in m]
        w = F.nullif(row[2], F.lit(0.0))
        return point(row[0] / w, row[1] / w)

    return _each(points, moved)


def square_to_quad(quad: Column) -> Column:
    """The 3 x 3 matrix, row by row with 1 at the end, that takes the corners (0, 0), (1, 0), (1, 1), (0, 1) to those of a
    quad; null for quads whose last three corners lie on one line."""

    def solved(q: Column) -> Column:
        (x0, y0), (x1, y1), (x2, y2), (x3, y3) = [(q[i]["x"], q[i]["y"]) for i in range(4)]
        ax, bx, sx, ay, by, sy = x1 - x2, x3 - x2, x0 - x1 + x2 - x3, y1 - y2, y3 - y2, y0 - y1 + y2 - y3
        den = F.nullif(ax * by - bx * ay, F.lit(0.0))
        gh = F.struct(((sx * by - bx * sy) / den).alias("g"), ((ax * sy - sx * ay) / den).alias("h"))
        rows = lambda k: F.array(x1 - x0 + k["g"] * x1, x3 - x0 + k["h"] * x3, x0, y1 - y0 + k["g"] * y1, y3 - y0 + k["h"] * y3, y0, k["g"], k["h"], F.lit(1.0))
        return let(gh, lambda k: F.when(k["g"].isNotNull(), rows(k)))

    return let(quad, solved)


def mapped(points: Column, m: Column) -> Column:
    """Points under a matrix that is a column: nine numbers, row by row."""

    def moved(p: Column) -> Column:
        row = [p["x"] * m[3 * i] + p["y"] * m[3 * i + 1] + m[3 * i + 2] for i in range(3)]
        return point(row[0] / F.nullif(row[2], F.lit(0.0)), row[1] / F.nullif(row[2], F.lit(0.0)))

    return _each(points, moved)


def homography_to_rectangle(quad: Column, width: float, height: float) -> Column:
    """The 3 x 3 matrix, row by row with 1 at the end, that takes a quad's corners to (0, 0), (width, 0), (width, height),
    (0, height). In closed form: the matrix from the unit square to the quad, inverted and scaled. Null for quads whose
    last three corners, or first two and last, lie on one line."""

    def solved(q: Column) -> Column:
        (x0, y0), (x1, y1), (x2, y2), (x3, y3) = [(q[i]["x"], q[i]["y"]) for i in range(4)]
        ax, bx, sx, ay, by, sy = x1 - x2, x3 - x2, x0 - x1 + x2 - x3, y1 - y2, y3 - y2, y0 - y1 + y2 - y3
        den = F.nullif(ax * by - bx * ay, F.lit(0.0))
        gh = F.struct(((sx * by - bx * sy) / den).alias("g"), ((ax * sy - sx * ay) / den).alias("h"))

        def inverted(k: Column) -> Column:
            g, h = k["g"], k["h"]
            a, b, c, d, e, f = x1 - x0 + g * x1, x3 - x0 + h * x3, x0, y1 - y0 + g * y1, y3 - y0 + h * y3, y0
            last = F.nullif(a * e - b * d, F.lit(0.0))
            rows = [(e - f * h, width), (c * h - b, width), (b * f - c * e, width), (f * g - d, height), (a - c * g, height), (c * d - a * f, height), (d * h - e * g, 1.0), (b * g - a * h, 1.0)]
            return F.when(last.isNotNull(), F.array(*[v * scale / last for v, scale in rows], F.lit(1.0)))

        return let(gh, inverted)

    return let(quad, solved)


def rotate(points: Column, degrees: Column, cx: Column, cy: Column, scale: float = 1.0) -> Column:
    """Positive angles turn anticlockwise on an image, whose y axis points down."""
    a, b = scale * F.cos(F.radians(degrees)), scale * F.sin(F.radians(degrees))
    return _each(points, lambda p: point(a * p["x"] + b * p["y"] + (1 - a) * cx - b * cy, -b * p["x"] + a * p["y"] + b * cx + (1 - a) * cy))


def corner_jitter(points: Column, shares: Column, ratio: float, cx: Column, cy: Column) -> Column:
    """Each corner's distance from the centre times a factor in 1 - ratio .. 1 + ratio, from a number in 0 .. 1."""
    return F.zip_with(points, shares, lambda p, u: point(cx + (p["x"] - cx) * (1 - ratio + 2 * ratio * u), cy + (p["y"] - cy) * (1 - ratio + 2 * ratio * u)))


def _cyclic(points: Column, term: Callable[[Column, Column], Column]) -> Column:
    """Sum of a term over edges."""

    def total(held: Column) -> Column:
        terms = F.transform(held, lambda p, i: term(p, F.element_at(held, (i + 1) % F.size(held) + 1)))
        return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)

    return let(points, total)


def area(points: Column) -> Column:
    return F.abs(_cyclic(points, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])) / 2


def center(points: Column) -> Column:
    n = F.size(points)
    total = lambda c: F.aggregate(points, F.lit(0.0), lambda s, p: s + p[c])
    return point(total("x") / n, total("y") / n)


def expand(points: Column, ratio: float) -> Column:
    """Moves vertices from the centre by a ratio of their distance, rounded to even at halves."""
    c = center(points)
    return _each(points, lambda p: point(p["x"] + F.bround((p["x"] - c["x"]) * ratio), p["y"] + F.bround((p["y"] - c["y"]) * ratio)))


def is_convex(points: Column) -> Column:
    """Whether all turns have one sign (0 counts as positive); null for fewer than three points."""
    n = F.size(points)

    def turn(p: Column, i: Column) -> Column:
        q, r = F.element_at(points, (i + 1) % n + 1), F.element_at(points, (i + 2) % n + 1)
        return ((q["x"] - p["x"]) * (r["y"] - q["y"]) - (q["y"] - p["y"]) * (r["x"] - q["x"])) >= 0

    turns = F.transform(points, turn)
    return F.when(n >= 3, F.forall(turns, lambda t: t) | F.forall(turns, lambda t: ~t))


def edge_length(points: Column, i: int, j: int) -> Column:
    """Between vertices i and j, from 0."""
    p, q = points[i], points[j]
    return F.sqrt((p["x"] - q["x"]) ** 2 + (p["y"] - q["y"]) ** 2)


def middle_distance(points: Column, a: tuple[int, int], b: tuple[int, int]) -> Column:
    """Between the midpoints of two edges."""
    mid = lambda e, c: (points[e[0]][c] + points[e[1]][c]) / 2
    return F.sqrt((mid(a, "x") - mid(b, "x")) ** 2 + (mid(a, "y") - mid(b, "y")) ** 2)


def is_tall(quad: Column) -> Column:
    """Whether the middles of the first and third edge lie further apart than those of the second and fourth."""
    return middle_distance(quad, (0, 1), (2, 3)) > middle_distance(quad, (1, 2), (3, 0))


def flip_upright(quad: Column) -> Column:
    """Corners in the order top left, bottom left, bottom right, top right: a tall quad starts at its second corner."""
    return F.when(is_tall(quad), F.array(quad[1], quad[2], quad[3], quad[0])).otherwise(quad)


def edge_angle(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.degrees(F.atan2(y1 - y0, x1 - x0))


def interpolate(p: Column, q: Column, t: float) -> Column:
    return point(p["x"] + (q["x"] - p["x"]) * t, p["y"] + (q["y"] - p["y"]) * t)


def to_text(points: Column) -> Column:
    """'x,y x,y ...' of whole coordinates."""
    return F.array_join(F.transform(points, lambda p: F.concat_ws(",", p["x"].cast("long").cast("string"), p["y"].cast("long").cast("string"))), " ")


def array_of(*points: Column) -> Column:
    return F.array(*points)


def mean_distance(a: Column, b: Column) -> Column:
    """Between two point sets of one size: the mean over their points, in order."""
    each = F.zip_with(a, b, lambda p, q: F.sqrt((p["x"] - q["x"]) ** 2 + (p["y"] - q["y"]) ** 2))
    return F.aggregate(each, F.lit(0.0), lambda s, x: s + x) / F.size(a)


def box_area(box: Column) -> Column:
    return F.greatest(F.lit(0.0), box["x1"] - box["x0"]) * F.greatest(F.lit(0.0), box["y1"] - box["y0"])


def box_overlap(a: Column, b: Column) -> Column:
    side = lambda low, high: F.greatest(F.lit(0.0), F.least(a[high], b[high]) - F.greatest(a[low], b[low]))
    return side("x0", "x1") * side("y0", "y1")


def box_holds(a: Column, b: Column) -> Column:
    return (a["x0"] <= b["x0"]) & (a["y0"] <= b["y0"]) & (a["x1"] >= b["x1"]) & (a["y1"] >= b["y1"])


def signed_area(points: Column) -> Column:
    """Positive for vertices in anticlockwise order on axes that point right and up."""
    return _cyclic(points, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]) / 2


def anticlockwise(points: Column) -> Column:
    return F.when(signed_area(points) < 0, F.reverse(points)).otherwise(points)


def edges(points: Column) -> Column:
    """Array of structs (p, q), from each vertex to the next."""
    return let(points, lambda held: F.transform(held, lambda p, i: F.struct(p.alias("p"), F.element_at(held, (i + 1) % F.size(held) + 1).alias("q"))))


def _side(edge: Column, r: Column) -> Column:
    """Positive where r lies to the left of the edge's line, 0 on it."""
    p, q = edge["p"], edge["q"]
    return (q["x"] - p["x"]) * (r["y"] - p["y"]) - (q["y"] - p["y"]) * (r["x"] - p["x"])


def clipped(points: Column, edge: Column) -> Column:
    """What of a polygon lies to the left of an edge's line: a vertex that does stays, and where two neighbours lie on
    different sides the point between them on the line is added."""

    sided = F.transform(points, lambda r: F.struct(r["x"].alias("x"), r["y"].alias("y"), _side(edge, r).alias("side")))

    def met(held: Column) -> Column:
        def kept(r: Column, i: Column) -> Column:
            s = F.element_at(held, F.when(i == 0, F.lit(-1)).otherwise(i))
            share = s["side"] / (s["side"] - r["side"])
            cut = F.when((r["side"] >= 0) != (s["side"] >= 0), point(s["x"] + (r["x"] - s["x"]) * share, s["y"] + (r["y"] - s["y"]) * share))
            return F.array_compact(F.array(cut, F.when(r["side"] >= 0, point(r["x"], r["y"]))))

        return F.flatten(F.transform(held, kept))

    return let(sided, met)


def intersection(a: Column, b: Column) -> Column:
    """What polygon a shares with a convex polygon b: a is clipped by b's edges one after another. For a convex a the result
    is exact; empty where they are apart, and without area where they only touch."""
    return F.aggregate(edges(anticlockwise(b)), F.transform(a, lambda p: point(p["x"], p["y"])), clipped)


def shared_area(a: Column, b: Column) -> Column:
    return area(intersection(a, b))


def difference_area(a: Column, b: Column) -> Column:
    """Of what of a lies outside b; both convex."""
    return area(a) - shared_area(a, b)


def holds(a: Column, b: Column) -> Column:
    """Whether the convex polygon a contains all of b; edges may touch."""
    return F.forall(edges(anticlockwise(a)), lambda e: F.forall(b, lambda r: _side(e, r) >= 0))


def bounds(points: Column) -> Column:
    """The box (x0, y0, x1, y1) around a polygon."""
    of = lambda c: F.transform(points, lambda p: p[c])
    return F.struct(F.array_min(of("x")).alias("x0"), F.array_min(of("y")).alias("y0"), F.array_max(of("x")).alias("x1"), F.array_max(of("y")).alias("y1"))


def rectangle(cx: Column, cy: Column, w: Column, h: Column) -> Column:
    return array_of(point(cx - w / 2, cy - h / 2), point(cx + w / 2, cy - h / 2), point(cx + w / 2, cy + h / 2), point(cx - w / 2, cy + h / 2))
