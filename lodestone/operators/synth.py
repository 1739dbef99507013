"""Synthetic detection samples: split sizes, seeded placement by rejection, label files."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import geometry as G
from lodestone.functions import sampling as S
from lodestone.functions import text as T
from lodestone.operators import catalog, placement
from lodestone.session import spread, staged


def splits(spark: SparkSession, train: int, val_ratio: float, test_ratio: float) -> DataFrame:
    """(split, i): val and test are made in addition to train."""
    sizes = {"train": train, "val": int(train * val_ratio), "test": int(train * test_ratio)}
    out = None
    for name, n in sizes.items():
        rows = spark.range(n).select(F.lit(name).alias("split"), F.col("id").alias("i"))
        out = rows if out is None else out.unionByName(rows)
    return out


def splits_of(keys: DataFrame, ident: str, val_ratio: float, test_ratio: float, seed: str = S.SEED) -> DataFrame:
    """(split, ident): all keys are train samples; val and test samples are made in addition, from that share of the keys
    each (rounded down), those with the lowest draws. Keys are distinct. Draws are ranked by ranges, not in one task."""
    out = keys.select(F.lit("train").alias("split"), ident)
    for name, ratio in (("val", val_ratio), ("test", test_ratio)):
        drawn = keys.select(F.struct(S.draw(f"split_{name}", F.col(ident), seed).alias("draw"), F.col(ident)).alias("_place"))
        size = F.broadcast(keys.agg(F.floor(F.count(F.lit(1)) * F.lit(ratio)).alias("_size")))  # one row
        ranked = catalog.dense_index(drawn, "_place", "_i").crossJoin(size).where("_i < _size")
        out = out.unionByName(ranked.select(F.lit(name).alias("split"), F.col(f"_place.{ident}").alias(ident)))
    return out


def clipped_area(a: np.ndarray, b: np.ndarray) -> float:
    """Area that two convex polygons share; both in anticlockwise order."""
    out = list(a)
    for k in range(len(b)):
        p, q = b[k], b[(k + 1) % len(b)]
        side = lambda r, p=p, q=q: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
        kept = []
        for i, r in enumerate(out):
            s = out[i - 1]
            fr, fs = side(r), side(s)
            if (fr >= 0) != (fs >= 0):
                kept.append(s + (r - s) * (fs / (fs - fr)))
            if fr >= 0:
                kept.append(r)
        out = kept
        if not out:
            return 0.0
    return polygon_area(np.array(out))


def polygon_area(p: np.ndarray) -> float:
    x, y = p[:, 0], p[:, 1]
    return float(abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2)


def perspective_matrix(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The 3 x 3 homography that takes four points to four others."""
    rows, right = [], []
    for (x, y), (u, v) in zip(source, target):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        right += [u, v]
    return np.append(np.linalg.solve(np.array(rows, float), np.array(right, float)), 1).reshape(3, 3)


def convex_hull(p: np.ndarray) -> np.ndarray:
    """Anticlockwise, by monotone chains."""
    p = np.unique(p, axis=0)

    def turn(a, b):
        return a[0] * b[1] - a[1] * b[0]

    def chain(points):
        out = []
        for q in points:
            while len(out) > 1 and turn(out[-1] - out[-2], q - out[-2]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(chain(list(p)) + chain(list(p[::-1]))) if len(p) > 2 else p


def oriented_quad(p: np.ndarray) -> np.ndarray:
    """A polygon's smallest enclosing rectangle, rolled so that edge 0 is the one that a ray from the hull's centre
    through the polygon's own centre hits first."""
    hull = convex_hull(np.asarray(p, float))
    best = None
    for k in range(len(hull)):
        e = hull[(k + 1) % len(hull)] - hull[k]
        e = e / (np.hypot(*e) or 1.0)
        axes = np.array([e, [-e[1], e[0]]])
        flat = hull @ axes.T
        low, high = flat.min(axis=0), flat.max(axis=0)
        size = np.prod(high - low)
        if best is None or size < best[0] - 1e-9:
            best = (size, np.array([[low[0], low[1]], [high[0], low[1]], [high[0], high[1]], [low[0], high[1]]]) @ axes)
    quad = best[1]
    to = np.asarray(p, float).mean(axis=0) - hull.mean(axis=0)
    middle = quad.mean(axis=0)
    edges = [(quad[k] + quad[(k + 1) % 4]) / 2 - middle for k in range(4)]
    first = int(np.argmax([np.dot(e, to) / (np.hypot(*e) or 1.0) for e in edges]))
    return np.roll(quad, -first, axis=0)


def attempts_of(samples: DataFrame, seed: int, least: int, most: int, size: float, attempts: int, aspect: float = 1.4, areas: tuple[float, float] = (0.01, 0.3)) -> DataFrame:
    """(image, card, ident, points): for each sample between ``least`` and ``most`` - 1 cards, and for each card drawn
    places, turns and sizes (shares of the image's area, evenly on a logarithmic scale) to be tried in order."""
    tag = str(seed)
    named = F.concat_ws("-", "split", F.col("i").cast("string"))
    cards = spread(samples).select(F.struct("split", "i").alias("image"), F.explode(F.sequence(F.lit(1), least + S.draw("cards", named, tag) % (most - least))).alias("card"))
    tries = cards.select("image", "card", F.explode(F.sequence(F.lit(1), F.lit(attempts))).alias("attempt"))
    tries = tries.select("image", "card", F.struct("image", "card", "attempt").alias("ident"), F.concat_ws("-", F.col("image.split"), *[F.col(c).cast("string") for c in ("image.i", "card", "attempt")]).alias("_n"))
    u = lambda name: S.uniform(name, F.col("_n"), tag)
    drawn = tries.select("image", "card", "ident", F.sqrt(S.log_uniform("area", F.col("_n"), *areas, tag) * size * size / aspect).alias("w"), (u("turn") * 2 * math.pi).alias("t"), (u("x") * size).alias("cx"), (u("y") * size).alias("cy"))
    corner = lambda a, b: G.point(F.col("cx") + F.col("w") / 2 * (a * F.cos("t") - b * aspect * F.sin("t")), F.col("cy") + F.col("w") / 2 * (a * F.sin("t") + b * aspect * F.cos("t")))
    return drawn.select("image", "card", "ident", G.array_of(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1)).alias("points"))


def placed(samples: DataFrame, seed: int, least: int = 1, most: int = 10, size: float = 640.0, attempts: int = 10, visible: float = 0.7) -> DataFrame:
    """samples: (split, i). Gives (split, i, label, points): cards placed at random in an image; a candidate is rejected if
    too little of it lies within the image, or if it hides too much of a card placed before (see placement). Draws come
    from the seed and the sample, so they are alike however rows are dealt out; samples are distinct."""
    tried = attempts_of(samples, seed, least, most, size, attempts)
    found = placement.place(tried, "image", "card", "ident", "points", size, size, least_in_image=visible)
    return found.select("image.split", "image.i", F.lit(0).alias("label"), "points")


#: Of the boxes in a card's halves, how far they stay from its edges and middle, as a share of its longer side.
MARGIN = 0.03


def keypoints(quad: Column, aspect: float = 1.4) -> Column:
    """Array of (label, points) of a card that lies in a quad: the card (0), the box of its top half (1), and that of its
    bottom half (2), seen in the quad's perspective."""
    m = MARGIN * max(1.0, aspect)
    box = lambda y0, y1: G.array_of(*[G.point(x, y / aspect) for x, y in ((m, y0), (1 - m, y0), (1 - m, y1), (m, y1))])
    halves = [box(m, aspect / 2 - m), box(aspect / 2 + m, aspect - m)]
    labelled = lambda i, points: F.struct(F.lit(i).alias("label"), points.alias("points"))
    return G.let(G.square_to_quad(quad), lambda h: F.array(labelled(0, quad), *[labelled(i + 1, G.mapped(b, h)) for i, b in enumerate(halves)]))


def picked(rows: DataFrame, drawn: Column, choices: DataFrame, ident: str, name: str) -> DataFrame:
    """rows with one of the distinct idents of ``choices`` in column ``name``, each as likely: that with the number that
    ``drawn``, a whole number, leaves modulo their count."""
    index = catalog.dense_index(choices, ident, "_i").withColumnRenamed(ident, name)
    size = F.broadcast(index.agg(F.count(F.lit(1)).alias("_size")))  # one row
    return rows.crossJoin(size).withColumn("_i", F.when(F.col("_size") > 0, drawn % F.col("_size"))).join(index, "_i", "left").drop("_i", "_size")


def generated(samples: DataFrame, cards: DataFrame, backgrounds: DataFrame, card: str, background: str, seed: int, background_only: float = 0.1, size: float = 640.0, **placing) -> DataFrame:
    """samples: (split, i), distinct. One row a sample: its background, by how many degrees that is turned before it is
    cropped, and ``cards``: an array of (card, label, points), three for each card placed, in the order of placement;
    empty for the share of samples that are background only. All draws come from the seed and the sample."""
    named = F.concat_ws("-", "split", F.col("i").cast("string"))
    own = lambda name: S.draw(name, named, str(seed))
    base = picked(samples.select("split", "i", (own("turn_of_background") % 360).alias("degrees"), S.bernoulli("empty", named, background_only, str(seed)).alias("empty"), own("background").alias("_drawn")), F.col("_drawn"), backgrounds, background, "background").drop("_drawn")
    base = staged(base, "backgrounds")
    tried = attempts_of(base.where("not empty").select("split", "i"), seed, placing.pop("least", 1), placing.pop("most", 10), size, placing.pop("attempts", 10))
    found = placement.place(tried, "image", "card", "ident", "points", size, size, **placing)
    of_card = S.draw("which_card", F.concat_ws("-", "image.split", F.col("image.i").cast("string"), F.col("card").cast("string")), str(seed))
    found = picked(found.select("image", F.col("card").alias("place"), "points", of_card.alias("_drawn")), F.col("_drawn"), cards, card, "card_id")
    each = found.select("image", F.explode(F.transform(keypoints(F.col("points")), lambda k: F.struct(F.col("place").alias("place"), k["label"].alias("label"), F.col("card_id").alias("card"), k["points"].alias("points")))).alias("k"))
    of_image = each.groupBy("image.split", "image.i").agg(F.array_sort(F.collect_list("k"), lambda a, b: (a["place"] * 3 + a["label"] - b["place"] * 3 - b["label"]).cast("int")).alias("k"))
    none = F.array().cast(dict(of_image.dtypes)["k"])
    met = base.join(of_image, ["split", "i"], "left").withColumn("k", F.coalesce("k", none))
    return met.select("split", "i", "background", "degrees", F.transform("k", lambda k: F.struct(k["card"].alias("card"), k["label"].alias("label"), k["points"].alias("points"))).alias("cards"))


def label_texts(made: DataFrame, size: float = 640.0) -> DataFrame:
    """(split, name, label) of generated samples: a file's text, one line a polygon, empty for a background alone."""
    lines = F.array_join(F.transform("cards", lambda c: T.label_line(c["label"], c["points"], size)), "\n")
    return made.select("split", T.numbered("image", F.col("i")).alias("name"), lines.alias("label"))


def write_labels(rows: DataFrame, path: str, size: float = 640.0) -> None:
    """One text line a polygon, below a folder for each split; fails where the folder exists."""
    rows.select("split", T.label_line(F.col("label"), F.col("points"), size).alias("value")).write.partitionBy("split").mode("errorifexists").text(path)
