import math
import random

import numpy as np
import pytest
from lodestone.functions import geometry as G
from lodestone.operators import assignment, boxes, mining, placement, synth
from lodestone.operators.boxes import overlapping
from pyspark.sql import functions as F

POINTS = "array<struct<x:double,y:double>>"


def pts(*p):
    return [{"x": float(x), "y": float(y)} for x, y in p]


def turned(cx, cy, w, h, angle):
    c, s = math.cos(angle), math.sin(angle)
    return [(cx + a * w / 2 * c - b * h / 2 * s, cy + a * w / 2 * s + b * h / 2 * c) for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1))]


def shared(a, b):
    return synth.clipped_area(np.array(a), np.array(b))


SQUARE = ((0, 0), (4, 0), (4, 4), (0, 4))


@pytest.mark.parametrize(
    ("other", "area", "holds", "held"),
    [
        (((1, 1), (2, 1), (2, 2), (1, 2)), 1, True, False),  # nested
        (((0, 0), (2, 0), (2, 2), (0, 2)), 4, True, False),  # nested, touching
        (SQUARE, 16, True, True),
        (tuple(reversed(SQUARE)), 16, True, True),
        (((4, 0), (6, 0), (6, 4), (4, 4)), 0, False, False),  # touching along an edge
        (((4, 4), (6, 4), (6, 6), (4, 6)), 0, False, False),  # touching at a corner
        (((9, 9), (10, 9), (10, 10)), 0, False, False),
        (((3, 3), (6, 3), (6, 6), (3, 6)), 1, False, False),
        (((2, -1), (5, 2), (2, 5), (-1, 2)), 14, False, False),  # corners cut
        (((-9, -9), (9, -9), (9, 9), (-9, 9)), 16, False, True),
    ],
)
def test_clipping_by_hand(spark, other, area, holds, held):
    row = spark.createDataFrame([(pts(*SQUARE), pts(*other))], f"a {POINTS}, b {POINTS}")
    a, b = F.col("a"), F.col("b")
    got = row.select(G.shared_area(a, b), G.shared_area(b, a), G.difference_area(a, b), G.holds(a, b), G.holds(b, a)).first()
    assert got[0] == pytest.approx(area) and got[1] == pytest.approx(area) and got[2] == pytest.approx(16 - area) and got[3] is holds and got[4] is held


def test_clipping_equals_a_loop(spark):
    r = random.Random(1)
    rows = [(turned(r.uniform(0, 9), r.uniform(0, 9), r.uniform(1, 9), r.uniform(1, 9), r.uniform(0, 7)), turned(r.uniform(0, 9), r.uniform(0, 9), r.uniform(1, 9), r.uniform(1, 9), r.uniform(0, 7))) for _ in range(300)]
    df = spark.createDataFrame([(i, pts(*a), pts(*b)) for i, (a, b) in enumerate(rows)], f"i int, a {POINTS}, b {POINTS}")
    got = {x["i"]: x["s"] for x in df.select("i", G.shared_area(F.col("a"), F.col("b")).alias("s")).collect()}
    assert all(got[i] == pytest.approx(shared(a, b), abs=1e-9) for i, (a, b) in enumerate(rows))


def test_boxes_meet_once_however_large(spark):
    r = random.Random(2)
    rows = [(i, i % 2, *(lambda x, y, s: (x, y, x + s, y + s))(r.uniform(-50, 50), r.uniform(-50, 50), r.choice([0.5, 3, 40]))) for i in range(150)] + [(200, None, 0.0, 0.0, 9.0, 9.0)]
    df = spark.createDataFrame(rows, "id int, k int, x0 double, y0 double, x1 double, y1 double").select("id", "k", F.struct("x0", "y0", "x1", "y1").alias("box"))
    got = [(x["l"]["id"], x["r"]["id"]) for x in overlapping(df, ["k"], "id", "box").collect()]
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] is not None and a[1] == b[1] and a[2] < b[4] and b[2] < a[4] and a[3] < b[5] and b[3] < a[5]}
    assert len(got) == len(set(got)) and set(got) == want
    assert overlapping(df.limit(0), ["k"], "id", "box").count() == 0


def loop(cards, size, visible, in_image):
    """Card after card, attempt after attempt."""
    frame, out = [(0, 0), (size, 0), (size, size), (0, size)], []
    area = lambda p: synth.polygon_area(np.array(p))
    for image, item, ident, poly in sorted(cards, key=lambda c: c[2]):
        mine = [o for o in out if o[0] == image]
        if poly is None or area(poly) == 0 or round(shared(poly, frame) / area(poly), 12) < max(in_image, visible) or any(o[1] == item for o in mine):
            continue
        # the part of the card that the image shows, as a polygon, by the same clipping on numbers
        if all(not blocked(poly, o[3], frame, visible) for o in mine):
            out.append((image, item, ident, poly))
    return {(o[0], o[1], o[2]) for o in out}


def clip(a, b):
    out = [np.array(p, float) for p in a]
    for k in range(len(b)):
        p, q = np.array(b[k], float), np.array(b[(k + 1) % len(b)], float)
        side = lambda r, p=p, q=q: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
        kept = []
        for i, r in enumerate(out):
            s = out[i - 1]
            if (side(r) >= 0) != (side(s) >= 0):
                kept.append(s + (r - s) * (side(s) / (side(s) - side(r))))
            if side(r) >= 0:
                kept.append(r)
        out = kept
    return out


def inside(a, b):
    return all((q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0]) >= 0 for p, q in zip(a, [*a[1:], a[0]]) for r in b)


def blocked(new, old, frame, visible):
    shown = clip(new, frame)
    area = lambda p: synth.polygon_area(np.array(p))
    both = shared(shown, old)
    return (area(shown) - both) / area(new) < visible or (area(old) - both) / area(old) < visible or inside(old, shown) or inside(shown, old)


def test_placement_equals_a_plain_loop(spark):
    r = random.Random(3)
    cards = [(i // 4 % 5, i // 4, i, turned(r.uniform(0, 100), r.uniform(0, 100), w := r.uniform(8, 60), w * 1.4, r.uniform(0, 7))) for i in range(240)]
    cards += [(0, 900, 900, None), (0, 901, 901, [(1, 1), (2, 2), (3, 3)])]
    df = spark.createDataFrame([(im, it, i, p and pts(*p), "x") for im, it, i, p in cards], f"image int, item int, ident int, card {POINTS}, more string").repartition(5)
    for visible, in_image in ((0.5, 0.7), (0.8, 0.2)):
        got = placement.place(df, "image", "item", "ident", "card", 100.0, 100.0, visible, in_image).collect()
        assert {(x["image"], x["item"], x["ident"]) for x in got} == loop(cards, 100, visible, in_image) and {x["more"] for x in got} == {"x"}
    assert placement.place(df.limit(0), "image", "item", "ident", "card", 100.0, 100.0).count() == 0


def test_rounds_follow_chains_not_candidates(spark):
    """Candidates in one chain of conflicts take a round for each that is taken; apart ones take one."""
    some = spark.range(40).select("id", F.col("id").alias("item"))
    chain = spark.range(39).select(F.col("id").alias("earlier"), (F.col("id") + 1).alias("later"))
    taken, rounds = placement.taken_in_order(some, chain.where("later <= 6"), "id", ["item"])
    assert {r["id"] for r in taken.collect()} == {0, 2, 4, 6, *range(7, 40)} and rounds == 4
    taken, rounds = placement.taken_in_order(some, chain.limit(0), "id", ["item"])
    assert taken.count() == 40 and rounds == 1


def greedy(left, right, reach):
    distance = lambda p, q: sum(math.hypot(a - c, b - d) for (a, b), (c, d) in zip(p, q)) / len(p)
    pairs = sorted((distance(p, q), i, j, k) for k, i, p in left if p for m, j, q in right if q and k == m and len(p) == len(q))
    out, ls, rs = set(), set(), set()
    for x, i, j, k in pairs:
        if x < reach and i not in ls and j not in rs:
            out.add((k, i, j, round(x, 9)))
            ls.add(i)
            rs.add(j)
    return out


def test_assignment_equals_a_greedy_loop(spark):
    r = random.Random(4)
    sets = lambda first, n: [(i % 3, first + i, [(r.randrange(60), r.randrange(60)) for _ in range(r.choice([2, 3]))] if i % 17 else r.choice([[], None])) for i in range(n)]
    left, right = sets(0, 90), sets(1000, 70)
    left += [(0, 500, [(1, 1), (2, 2)]), (0, 501, [(1, 1), (2, 2)])]
    right += [(0, 1500, [(1, 1), (2, 2)]), (0, 1501, [(1, 1), (2, 2)])]
    df = lambda rows: spark.createDataFrame([(k, i, p and pts(*p) if p else p) for k, i, p in rows], f"k int, id int, points {POINTS}").repartition(4)
    for reach in (6.0, 25.0):
        got = assignment.assigned(df(left), df(right), ["k"], "id", "points", reach).collect()
        assert {(x["k"], x["left_id"], x["right_id"], round(x["distance"], 9)) for x in got} == greedy(left, right, reach)
    assert assignment.assigned(df(left).limit(0), df(right), ["k"], "id", "points", 5.0).count() == 0


def test_reach_is_open_and_rounds_are_few(spark):
    one = lambda i, x: spark.createDataFrame([(1, i, pts((x, 0), (x, 2)))], f"k int, id int, points {POINTS}")
    assert assignment.assigned(one(1, 0), one(2, 300), ["k"], "id", "points", 300.0).count() == 0
    assert assignment.assigned(one(1, 0), one(2, 300), ["k"], "id", "points", 300.0, closed=True).count() == 1
    # a line of points at growing distances: nearest first, each found pair sets the next one free
    pairs = spark.createDataFrame([(1, i, 100 + j, float(i + j)) for i in range(12) for j in (i, i + 1)], "k int, left_id int, right_id int, distance double")
    found, rounds = assignment.mutual(pairs, ["k"])
    assert {(x["left_id"], x["right_id"]) for x in found.collect()} == {(i, 100 + i) for i in range(12)} and rounds == 12


def test_pairs_stay_within_the_grid(spark):
    """On a wide plane only neighbours meet, so pairs grow with the points and not with their square."""
    at = lambda n, step: spark.range(n).select(F.lit(1).alias("k"), F.col("id"), F.array(F.struct((F.col("id") * step).cast("double").alias("x"), F.lit(0.0).alias("y"))).alias("points"))
    assert assignment.near_pairs(at(2000, 10), at(2000, 10), ["k"], "id", "points", 10.0).count() == 2000


def test_mining_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(mining, "HELD_ROWS", 50)
    r = np.random.default_rng(5)
    rows = [(i // 40, i, f"l{i % 3}" if i < 160 else "same", r.normal(size=6).round(2).tolist()) for i in range(200)]
    rows += [(0, 900, "l0", None), (0, 901, "l0", [0.0] * 6), (0, 902, "l1", [1.0]), (None, 903, "l0", [1.0] * 6), (7, 904, "lonely", [1.0] * 6), (0, 905, "l0", rows[1][3]), (0, 906, "l1", rows[1][3])]
    df = spark.createDataFrame(rows, "batch int, id int, label string, v array<double>").repartition(6)
    got = {x["id"]: x for x in mining.hardest(df, "batch", "id", "label", "v", block=7).collect()}
    alive = [x for x in rows if x[0] is not None and x[3] is not None and len(x[3]) == 6 and any(x[3])]
    assert set(got) == {x[1] for x in alive}
    for b, i, lab, v in alive:
        score = lambda o: round(float(np.dot(v, o[3]) / np.linalg.norm(v) / np.linalg.norm(o[3])), 12)
        others = [o for o in alive if o[0] == b and o[1] != i]
        pos = min(((score(o), o[1]) for o in others if o[2] == lab), default=None)
        neg = min(((-score(o), o[1]) for o in others if o[2] != lab), default=None)
        x = got[i]
        assert (x["positive"], x["negative"]) == (pos and pos[1], neg and neg[1])
        assert (pos is None) == (x["positive_score"] is None) and (pos is None or x["positive_score"] == pytest.approx(pos[0]))


def test_reach_grows_in_place_of_all_pairs(spark, monkeypatch):
    """Of dense sets that all lie within the reach, few pairs are formed, and the result is that of the loop over all."""
    formed, whole = [], assignment.mutual
    monkeypatch.setattr(assignment, "PAIRS_A_SET", 2)
    monkeypatch.setattr(assignment, "mutual", lambda pairs, keys: (formed.append(pairs.count()), whole(pairs, keys))[1])
    r = random.Random(6)
    sets = lambda first: [(i % 2, first + i, [(r.randrange(2000) / 10, r.randrange(2000) / 10)]) for i in range(400)]
    left, right = sets(0), sets(1000)
    df = lambda rows: spark.createDataFrame([(k, i, pts(*p)) for k, i, p in rows], f"k int, id int, points {POINTS}")
    got = assignment.assigned(df(left), df(right), ["k"], "id", "points", 300.0).collect()
    assert {(x["k"], x["left_id"], x["right_id"], round(x["distance"], 9)) for x in got} == greedy(left, right, 300.0) and len(got) == 400
    assert len(formed) > 1 and max(formed) < 40_000  # all pairs are 80,000


def test_rounds_of_placement_broadcast_nothing(spark, monkeypatch):
    """Idents compress well, so what Spark takes for small can be millions of rows."""
    plans, whole = [], placement.staged
    monkeypatch.setattr(placement, "staged", lambda df, name: (plans.append(df._jdf.queryExecution().executedPlan().toString()), whole(df, name))[1])
    cards = spark.createDataFrame([(0, i, i, pts(*turned(20 + i % 5 * 9, 30 + i, 20, 28, i))) for i in range(20)], f"image int, item int, ident int, card {POINTS}")
    assert placement.place(cards, "image", "item", "ident", "card", 100.0, 100.0).count() > 0
    assert len(plans) > 5 and not any("BroadcastHashJoin" in p for p in plans[3:])


def test_copies_of_boxes_meet_once(spark, monkeypatch):
    """Pairs by distinct boxes equal those by all rows, with blocks of copies and cells that are cut into shares."""
    monkeypatch.setattr(boxes, "COPIES", 4)
    monkeypatch.setattr(boxes, "SHARE", 5)
    r = random.Random(7)
    some = [(x := r.randrange(20), y := r.randrange(20), x + r.choice([0, 2, 9]), y + r.choice([3, 9])) for _ in range(40)]
    rows = [(i, *map(float, r.choice(some[: 40 if i % 2 else 2]))) for i in range(300)] + [(900, None, 1.0, 2.0, 3.0)]
    df = spark.createDataFrame(rows, "id int, x0 double, y0 double, x1 double, y1 double").select("id", F.struct("x0", "y0", "x1", "y1").alias("box"))
    found = boxes.overlapping_ids(df, "id", "box")
    got = [tuple(x) for x in found.collect()]
    want = {(a[0], b[0]) for a in rows[:-1] for b in rows[:-1] if a[0] < b[0] and a[1] < b[3] and b[1] < a[3] and a[2] < b[4] and b[2] < a[4]}
    assert len(got) == len(set(got)) and set(got) == want and found.columns == ["id", "other_id"]
    assert boxes.overlapping_ids(df.limit(0), "id", "box").count() == 0


def test_pairs_of_copies_are_written_in_few_bytes(spark, tmp_path):
    """All pairs come out, in an order that Parquet's encodings shrink: 60 copies of each of 50 boxes, keys shifted."""
    places = [(i % 10 * 0.5, i // 10 * 3.0) for i in range(50)]
    cells = F.array(*[F.struct(F.lit(x).alias("x0"), F.lit(y).alias("y0"), F.lit(x + 3).alias("x1"), F.lit(y + 20).alias("y1")) for x, y in places])
    df = spark.range(3000).select(F.col("id"), F.element_at(cells, (F.col("id") * 7 % 50 + 1).cast("int")).alias("box"))
    boxes.overlapping_ids(df, "id", "box").write.parquet(str(tmp_path / "pairs"))
    pairs = spark.read.parquet(str(tmp_path / "pairs"))
    near = sum(abs(a[0] - b[0]) < 3 and abs(a[1] - b[1]) < 20 for a in places for b in places)
    rows = pairs.count()
    assert rows == (60 * 60 * near - 3000) // 2 == pairs.where("id < other_id").distinct().count()
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 0.3 * rows


def test_rows_that_share_an_ident_are_no_pair(spark):
    """Neither of one box nor of two: the ident of a pair's first row is the smaller."""
    rows = [(1, 0.0, 0.0, 2.0, 2.0), (1, 1.0, 1.0, 3.0, 3.0), (1, 0.0, 0.0, 2.0, 2.0), (2, 1.0, 1.0, 3.0, 3.0), (None, 0.0, 0.0, 2.0, 2.0)]
    df = spark.createDataFrame(rows, "id int, x0 double, y0 double, x1 double, y1 double").select("id", F.struct("x0", "y0", "x1", "y1").alias("box"))
    found = boxes.overlapping_ids(df, "id", "box")
    assert [tuple(x) for x in found.collect()] == [(1, 2)] * 3 and dict(found.dtypes) == {"id": "int", "other_id": "int"}
