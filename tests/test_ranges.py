import random

import pytest
from lodestone.operators import ranges
from pyspark.sql import functions as F


def made(seed=1, n=300):
    r = random.Random(seed)
    rows = [(r.choice(["a", "a", "a", "a", "b", "c", None]), i * 3 % 1000, i, r.choice([None, i * 10])) for i in range(n)]
    return rows + [("solo", 5, 900, 1), ("pair", 5, 901, None), ("pair", 5, 902, 2)]


def groups(rows):
    out = {}
    for row in sorted(rows, key=lambda x: (x[1], x[2])):
        out.setdefault(row[0], []).append(row)
    return out


@pytest.fixture(params=[1, 7, 40, 200])
def parts(request):
    """Numbers of ranges: one, some, many, and more than keys have rows."""
    return request.param


@pytest.fixture
def df(spark):
    return spark.createDataFrame(made(), "k string, at long, i long, v long").repartition(5)


def test_lag_and_lead(df, parts):
    got = {r["i"]: (r["one"], r["three"], r["next"], r["far"]) for r in ranges.lagged(df, "k", ["at", "i"], {"one": ("v", 1), "three": ("i", 3), "next": ("v", -1), "far": ("i", -4)}, parts).collect()}
    want = {}
    for own in groups(made()).values():
        at = lambda j, c, own=own: own[j][c] if 0 <= j < len(own) else None
        want |= {row[2]: (at(j - 1, 3), at(j - 3, 2), at(j + 1, 3), at(j + 4, 2)) for j, row in enumerate(own)}
    assert got == want


def test_places_and_rings(df, parts):
    got = {r["i"]: r["place"] for r in ranges.placed(df, "k", ["at", "i"], "place", parts).collect()}
    ring = {r["i"]: r["next"] for r in ranges.ringed(df, "k", ["at", "i"], "i", "next", parts).collect()}
    values = {r["i"]: r["next"] for r in ranges.ringed(df, "k", ["at", "i"], "v", "next", parts).collect()}
    own = groups(made()).values()
    assert got == {row[2]: j + 1 for g in own for j, row in enumerate(g)}
    assert ring == {row[2]: g[(j + 1) % len(g)][2] for g in own for j, row in enumerate(g)}
    assert values == {row[2]: g[(j + 1) % len(g)][3] for g in own for j, row in enumerate(g)}


def test_filled(df, parts):
    got = {r["i"]: (r["low"], r["high"]) for r in ranges.filled(df, "k", ["at", "i"], "v", "low", "high", parts).collect()}
    want = {}
    for own in groups(made()).values():
        for j, row in enumerate(own):
            before, after = [x[3] for x in own[: j + 1] if x[3] is not None], [x[3] for x in own[j:] if x[3] is not None]
            want[row[2]] = (before[-1] if before else None, after[0] if after else None)
    assert got == want


def test_nearest(spark):
    r = random.Random(3)
    wanted, known = ([(r.choice("abbb"), first + i, float(r.randrange(200))) for i in range(n)] for first, n in ((0, 150), (1000, 60)))
    wanted += [("a", 500, None), ("z", 501, 1.0)]
    known += [("b", 2000, None), ("a", 2001, 7.0), ("a", 2002, 7.0)]
    make = lambda rows: spark.createDataFrame(rows, "k string, id long, x double").repartition(3)
    got = {(x["id"], x["other"], x["distance"]) for x in ranges.nearest(make(wanted), make(known), "k", "id", "x", 4.0).collect()}
    want = set()
    for k, i, x in wanted:
        best = min(((abs(x - y), j) for m, j, y in known if m == k and x is not None and y is not None), default=None)
        if best and best[0] <= 4.0:
            want.add((i, best[1], best[0]))
    assert got == want


def test_hot_keys_are_spread(spark):
    """Five keys, one with most rows: no range has more than twice the mean."""
    df = spark.range(20_000).select(F.when(F.col("id") % 5 > 1, F.lit(0)).otherwise(F.col("id") % 5 + 1).alias("k"), F.xxhash64("id").alias("o"), "id")
    sizes = [r["count"] for r in ranges.in_ranges(df, "k", ["o", "id"], 16).groupBy("_range").count().collect()]
    assert len(sizes) == 16 and max(sizes) <= 2 * sum(sizes) / len(sizes)


def test_empty(spark, df):
    none = df.limit(0)
    assert ranges.lagged(none, "k", ["at"], {"x": ("v", 1)}).count() == 0 and ranges.placed(none, "k", ["at"], "p").count() == 0
    assert ranges.ringed(none, "k", ["at"], "i", "x").count() == 0 and ranges.filled(none, "k", ["at"], "v", "l", "h").count() == 0


def test_no_frame_is_read_anew_for_each_row(spark):
    """Spark evaluates a frame that ends with its partition from the row on for every row, so a range takes the square of its rows."""
    rows = spark.range(50).select((F.col("id") % 2).alias("k"), "id", F.when(F.col("id") % 3 == 0, F.col("id")).alias("v"))
    found = ranges.filled(rows, "k", ["id"], "v", "before", "after", 3)
    assert "unboundedfollowing" not in found._jdf.queryExecution().toString().lower()
    known = lambda k: [i for i in range(k, 50, 2) if i % 3 == 0]
    assert all(r["before"] == max((i for i in known(r["k"]) if i <= r["id"]), default=None) and r["after"] == min((i for i in known(r["k"]) if i >= r["id"]), default=None) for r in found.collect())
