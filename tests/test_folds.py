import random

import pytest
from lodestone.operators import folds
from pyspark.sql import functions as F


def loops(rows, gate, every):
    """(plain, gated, vectors, counts) by plain loops."""
    plain, gated, vectors, counts = {}, {}, {}, {}
    for k, t, v, w in sorted((r for r in rows if r[1] is not None and r[2] is not None), key=lambda r: r[1]):
        plain[k] = v if not plain.get(k) else v * 0.1 + plain[k] * 0.9
        if k not in gated or t - gated[k][0] > gate:
            gated[k] = (t, v if k not in gated else 0.1 * v + 0.9 * gated[k][1], gated[k][2] + 1 if k in gated else 1)
            vectors[k] = w if k not in vectors else [0.1 * a + 0.9 * b for a, b in zip(w, vectors[k])]
        if k not in counts or t - counts[k][0] >= every:
            counts[k] = (t, counts[k][1] + 1 if k in counts else 1)
    return plain, gated, vectors, counts


def check(spark, rows, kind, gate, every):
    df = spark.createDataFrame(rows, f"k {kind}, t double, v double, w array<double>").repartition(5)
    plain, gated, vectors, counts = loops(rows, gate, every)
    close = lambda x: pytest.approx(x, rel=1e-9, abs=1e-12)
    assert {r["k"]: r["z"] for r in folds.ewma(df, "k", ["t"], "v").collect()} == {k: close(z) for k, z in plain.items()}
    assert {r["k"]: (r["t"], r["z"], r["n"]) for r in folds.gated_ewma(df, "k", "t", "v", gate).collect()} == {k: (t, close(z), n) for k, (t, z, n) in gated.items()}
    got = {r["k"]: r["z"] for r in folds.gated_ewma(df, "k", "t", "w", gate).collect()}
    assert set(got) == set(vectors) and all(got[k] == close(z) for k, z in vectors.items())
    assert {r["k"]: r["emitted"] for r in folds.every_n(df, "k", "t", every).collect()} == {k: n for k, (_, n) in counts.items()}


def made(seed, n, values, keys, step=0.7):
    r = random.Random(seed)
    at = sorted(round(r.uniform(0, n * step), 3) for _ in range(n))
    at = [t + i * 1e-6 for i, t in enumerate(at)]
    return [(r.choice(keys), t, float(v := r.choice(values)), [float(v), 1.0]) for t in at]


@pytest.mark.parametrize("batch", [3, 10_000])
@pytest.mark.parametrize("values", [range(1, 9), range(0, 4), (-9, -1, 0, 1, 9), (-1, 0)])
def test_cool_keys(spark, batch, values):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        check(spark, made(1, 300, values, (0, 0, 0, 1, 2, 3, 4)), "long", 2.5, 4.2)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


@pytest.mark.parametrize("values", [range(1, 9), range(0, 4), (-9, -1, 0, 1, 9)])
@pytest.mark.parametrize("gate", [0.0, 2.5, 40.0, 1e9])
def test_hot_keys_in_blocks(spark, monkeypatch, values, gate):
    """Two keys hold most rows and are cut into blocks; results are those of the loops."""
    monkeypatch.setattr(folds, "BLOCK_ROWS", 40)
    rows = made(2, 500, values, ("a", "a", "a", None, None, "b", "c")) + [("a", None, 1.0, [1.0, 1.0]), ("d", 1.0, 5.0, [5.0, 1.0])]
    check(spark, rows, "string", gate, gate or 0.5)


def test_an_average_that_comes_back_to_zero(spark, monkeypatch):
    """1, -9 gives exactly 0, and the next value counts in full, in whichever block it stands."""
    monkeypatch.setattr(folds, "BLOCK_ROWS", 5)
    values = [1.0, -9.0, 4.0, 4.0, -36.0, 0.0, 7.0, 2.0, 1.0, -9.0] * 6
    check(spark, [(1.5, float(i), v, [v, v]) for i, v in enumerate(values)], "double", 0.5, 1.0)


def test_a_hot_key_is_spread(spark, monkeypatch):
    """One key with all rows: blocks of like size, each a task's share."""
    monkeypatch.setattr(folds, "BLOCK_ROWS", 500)
    df = spark.range(4000).select(F.lit(1).alias("k"), F.col("id").cast("double").alias("t"), F.lit(1.0).alias("v"))
    rows, hot = folds._split(df, "k", ["t"])
    sizes = [r["count"] for r in hot.groupBy("_block").count().collect()]
    assert rows.count() == 0 and len(sizes) >= 8 and max(sizes) <= 2 * sum(sizes) / len(sizes)
    assert folds.gated_ewma(df, "k", "t", "v", 3.0).first()["n"] == 1000
    assert folds.ewma(df.limit(0), "k", ["t"], "v").count() == 0


def test_ties_and_equal_times(spark, monkeypatch):
    monkeypatch.setattr(folds, "BLOCK_ROWS", 10)
    rows = [("a", float(i // 7), i, float(i)) for i in range(90)]
    df = spark.createDataFrame(rows, "k string, t double, i long, v double").repartition(4)
    z, last, n = None, None, 0
    for _, t, _, v in rows:
        if last is None or t - last > 1:
            z, last, n = v if z is None else 0.1 * v + 0.9 * z, t, n + 1
    got = folds.gated_ewma(df, "k", "t", "v", 1.0, ties=("i",)).first()
    assert (got["t"], got["n"]) == (last, n) and got["z"] == pytest.approx(z)
