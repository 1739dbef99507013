import collections
import json

import numpy as np
import pytest
from lodestone.operators import synth
from lodestone.sources import dataset
from pyspark.sql import functions as F

POINTS = "array<struct<x:double,y:double>>"


@pytest.fixture(scope="module")
def made(spark):
    samples = spark.range(40).select(F.when(F.col("id") < 30, "train").otherwise("val").alias("split"), F.col("id").alias("i"))
    cards = spark.range(17).select(F.concat(F.lit("card"), "id").alias("c"))
    backgrounds = spark.createDataFrame([("sea",), ("sky",), (None,), ("sea",)], "b string")
    build = lambda s: synth.generated(s, cards, backgrounds, "c", "b", seed=5, background_only=0.3, most=4, attempts=3, least_in_image=0.6)
    return samples, build, build(samples).collect()


def test_samples_are_whole_and_repeat(made):
    samples, build, rows = made
    assert len(rows) == 40 and {r["background"] for r in rows} == {"sea", "sky"} and all(0 <= r["degrees"] < 360 for r in rows)
    again = build(samples.repartition(7)).collect()
    key = lambda rows: sorted(map(repr, rows))
    assert key(rows) == key(again)
    empty = sum(not r["cards"] for r in rows)
    assert 4 <= empty <= 25
    for r in rows:
        assert len(r["cards"]) % 3 == 0 and [c["label"] for c in r["cards"]] == [0, 1, 2] * (len(r["cards"]) // 3)
        assert all(len({c["card"] for c in r["cards"][k : k + 3]}) == 1 and r["cards"][k]["card"].startswith("card") for k in range(0, len(r["cards"]), 3))


def test_boxes_lie_where_a_homography_puts_them(made):
    _, _, rows = made
    m, seen = synth.MARGIN * 1.4, 0
    for r in rows:
        for k in range(0, len(r["cards"]), 3):
            quad = np.array([(p["x"], p["y"]) for p in r["cards"][k]["points"]])
            h = synth.perspective_matrix(np.array([[0, 0], [1, 0], [1, 1], [0, 1]], float), quad)
            for c, (y0, y1) in zip(r["cards"][k + 1 : k + 3], ((m, 0.7 - m), (0.7 + m, 1.4 - m))):
                box = np.array([[m, y0 / 1.4, 1], [1 - m, y0 / 1.4, 1], [1 - m, y1 / 1.4, 1], [m, y1 / 1.4, 1]]) @ h.T
                assert np.allclose([(p["x"], p["y"]) for p in c["points"]], box[:, :2] / box[:, 2:], atol=1e-6)
                seen += 1
    assert seen > 40


def test_a_skewed_quad(spark):
    quad = [(10, 10), (90, 30), (80, 120), (5, 100)]
    df = spark.createDataFrame([([{"x": float(x), "y": float(y)} for x, y in quad],), ([{"x": 0.0, "y": 0.0}] * 4,)], f"q {POINTS}")
    good, flat = [r["k"] for r in df.select(synth.keypoints(F.col("q")).alias("k")).collect()]
    h = synth.perspective_matrix(np.array([[0, 0], [1, 0], [1, 1], [0, 1]], float), np.array(quad, float))
    m = synth.MARGIN * 1.4
    corner = np.array([m, m / 1.4, 1]) @ h.T
    assert (good[1]["points"][0]["x"], good[1]["points"][0]["y"]) == pytest.approx(tuple(corner[:2] / corner[2]))
    assert [k["label"] for k in flat] == [0, 1, 2] and flat[1]["points"][0]["x"] is None  # no perspective


def test_from_samples_to_a_dataset(spark, made, tmp_path):
    """Generated samples become label files, counted by the manifest."""
    samples, build, rows = made
    dataset.register(spark)
    texts = synth.label_texts(build(samples)).withColumn("image", F.lit(b"\xff\xd8"))
    texts.write.format("detection_dataset").mode("append").save(f"{tmp_path}/set")
    told = json.load(open(f"{tmp_path}/set/{dataset.MANIFEST}"))
    want = collections.Counter()
    for r in rows:
        want[r["split"]] += len(r["cards"])
    assert {s: v["lines"] for s, v in told["splits"].items()} == dict(want) and {s: v["samples"] for s, v in told["splits"].items()} == {"train": 30, "val": 10}


def test_empty_tables(spark, made):
    samples, build, _ = made
    assert build(samples.limit(0)).count() == 0
    none = synth.generated(samples.limit(3), spark.createDataFrame([], "c string"), spark.createDataFrame([], "b string"), "c", "b", seed=1, background_only=1.0)
    assert [(r["background"], r["cards"]) for r in none.collect()] == [(None, [])] * 3
