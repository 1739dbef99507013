import numpy as np
import pytest
from lodestone.operators import documents, segmenter
from lodestone.plans import payloads
from pyspark.sql import functions as F


def test_documents_are_parsed_once(spark):
    plan = payloads.payload_variant_paths(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") + plan.count("parse_json") == 1


def test_odd_documents(spark):
    texts = ['{"a":1,"b":[1,"x",null],"c":{"d":"2.5"}}', '{"a":"one","b":{},"c":7}', "[1,2]", "", "{", None, "null", '{"a":1e400}', "5"]
    df = documents.parsed(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), "t", "v")
    got = {r["i"]: (r["a"], r["d"], r["n"]) for r in documents.fields(df, "v", {"a": ("$.a", "int"), "d": ("$.c.d", "double"), "n": ("$[1]", "long")}).collect()}
    assert got == {0: (1, 2.5, None), 1: (None, None, None), 2: (None, None, 2)} | {i: (None, None, None) for i in range(3, 9)}
    items = documents.entries(df, "v", "$.b", "string", ["i"]).collect()
    assert [(r["i"], r["pos"], r["value"]) for r in sorted(items, key=lambda r: r["pos"])] == [(0, 0, "1"), (0, 1, "x"), (0, 2, None)]
    assert documents.fields(df.limit(0), "v", {"a": ("$.a", "int")}).count() == 0


def test_variants_survive_parquet(spark, tmp_path):
    df = documents.parsed(spark.createDataFrame([(1, '{"p":{"usd":"0.20"}}')], "i int, t string"), "t", "v").select("i", "v")
    df.write.parquet(f"{tmp_path}/v")
    back = spark.read.parquet(f"{tmp_path}/v")
    assert documents.fields(back, "v", {"usd": ("$.p.usd", "double")}).first()["usd"] == 0.2


def test_segments_by_lateral_join(spark):
    frame = np.array([[0, 200, 200, 0], [90, 0, 0, 255], [0, 0, 0, 0]], np.uint8)
    segmenter.register(spark, "test_segments", lambda: segmenter.bright_runs(4, 80))
    spark.createDataFrame([(1, frame.tobytes()), (2, None), (3, b""), (4, bytes(12))], "i int, frame binary").createOrReplaceTempView("frames")
    rows = spark.sql("SELECT i, s.label, s.conf, s.points FROM frames, LATERAL test_segments(frame) s").collect()
    got = sorted((r["i"], r["label"], round(r["conf"] * 255), [(p["x"], p["y"]) for p in r["points"]]) for r in rows)
    box = lambda x0, x1, y: [(x0, y), (x1, y), (x1, y + 1), (x0, y + 1)]
    assert got == [(1, 0, 90, box(0, 1, 1)), (1, 0, 200, box(1, 3, 0)), (1, 0, 255, box(3, 4, 1))]
    # frames without segments are kept by a join by key
    assert spark.sql("SELECT f.i, t.conf FROM frames f LEFT JOIN (SELECT i, s.conf FROM frames, LATERAL test_segments(frame) s) t ON f.i = t.i").count() == 6


def test_the_segmenter_is_loaded_where_it_runs(spark):
    def load():
        state = {"n": 0}

        def count(frame):
            state["n"] += 1
            return None if frame == b"none" else [(7, float(state["n"]), [])]

        return count

    segmenter.register(spark, "counting", load)
    frames = spark.createDataFrame([(b"a",), (b"none",), (b"b",)], "frame binary").coalesce(1)
    got = [(r["label"], r["conf"]) for r in spark.sql("SELECT s.* FROM {f}, LATERAL counting(frame) s", f=frames).collect()]
    assert [g[0] for g in got] == [7, 7] and all(c >= 1 for _, c in got)


@pytest.mark.parametrize("kind", ["int", "string"])
def test_missing_paths_are_null(spark, kind):
    df = documents.parsed(spark.range(1).select(F.lit('{"a":{}}').alias("t")), "t", "v")
    assert documents.fields(df, "v", {"x": ("$.a.b.c[3]", kind)}).first()["x"] is None
