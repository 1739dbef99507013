import time

import numpy as np
from lodestone.operators import folds
from lodestone.streaming.averages import gated_average, windowed_counts
from lodestone.streaming.frames import recognised
from lodestone.streaming.tracker import advance, tracked
from pyspark.sql import functions as F


def run(df, name, mode):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_stream_equals_batch_fold(spark, tmp_path):
    rows = [(k, float(t), [float((t * 7 + k) % 5), 1.0]) for k in range(3) for t in (0, 1, 3, 4, 9, 10, 11)]
    schema = "k int, t double, v array<double>"
    for i in range(3):  # three files, three triggers
        spark.createDataFrame([r for r in rows if i * 4 <= r[1] < (i + 1) * 4], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    spark.conf.set("spark.sql.streaming.checkpointLocation", f"{tmp_path}/state")
    got = run(gated_average(stream, "k", "t", "v", 1.5), "averages", "update").groupBy("k").agg(F.max_by(F.struct("z", "n"), "t").alias("r")).select("k", "r.*")
    batch = folds.gated_ewma(spark.createDataFrame(rows, schema), "k", "t", "v", 1.5).select("k", "z", "n")
    a, b = ({r["k"]: (np.round(r["z"], 9).tolist(), r["n"]) for r in x.collect()} for x in (got, batch))
    assert a == b
    spark.conf.unset("spark.sql.streaming.checkpointLocation")


def test_tracks_live_and_end():
    state = {"next": 0, "tracks": [], "frame": None}
    at = lambda x: np.array([[x, 0.0], [x + 1, 0.0]])
    assert [t for t, _, _ in advance(state, [at(0), at(1000)], 300, 5)] == [0, 1]
    assert [t for t, _, _ in advance(state, [at(990), at(10)], 300, 5)] == [1, 0]
    assert [t for t, _, _ in advance(state, [at(20)], 300, 5)] == [0]
    for _ in range(2):
        advance(state, [at(20)], 300, 5)
    assert [t["id"] for t in state["tracks"]] == [0]  # the other one missed its frames
    assert [t for t, _, _ in advance(state, [at(5000)], 300, 5)] == [2]


def test_tracker_stream(spark, tmp_path):
    rows = [("s", f, j, [[float(x + f), 0.0], [float(x + f + 1), 0.0]]) for f in range(4) for j, x in enumerate((0, 1000))]
    schema = "stream_id string, frame long, detection long, points array<array<double>>"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    got = run(tracked(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")), "tracks", "append").collect()
    assert len(got) == 6 and {(r["detection"], r["track"]) for r in got} == {(0, 0), (1, 1)}


def test_windowed_counts(spark, tmp_path):
    rows = [("2024-01-01 00:00:01", "a"), ("2024-01-01 00:04:00", "a"), ("2024-01-01 00:06:00", "b")]
    spark.createDataFrame(rows, "s string, k string").select(F.to_timestamp("s").alias("ts"), "k").coalesce(1).write.parquet(f"{tmp_path}/in")
    got = run(windowed_counts(spark.readStream.schema("ts timestamp, k string").parquet(f"{tmp_path}/in"), "ts", "k", "5 minutes"), "counts", "update")
    assert {(r["k"], r["n"]) for r in got.collect()} == {("a", 2), ("b", 1)}


def test_frames_meet_the_catalog(spark, tmp_path):
    schema = "frame long, id long, name string"
    spark.createDataFrame([(1, 7, "x"), (1, None, "y"), (2, 8, "z")], schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    held = spark.createDataFrame([(7, "Island", 0.5), (None, "none", 1.0), (9, "Forest", 2.0)], "id long, name string, price double")
    got = run(recognised(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), held), "frames", "append")
    assert {tuple(r) for r in got.select("frame", "id", "name", "price", "known").collect()} == {(1, 7, "x", 0.5, True), (1, None, "y", None, False), (2, 8, "z", None, False)}


def test_state_of_idle_keys_is_gone(spark, tmp_path):
    """Within the time to live the state of an earlier run is there; after it, averages, tracks and ids start anew."""
    frames = "stream_id string, frame long, detection long, points array<array<double>>"
    near = lambda f: ("s", f, 0, [[1.0 + f, 0.0], [2.0 + f, 0.0]])
    values = "k string, t double, v array<double>"

    def bring(i):
        spark.createDataFrame([near(i)], frames).coalesce(1).write.mode("append").parquet(f"{tmp_path}/frames")
        spark.createDataFrame([("a", float(i), [float(i)])], values).coalesce(1).write.mode("append").parquet(f"{tmp_path}/values")

    def after(i):
        bring(i)
        out = []
        for name, df, mode in (
            ("seen", tracked(spark.readStream.schema(frames).parquet(f"{tmp_path}/frames"), hits_first=1, ttl_ms=6000), "append"),
            ("average", gated_average(spark.readStream.schema(values).parquet(f"{tmp_path}/values"), "k", "t", "v", 0.5, ttl_ms=6000), "update"),
        ):
            rows = []
            q = df.writeStream.outputMode(mode).foreachBatch(lambda d, _, rows=rows: rows.extend(d.collect())).option("checkpointLocation", f"{tmp_path}/state-{name}").trigger(availableNow=True).start()
            q.awaitTermination()
            out.append((rows[-1]["track"], rows[-1]["seen"]) if name == "seen" else rows[-1]["n"])
        return out

    assert after(1) == [(0, 1), 1]
    assert after(2) == [(0, 2), 2]
    time.sleep(7)
    assert after(3) == [(0, 1), 1]
