import json
import os

import pytest
from lodestone.functions import geometry as G
from lodestone.functions import text as T
from lodestone.operators import synth
from lodestone.sources import dataset
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def samples(spark):
    """A sample a row of the splits of part, with one label line."""
    dataset.register(spark)
    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet")
    rows = synth.splits_of(part, "p_partkey", 0.1, 0.05).join(part, "p_partkey")
    outline = G.rectangle(F.lit(320.0), F.lit(320.0), F.col("p_size") * 1.0, F.col("p_size") * 1.4)
    return rows.select("split", T.numbered("image", F.col("p_partkey")).alias("name"), F.col("p_name").cast("binary").alias("image"), T.label_line(F.col("p_partkey") % 3, outline).alias("label")).repartition(4)


def files(root):
    return sorted(os.path.relpath(os.path.join(d, f), root) for d, _, names in os.walk(root) for f in names)


def test_files_and_manifest(samples, tmp_path):
    out = f"{tmp_path}/set"
    samples.write.format("detection_dataset").mode("append").save(out)
    told = json.load(open(f"{out}/{dataset.MANIFEST}"))
    assert {s: v["samples"] for s, v in told["splits"].items()} == {"train": 200, "val": 20, "test": 10}
    assert {s: v["lines"] for s, v in told["splits"].items()} == {"train": 200, "val": 20, "test": 10} and told["names"] == {"0": "card", "1": "card_top", "2": "card_bottom"}
    rows = samples.collect()
    assert files(out) == sorted([dataset.MANIFEST, *(f"images/{r['split']}/{r['name']}.jpg" for r in rows), *(f"labels/{r['split']}/{r['name']}.txt" for r in rows)])
    assert all(open(f"{out}/labels/{r['split']}/{r['name']}.txt").read() == r["label"] and open(f"{out}/images/{r['split']}/{r['name']}.jpg", "rb").read() == bytes(r["image"]) for r in rows)
    assert told["image_bytes"] == sum(len(r["image"]) for r in rows)


def test_a_folder_that_is_not_empty_is_refused(samples, tmp_path):
    (tmp_path / "set").mkdir()
    (tmp_path / "set/keep").write_text("x")
    with pytest.raises(Exception, match="not empty"):
        samples.write.format("detection_dataset").mode("append").save(f"{tmp_path}/set")
    with pytest.raises(Exception, match="never overwritten"):
        samples.write.format("detection_dataset").mode("overwrite").save(f"{tmp_path}/other")
    assert files(tmp_path / "set") == ["keep"]


def test_a_failed_task_leaves_nothing(samples, tmp_path):
    bad = samples.withColumn("name", F.when(F.col("name") == "image_0007", "../up").otherwise(F.col("name")))
    with pytest.raises(Exception, match="plain words"):
        bad.write.format("detection_dataset").mode("append").save(f"{tmp_path}/set")
    assert files(tmp_path) == []
    samples.write.format("detection_dataset").mode("append").save(f"{tmp_path}/set")  # the folder is as good as new
    assert os.path.exists(f"{tmp_path}/set/{dataset.MANIFEST}")


def test_missing_columns_and_empty_tables(samples, tmp_path):
    with pytest.raises(Exception, match="missing"):
        samples.drop("label").write.format("detection_dataset").mode("append").save(f"{tmp_path}/a")
    samples.limit(0).write.format("detection_dataset").mode("append").save(f"{tmp_path}/b")
    assert json.load(open(f"{tmp_path}/b/{dataset.MANIFEST}"))["splits"] == {}
