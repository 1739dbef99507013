import pytest
from lodestone import registry
from lodestone.operators import synth
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["orient_quad", "frame_segments", "round_rect_mask"])
def test_small_tables_whose_rows_take_long_are_dealt_out(spark, name):
    """By its bytes the table is one task."""
    assert registry.queries()[name](spark, SF).rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism


def test_attempts_of_few_bytes_are_dealt_out(spark):
    samples = spark.range(20).select(F.lit("train").alias("split"), F.col("id").alias("i")).coalesce(1)
    tried = synth.attempts_of(samples, 5, 1, 4, 640.0, 3)
    assert tried.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
