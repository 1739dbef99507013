import random

import pytest
from helpers import empty, odd, prose
from lodestone.llm import catalogue, mixing
from oracle import assert_same, views
from pyspark.sql import functions as F


def reshared(sizes, share=1.5, epochs=2, turns=(5, 2, 1)):
    """Gives by weight, caps, and gives the excess to the others, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: turns[i % len(turns)] for i, s in enumerate(order)}
    fixed, left = {}, share * sum(sizes.values())
    while True:
        open_ = [s for s in order if s not in fixed]
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > epochs * sizes[s]]
        if not over:
            return fixed | {s: left * weight[s] / total for s in open_}
        for s in over:
            fixed[s] = epochs * sizes[s]
        left = share * sum(sizes.values()) - sum(fixed.values())


def test_targets_equal_resharing(spark):
    r = random.Random(1)
    for _ in range(5):
        sizes = {s: r.randrange(0, 5000) for s in ["a", "é", "b", "B", None, "z1", "z2"]}
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {row["source"]: row["target"] for row in mixing.targets(df).collect()}
        want = reshared(sizes)
        assert all(got[s] == pytest.approx(want[s], rel=1e-9, abs=1e-6) for s in sizes)


def docs(spark, n=600):
    r = random.Random(2)
    return spark.createDataFrame([(i, prose(i, r.randrange(1, 60)), "en", r.choice(["a", "a", "a", "b", "c", None]), 0) for i in range(n)], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.mark.parametrize("bins", [1, 7, 1024])
def test_bins_do_not_matter_and_targets_are_met(spark, bins):
    got = mixing.mix(docs(spark), bins=bins).collect()
    again = mixing.mix(docs(spark).repartition(5), bins=64).collect()
    assert {tuple(r) for r in got} == {tuple(r) for r in again}
    for source in {r["source"] for r in got}:
        own = [r for r in got if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own) / 2 + 1e-6
    assert all(r["taken"] <= 2 * r["size"] and r["copies"] >= min(x["copies"] for x in got if x["source"] == r["source"]) for r in got)


def test_smaller_keys_first_and_weights_count(spark):
    base = docs(spark).where("source = 'a'")
    heavy = mixing.mix(base, weight=F.when(base["doc_id"] % 2 == 0, 50.0).otherwise(0.02), share=0.3).collect()
    assert sum(r["copies"] for r in heavy if r["doc_id"] % 2 == 0) > 20 * max(1, sum(r["copies"] for r in heavy if r["doc_id"] % 2))


def test_the_last_bin_is_small_whatever_the_weights(spark):
    """Nine of ten rows weigh a fiftieth: evenly cut keys would put most of them in one bin."""
    base = docs(spark, 3000).withColumn("source", F.lit("a"))
    light = F.when(base["doc_id"] % 10 == 0, 1.0).otherwise(0.02)
    rows = base.select(F.col("source"), mixing.n_words(F.col("text")).alias("size"), (-F.log(mixing.uniform(F.col("doc_id"))) / light).alias("drawn"))
    for rest in (10.0, 20_000.0, 60_000.0):
        cut = mixing._cut(rows, spark.createDataFrame([("a", rest)], "of string, rest double"), 64, 3).collect()
        assert len(cut) == 1 and rows.where(F.col("drawn").between(cut[0]["low"], cut[0]["high"])).count() <= 6
        assert cut[0]["before"] == (rows.where(F.col("drawn") < cut[0]["low"]).agg(F.sum("size")).first()[0] or 0) <= rest


def test_mixed_repeats_rows(spark):
    d = docs(spark).withColumn("copies", F.lit("clash")).withColumn("size", F.lit("clash")).withColumn("bin", F.lit(1))
    plan = {r["doc_id"]: r["copies"] for r in mixing.mix(d).collect()}
    out = mixing.mixed(d)
    assert out.columns == d.columns
    got = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert got == {k: v for k, v in plan.items() if v}


def test_odd_rows_and_empty_tables(spark):
    got = mixing.mix(odd(spark)).collect()
    assert len(got) == 11 and all(r["size"] == 0 for r in got if r["doc_id"] in (2, 3, 4))
    assert mixing.mix(empty(spark)).count() == 0 and mixing.mixed(empty(spark)).count() == 0


def test_query_equals_oracle(spark):
    sf = "/root/testdata/sf0.001"
    assert_same(catalogue.op7_mixing(spark, sf), views(sf), mixing.ORACLE)
