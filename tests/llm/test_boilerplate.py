from helpers import empty, odd
from lodestone.llm import boilerplate as L
from lodestone.llm import catalogue
from oracle import assert_same, views
from pyspark.sql import functions as F


def test_ratio_is_of_the_host(spark):
    rows = [(i, f"Menu \nown line {i}\n\nshared", "big" if i < 400 else "small") for i in range(406)] + [(1000 + i, f"rare\nown {i}" if i < 4 else f"more {i}", "big") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r["text"] for r in L.drop_boilerplate(docs).collect()}
    assert got[3] == "own line 3\n" and got[401] == "own line 401\n"
    assert got[1001] == "rare\nown 1"  # four pages are too few


def test_copies_of_a_page_count_once(spark):
    docs = spark.createDataFrame([(i, "a page\nthat was copied", "s") for i in range(50)] + [(100 + i, f"other {i}", "s") for i in range(50)], "doc_id long, text string, source string")
    assert L.drop_boilerplate(docs, counts=True).where("n_dropped > 0").count() == 0


def test_odd_rows_and_empty_tables(spark):
    docs = odd(spark).withColumn("host", F.lit("clash")).withColumn("line", F.lit("clash")).withColumn("bad", F.lit(1)).withColumn("n_lines", F.lit("x"))
    got = {r["doc_id"]: r for r in L.drop_boilerplate(docs, counts=True).collect()}
    assert got[2]["text"] is None and got[3]["text"] == "" and got[4]["text"] == " \n\t " and got[4]["n_lines"] == 2
    assert L.drop_boilerplate(docs).columns == docs.columns and L.drop_boilerplate(docs).count() == 11
    assert L.drop_boilerplate(empty(spark)).count() == 0
    nulls = spark.createDataFrame([(i, f"same\nown {i}", None) for i in range(20)], "doc_id long, text string, source string")
    assert L.drop_boilerplate(nulls, counts=True).where("n_dropped = 1").count() == 20


def test_query_equals_oracle(spark):
    sf = "/root/testdata/sf0.001"
    assert_same(catalogue.op6_line_dedup(spark, sf), views(sf), L.ORACLE)


def test_null_rows_equal_the_oracle(spark, tmp_path):
    """A null text is no page of its host: with it, 5 of 500 pages would not pass the ratio of 1 %."""
    rows = [(i, f"seen\nown {i}" if i < 5 else f"own {i}", "a") for i in range(499)] + [(600, None, "a"), (601, None, None), (602, "", "a"), (602, "", "a"), (None, "seen", "a")]
    rows += [(700 + i, f"x{i % 9}\n\n y{i} ", None) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalogue.op6_line_dedup(spark, str(tmp_path))
    assert_same(got, views(str(tmp_path)), L.ORACLE)
    assert got.where("n_dropped > 0").count() > 60


def test_slots_hold_every_line(spark):
    """More boilerplate lines than slots: none is lost."""
    menu = "\n".join(f"item {k}" for k in range(3 * L.SLOTS))
    docs = spark.createDataFrame([(i, f"{menu}\nown {i}", "s") for i in range(20)], "doc_id long, text string, source string")
    assert {r["text"] for r in L.drop_boilerplate(docs).collect()} == {f"own {i}" for i in range(20)}
