import random
import re
import zlib
from collections import Counter

import pytest
from helpers import empty, odd
from lodestone.llm import variants as V
from pyspark.sql import functions as F


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def counted(rows, noise=97, least=5):
    out = Counter()
    for key, text in rows:
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", lowered):
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if noise and h % noise == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least:
                out[run] += 1
    return out


def brute(counts, least=3):
    """By comparing all pairs."""
    n = {w: c for w, c in counts.items() if c >= least}
    near = {w: [v for v in n if one_apart(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] is not None else None))
    return out


def rows_of(df):
    return {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def shaken(seed, n, letters="abcé"):
    r = random.Random(seed)
    base = ["".join(r.choice(letters) for _ in range(r.randrange(4, 9))) for _ in range(n)]
    return base + [w[: (i := r.randrange(len(w)))] + r.choice(["", r.choice(letters), w[i] + r.choice(letters)]) + w[i + 1 :] for w in base for _ in range(2)]


@pytest.mark.parametrize("most", [20_000, 12])
def test_pairs_equal_all_pairs(spark, most):
    """With small partitions too, where hot ones are cut again and again."""
    words = sorted({*shaken(1, 60), *shaken(2, 40, "ab"), "a" * 900, "a" * 901, "a" * 450 + "b" + "a" * 449, "x", "y", "xy", "abcde"})
    table = spark.createDataFrame([(w, len(w)) for w in words], "word string, n long")
    got = [(r["word"], r["near"], r["n"], r["near_n"]) for r in V.near_pairs(table, most).collect()]
    want = {(a, b, len(a), len(b)) for a in words for b in words if one_apart(a, b)}
    assert len(got) == len(set(got)) and set(got) == want


def test_batches_do_not_cut_partitions(spark, monkeypatch):
    monkeypatch.setattr(V, "JOINED_WORDS", 7)
    words = sorted(set(shaken(5, 50, "ab")))
    table = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        got = {(r["word"], r["near"]) for r in V.near_pairs(table).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {(a, b) for a in words for b in words if one_apart(a, b)}


def test_hot_prefix_is_cut(spark):
    words = [f"prefix{a}{b}{c}tail" for a in "abcdefgh" for b in "abcdefgh" for c in "abcdefgh"]
    table = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    sizes = V.partitions(table, 100).groupBy("key").agg(F.count("*").alias("n"), F.max(F.length("rest")).alias("rest")).collect()
    assert all(r["n"] <= 100 or r["rest"] <= 1 for r in sizes)
    assert V.near_pairs(table, 100).count() == 512 * 21


def test_rows_equal_brute_force(spark):
    r = random.Random(8)
    pool = shaken(11, 50)
    weights = [1 / (i + 1) for i in range(len(pool))]
    rows = [(i if i % 40 else None, " ".join(r.choices(pool, weights, k=60)).upper() + "Éa×bc÷ don't 12abcde34") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    counts = counted(rows)
    assert {(x["word"], x["n"]) for x in V.word_counts(docs).collect()} == set(counts.items())
    assert rows_of(V.variants(docs)) == brute(counts)
    dense = counted(rows, noise=3)
    assert rows_of(V.variants(docs, noise=3)) == brute(dense)


def test_chains_ties_and_roots(spark):
    text = " ".join(["aaaaa"] * 3 + ["aaaab"] * 6 + ["aaabb"] * 12 + ["aabbb"] * 24 + ["abbbb"] * 48 + ["zzzzz"] * 3 + ["zzzzy"] * 6 + ["zzzzx"] * 6 + ["lonely"] * 3 + ["twice"] * 2)
    rows = [(1, text)]
    got = rows_of(V.variants(spark.createDataFrame(rows, "doc_id long, text string"), noise=None))
    assert got == brute(counted(rows, noise=None))
    assert {(w, f, x) for w, f, x, *_ in got} >= {("aaaaa", "aaaab", "abbbb"), ("zzzzz", "zzzzx", "zzzzx"), ("lonely", None, "lonely")}


def test_handed_over_counts_add_up(spark, monkeypatch):
    monkeypatch.setattr(V, "HELD_WORDS", 5)
    rows = [(i, "alpha beta gamma delta epsilon zeta theta kappa lambda " * 3) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(x["word"], x["n"]) for x in V.word_counts(docs).collect()} == set(counted(rows).items())


def test_odd_rows_and_empty_tables(spark):
    docs = odd(spark).withColumn("word", F.lit("clash")).withColumn("n", F.lit("clash")).withColumn("root", F.lit(0))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert rows_of(V.variants(docs, noise=5, least_count=1)) == brute(counted(rows, noise=5), least=1)
    assert V.variants(empty(spark)).count() == 0
    assert V.variants(spark.createDataFrame([(1, None)], "doc_id long, text string")).count() == 0


def test_query_equals_brute_force(spark):
    from lodestone.llm.catalogue import queries

    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert rows_of(queries()["op13_variants"](spark, "/root/testdata/sf0.001")) == brute(counted(rows))
