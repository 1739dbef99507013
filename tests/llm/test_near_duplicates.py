import random

import numpy as np
import pytest
from helpers import WORDS, empty, odd, prose
from lodestone.llm import near_duplicates as N
from lodestone.llm.components import connected
from lodestone.llm.textblocks import WordHasher
from pyspark.sql import functions as F


def shingles(text, width=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute(texts, percent):
    """Smallest reachable id by comparing all pairs."""
    sets, up = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def top(i):
        return i if up[i] == i else top(up[i])

    ids = sorted(texts)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in ids}


def copies(n, seed=7):
    """A base text with chains of small edits, copies and strangers."""
    r = random.Random(seed)
    out, current = {}, prose(1, 120).split()
    for i in range(n):
        kind = r.random()
        if kind < 0.25:
            out[i] = prose(1000 + i, r.randrange(1, 150))
        elif kind < 0.4 and out:
            out[i] = out[r.choice(list(out))]
        else:
            current = list(current)
            for _ in range(r.randrange(3)):
                current[r.randrange(len(current))] = r.choice(WORDS)
            out[i] = " ".join(current)
    return out


@pytest.mark.parametrize("percent", [80, 85])
def test_components_equal_brute_force(spark, percent):
    texts = copies(300)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.near_duplicates(docs, percent=percent).collect()}
    assert got == brute(texts, percent)


def test_groups_larger_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 8)
    monkeypatch.setattr(N, "BLOCK_SHINGLES", 2000)
    texts = copies(150, seed=3)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.near_duplicates(docs, percent=85).collect()}
    assert got == brute(texts, 85)


def test_many_survivors_are_verified_by_matrix():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 62, 60, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(60) < 0.9], rng.integers(0, 1 << 62, 3, dtype=np.uint64)])) for _ in range(80)]
    i, j = np.triu_indices(80, 1)
    forest = N.verified(sets, i, j, np.zeros(len(i)), 80)
    few = N.Forest(80)
    for a, b in zip(i, j):
        both = len(np.intersect1d(sets[a], sets[b]))
        if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            few.link(a, b)
    assert [forest.top(k) for k in range(80)] == [few.top(k) for k in range(80)]


def test_posterior_bounds():
    looks = N.least_matches(85, 180, 1e-6)
    assert looks[-1][0] == 180 and all(0 < m < n for n, m in looks)
    bands, rows = N.plan(85)
    assert (1 - 0.85**rows) ** bands <= 1e-6


def test_word_hashes_split_like_bytes():
    texts = ["A b\x0bC", "", "é\x1cE  x", " y "]
    raw = "".join(texts).encode()
    ends = np.cumsum([0] + [len(t.encode()) for t in texts])
    words = WordHasher().words(np.frombuffer(raw, dtype=np.uint8), ends)
    assert np.diff(words.first).tolist() == [len(t.encode().split()) for t in texts]


def test_odd_rows_and_empty_tables(spark):
    got = N.near_duplicates(odd(spark).withColumn("id", F.lit("clash")).withColumn("h", F.lit(1)), percent=85).collect()
    assert len(got) == 11
    by = {r["doc_id"]: r for r in got}
    assert all(by[k]["n_shingles"] == 0 and by[k]["component_id"] == k and by[k]["kept"] for k in (2, 3, 4))
    assert by[5]["component_id"] == 1 and not by[5]["kept"] and by[6]["n_shingles"] == 1
    assert not by[None]["kept"]
    assert N.near_duplicates(empty(spark)).count() == 0
    kept = N.one_of_each(odd(spark))
    assert kept.columns == odd(spark).columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "2", "3", "4", "6", "7", "8", "9", "None"])


def test_components_of_a_long_chain(spark):
    edges = spark.range(1, 200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).union(spark.createDataFrame([(500, 500), (700, 600)], "a long, b long"))
    got = {r["id"]: r["component"] for r in connected(edges).collect()}
    assert got == {i: 1 for i in range(1, 201)} | {600: 600, 700: 600}
