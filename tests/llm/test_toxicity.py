import random

import numpy as np
from helpers import empty, odd, prose
from lodestone.llm import toxicity as X
from pyspark.sql import functions as F

BAD = ["grumbok", "snarfel", "plixon"]


def corpus(spark, n=900):
    """A third of label 1: two words or more of a lexicon, or of a stem with changing ends."""
    r = random.Random(3)
    docs, labels = [], []
    for i in range(n):
        words = prose(i, r.randrange(20, 60)).split()
        toxic = i % 3 == 0
        if toxic:
            for _ in range(r.randrange(2, 5)):
                words.insert(r.randrange(len(words)), r.choice(BAD) if i % 2 else "zurvex" + r.choice(["a", "um", "ior", "ens"]))
        elif r.random() < 0.03:
            words.insert(0, "zurvexa")
        docs.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = corpus(spark)
    got = X.toxicity(docs, labels.where("doc_id % 4 <> 1")).where("doc_id % 4 = 1").collect()
    wrong = [r["doc_id"] for r in got if r["predicted"] != (r["doc_id"] % 3 == 0)]
    assert len(wrong) <= 0.03 * len(got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)


def test_label_model_recovers_rates_and_correlations():
    rng = np.random.default_rng(5)
    truth = rng.random(4000) < 0.3
    rate = np.array([[0.02, 0.05, 0.01, 0.03, 0.03], [0.7, 0.6, 0.4, 0.5, 0.5]])
    votes = rng.random((4000, 5)) < np.where(truth[:, None], rate[1], rate[0])
    votes[:, 4] = votes[:, 3]  # one voter twice
    noisy = np.where(rng.random(4000) < 0.1, ~truth, truth).astype(float)
    posterior, rates, together = X.label_model(votes, noisy)
    assert np.abs(rates - rate).max() < 0.12
    assert together[3, 4] > 0.95 and abs(together[0, 1]) < 0.2
    assert ((posterior > 0.5) == truth).mean() > 0.9


def drawn(n, known, seed=6):
    """Votes of five voters, the last one like the fourth, and labels of the first ``known`` rows, a tenth of them wrong."""
    rng = np.random.default_rng(seed)
    truth = rng.random(n) < 0.3
    votes = rng.random((n, 5)) < np.where(truth[:, None], [0.7, 0.6, 0.4, 0.5, 0.5], [0.02, 0.05, 0.01, 0.03, 0.03])
    votes[:, 4] = votes[:, 3]
    labels = np.where(rng.random(n) < 0.1, ~truth, truth).astype(float)
    labels[known:] = np.nan
    return truth, votes, labels


def test_label_model_of_a_table_equals_rows_at_hand(spark):
    _, votes, labels = drawn(1500, 300)
    rows = [([int(k) for k in np.flatnonzero(v)], None if np.isnan(c) else float(c)) for v, c in zip(votes, labels)]
    patterns = spark.createDataFrame(rows, "votes array<int>, label double").groupBy("votes", "label").agg(F.count(F.lit(1)).alias("n")).repartition(3)
    posterior, rates, together = X.label_model(votes, labels)
    model = X.label_model_of(patterns, 5, np.nanmean(labels))
    assert np.allclose(model.rates, rates) and np.allclose(model.together, together)
    assert np.allclose(model.posterior(votes, labels), posterior)


def test_posterior_and_sums_equal_plain_bayes():
    """One round by loops: Bayes' rule over voters that fire, each to the power of its share of its correlated group."""
    _, votes, labels = drawn(200, 120)
    model = X.LabelModel(5, 0.3)
    model.maximised(model.expected(votes, labels, np.ones(200)))
    rates, alike, wanted = model.rates, [sum(t for t in model.together[v] if t > X.CORRELATED) for v in range(5)], []
    for v, c in zip(votes, labels):
        one, zero = 0.3, 0.7
        for k in np.flatnonzero(v):
            one, zero = one * rates[1][k] ** (1 / alike[k]), zero * rates[0][k] ** (1 / alike[k])
        if c == 1:
            one, zero = one * X.TRUST[1], zero * X.TRUST[0]
        elif c == 0:
            one, zero = one * (1 - X.TRUST[1]), zero * (1 - X.TRUST[0])
        wanted.append(one / (one + zero))
    assert 1.8 < alike[4] < 2.2 and np.allclose(model.posterior(votes, labels), wanted)
    sums = model.expected(votes, labels, np.full(200, 2.0))
    for a in range(5):
        for b in range(5):
            both = [i for i in range(200) if votes[i, a] and votes[i, b]]
            assert np.allclose(sums[:, a, b], [2 * sum(1 - wanted[i] for i in both), 2 * sum(wanted[i] for i in both)])
    assert np.allclose(sums[1, 5, 5], 2 * sum(wanted)) and np.allclose(sums[1, 7, 7], 2 * sum(w for w, c in zip(wanted, labels) if c == 1))


def test_texts_without_labels_tell_how_good_voters_are():
    off = []
    for seed in range(5):
        truth, votes, labels = drawn(6000, 80, seed)
        rate = np.array([votes[~truth].mean(axis=0), votes[truth].mean(axis=0)])
        off.append([np.abs(X.label_model(v, c)[1] - rate).mean() for v, c in ((votes, labels), (votes[:80], labels[:80]))])
    with_them, without = np.mean(off, axis=0)
    assert with_them < 0.75 * without


def test_equal_voters_are_one():
    rows = [np.arange(10), np.arange(10), np.arange(5, 20), np.array([], dtype=int)]
    assert X.chosen_voters(rows, 30, 5) == [0, 2]


def test_sample_is_bounded(spark):
    docs, labels = corpus(spark, 300)
    assert len(X.fit(docs, labels, sample=100)["truth"]) == 100


def test_repeated_documents_stand_once_for_their_key(spark):
    docs, labels = corpus(spark, 300)
    one = docs.where("doc_id = 7")
    for _ in range(5):
        one = one.union(one)
    fitted = X.fit(docs.union(one), labels, sample=300)
    assert len(fitted["truth"]) == 300 and fitted["truth"].sum() == 100


def test_features_are_read_once_with_the_same_scores(spark):
    docs, labels = corpus(spark, 300)
    more = docs.withColumn("has", F.lit("x")).withColumn("row", F.lit(2)).unionByName(odd(spark).withColumn("has", F.lit(None)).withColumn("row", F.lit(3)))
    model = X.fit(more, labels)
    one = X.toxicity(more, labels, keep=["doc_id", "row", "has"])
    two = X.score(more, model, keep=["doc_id", "row", "has"])
    assert one.columns == two.columns and one.count() == 311
    order = lambda df: sorted(((r["doc_id"] or -1, r["row"], r["score"], r["predicted"]) for r in df.collect()))
    assert np.allclose(order(one), order(two))
    assert np.all(np.diff(model["trust"]) > 0) and len(model["posterior"]) == 300


def test_odd_rows_and_empty_tables(spark):
    docs, labels = corpus(spark, 300)
    model = X.fit(docs, labels)
    clash = odd(spark).withColumn("score", F.lit("clash")).withColumn("k", F.lit(1)).withColumn("toxic", F.lit(1))
    got = X.score(clash, model).collect()
    assert len(got) == 11 and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (2, 3, 4)}) == 1
    assert X.score(empty(spark), model).count() == 0
    none = X.toxicity(odd(spark), labels.limit(0)).collect()
    assert len(none) == 11 and all(r["predicted"] == 0 for r in none)
    repeats = labels.union(labels).union(spark.createDataFrame([(None, 1, 1), (5, 1, None)], labels.schema))
    assert np.allclose(X.fit(docs, repeats)["weights"], model["weights"])
