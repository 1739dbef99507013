import collections
import math
import random
import zlib

import numpy as np
import pytest
from helpers import WORDS, empty, odd, prose
from lodestone.llm import catalogue, scoring
from pyspark.sql import functions as F

END = b"\0end"


def tokens(text):
    return (text or "").encode().lower().split() + [END]


def brute(rows, training):
    """Base scores, and exact Witten-Bell bigram scores."""
    count, pairs, followers, texts = collections.Counter(), collections.Counter(), collections.defaultdict(set), 0
    for text in training:
        w, texts = tokens(text), texts + 1
        count.update(w)
        for a, b in zip([None, *w], w):
            pairs[a, b] += 1
            followers[a].add(b)
    n, v, out = sum(count.values()), len(count), []
    for text in rows:
        w, base, full = tokens(text), 0.0, 0.0
        for a, b in zip([None, *w], w):
            p = (count[b] + 0.5) / (n + 0.5 * (v + 1))
            base += math.log10(p)
            c, t = (texts if a is None else count[a]), len(followers.get(a, ()))
            if c:
                p = (pairs[a, b] + t * p) / (c + t)
            full += math.log10(p)
        out.append((len(w), sum(count[x] > 0 for x in w), n, base, full))
    return out


def chained(seed: int, n: int) -> str:
    """Each word is one of two that may follow the one before."""
    r, at, out = random.Random(seed), seed % len(WORDS), []
    for _ in range(n):
        at = (3 * at + r.randrange(2)) % len(WORDS)
        out.append(WORDS[at])
    return " ".join(out)


def test_scores_follow_brute_force(spark):
    texts = [chained(k, 80) for k in range(60)] + [prose(3, 80), "new words here", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in scoring.score(docs, docs.where("doc_id % 4 <> 0")).collect()}
    want = brute(texts, [t for i, t in enumerate(texts) if i % 4])
    for i, (n, known, total, base, full) in enumerate(want):
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert abs(r["score"] - full) < 0.12 * n + 0.2  # counts are quantised
    held = [i for i in range(0, 60, 4)]
    assert sum(got[i]["score"] for i in held) > sum(got[i]["base_score"] for i in held)


def brute_levels(rows, training, order, base):
    """Witten-Bell scores of any order, from counts that are kept as levels: what the filter would give without any false
    positive. The unigram is exact."""
    quantised = lambda c: float(scoring.count_at(scoring.levels_of(np.array([c]), base), base)[0]) if c else 0.0
    unigrams, grams, followers, texts = collections.Counter(), [collections.Counter() for _ in range(order + 1)], [collections.defaultdict(set) for _ in range(order + 1)], len(training)
    row = lambda t: [None] * (order - 1) + tokens(t)
    for text in training:
        w = row(text)
        unigrams.update(w[order - 1 :])
        for i in range(order - 1, len(w)):
            for k in range(2, order + 1):
                h = tuple(w[i - k + 1 : i])
                grams[k][h, w[i]] += 1
                followers[k][h].add(w[i])
    n, v, out = sum(unigrams.values()), len(unigrams), []
    for text in rows:
        w, total = row(text), 0.0
        before = {}
        for i in range(order - 1, len(w)):
            p = (unigrams[w[i]] + 0.5) / (n + 0.5 * (v + 1))
            first = i == order - 1
            seen = texts if first else unigrams[w[i - 1]]
            now = {}
            for k in range(2, order + 1):
                h = tuple(w[i - k + 1 : i])
                whole = min(quantised(grams[k][h, w[i]]), seen)
                level = len(followers[k].get(h, ()))
                others = min(max(quantised(level) if scoring.levels_of(np.array([max(level, 1)]), base)[0] >= 2 else 0.0, 1.0), max(seen, 1.0))
                if seen > 0:
                    p = (whole + others * p) / (seen + others)
                now[k] = whole
                seen = texts if first else before[k]
            before = now
            total += math.log10(p)
        out.append(total)
    return out


def second_order(seed: int, n: int) -> str:
    """The next word follows from the two before, and hardly from one."""
    r, out = random.Random(seed), [WORDS[seed % len(WORDS)], WORDS[seed * 7 % len(WORDS)]]
    while len(out) < n:
        i, j = WORDS.index(out[-2]), WORDS.index(out[-1])
        out.append(WORDS[(i * 3 + j * 5 + r.randrange(2)) % len(WORDS)])
    return " ".join(out)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_scores_of_any_order_equal_brute_force(spark, order):
    """With so many bits that no absent n-gram is taken for one that was seen, scores are exact, at the default order too;
    and texts in which two words tell the third are likelier under trigrams than under bigrams."""
    texts = [second_order(k, 60) for k in range(50)] + [prose(3, 80), "new words here", None, "", "one", "ONE one"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    training = [t for i, t in enumerate(texts) if i % 4]
    got = {r["doc_id"]: r["score"] for r in scoring.score(docs, docs.where("doc_id % 4 <> 0"), order=order, bits=256).collect()}
    want = brute_levels(texts, training, order, scoring.BASE)
    assert all(got[i] == pytest.approx(w, rel=1e-9) for i, w in enumerate(want))
    if order == 3:
        plain = brute_levels(texts, training, 2, scoring.BASE)
        assert sum(want[i] for i in range(0, 50, 4)) > sum(plain[i] for i in range(0, 50, 4)) * 0.8


def test_false_positives_hardly_matter(spark):
    """At the registered bits, the corpus scores within 2 % of what it scores without false positives."""
    texts = [second_order(k, 60) for k in range(80)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    train = docs.where("doc_id % 4 <> 0")
    few, many = ({r["doc_id"]: r["score"] for r in scoring.score(docs, train, **how).collect()} for how in ({}, {"bits": 256}))
    assert abs(sum(few.values()) - sum(many.values())) < 0.02 * abs(sum(many.values()))


@pytest.mark.parametrize("order", [2, 3])
def test_passes_agree_with_one(spark, order):
    docs = spark.createDataFrame([(i, prose(i, 50)) for i in range(40)], "doc_id long, text string")
    whole = {r["doc_id"]: r["score"] for r in scoring.score(docs, docs, order=order).collect()}
    cut = {r["doc_id"]: r["score"] for r in scoring.score(docs, docs, order=order, max_broadcast=6000).collect()}
    assert whole == cut
    dealt = {r["doc_id"]: r["score"] for r in scoring.score(docs, docs, order=order, max_broadcast=6000, max_mapped=0).collect()}
    assert whole == dealt
    twice = {r["doc_id"]: r["score"] for r in scoring.score(docs, docs, order=order, max_broadcast=6000).collect()}
    assert whole == twice


def test_contexts_are_probed_once_and_levels_over_all_pieces(spark, monkeypatch):
    """Each key has the level that it has when probed alone; the followers of a context are probed once for all its
    n-grams, and the steps do not grow with the number of pieces. Null, empty and repeated texts are among the rows."""
    docs = odd(spark).unionByName(spark.createDataFrame([(100 + i, prose(i % 9, 50), "en", "a", 0) for i in range(40)], odd(spark).schema))
    n_buckets = 16
    model = scoring._segments(scoring._ngram_blocks(docs, "text", 3, n_buckets), scoring.BASE, 12).collect()
    texts = [*(r["text"] or "" for r in docs.collect()), "words never seen"]
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    words = scoring.WordHasher().words(np.frombuffer("".join(texts).encode(), dtype=np.uint8), offsets)
    keys = scoring.distinct(np.concatenate(scoring.Tokens(words, 3).keys))
    contexts = keys >> scoring._FOLLOWER_BITS << scoring._FOLLOWER_BITS
    steps, slots = [], scoring._slots
    monkeypatch.setattr(scoring, "_slots", lambda k, level, sizes: steps.append(k) or slots(k, level, sizes))

    def found(n_pieces):
        cuts = scoring._cuts(n_buckets, n_pieces)
        pieces = [scoring.Piece([r for r in model if low <= r["bucket"] < high], low, high, n_buckets) for low, high in zip(cuts.tolist(), [*cuts[1:].tolist(), n_buckets])]
        steps.clear()
        got = scoring._levels([(pieces[p], x, y) for p, x, y in scoring._by_piece(keys, cuts, n_buckets)], keys)
        return [x.tolist() for x in got], [len(k) for k in steps]

    whole = scoring.Piece(model, 0, n_buckets, n_buckets)

    def alone(key, bucket, level):
        segment = whole.words[whole.begins[bucket] :][: whole.sizes[bucket]]
        last = 0
        while len(segment):
            at, mask = slots(np.array([key]), level, np.array([len(segment)]))
            if segment[at[0]] & mask[0] != mask[0]:
                break
            last, level = level, level + 1
        return last

    of = scoring._buckets(keys, n_buckets).tolist()
    want = [[alone(k, b, 1) for k, b in zip(keys, of)], [alone(c ^ scoring._FOLLOWERS, b, 2) for c, b in zip(contexts, of)]]
    got, asked = found(1)
    assert got == want and min(want[0]) == 0 and max(want[1]) > 2
    assert len(np.unique(contexts)) in asked and len(np.unique(contexts)) < len(keys)
    assert found(8) == (got, asked)
    assert [len(x) for x in scoring._levels([(whole, 0, 0)], keys[:0])] == [0, 0]


def test_levels_only_grow():
    counts = np.arange(1, 5000)
    levels = scoring.levels_of(counts, 1.5)
    assert (np.diff(levels) >= 0).all() and levels[0] == 1
    assert np.abs(np.log(scoring.count_at(levels, 1.5) / counts)).max() < 0.7


def test_odd_rows_and_empty_tables(spark):
    got = scoring.score(odd(spark), odd(spark)).collect()
    assert len(got) == 11 and all(math.isfinite(r["score"]) for r in got)
    assert {r["n_tokens"] for r in got if r["doc_id"] in (2, 3, 4)} == {1}
    assert len({r["score"] for r in got if r["doc_id"] == 9}) == 1
    assert scoring.score(empty(spark), empty(spark)).count() == 0
    assert scoring.score(odd(spark), empty(spark)).where("train_tokens <> 0 or n_known <> 0").count() == 0
    clash = odd(spark).withColumn("key", F.lit(1)).withColumn("score", F.lit("x")).withColumn("id", F.lit(2))
    assert scoring.score(clash, clash).columns == ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


def test_held_out_by_crc(spark):
    got = catalogue.op1_lm_scores(spark, "/root/testdata/sf0.001").select("doc_id", "held_out").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1) for r in got)
