import collections
import random
import re

import numpy as np
import pytest
from helpers import empty, odd, prose
from lodestone.llm import outliers as Q
from pyspark.sql import functions as F

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    s = text or ""
    w = WORD.findall(s)
    at, covered = collections.defaultdict(list), set()
    for i in range(len(w) - 7):
        at[tuple(w[i : i + 8])].append(i)
    for places in at.values():
        if len(places) > 1:
            covered.update(k for p in places for k in range(p, p + 8))
    lines = [x for x in s.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(s.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_measures_equal_brute_force(spark):
    r = random.Random(6)
    texts = [prose(i, r.randrange(0, 50)) for i in range(40)] + [" ".join(r.choice("ab") for _ in range(r.randrange(60))) for _ in range(60)]
    texts += ["a b c d e f g h\na b c d e f g h\n\n \n#é|", "one two " * 200, "x\r\ny\x0bz\x1cq"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in Q.measured(docs).collect():
        assert (row["n_words"], row["word_chars"], row["n_symbols"], row["n_dup_lines"], row["n_repeat_words"]) == brute(texts[row["doc_id"]])


def test_windows_that_repeat_are_found_through_smaller_ones(spark):
    """Texts at the edge of each gate: 7 and 8 words again, overlapping windows, many repeated words, pairs or fours and no
    repeated window; nulls, empty texts and repeated keys. The text itself is searched for capitals and symbols once."""
    w = [f"w{i}" for i in range(40)]
    texts = [w[:k] + ["x"] + w[:k] for k in (3, 6, 7, 8, 9, 12)] + [["a"] * k for k in (7, 8, 9, 10, 17)] + [w[:8] * 2, w[:8] * 2 + ["y"], w[:7] * 2, w[:4] * 2, ["a", "b", "c"] * 6, w[:8]]
    texts += [w[:2] + [str(i)] + w[:2] + [str(-i)] for i in range(3)] + [[x for i in range(9) for x in (*w[:2], f"n{i}")], [x for i in range(9) for x in (*w[:5], f"n{i}")], [x for i in range(3) for x in (*w[:9], f"n{i}")]]
    texts = [" ".join(x) for x in texts] + [None, "", " \n\t", "É$ A\u00a0B", "#" * 9, "\r\n \x0b\f\nQ\nQ\n \tQ", "\U0001f600 Z\U0001f600%"]
    docs = spark.createDataFrame([*((i // 2, t) for i, t in enumerate(texts)), (None, "A b"), (None, "A b")], "doc_id long, text string")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_capitals")
    got = Q.measured(docs)
    want = [(k, *brute(t), len(re.findall("[A-Z]", t or ""))) for k, t in [*((i // 2, t) for i, t in enumerate(texts)), (None, "A b"), (None, "A b")]]
    assert collections.Counter((r["doc_id"], *(r[n] for n in names)) for r in got.collect()) == collections.Counter(want)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "translate(" not in plan and len(re.findall(r"regexp_replace\(coalesce", plan)) == 1


def corpus(spark):
    r = random.Random(8)
    rows = []
    for i in range(400):
        text = prose(i, r.randrange(30, 90))
        if i % 20 == 0:
            text = " ".join(w + "###%%%" for w in text.split())
        rows.append((i, text, "en" if i % 2 else "fr", "s", 0))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_symbol_soup_is_rejected_and_prose_kept(spark):
    got = Q.quality(corpus(spark)).collect()
    assert all(r["kept"] == (r["doc_id"] % 20 != 0) for r in got)


@pytest.mark.parametrize("share", [20, 35, 40, 45])
@pytest.mark.parametrize("kind", ["soup", "shout", "mixed"])
def test_junk_is_rejected_up_to_nearly_half(spark, share, kind):
    """One cell of 300 texts: all junk goes and all prose stays, whatever share of the texts is junk of one kind or two."""
    made = {"soup": lambda t: " ".join(w + "###%%%" for w in t.split()), "shout": lambda t: t.upper()}
    r, rows = random.Random(share), []
    for i in range(300):
        text = prose(i, r.randrange(30, 90))
        junk = i % 100 < share
        rows.append((i, made[kind if kind != "mixed" else ("soup", "shout")[i % 2]](text) if junk else text, "en", "s", 0))
    got = Q.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()
    assert {r["doc_id"] for r in got if not r["kept"]} == {i for i in range(300) if i % 100 < share}


def test_an_unfinished_fit_says_so(spark, monkeypatch):
    monkeypatch.setattr(Q, "MOST_STEPS", 1)
    monkeypatch.setattr(Q, "TOLERANCE", -1.0)
    with pytest.warns(RuntimeWarning, match="still move"):
        Q.quality(corpus(spark)).count()


def test_fit_equals_numpy(spark):
    """The same concentration steps in numpy end at the same distances (medians and limits are exact on small cells)."""
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (300, Q.DIMS)) * [0.3, 0.1, 0.2, 0.1, 0.2]
    x[:30] += 3
    rows = spark.createDataFrame([("c", *map(float, v)) for v in x], "cell string, " + ", ".join(f"x{i} double" for i in range(Q.DIMS)))
    fit = Q._fit(rows).first()
    floor = np.diag(np.square(Q.FLOORS))

    def exact(values, share):  # the smallest value that at least this share of rows do not exceed
        return np.sort(values)[max(0, int(np.ceil(share * len(values))) - 1)]

    middle = np.array([exact(x[:, i], 0.5) for i in range(Q.DIMS)])
    off = np.array([exact(np.abs(x[:, i] - middle[i]), 0.5) for i in range(Q.DIMS)])
    starts, moved, last = [(middle, np.diag((1.4826 * off) ** 2) + floor), (x.mean(0), np.cov(x.T, bias=True) + floor)], np.inf, None
    while moved > Q.TOLERANCE:
        for k, (m, c) in enumerate(starts):
            d2 = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
            near = x[d2 <= exact(d2, Q.SUBSET)]
            starts[k] = near.mean(0), Q.CONSISTENT * np.cov(near.T, bias=True) + floor
        now = np.array([np.linalg.slogdet(c)[1] for _, c in starts])
        moved, last = np.inf if last is None else np.abs(now - last).max(), now
    best = min((np.linalg.det(c), m) for m, c in starts) if last[0] != last[1] else (np.linalg.det(starts[0][1]), starts[0][0])
    assert np.allclose([fit[f"m{i}"] for i in range(Q.DIMS)], best[1], atol=1e-6)
    assert np.isclose(fit["log_det"], np.log(best[0]), atol=1e-6)


def test_moments_within_a_limit(spark):
    """As those of the rows that a filter keeps, with null values and a cell that has none within. The distance is not
    written out again in a condition, and its method is short enough for the JVM to compile it (8,000 bytes)."""
    rng = np.random.default_rng(3)
    x = ", ".join(f"x{i} double" for i in range(Q.DIMS))
    rows = [(c, *map(float, v)) for c in "ab" for v in rng.normal(0, 1, (60, Q.DIMS))] + [("b", None, 1.0, 2.0, 3.0, 4.0), ("c", *[9.0] * Q.DIMS), (None, *[0.0] * Q.DIMS)]
    cells = [(c, *[0.1] * Q.DIMS, *[1.0 if i == j else 0.2 for i, j in Q._PAIRS]) for c in "abc"]
    fits = spark.createDataFrame(cells, "cell string, " + ", ".join([f"m{i} double" for i in range(Q.DIMS)] + [f"l{i}{j} double" for i, j in Q._PAIRS]))
    near = Q._with_distance(spark.createDataFrame(rows, f"cell string, {x}").join(F.broadcast(fits), "cell"))
    got = Q._moments_within(near, F.lit(6.0), ["cell"], F.count("cell").alias("n"))
    plain = near.where("d2 <= 6.0").select("cell", *Q._X).groupBy("cell").agg(*Q._moments())
    now, then = sorted(map(tuple, got.drop("n").collect())), sorted(map(tuple, plain.collect()))
    assert [r[0] for r in now] == [r[0] for r in then] and np.allclose([r[1:] for r in now], [r[1:] for r in then], rtol=1e-12, atol=0)
    assert {r["cell"]: r["n"] for r in got.collect()} == {"a": 60, "b": 61}
    got.collect()
    out = got._sc._jvm.PythonSQLUtils.explainString(got._jdf.queryExecution(), "codegen")
    assert max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", out))) < 8000


def test_odd_rows_and_empty_tables(spark):
    docs = odd(spark).withColumn("cell", F.lit("clash")).withColumn("d2", F.lit(1)).withColumn("n_words", F.lit("clash"))
    got = Q.quality(docs).collect()
    assert len(got) == 11
    by = {r["doc_id"]: r for r in got}
    assert all(by[k]["base_failed"] and not by[k]["kept"] and by[k]["n_words"] == 0 for k in (2, 3, 4))
    assert by[1]["kept"] and by[1]["distance"] is None  # too few rows to fit
    assert by[8]["n_words"] == 1 and by[8]["base_failed"]
    assert Q.quality(empty(spark)).count() == 0
    one = spark.createDataFrame([(i, prose(1, 40), None, None, 0) for i in range(80)], "doc_id long, text string, lang string, source string, n_chars long")
    assert Q.quality(one).where("kept").count() == 80  # no spread at all
