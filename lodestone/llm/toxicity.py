"""Toxicity by weak supervision.

1. Voters. From a bounded sample of labelled training rows, words (a lexicon) and word beginnings (patterns), each seen
   once, several times or densely, that are far more frequent in rows of label 1 become voters: each votes for a text
   that has it, else abstains.
2. Label model. A generative model with two classes gives each voter a firing rate per class (its accuracy) by
   expectation maximisation over all texts, those without a label included. Where there is a label, it is one more voter,
   whose accuracy is estimated like the others'. The balance of the classes is that of the labels, and a voter that
   abstains tells nothing. Voters that fire together within a class are not independent evidence: their correlations
   within classes are estimated too, and each vote is divided by the number of votes that its correlated group amounts to.
   Texts count by their sets of votes; a round is one job over the distinct sets, whose sums for pairs of voters (VOTERS
   squared) are all that comes back.
3. Classifier. A logistic regression over the features is trained on the posterior labels of the sample, and its output
   is calibrated on the labels of the training rows. Only this linear model scores texts.

What is fitted on the driver is bounded by SAMPLE rows, FEATURES features and VOTERS voters; every text is scored in
place, with the weights broadcast. Labels, languages, sources and ids are never inputs of a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.textblocks import slices
from lodestone.session import staged

#: Labelled rows that are used, at most.
SAMPLE = 20_000
#: Features and voters, at most.
FEATURES, VOTERS = 3000, 200
BEGINNINGS = range(3, 11)
#: Rows of label 1 that must have a feature, at least, and how many times likelier it is there.
LEAST_ROWS, LEAST_LIFT = 5, 6.0
#: Correlation within classes from which votes share their evidence: below, it comes from subjects or languages that
#: some voters have in common, not from voters that look at the same thing.
CORRELATED = 0.6
#: How often a label of 1 is given in either class, before it is estimated.
TRUST = (0.05, 0.95)
#: Rounds of the label model, at most, and the change of rates and balance below which it ends.
ROUNDS, STILL = 30, 2e-3
CUT = 0.3
#: Words whose features a task remembers.
CACHED_WORDS = 100_000
#: Of how many hundred words one must have a feature, for its third level.
DENSE = 100
_WORD = re.compile(r"\w+")


def word_features(word: str) -> list[str]:
    """A word as such, and its beginnings."""
    return ["=" + word, *(word[:n] for n in BEGINNINGS if n <= len(word))]


def words_of(text: str | None) -> Counter:
    return Counter(_WORD.findall((text or "").lower()))


def level(count: int, n_words: int) -> int:
    """1 for a single word of a text, 2 for several, 3 for several that are also a hundredth of its words."""
    return 1 if count < 2 else 3 if count * DENSE >= n_words else 2


def mined(sample: DataFrame) -> list[tuple[str, int, int]]:
    """(feature, rows of label 1, rows of label 0) of the features that tell label 1, best first. sample: (text, toxic)."""

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            have = (Counter(), Counter())
            for text, toxic in zip(part["text"], part["toxic"]):
                words, hits = words_of(text), Counter()
                for w, n in words.items():
                    for f in word_features(w):
                        hits[f] += n
                total = words.total()
                have[int(toxic == 1)].update(f"{k}{f}" for f, n in hits.items() for k in range(1, level(n, total) + 1))
            names = list(have[0].keys() | have[1].keys())
            yield pd.DataFrame({"feature": names, "one": [have[1][n] for n in names], "zero": [have[0][n] for n in names]})

    ones, zeros = sample.agg(F.count(F.when(F.col("toxic") == 1, 1)), F.count(F.when(F.col("toxic") != 1, 1))).first()
    if not ones or not zeros:
        return []
    counts = sample.mapInPandas(count, "feature string, one long, zero long").groupBy("feature").agg(F.sum("one").alias("one"), F.sum("zero").alias("zero"))
    lift = ((F.col("one") + 0.5) / (ones + 1)) / ((F.col("zero") + 0.5) / (zeros + 1))
    told = counts.where(F.col("one") >= LEAST_ROWS).where(lift >= LEAST_LIFT)
    rows = told.select("feature", "one", "zero").orderBy((F.col("one") * F.log(lift)).desc(), "feature").limit(FEATURES).collect()
    return [(r["feature"], r["one"], r["zero"]) for r in rows]


class Finder:
    """Indices of the features that a text has: each is a word or beginning, after the level that it must reach."""

    def __init__(self, features: list[str]):
        self.levels: dict[str, list[tuple[int, int]]] = {}
        for i, f in enumerate(features):
            self.levels.setdefault(f[1:], []).append((int(f[0]), i))
        self.seen: dict[str, tuple[str, ...]] = {}

    def find(self, text: str | None) -> np.ndarray:
        words, seen, hits = words_of(text), self.seen, {}
        for w, n in words.items():
            fits = seen.get(w)
            if fits is None:
                fits = tuple(f for f in word_features(w) if f in self.levels)
                if len(seen) >= CACHED_WORDS:
                    seen.clear()
                seen[w] = fits
            for f in fits:
                hits[f] = hits.get(f, 0) + n
        total = words.total()
        found = [i for f, n in hits.items() for k, i in self.levels[f] if k <= level(n, total)]
        return np.array(sorted(found), dtype=np.int64)


class LabelModel:
    """Two classes, voters with a firing rate in each, and the label as one more voter where it is known."""

    def __init__(self, n_voters: int, share: float):
        self.share = float(np.clip(share, 1e-4, 1 - 1e-4))
        self.rates, self.together = np.full((2, n_voters), 0.5), np.eye(n_voters)
        self.evidence, self.trust = np.zeros(n_voters), np.array(TRUST)
        self.bias, self.started = math.log(self.share / (1 - self.share)), False

    def posterior(self, votes: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """Of class 1. votes: (rows, voters) of 0 and 1; labels: 0, 1 or nan."""
        told = np.log(np.array([(1 - self.trust[1]) / (1 - self.trust[0]), self.trust[1] / self.trust[0]]))
        given = np.where(np.isnan(labels), 0, told[(labels == 1).astype(int)])
        return 1 / (1 + np.exp(-np.clip(votes @ self.evidence + given + self.bias, -40, 40)))

    def expected(self, votes: np.ndarray, labels: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Of rows that stand for n texts each, for each class a matrix of one row and column more than voters: texts in
        which two voters fire together (on the diagonal: one fires); last, texts, texts with a label, and with label 1.
        Before the start, the labels are the classes, and texts without one do not count."""
        known = ~np.isnan(labels)
        votes, n = votes.astype(float), n * (1 if self.started else known)
        one = self.posterior(votes, labels) if self.started else np.nan_to_num(labels)
        m = votes.shape[1]
        out = np.zeros((2, m + 3, m + 3))
        for c, weight in enumerate((n * (1 - one), n * one)):
            out[c, :m, :m] = (votes.T * weight) @ votes
            out[c, m, m], out[c, m + 1, m + 1], out[c, m + 2, m + 2] = weight.sum(), weight[known].sum(), weight[known] @ labels[known]
        return out

    def maximised(self, sums: np.ndarray) -> float:
        """Take the parameters that the sums of expected() make likeliest; returns by how much they changed."""
        m, before = len(self.evidence), self.rates
        self.rates, self.together = np.empty((2, m)), np.zeros((m, m))
        for c in (0, 1):
            total, fired = sums[c, m, m], np.diag(sums[c])[:m]
            r = self.rates[c] = (fired + 0.5) / (total + 1)
            off = sums[c, :m, :m] - np.outer(r, fired) - np.outer(fired, r) + total * np.outer(r, r)
            spread = np.sqrt(np.maximum(np.diag(off), 1e-9))
            self.together += (self.share if c else 1 - self.share) * off / np.outer(spread, spread)
            if self.started:
                self.trust[c] = (sums[c, m + 2, m + 2] + 0.5) / (sums[c, m + 1, m + 1] + 1)
        np.fill_diagonal(self.together, 1)
        alike = np.where(self.together > CORRELATED, self.together, 0).sum(axis=1)
        self.evidence = np.log(self.rates[1] / self.rates[0]) / alike
        moved = np.abs(self.rates - before).max(initial=0)
        if self.started:  # the prior moves until the classes have the share of the labels
            zero, one = np.maximum(sums[:, m, m], 1e-9)
            short = math.log(self.share / (1 - self.share)) - math.log(one / zero)
            self.bias += short
            moved = max(moved, abs(short) * self.share)
        self.started = True
        return moved


def label_model(votes: np.ndarray, labels: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The label model of rows at hand. votes: (rows, voters) of 0 and 1; labels: 0, 1 or nan. Gives the posterior of class
    1, the firing rates (2, voters) and the correlations within classes (voters, voters)."""
    labels = labels.astype(float)
    model = LabelModel(votes.shape[1], np.nanmean(labels))
    for k in range(rounds + 1):
        if model.maximised(model.expected(votes, labels, np.ones(len(votes)))) < STILL and k:
            break
    return model.posterior(votes, labels), model.rates, model.together


def label_model_of(patterns: DataFrame, n_voters: int, share: float, rounds: int = ROUNDS) -> LabelModel:
    """The label model of all texts. patterns: (votes, label, n), the texts that have this set of votes and this label.
    A round adds the sums up where the rows are."""
    model = LabelModel(n_voters, share)

    def summed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((2, n_voters + 3, n_voters + 3))
        for part in parts:
            for at in range(0, len(part), 4096):
                rows = part.iloc[at : at + 4096]
                votes = np.zeros((len(rows), n_voters), dtype=bool)
                for k, v in enumerate(rows["votes"]):
                    votes[k, v] = True
                sums += model.expected(votes, rows["label"].to_numpy(dtype=float), rows["n"].to_numpy(dtype=float))
        i, j = np.nonzero(np.triu(sums.sum(axis=0)))
        yield pd.DataFrame({"i": i, "j": j, "zero": sums[0, i, j], "one": sums[1, i, j]})

    for k in range(rounds + 1):
        got = patterns.mapInPandas(summed, "i int, j int, zero double, one double").groupBy("i", "j").agg(F.sum("zero").alias("zero"), F.sum("one").alias("one")).toPandas()
        i, j, sums = got["i"].to_numpy(), got["j"].to_numpy(), np.zeros((2, n_voters + 3, n_voters + 3))
        for c, name in enumerate(("zero", "one")):
            sums[c, i, j] = sums[c, j, i] = got[name].to_numpy()
        if model.maximised(sums) < STILL and k:
            break
    return model


def chosen_voters(rows_of: list[np.ndarray], n: int, most: int) -> list[int]:
    """Features that vote, best first: one that fires for nearly the rows of an earlier voter is the same voter."""
    kept: list[int] = []
    fires = np.zeros((n, most), dtype=np.uint8)
    for f, rows in enumerate(rows_of):
        if not len(rows):
            continue
        both = fires[rows, : len(kept)].sum(axis=0, dtype=np.int64)
        if len(kept) and (both / (len(rows) + np.array([len(rows_of[k]) for k in kept]) - both)).max() > 0.8:
            continue
        fires[rows, len(kept)] = 1
        kept.append(f)
        if len(kept) == most:
            break
    return kept


def logistic(rows: np.ndarray, columns: np.ndarray, n: int, m: int, wanted: np.ndarray, l2: float = 1.0, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights of m sparse features (row, column), and the bias; by gradient steps with moments."""
    now = np.append(np.zeros(m), math.log((wanted.mean() + 1e-4) / (1 - wanted.mean() + 1e-4)))
    first, second = np.zeros(m + 1), np.zeros(m + 1)
    for t in range(1, steps + 1):
        z = np.bincount(rows, weights=now[columns], minlength=n) + now[m]
        off = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - wanted
        slope = np.append(np.bincount(columns, weights=off[rows], minlength=m) + l2 * now[:m], off.sum()) / n
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        now = now - 0.05 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return now[:m], float(now[m])


def calibrated(z: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """a, b of sigmoid(a z + b) that fits the labels, by damped Newton steps; a stays positive. Labels are drawn in by one
    row of the other class, so that classes that separate do not send a to infinity."""
    ones = labels.sum()
    wanted = np.where(labels == 1, (ones + 1) / (ones + 2), 1 / (len(labels) - ones + 2))

    def cost(a: float, b: float) -> float:
        x = a * z + b
        return float((np.logaddexp(0, x) - wanted * x).sum())

    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -40, 40)))
        v = np.maximum(p * (1 - p), 1e-6)
        g = np.array([((p - wanted) * z).sum(), (p - wanted).sum()])
        h = np.array([[(v * z * z).sum(), (v * z).sum()], [(v * z).sum(), v.sum()]]) + 1e-6 * np.eye(2)
        step, size, before = np.linalg.solve(h, g), 1.0, cost(a, b)
        while size > 1e-4 and (a - size * step[0] <= 0 or cost(a - size * step[0], b - size * step[1]) > before):
            size /= 2
        if size <= 1e-4 or np.abs(step).max() < 1e-6:
            break
        a, b = a - size * step[0], b - size * step[1]
    return a, b


def featured(docs: DataFrame, names: list[str], key: str, text: str, keep: list[str]) -> DataFrame:
    """(row, has) for every row, staged: its key as ``_k`` with the columns ``keep``, and the indices of its features."""
    given = docs.select(F.struct(docs[key].alias("_k"), *[docs[c] for c in keep]).alias("row"), docs[text].alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(names)

    def find(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(shared.value)
        for part in parts:
            for rows, texts in slices(part, "text"):
                yield pa.RecordBatch.from_arrays([rows.column("row"), pa.array([finder.find(t) for t in texts], pa.list_(pa.int32()))], names=["row", "has"])

    schema = T.StructType([given.schema["row"], T.StructField("has", T.ArrayType(T.IntegerType()))])
    return staged(given.mapInArrow(find, schema), "featured")


def vote_patterns(had: DataFrame, chosen: DataFrame, voters: list[int]) -> DataFrame:
    """(votes, label, n), staged: the sets of voters that fire, by their places in ``voters``, and how many texts have
    each. had: of featured(); chosen: (k, toxic). Counts are combined before the shuffle."""
    labelled = had.join(F.broadcast(chosen), had["row._k"] == chosen["k"], "left")
    fired = F.array_sort(F.transform(F.array_intersect("has", F.lit(voters).cast("array<int>")), lambda f: (F.array_position(F.lit(voters).cast("array<int>"), f) - 1).cast("int")))
    return staged(labelled.select(fired.alias("votes"), (F.col("toxic") == 1).cast("double").alias("label")).groupBy("votes", "label").agg(F.count(F.lit(1)).alias("n")), "votes")


def _fit(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, sample: int, keep: list[str]) -> tuple[dict, DataFrame | None]:
    """The model of fit(), and featured() rows of docs, if there are features."""
    chosen = labels.select(labels[key].alias("k"), labels[label].alias("toxic")).where("k is not null and toxic is not null").groupBy("k").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("k"), "k").limit(sample)
    # bounded by ``sample``, so the few ids are sent to the texts and not the texts to them
    chosen = staged(chosen, "chosen")
    rows = staged(docs.select(docs[key].alias("k"), docs[text].alias("text")).join(F.broadcast(chosen), "k"), "labelled")
    names = [f for f, _, _ in mined(rows)]
    if not names:
        share = rows.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0]
        share = min(max(share or 0.0, 1e-4), 1 - 1e-4)
        return {"features": [], "weights": np.zeros(0), "bias": math.log(share / (1 - share)), "posterior": None}, None
    had = featured(docs, names, key, text, keep)
    # one row for each key chosen
    got = had.join(F.broadcast(chosen), had["row._k"] == chosen["k"]).groupBy("k", "toxic").agg(F.min("has").alias("has")).orderBy("k").collect()
    n, m = len(got), len(names)
    truth = np.array([r["toxic"] == 1 for r in got], dtype=float)
    has = [np.array(r["has"], dtype=np.int64) for r in got]
    at, columns = np.repeat(np.arange(n), [len(h) for h in has]), np.concatenate(has)
    order = np.argsort(columns, kind="stable")
    rows_of = np.split(at[order], np.searchsorted(columns[order], np.arange(1, m)))
    voters = chosen_voters(rows_of, n, VOTERS)
    votes = np.zeros((n, len(voters)), dtype=bool)
    for k, f in enumerate(voters):
        votes[rows_of[f], k] = True
    told = label_model_of(vote_patterns(had, chosen, voters), len(voters), truth.mean())
    posterior = told.posterior(votes, truth)
    w, b = logistic(at, columns, n, m, posterior)
    z = np.bincount(at, weights=w[columns], minlength=n) + b
    scale, shift = calibrated(z, truth)
    model = {"features": names, "weights": scale * w, "bias": float(scale * b + shift), "posterior": posterior, "rates": told.rates, "together": told.together, "trust": told.trust, "truth": truth, "voters": voters}
    return model, had


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> dict:
    """Features, weights and bias. labels: (key, label), training rows only. Rows of a key that labels
    repeats take its highest label; null keys and labels are left out. Texts of docs that share a key all count when words
    are mined and in the label model; the one with the first features in order stands for the key after that. Of more than
    ``sample`` labelled keys, those with the smallest hashes are used; the others' texts count as having no label."""
    return _fit(docs, labels, key, text, label, sample, [])[0]


def _scores(model: dict, spark):
    """A function from texts to scores, for tasks; the model is broadcast."""
    shared = spark.sparkContext.broadcast((model["features"], model["weights"], model["bias"]))

    def made():
        features, weights, bias = shared.value
        finder = Finder(features)
        return lambda texts: 1 / (1 + np.exp(-np.clip(np.array([weights[finder.find(t)].sum() + bias for t in texts]), -40, 40)))

    return made


def score(docs: DataFrame, model: dict, key: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """key (or the columns ``keep``), score (0 to 1) and predicted (1 from CUT on) for every row. Null and empty texts
    have no features: their score is that of the bias. Columns named score or predicted are replaced."""
    kept = [c for c in (keep or [key]) if c not in ("score", "predicted")]
    types, made = dict(docs.dtypes), _scores(model, docs.sparkSession)

    def apply(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores_of = made()
        for part in parts:
            for rows, texts in slices(part, text):
                scores = scores_of(texts)
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in kept), pa.array(scores), pa.array(scores >= CUT).cast(pa.int32())], names=[*kept, "score", "predicted"])

    return docs.select(*[docs[c] for c in dict.fromkeys([*kept, text])]).mapInArrow(apply, ", ".join([f"`{c}` {types[c]}" for c in kept] + ["score double", "predicted int"]))


def accepted(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """The rows of docs whose score is below CUT, with all their columns as they are, whatever the names."""
    made = _scores(model, docs.sparkSession)

    def apply(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores_of = made()
        for part in parts:
            for rows, texts in slices(part, text):
                yield rows.filter(pa.array(scores_of(texts) < CUT))

    return docs.mapInArrow(apply, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """score() with a model that is fitted on the labels given. Texts are read for their features once."""
    kept = [c for c in (keep or [key]) if c not in ("score", "predicted")]
    model, had = _fit(docs, labels, key, text, "toxic", SAMPLE, kept)
    if had is None:
        return score(docs, model, key, text, keep)
    shared = docs.sparkSession.sparkContext.broadcast((model["weights"], model["bias"]))

    def apply(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        for part in parts:
            has = part.column("has")
            at = np.repeat(np.arange(len(has)), has.value_lengths().to_numpy(zero_copy_only=False))
            z = np.bincount(at, weights=weights[has.flatten().to_numpy()], minlength=len(has)) + bias
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))))], names=["row", "score"])

    scored = had.mapInArrow(apply, T.StructType([had.schema["row"], T.StructField("score", T.DoubleType())]))
    return scored.select(*[F.col("row")[c].alias(c) for c in kept], "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
