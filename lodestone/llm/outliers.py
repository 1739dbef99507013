"""Quality rules: fixed limits, then robust multivariate outliers. Built from DataFrame functions alone.

Statistics of each text are transformed to a vector of ``DIMS`` values. For each language and source, the minimum
covariance determinant gives their centre and spread: from two starts (medians with their absolute deviations, and plain
moments), concentration steps take the moments of the ``SUBSET`` share of rows that lie nearest, until no cell's log
determinant changes by more than ``TOLERANCE``; the start that ends with the smaller determinant counts. As the subset is
one half, close to half of a cell's texts may be junk without moving the estimate. Half of the rows make a rough estimate of
what is good, so it is taken once more over all rows within ``NEAR``, the usual last step of the method. Texts whose squared
Mahalanobis distance passes ``CUTOFF`` are rejected.

A spread below ``FLOORS`` is not trusted: many statistics are 0 in most texts, so half of the rows may have no spread at
all, and the floors say which difference means anything. All steps aggregate over map-side partial sums.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.session import staged

WINDOW = 8
NAMES = ("word_length", "symbols", "repeats", "capitals", "lines")
DIMS = len(NAMES)
FLOORS = (0.05, 0.05, 0.15, 0.05, 0.30)
SUBSET = 0.5
TOLERANCE = 1e-4
#: A bound in case rounding keeps a cell from coming to rest; a fit that meets it says so.
MOST_STEPS = 40
#: Cells with fewer texts are pooled.
LEAST_ROWS = 50
#: Make the covariance of the nearest half of normal rows in five dimensions consistent; the squared distance
#: within which 97.5 % of them lie; and the same factor for those.
CONSISTENT, NEAR, CONSISTENT_NEAR = 1.91, 12.83, 1.056
#: Of squared distances.
CUTOFF = 30.0
_SPACE = "[\\x20\\x09-\\x0D]+"


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without ``text`` but with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_capitals (long).
    Columns of these names, and of names that begin with ``_lodestone_``, are replaced.

    A word in an 8-word window that the text has at least twice is a repeated word. Windows are compared by hashes of
    their words' hashes; only texts with a repeated window are sorted. Windows grow from 1 to 2, 4 and 8 words: a repeated
    one of 8 holds WINDOW + 1 - width repeated ones of each smaller width, so texts with fewer of these are done. Each text
    is measured within its row."""
    new = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_capitals")
    kept = [docs[c] for c in docs.columns if c != text and c not in new and not c.startswith("_lodestone_")]
    names = [c for c in docs.columns if c != text and c not in new and not c.startswith("_lodestone_")]
    t = F.coalesce(docs[text], F.lit(""))
    zero = docs.select(
        *kept,
        F.array_remove(F.split(t, _SPACE), "").alias("_lodestone_words"),
        F.regexp_replace(t, "[^A-Z#*$%&|<>]+", "").alias("_lodestone_marks"),
        F.filter(F.split(t, "\n"), lambda x: F.trim(x, F.lit(" \t\x0b\f\r")) != "").alias("_lodestone_lines"),
    )
    two = zero.select(
        *names,
        F.size("_lodestone_words").cast("long").alias("n_words"),
        F.length(F.array_join("_lodestone_words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_lodestone_marks", "[A-Z]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("_lodestone_marks", "[^A-Z]+", "")).cast("long").alias("n_capitals"),
        (F.size("_lodestone_lines") - F.size(F.array_distinct("_lodestone_lines"))).cast("long").alias("n_dup_lines"),
        F.transform("_lodestone_words", lambda w: F.xxhash64(w)).alias("_lodestone_w"),
    )
    width = 1
    while width < WINDOW:
        grown = f"slice(transform(_lodestone_w, (h, i) -> xxhash64(h, get(_lodestone_w, i + {width}))), 1, size(_lodestone_w) - {width})"
        two = two.withColumn("_lodestone_w", F.expr(f"case when size(_lodestone_w) - size(array_distinct(_lodestone_w)) >= {WINDOW + 1 - width} then {grown} else array() end"))
        width *= 2
    three = two.withColumn("_lodestone_s", F.expr("case when size(array_distinct(_lodestone_w)) < size(_lodestone_w) then array_sort(transform(_lodestone_w, (h, i) -> struct(h as h, i as i))) end"))
    four = three.withColumn(
        "_lodestone_p",
        F.expr("case when _lodestone_s is not null then array_sort(transform(filter(_lodestone_s, (x, k) -> (k > 0 and x.h = _lodestone_s[greatest(k - 1, 0)].h) or (k < size(_lodestone_s) - 1 and x.h = _lodestone_s[least(k + 1, size(_lodestone_s) - 1)].h)), x -> x.i)) end"),
    )
    covered = F.expr(f"case when _lodestone_p is null then 0L else cast(aggregate(transform(_lodestone_p, (x, k) -> case when k < size(_lodestone_p) - 1 then least({WINDOW}, _lodestone_p[least(k + 1, size(_lodestone_p) - 1)] - x) else {WINDOW} end), 0L, (a, x) -> a + x) as bigint) end")
    return four.withColumn("n_repeat_words", covered).select(*names, *new)


def vector() -> list[Column]:
    """The transformed statistics, from the columns of measured()."""
    words, chars = F.greatest(F.col("n_words"), F.lit(1)).cast("double"), F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    return [F.log(chars / words), F.sqrt(F.col("n_symbols") / chars), F.sqrt(F.col("n_repeat_words") / words), F.sqrt(F.col("n_capitals") / chars), F.sqrt(F.col("n_dup_lines") / (F.col("n_dup_lines") + 5.0))]


_X = [f"x{i}" for i in range(DIMS)]
_PAIRS = [(i, j) for i in range(DIMS) for j in range(i + 1)]


def _moments() -> list[Column]:
    return [F.avg(x).alias(f"m{i}") for i, x in enumerate(_X)] + [F.avg(F.col(_X[i]) * F.col(_X[j])).alias(f"q{i}{j}") for i, j in _PAIRS]


def _factored(cells: DataFrame, scale: float) -> DataFrame:
    """Adds l_ij, the lower factor of the scaled covariance with the floors on its diagonal, and its log determinant."""
    for i, j in _PAIRS:
        cov = scale * (F.col(f"q{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}")) + (FLOORS[i] ** 2 if i == j else 0.0)
        rest = cov
        for k in range(j):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        cells = cells.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(FLOORS[i] ** 2 / 4))) if i == j else rest / F.col(f"l{j}{j}"))
    return cells.withColumn("log_det", sum((2 * F.log(f"l{i}{i}") for i in range(DIMS)), F.lit(0.0)))


def _with_distance(rows: DataFrame) -> DataFrame:
    """Adds d2 by forward substitution, from x, m and l."""
    for i in range(DIMS):
        z = F.col(_X[i]) - F.col(f"m{i}")
        for k in range(i):
            z = z - F.col(f"l{i}{k}") * F.col(f"z{k}")
        rows = rows.withColumn(f"z{i}", z / F.col(f"l{i}{i}"))
    return rows.withColumn("d2", sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(DIMS)), F.lit(0.0)))


def _moments_within(rows: DataFrame, limit: Column, by: list[str], *more: Column) -> DataFrame:
    """_moments(), and more, of the rows whose d2 is within the limit. The others are masked, not filtered: a filter would be
    pushed into the join that d2 comes from, with each z written out anew in the next, in a method too long to be compiled."""
    masked = rows.select(*[c for c in rows.columns if c not in _X], *[F.when(F.col("d2") <= limit, F.col(x)).alias(x) for x in _X])
    return masked.groupBy(*by).agg(*_moments(), *more).where("m0 is not null")


def _of_cells(table: DataFrame, name: str) -> DataFrame:
    """A table of a row or two a cell, staged in one file: the planner sees how small it is and broadcasts it, so that hot
    cells never meet in one task. Of many small files it would see the sum of their footers."""
    return staged(table.repartition(1), name)


def _fit(rows: DataFrame) -> DataFrame:
    """rows: (cell, x0..). One row a cell: its centre and factor at the smaller determinant of two starts."""
    shape = ["cell", "start", *[f"m{i}" for i in range(DIMS)], *[f"l{i}{j}" for i, j in _PAIRS], "log_det"]
    middle = _of_cells(rows.groupBy("cell").agg(*[F.percentile_approx(x, 0.5, 10000).alias(f"m{i}") for i, x in enumerate(_X)]), "medians")
    off = rows.join(middle, "cell").groupBy("cell", *[f"m{i}" for i in range(DIMS)]).agg(*[F.percentile_approx(F.abs(F.col(x) - F.col(f"m{i}")), 0.5, 10000).alias(f"a{i}") for i, x in enumerate(_X)])
    for i, j in _PAIRS:
        off = off.withColumn(f"l{i}{j}", F.sqrt((1.4826 * F.col(f"a{i}")) ** 2 + FLOORS[i] ** 2) if i == j else F.lit(0.0))
    first = off.withColumn("start", F.lit(0)).withColumn("log_det", F.lit(0.0)).select(*shape)
    second = _factored(rows.groupBy("cell").agg(*_moments()), 1.0).withColumn("start", F.lit(1)).select(*shape)
    cells = _of_cells(first.unionByName(second), "cells")
    for _ in range(MOST_STEPS):
        # distances are computed twice, which costs less than writing them; only what is known of cells is staged
        near = _with_distance(rows.join(cells, "cell")).select("cell", "start", *_X, "d2", F.col("log_det").alias("was"))
        limit = _of_cells(near.groupBy("cell", "start").agg(F.percentile_approx("d2", SUBSET, 10000).alias("limit")), "limits")
        inner = _moments_within(near.join(limit, ["cell", "start"]), F.col("limit"), ["cell", "start"], F.first("was").alias("was"))
        cells = _of_cells(_factored(inner, CONSISTENT).select(*shape, "was"), "cells")
        moved = cells.agg(F.max(F.abs(F.col("log_det") - F.col("was")))).first()[0]
        cells = cells.drop("was")
        if moved is None or moved <= TOLERANCE:
            break
    else:
        warnings.warn(f"after {MOST_STEPS} steps log determinants still move by {moved:.2g}", RuntimeWarning, stacklevel=2)
    return cells.groupBy("cell").agg(F.min_by(F.struct(*[c for c in shape if c not in ("cell", "start")]), F.struct("log_det", "start")).alias("fit")).select("cell", "fit.*")


def _reweighted(rows: DataFrame, fits: DataFrame) -> DataFrame:
    """The centre and factor of all rows within NEAR of a cell's fit."""
    near = _moments_within(_with_distance(rows.join(fits, "cell")), F.lit(NEAR), ["cell"])
    return _factored(near, CONSISTENT_NEAR).select("cell", *[f"m{i}" for i in range(DIMS)], *[f"l{i}{j}" for i, j in _PAIRS])


def quality(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", cutoff: float = CUTOFF) -> DataFrame:
    """Per row of docs: key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distance (squared;
    null where no cell could be fitted) and kept.

    base_failed: fewer than 20 words, or more than 30 % repeated words; such rows are never kept and take no part in the
    fit. Null texts count as empty. Null languages and sources are values of their own. Cells of fewer than LEAST_ROWS
    texts are pooled; if the pool is as small, its rows are kept. Where half of a cell's texts or more are junk of one kind,
    the junk is what the cell looks like, and is kept. Rows that repeat count as often as they occur. Other
    columns are not read.
    """
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    rows = measured(docs.select(docs[key].alias("id"), docs[text].alias("text"), docs[lang].alias("of_lang"), docs[source].alias("of_source")))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed).select("id", *base, "base_failed", F.to_json(F.struct("of_lang", "of_source")).alias("own"), *[x.alias(n) for x, n in zip(vector(), _X)])
    rows = staged(rows, "measured")
    large = _of_cells(rows.where("not base_failed").groupBy("own").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_ROWS).select(F.col("own").alias("cell")), "large")
    rows = staged(rows.join(large, rows["own"] == large["cell"], "left").drop("own").withColumn("cell", F.coalesce("cell", F.lit("pooled"))), "placed")
    fitting = rows.where("not base_failed").select("cell", *_X)
    enough = _of_cells(fitting.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_ROWS).select("cell"), "enough")
    fitting = fitting.join(enough, "cell", "left_semi")
    fits = _of_cells(_reweighted(fitting, _of_cells(_fit(fitting), "raw-fits")), "fits")
    out = _with_distance(rows.join(fits, "cell", "left"))
    return out.select(F.col("id").alias(key), *base, "base_failed", F.col("d2").alias("distance"), (~F.col("base_failed") & F.coalesce(F.col("d2") <= cutoff, F.lit(True))).alias("kept"))
