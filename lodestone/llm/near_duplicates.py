"""Near-duplicate texts by MinHash, with sequential Bayesian verification of banded candidates.

1. Every text gives its set of word shingles, a signature of min-hashes, and band keys. Texts with one and the same set
   form a class, which its smallest id stands for from there on.
2. Representatives that share a band key are compared, a batch of signature values at a time. After each batch the
   posterior of the similarity (uniform prior, binomial matches) drops pairs whose chance of reaching the threshold is
   below the chosen miss probability. Surviving pairs only serve to gather clusters here, so a block passes on a
   spanning forest of them, not all pairs.
3. Within each cluster, pairs that survive the posterior are verified on their full shingle sets.
4. Components of verified links are closed over all clusters.

Buckets and clusters of any size are cut into blocks, and each pair of blocks is a row of work: no cap, no rows of pairs,
and no group that one task must hold. Members that appear together in several bands are compared once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.components import connected
from lodestone.llm.textblocks import Words, WordHasher, blocks, distinct, distinct_places, mix, window_hashes
from lodestone.session import staged

#: Members of a block; a row of work holds two blocks at most.
BLOCK = 256
#: Shingles of a block of a cluster, about.
BLOCK_SHINGLES = 300_000
#: Signature values compared between two looks at the posterior.
BATCH = 32
MISS = 1e-6
_SEED = 20_240_229


def plan(percent: int, miss: float = MISS) -> tuple[int, int]:
    """Bands and rows of a band, so that a pair at the threshold shares no band with a chance of ``miss`` at most."""
    rows = 6 if percent >= 85 else 5
    return math.ceil(math.log(miss) / math.log(1 - (percent / 100) ** rows)), rows


def least_matches(percent: int, values: int, miss: float = MISS) -> list[tuple[int, int]]:
    """(compared, least matches that keep a pair) for each batch: with a uniform prior, the posterior chance of a
    similarity of at least t after m matches of n is that of at most m successes in n + 1 trials at t."""
    out, t = [], percent / 100
    for n in [*range(BATCH, values, BATCH), values]:
        total, m = 0.0, 0
        for m in range(n + 1):
            total += math.exp(math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n + 2 - m) + m * math.log(t) + (n + 1 - m) * math.log(1 - t))
            if total >= miss:
                break
        out.append((n, m))
    return out


def shingle_sets(words: Words, width: int) -> list[np.ndarray]:
    """Sorted distinct shingles of each text; a shorter text is one shingle, a text without words none."""
    windows = window_hashes(words.hashes, width)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if b - a >= width:
            out.append(distinct(windows[a : b - width + 1]))
        else:
            out.append(window_hashes(words.hashes[a:b], b - a) if b > a else windows[:0])
    return out


def _signatures(sets: list[np.ndarray], multipliers: np.ndarray) -> np.ndarray:
    """(texts, values) of min-hashes; every set has an element. Works through runs of texts that fit the cache."""
    sizes = np.array([len(s) for s in sets])
    out = np.empty((len(sets), len(multipliers)), dtype=np.uint64)
    at = 0
    while at < len(sets):
        end = max(at + 1, int(np.searchsorted(np.cumsum(sizes[at:]), 1 << 15, side="right")) + at)
        x = np.concatenate(sets[at:end])
        begins = np.concatenate([[0], np.cumsum(sizes[at : end - 1])])
        v = np.empty_like(x)
        for k, a in enumerate(multipliers):
            np.multiply(x, a, out=v)
            out[at:end, k] = np.minimum.reduceat(v, begins)
        at = end
    return out


def signed(docs: DataFrame, key: str, text: str, width: int, bands: int, rows: int) -> DataFrame:
    """(id, n_shingles, s1, s2, bands, signature): s1 and s2 are two sums over the set, which tell sets apart; all but
    id and n_shingles are null where the set is empty. The signature keeps 16 mixed bits of each min-hash."""
    multipliers = np.random.default_rng(_SEED).integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    kind = dict(docs.dtypes)[key]

    def sign(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for part in parts:
            for a, b, data, offsets in blocks(part, "text"):
                sets = shingle_sets(hasher.words(data, offsets), width)
                filled = [i for i, s in enumerate(sets) if len(s)]
                n, s1, s2, keys, kept = [len(s) for s in sets], [None] * len(sets), [None] * len(sets), [None] * len(sets), [None] * len(sets)
                if filled:
                    least = _signatures([sets[i] for i in filled], multipliers)
                    folded = np.zeros((len(filled), bands), dtype=np.uint64) + np.arange(1, bands + 1, dtype=np.uint64)
                    for r in range(rows):
                        folded = folded * np.uint64(0xFF51AFD7ED558CCD) + least[:, r::rows]
                    folded = mix(folded).view(np.int64)
                    short = (mix(least) & np.uint64(0xFFFF)).astype("<u2")
                    for row, i in enumerate(filled):
                        s1[i], s2[i] = int(sets[i].sum().view(np.int64)), int(mix(sets[i]).sum().view(np.int64))
                        keys[i], kept[i] = folded[row], short[row].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").slice(a, b - a), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(kept, pa.binary())],
                    names=["id", "n_shingles", "s1", "s2", "bands", "signature"],
                )

    return docs.select(docs[key].alias("id"), docs[text].alias("text")).mapInArrow(sign, f"id {kind}, n_shingles long, s1 long, s2 long, bands array<long>, signature binary")


class Forest:
    """Union-find over 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def top(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def link(self, i: int, j: int) -> None:
        i, j = self.top(i), self.top(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)

    def links(self) -> list[tuple[int, int]]:
        """Each member with the first of its tree."""
        return [(t, i) for i in range(len(self.up)) if (t := self.top(i)) != i]


def survivors(values: np.ndarray, left: int, looks: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows of ``values`` that no look at the posterior drops, with their matches. The first ``left`` rows are
    one block; if there are others, only pairs across are asked for."""
    n = len(values)
    if left == n:
        i, j = np.triu_indices(n, 1)
    else:
        i, j = np.repeat(np.arange(left), n - left), np.tile(np.arange(left, n), left)
    matches, seen = np.zeros(len(i), dtype=np.int32), 0
    for upto, least in looks:
        matches += np.count_nonzero(values[i, seen:upto] == values[j, seen:upto], axis=1).astype(np.int32)
        keep = matches >= least
        if not keep.all():
            i, j, matches = i[keep], j[keep], matches[keep]
        if not len(i):
            break
        seen = upto
    return i, j, matches


def verified(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, matches: np.ndarray, percent: int) -> Forest:
    """Trees of the pairs (i, j) whose sets reach the threshold. Pairs with most matches come first; those already in
    one tree need no look."""
    forest = Forest(len(sets))
    if len(i) > 2000:
        used = distinct(np.concatenate([i, j]))
        place = np.full(len(sets), -1)
        place[used] = np.arange(len(used))
        ids, codes = distinct_places(np.concatenate([sets[u] for u in used]))
        sizes = np.array([len(sets[u]) for u in used])
        owner = np.repeat(np.arange(len(used)), sizes)
        order = np.argsort(codes, kind="stable")
        codes, owner = codes[order], owner[order]
        shared = np.zeros((len(used), len(used)), dtype=np.float32)
        for at in range(0, len(ids), 4096):
            a, b = np.searchsorted(codes, [at, at + 4096])
            has = np.zeros((len(used), min(4096, len(ids) - at)), dtype=np.float32)
            has[owner[a:b], codes[a:b] - at] = 1
            shared += has @ has.T
        both = shared[place[i], place[j]].astype(np.int64)
        linked = 100 * both >= percent * (sizes[place[i]] + sizes[place[j]] - both)
        for a, b in zip(i[linked].tolist(), j[linked].tolist()):
            forest.link(a, b)
        return forest
    for k in np.argsort(-matches, kind="stable").tolist():
        a, b = int(i[k]), int(j[k])
        if forest.top(a) != forest.top(b):
            both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                forest.link(a, b)
    return forest


def _in_blocks(members: DataFrame, group: str, blocks_of: Column, *what: str) -> DataFrame:
    """A row for each pair of blocks of each group, with the members of the first (left) and, of two different blocks,
    of the second (right) as lists of structs of ``what``. A member is sent to as many rows as its group has blocks."""
    cut = members.withColumn("_n", blocks_of).withColumn("_own", F.expr("cast(pmod(xxhash64(id), _n) as int)")).withColumn("_other", F.explode(F.expr("sequence(0, _n - 1)")))
    cut = cut.select(group, F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"), "_own", F.struct(*what).alias("_m"))
    return cut.groupBy(group, "_i", "_j").agg(F.collect_list(F.when(F.col("_own") == F.col("_i"), F.col("_m"))).alias("left"), F.collect_list(F.when(F.col("_own") != F.col("_i"), F.col("_m"))).alias("right"))


def _candidate_links(reps: DataFrame, kind: str, percent: int, values: int, miss: float) -> DataFrame:
    """(a, b): a spanning forest, block by block, of pairs that share a band and survive the posterior."""
    keyed = reps.select("id", F.explode("bands").alias("h"))
    shared = keyed.groupBy("h").count().where("count > 1")
    members = keyed.join(shared, "h")
    lists = _in_blocks(members, "h", F.expr(f"cast(ceil(count / {BLOCK}) as int)"), "id")
    # most copies share many bands: equal lists are one piece of work
    lists = lists.select(F.array_sort(F.expr("transform(left, x -> x.id)")).alias("left"), F.array_sort(F.expr("transform(right, x -> x.id)")).alias("right")).where("size(left) + size(right) > 1").distinct()
    sides = lists.select(F.xxhash64("left", "right").alias("g"), F.explode(F.concat(F.transform("left", lambda x: F.struct(F.lit(0).alias("side"), x.alias("id"))), F.transform("right", lambda x: F.struct(F.lit(1).alias("side"), x.alias("id"))))).alias("m")).select("g", "m.*")
    rows = sides.join(reps.select("id", "signature"), "id").groupBy("g").agg(F.sort_array(F.collect_list(F.struct("side", "id", "signature"))).alias("m"))
    rows = rows.select(F.expr("transform(m, x -> x.id)").alias("ids"), F.expr("transform(m, x -> x.signature)").alias("signatures"), F.expr("size(filter(m, x -> x.side = 0))").alias("n_left"))
    looks = least_matches(percent, values, miss)

    def compare(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            a, b = [], []
            for ids, packed, left in zip(part["ids"], part["signatures"], part["n_left"]):
                matrix = np.frombuffer(b"".join(packed), dtype="<u2").reshape(len(ids), values)
                i, j, _ = survivors(matrix, left or len(ids), looks)
                forest = Forest(len(ids))
                for x, y in zip(i.tolist(), j.tolist()):
                    forest.link(x, y)
                for x, y in forest.links():
                    a.append(ids[x])
                    b.append(ids[y])
            yield pd.DataFrame({"a": pd.Series(a, dtype=object), "b": pd.Series(b, dtype=object)})

    return rows.mapInPandas(compare, f"a {kind}, b {kind}")


def _verified_links(docs: DataFrame, key: str, text: str, kind: str, clustered: DataFrame, width: int, percent: int, values: int, miss: float) -> DataFrame:
    """(a, b): a spanning forest, block by block, of pairs within a cluster that survive the posterior and whose full
    sets reach the threshold. clustered: (id, component, n_shingles, signature)."""
    sizes = clustered.groupBy("component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("weight"))
    placed = clustered.join(sizes, "component").select("id", "component", "signature", F.expr(f"cast(greatest(ceil(n / {BLOCK}), ceil(weight / {BLOCK_SHINGLES})) as int)").alias("n_blocks"))
    texts = docs.select(docs[key].alias("id"), docs[text].alias("text")).join(placed, "id")

    def shingled(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for part in parts:
            for a, b, data, offsets in blocks(part, "text"):
                sets = shingle_sets(hasher.words(data, offsets), width)
                cut = part.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*(cut.column(c) for c in ("id", "component", "signature", "n_blocks")), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "component", "signature", "n_blocks", "shingles"])

    sets = texts.select("id", "component", "signature", "n_blocks", "text").mapInArrow(shingled, f"id {kind}, component {kind}, signature binary, n_blocks int, shingles binary")
    rows = _in_blocks(sets, "component", F.col("n_blocks"), "id", "signature", "shingles")
    flat = [F.expr(f"transform({side}, x -> x.{what})").alias(f"{side}_{what}") for side in ("left", "right") for what in ("id", "signature", "shingles")]
    looks = least_matches(percent, values, miss)

    def check(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            a, b = [], []
            for row in part.itertuples(index=False):
                seen, ids, packed, sets, n_left = set(), [], [], [], 0
                for side in ("left", "right"):  # an id that the table repeats is looked at once
                    for x, s, z in zip(getattr(row, f"{side}_id"), getattr(row, f"{side}_signature"), getattr(row, f"{side}_shingles")):
                        if x not in seen:
                            seen.add(x)
                            ids.append(x)
                            packed.append(s)
                            sets.append(np.frombuffer(z, dtype=np.uint64))
                    n_left = n_left or len(ids)
                if len(ids) < 2:
                    continue
                matrix = np.frombuffer(b"".join(packed), dtype="<u2").reshape(len(ids), values)
                for x, y in verified(sets, *survivors(matrix, n_left, looks), percent).links():
                    a.append(ids[x])
                    b.append(ids[y])
            yield pd.DataFrame({"a": pd.Series(a, dtype=object), "b": pd.Series(b, dtype=object)})

    return rows.select(*flat).mapInPandas(check, f"a {kind}, b {kind}")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 80, width: int = 5, miss: float = MISS) -> DataFrame:
    """One row per row of docs: key, n_shingles, component_id, kept.

    Words are runs of bytes other than ASCII white space, with A-Z lower-cased; a text's set holds its distinct runs of
    ``width`` words (fewer words: all of them as one). Texts are linked where 100 * shared >= percent * united, and
    component_id is the smallest key reachable over links; kept marks the row whose key that is. Each link may be missed
    with a chance of about ``miss`` in candidate search and in each look at the posterior; no pair is linked wrongly.
    Null, empty and blank texts have an empty set and link to nothing. Rows that repeat a key and text give equal
    results. A null key is reported with the component of its set, never kept, and never stands for others unless all
    keys of the set are null. Only key and text are read, so other columns may have any names.
    """
    kind = dict(docs.dtypes)[key]
    bands, rows = plan(percent, miss)
    sets = staged(signed(docs, key, text, width, bands, rows), "signed")
    classes = staged(sets.where("n_shingles > 0 and id is not null").groupBy("s1", "s2", "n_shingles").agg(F.min("id").alias("id"), F.first("bands").alias("bands"), F.first("signature").alias("signature")), "classes")
    clusters = connected(_candidate_links(classes, kind, percent, bands * rows, miss))
    clustered = staged(clusters.join(classes.select("id", "n_shingles", "signature"), "id"), "clustered")
    found = connected(_verified_links(docs, key, text, kind, clustered, width, percent, bands * rows, miss))
    classes = classes.select("s1", "s2", "n_shingles", F.col("id").alias("stands")).join(found.select(F.col("id").alias("stands"), "component"), "stands", "left").select("s1", "s2", "n_shingles", F.coalesce("component", "stands").alias("component"))
    out = sets.select("id", "n_shingles", "s1", "s2").join(classes, ["s1", "s2", "n_shingles"], "left")
    return out.select(F.col("id").alias(key), "n_shingles", F.coalesce("component", "id").alias("component_id"), F.coalesce(F.col("id") == F.coalesce("component", "id"), F.lit(False)).alias("kept"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """docs with one row of each group of near-duplicates: that of its smallest key. Rows that repeat a key and a text
    are one. Texts without words stay, and so do rows with a null key, which nothing tells apart."""
    kept = near_duplicates(docs, key, text, **settings).where(F.col("kept")).select(F.col(key).alias("_lodestone_key")).distinct()
    stay = docs.join(kept, docs[key] == kept["_lodestone_key"], "left_semi").withColumn("_lodestone_text", F.xxhash64(docs[text])).dropDuplicates([key, "_lodestone_text"]).select(*docs.columns)
    return stay.unionByName(docs.where(docs[key].isNull()))
