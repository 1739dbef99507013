"""Nearest-neighbour search over vectors, exact or by cells, and a keyed collection of vectors with payloads."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.operators import catalog
from lodestone.operators.keyed_table import KeyedTable
from lodestone.session import staging_dir

#: Query vectors are broadcast up to this many bytes; more are searched in blocks that stay below it.
BROADCAST_BYTES = 32 << 20
#: Queries of a block at most, as each task counts scores for all of them.
QUERIES = 1 << 15
#: Scores of a batch that exist at once.
SCORES = 1 << 21
#: Scores that agree to so many digits are equal, so that equal vectors rank by id in every batch and block.
DIGITS = 12
#: Bins from -1 to 1 in which scores are counted, to learn what the k-th best of a query reaches.
BINS = 256


def units(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, unit vectors) of the vectors that have ``dims`` elements, no null, and are not zero."""
    lists = column.cast(pa.list_(pa.float64()))
    sizes = np.diff(lists.offsets.to_numpy())
    whole = np.flatnonzero((sizes == dims) & np.asarray(column.is_valid()))
    rows = lists.take(pa.array(whole)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    norms = np.sqrt(np.einsum("ij,ij->i", rows, rows))
    good = norms > 0  # also false for NaN, which is what a null element becomes
    return whole[good], rows[good] / norms[good, None]


def query_blocks(queries: DataFrame, query_id: str, vector: str) -> Iterator[tuple[pa.Array, np.ndarray, int]]:
    """(ids, unit vectors, dims) of the queries, in blocks of BROADCAST_BYTES at most; the driver holds one at a time."""
    asked = queries.select(F.col(query_id).alias("query_id"), F.col(vector).alias("q")).where("q is not null")
    count, dims = asked.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("q")), F.lit(0))).first()
    blocks = max(1, -(-count * dims * 8 // BROADCAST_BYTES), -(-count // QUERIES))
    for b in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).toArrow()
        at, found = units(part.column("q").combine_chunks(), dims) if part.num_rows else (np.zeros(0, dtype=int), np.zeros((0, max(dims, 1))))
        yield part.column("query_id").combine_chunks().take(pa.array(at)), found, dims


def met(parts: Iterator[pa.RecordBatch], dims: int, queries: int, looks: np.ndarray | None, most: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray | slice]]:
    """(ids of points, their unit vectors, places of the queries that look at them), in cuts of ``most`` scores."""
    step = max(1, most // max(1, queries))
    for part in parts if queries else ():
        for a in range(0, part.num_rows, step):
            cut = part.slice(a, step)
            at, p = units(cut.column("p"), dims)
            own = cut.column("id").take(pa.array(at))
            if looks is None:
                yield own, p, slice(None)
                continue
            cells = cut.column("cell").to_numpy(zero_copy_only=False)[at]
            for c in np.unique(cells).tolist():
                if len(who := np.flatnonzero((looks == c).any(axis=1))):
                    here = np.flatnonzero(cells == c)
                    yield own.take(pa.array(here)), p[here], who


def by_id(ids: pa.Array) -> dict:
    """The places of each id."""
    places: dict = {}
    for at, x in enumerate(ids.to_pylist()):
        places.setdefault(x, []).append(at)
    return places


def scores_of(q: np.ndarray, p: np.ndarray, who: np.ndarray | slice, own: pa.Array, places: dict | None) -> np.ndarray:
    """Queries ``who`` by points; -inf where ``places`` (see by_id) has a query with the id of the point."""
    scores = q[who] @ p.T
    if places:
        rows = np.arange(len(q)) if isinstance(who, slice) else who
        for col, x in enumerate(own.to_pylist()):
            if x in places:
                scores[np.isin(rows, places[x]), col] = -np.inf
    return scores


def at_least(scores: np.ndarray, floors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of the scores that reach the floor of their row."""
    return np.divmod(np.flatnonzero(scores >= floors[:, None]), max(1, scores.shape[1]))


def own_floors(scores: np.ndarray, row: np.ndarray, k: int) -> np.ndarray:
    """What each row's k-th best reaches, for rows that come more than k times in ``row``; -inf for others."""
    floors, many = np.full(len(scores), -np.inf), np.flatnonzero(np.bincount(row, minlength=len(scores)) > k)
    if len(many):
        floors[many] = np.partition(np.nan_to_num(np.round(scores[many], DIGITS), nan=-np.inf), -k, axis=1)[:, -k]
    return floors


def bins_of_kth(counts: np.ndarray, k: int) -> np.ndarray:
    """Of each row, the bin that holds its k-th best; -1 where fewer were counted."""
    out = np.full(len(counts), -1)
    for a in range(0, len(counts), 4096):
        best = counts[a : a + 4096, ::-1].cumsum(axis=1) >= k
        out[a : a + 4096] = np.where(best[:, -1], BINS - 1 - best.argmax(axis=1), -1)
    return out


def edges(bins: np.ndarray) -> np.ndarray:
    return bins * (2 / BINS) - 1


def top_k(points: DataFrame, queries: DataFrame, k: int, threshold: float | None = None, ident: str = "id", vector: str = "vector", query_id: str = "query_id", skip_self: bool = False, probed: tuple[str, np.ndarray, int] | None = None) -> DataFrame:
    """(query_id, id, score, rank): the k nearest by cosine of each query, at least ``threshold`` (inclusive), ties by id.

    Queries may be many: they are broadcast in blocks of a bounded size, and points stay in place. All scores are computed
    twice. First each task counts a query's scores in bins, and the sums over all tasks tell a floor that at least k of them
    reach. Then only what reaches its query's floor is passed on and ranked: k of a query and the rest of one bin, however
    many batches and tasks the points lie in; of that rest, each batch's own k best and their ties. Null and zero vectors, and those of other lengths than the queries', have no
    score. ``probed``: a column with each point's cell, the centres of the cells, and how many of these a query looks into
    (see VectorIndex); all of them by default."""
    context, types, found = points.sparkSession.sparkContext, dict(points.dtypes), None
    cell, centres, probes = probed or (None, None, 0)
    for ids, block, dims in query_blocks(queries, query_id, vector):
        looks = np.argsort(-(block @ centres.T), axis=1, kind="stable")[:, :probes] if probed else None
        shared = context.broadcast((ids, block, looks))
        slack = (dims + 16) * 2.0**-23  # of scores in single precision
        lowest = -2.0 if threshold is None else threshold - slack

        def count(parts: Iterator[pa.RecordBatch], shared=shared, dims=dims, lowest=lowest) -> Iterator[pa.RecordBatch]:
            ids, q, looks = shared.value
            q, places = q.astype(np.float32), by_id(ids) if skip_self else None
            counts, kth, floors = np.zeros((len(q), BINS), dtype=np.int32), np.full(len(q), -1), np.full(len(q), lowest, dtype=np.float32)
            for part in parts:
                for own, p, who in met([part], dims, len(q), looks, SCORES):
                    scores = scores_of(q, p.astype(np.float32), who, own, places)
                    row, col = at_least(scores, floors[who])
                    bins = np.clip((scores[row, col] + 1) * (BINS / 2), 0, BINS - 1).astype(int)
                    np.add.at(counts.reshape(-1), np.arange(len(q))[who][row] * BINS + bins, 1)
                kth = bins_of_kth(counts, k)  # what lies below this task's own k best can't matter
                floors = np.where(kth > 0, np.maximum(edges(kth), lowest), lowest).astype(np.float32)
            for a in range(0, len(q), 4096):
                some = counts[a : a + 4096]
                row, col = np.nonzero((some > 0) & (np.arange(BINS) >= kth[a : a + 4096, None]))
                yield pa.RecordBatch.from_arrays([pa.array((a + row).astype(np.int32)), pa.array(col.astype(np.int32)), pa.array(some[row, col].astype(np.int64))], names=["query", "bin", "n"])

        some = points.where(F.col(cell).isin(np.unique(looks).tolist())) if cell else points  # other cells are not read where they are stored apart
        read = some.select(F.col(ident).alias("id"), F.col(vector).alias("p"), *([F.col(cell).alias("cell")] if cell else []))
        counts = read.coalesce(max(64, 4 * context.defaultParallelism)).mapInArrow(count, "query int, bin int, n long")  # counts grow with tasks
        reached = counts.withColumn("n", F.sum("n").over(W.partitionBy("query").orderBy(F.col("bin").desc())))  # with all of the same bin
        kth = reached.where(F.col("n") >= k).groupBy("query").agg(F.max("bin").alias("bin")).toArrow()
        floors = np.full(len(block), lowest)
        floors[kth.column("query").to_numpy()] = np.maximum(edges(kth.column("bin").to_numpy()) - slack, lowest)
        least = context.broadcast(floors)

        def score(parts: Iterator[pa.RecordBatch], shared=shared, dims=dims, least=least) -> Iterator[pa.RecordBatch]:
            ids, q, looks = shared.value
            places = by_id(ids) if skip_self else None
            for own, p, who in met(parts, dims, len(q), looks, SCORES):
                scores = scores_of(q, p, who, own, places)
                row, col = at_least(scores, least.value[who])
                exact = np.round(scores[row, col], DIGITS)
                good = exact >= own_floors(scores, row, k)[row]  # binds where many scores share a bin
                if threshold is not None:
                    good &= exact >= threshold
                row, col, exact = row[good], col[good], exact[good]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.arange(len(q))[who][row])), own.take(pa.array(col)), pa.array(exact)], names=["query_id", "id", "score"])

        hits = read.mapInArrow(score, f"query_id {dict(queries.dtypes)[query_id]}, id {types[ident]}, score double")
        found = hits if found is None else found.unionByName(hits)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "id"))
    return found.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


class VectorIndex:
    """Cells around centres. Centres are fitted on at most ``sample`` vectors, chosen by hash; every row is then put into
    the cell of its nearest centre. A search looks into the ``probes`` cells whose centres are nearest to a query, and
    top_k without an index stays the exact way. How many probes a recall takes depends on the vectors: where they lie in
    clusters a few do, evenly spread ones (as in the test tables) take more than half of the cells."""

    def __init__(self, points: DataFrame, ident: str = "id", vector: str = "vector", cells: int = 64, sample: int = 20_000, rounds: int = 10):
        self.ident, self.vector, self.points = ident, vector, points
        chosen = points.where(F.col(vector).isNotNull()).orderBy(F.xxhash64(ident), ident).limit(sample).select(vector).toArrow().column(vector).combine_chunks()
        self.dims = len(chosen[0]) if len(chosen) else 0
        _, rows = units(chosen, self.dims) if len(chosen) else (None, np.zeros((0, 1)))
        self.centres = rows[np.random.default_rng(7).permutation(len(rows))[:cells]]
        for _ in range(rounds):
            own = np.argmax(rows @ self.centres.T, axis=1) if len(rows) else np.zeros(0, dtype=int)
            sums = np.zeros_like(self.centres)
            np.add.at(sums, own, rows)
            norms = np.sqrt((sums**2).sum(axis=1, keepdims=True))
            self.centres = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), self.centres)

    def placed(self) -> DataFrame:
        """All rows with their ``cell``, -1 for those without a score."""
        centres, dims, vector = self.centres, self.dims, self.vector
        kept = [c for c in self.points.columns if c != "cell"]
        types = dict(self.points.dtypes)

        def place(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                cells = np.full(part.num_rows, -1, dtype=np.int32)
                at, p = units(part.column(vector), dims)
                if len(at):
                    cells[at] = np.argmax(p @ centres.T, axis=1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cells)], names=[*kept, "cell"])

        return self.points.select(*kept).mapInArrow(place, ", ".join(f"`{c}` {types[c]}" for c in kept) + ", cell int")

    def stored(self, path: str | None = None) -> DataFrame:
        """placed(), written once in folders by cell, to ``path`` or the staging folder: a search reads only the cells that
        its queries look into."""
        spark = self.points.sparkSession
        path = path or f"{staging_dir(spark).rstrip('/')}/index-{uuid.uuid4().hex}"
        placed = self.placed()
        placed.repartition("cell", F.pmod(F.xxhash64(self.ident), F.lit(8))).write.partitionBy("cell").mode("errorifexists").parquet(path)
        return spark.read.schema(placed.schema).parquet(path)

    def search(self, placed: DataFrame, queries: DataFrame, k: int, probes: int = 40, **settings) -> DataFrame:
        return top_k(placed, queries, k, ident=self.ident, vector=self.vector, probed=("cell", self.centres, probes), **settings)


class VectorCollection:
    """id STRING, vector ARRAY<FLOAT>, payload STRING (JSON): a keyed table under one path, with search."""

    SCHEMA = "id string, vector array<float>, payload string"

    def __init__(self, spark: SparkSession, path: str, dims: int = 768):
        self.table, self.dims = KeyedTable(spark, path, self.SCHEMA, "id"), dims

    def create(self) -> VectorCollection:
        """Does nothing where the collection exists."""
        self.table.create()
        return self

    def points(self) -> DataFrame:
        return self.table.rows()

    def upsert(self, points: DataFrame) -> None:
        """Inserts or replaces by id. Vectors of other dimensions fail; repeated ids take the largest row."""
        right = F.col("vector").isNull() | (F.size("vector") == self.dims)
        self.table.upsert(points.select(F.lower(F.trim("id")).alias("id"), F.when(right, F.col("vector")).otherwise(F.raise_error(F.lit("wrong dimension")).cast("array<float>")).alias("vector"), "payload"))

    def retrieve(self, ids: DataFrame, with_payload: bool = True, with_vectors: bool = False) -> DataFrame:
        """Points of the ids that exist."""
        columns = ["id", *["payload"] * with_payload, *["vector"] * with_vectors]
        return catalog.retrieved(self.points(), ids.select(F.lower(F.trim("id")).alias("id")), "id", columns[1:])

    def nearby(self, queries: DataFrame, k: int, threshold: float | None = None, with_payload: bool = True, with_vectors: bool = False) -> DataFrame:
        hits = top_k(self.points(), queries, k, threshold)
        extra = self.points().select("id", *["payload"] * with_payload, *["vector"] * with_vectors)
        return hits.join(extra, "id") if with_payload or with_vectors else hits

    def overwrite_payload(self, payloads: DataFrame) -> None:
        """Whole payloads of the ids that exist are replaced; only those points are written."""
        new = payloads.select(F.lower(F.trim("id")).alias("id"), "payload")
        self.table.upsert(self.points().drop("payload").join(new, "id"))

    def drop(self) -> None:
        self.table.drop()
