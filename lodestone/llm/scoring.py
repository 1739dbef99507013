"""Language-model scores from a log-frequency Bloom filter.

Counts of n-grams are quantised on a log scale: a count c has level 1 + floor(log_b c), and the filter holds the pairs
(n-gram, 1), ..., (n-gram, level). A count is read by probing level after level until one is absent; a false positive
can only raise it, by a level at a time. The number of different words that follow a context is kept in the same way
(from its second level on: a context that was seen has one follower at least). Probabilities are interpolated as by
Witten and Bell, from the add-half unigram upwards:

    p(w | h) = (c(hw) + t(h) p(w | h')) / (c(h) + t(h))

Training counts over all documents: each task counts 64-bit hashes of its n-grams in arrays, cuts the sorted keys into
buckets by their leading bits, and only those blocks are shuffled. Each bucket then gives its own segment of the filter,
sized by its items, with its part of the exact unigram table. The leading bits come from the context, so a bucket knows
all followers of its contexts.

A model of at most ``max_broadcast`` bytes is broadcast, in pieces of a few MB that the driver handles one by one, and is
given up again once the scores are written. Each Python worker holds a copy of what is broadcast, so that bound is one of a
worker. A larger model, of at most ``max_mapped`` bytes, reaches the workers through the folder that all executors share:
tasks write its pieces there as plain arrays, and workers map them into memory, so a machine holds one copy, of the pages
that are probed, and the driver none. Beyond that, or where the folder can't be mapped, the model stays where it was built:
texts are probed by two shuffles of n-gram hashes, one to the segments and one back with what was found there. All ways
read the same bits and give the same scores; the last is linear in corpus and model, whatever their sizes.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as stores
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.textblocks import WordHasher, Words, blocks, distinct, distinct_places, give_back_memory, mix
from lodestone.session import staged, staging_dir

#: The longest n-gram.
ORDER = 3
#: Base of the log scale.
BASE = 1.5
BITS_PER_ITEM = 12
#: Every Python worker of an executor holds a copy.
MAX_BROADCAST = 48 << 20
#: What a machine's page cache can be expected to hold.
MAX_MAPPED = 16 << 30
#: The driver gathers and passes on about so much at once.
PIECE = 8 << 20
#: Characters of text whose n-grams fall in a bucket, about.
BUCKET_CHARS = 1_000_000
#: Hashes that a task gathers before it counts them.
GATHERED = 1 << 20
#: Tokens of the texts that are probed together: their distinct hashes, in order.
CHUNK_TOKENS = 1 << 17
#: Distinct hashes that are probed at once, over all pieces that they lie in: few enough for a core's cache.
PROBED = 1 << 15
_FOLLOWER_BITS = np.uint64(24)
_START, _END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_STEP, _FOLLOWERS = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


def crc_remainder(key: str, n: int):
    """crc32 of the key as text, modulo n; null for a null key."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % n


class Tokens:
    """Hashes of the tokens of a block (each text's words, then one end), and the keys of the n-grams that end there.

    ``contexts[k]`` and ``keys[k]`` belong to the (k + 2)-grams. A key holds 40 bits of its context's hash, then 24 bits
    of the token's. Places before a text's first word count as start marks."""

    __slots__ = ("contexts", "first", "keys", "start", "token")

    def __init__(self, words: Words, order: int):
        n, pad = len(words.first) - 1, order - 1
        sizes = np.diff(words.first)
        text = np.repeat(np.arange(n), sizes)
        row = np.full(len(words.hashes) + n * (1 + pad), _START, dtype=np.uint64)
        row[np.arange(len(text)) + text * (1 + pad) + pad] = words.hashes
        ends = np.cumsum(sizes + 1 + pad) - 1
        row[ends] = _END
        is_token = np.ones(len(row), dtype=bool)
        for k in range(pad):
            is_token[ends - sizes - pad + k] = False
        at = np.flatnonzero(is_token)
        self.token, self.first = row[at], np.concatenate([[0], np.cumsum(sizes + 1)])
        self.start = np.zeros(len(at), dtype=bool)
        self.start[self.first[:-1]] = True
        self.contexts, self.keys = [], []
        context = np.zeros(len(at), dtype=np.uint64)
        for k in range(1, order):
            context = mix(context + row[at - k] * _STEP + np.uint64(k))
            self.contexts.append(context)
            self.keys.append((context >> _FOLLOWER_BITS << _FOLLOWER_BITS) | (mix(self.token ^ context) >> np.uint64(40)))


def _counted(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if counts is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    begins = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[begins], np.add.reduceat(counts, begins) if len(begins) else counts


def _buckets(keys: np.ndarray, n: int) -> np.ndarray:
    """By leading bits, so that sorted keys have sorted buckets."""
    return ((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def packed(keys: np.ndarray) -> bytes:
    """Sorted keys: the first, then the gaps between them in the fewest whole bytes that hold each, compressed."""
    gaps = np.diff(keys).astype("<u8")
    width = max(1, -(-int(gaps.max(initial=0)).bit_length() // 8))
    return keys[:1].tobytes() + bytes([width]) + pa.compress(gaps.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes(), codec="zstd", asbytes=True)


def unpacked(raw: bytes, n: int) -> np.ndarray:
    gaps = np.zeros((n, 8), dtype=np.uint8)
    gaps[0] = np.frombuffer(raw[:8], dtype=np.uint8)
    width = raw[8]
    if n > 1:
        gaps[1:, :width] = np.frombuffer(pa.decompress(raw[9:], (n - 1) * width, codec="zstd", asbytes=True), dtype=np.uint8).reshape(width, -1).T
    return np.cumsum(gaps.view("<u8").ravel(), dtype=np.uint64)


def _runs(sorted_groups: np.ndarray) -> list[tuple[int, int, int]]:
    """(group, from, to) of each run of equal values: of those that occur only."""
    if not len(sorted_groups):
        return []
    begins = np.flatnonzero(np.concatenate([[True], sorted_groups[1:] != sorted_groups[:-1]]))
    return list(zip(sorted_groups[begins].tolist(), begins.tolist(), [*begins[1:].tolist(), len(sorted_groups)]))


def _ngram_blocks(docs: DataFrame, text: str, order: int, n_buckets: int) -> DataFrame:
    """(kind, bucket, n, keys, counts): kind 1 for unigrams, 2 for longer n-grams; counts of one task's hashes."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back_memory()
        hasher = WordHasher()
        held: dict[int, list] = {1: [], 2: []}
        size = {1: 0, 2: 0}

        def give(kind: int) -> pa.RecordBatch:
            keys, counts = _counted(np.concatenate(held[kind]))
            held[kind].clear()
            size[kind] = 0
            runs = _runs(_buckets(keys, n_buckets))
            narrow = counts.astype("<u4") if counts.max(initial=0) < 1 << 32 else counts.astype("<i8")
            return pa.RecordBatch.from_arrays(
                [pa.array([kind] * len(runs), pa.int32()), pa.array([r for r, _, _ in runs], pa.int32()), pa.array([y - x for _, x, y in runs], pa.int32()), pa.array([packed(keys[x:y]) for _, x, y in runs], pa.binary()), pa.array([narrow[x:y].tobytes() for _, x, y in runs], pa.binary())],
                names=["kind", "bucket", "n", "keys", "counts"],
            )

        for part in parts:
            for _, _, data, offsets in blocks(part, "text"):
                tokens = Tokens(hasher.words(data, offsets), order)
                for kind, got in ((1, [tokens.token]), (2, tokens.keys)):
                    held[kind] += got
                    size[kind] += sum(map(len, got))
                    if size[kind] >= GATHERED:
                        yield give(kind)
        for kind in (1, 2):
            if size[kind]:
                yield give(kind)

    return docs.select(F.col(text).alias("text")).mapInArrow(count, "kind int, bucket int, n int, keys binary, counts binary")


def _narrow(counts: np.ndarray) -> str:
    return "<u4" if counts.max(initial=0) < 1 << 32 else "<i8"


def levels_of(counts: np.ndarray, base: float) -> np.ndarray:
    return 1 + np.floor(np.log(np.maximum(counts, 1)) / math.log(base) + 1e-9).astype(np.int64)


def count_at(levels: np.ndarray, base: float) -> np.ndarray:
    """The count that a level stands for: the middle of its range, 0 for level 0."""
    j = levels.astype(np.float64)
    return np.where(levels > 0, (base ** (j - 1) + base**j - 1) / 2, 0.0)


def _slots(keys: np.ndarray, level: int | np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit word of its segment in which each (key, level) lies, and its four bits there."""
    h = mix(keys + np.asarray(level).astype(np.uint64) * _STEP)
    one = np.uint64(1)
    mask = one << (h & np.uint64(63))
    for shift in (6, 12, 18):
        mask |= one << (h >> np.uint64(shift) & np.uint64(63))
    return ((h >> np.uint64(32)) * sizes.astype(np.uint64) >> np.uint64(32)).astype(np.int64), mask


def _segments(counted: DataFrame, base: float, bits: int) -> DataFrame:
    """(bucket, kind, a, b, tokens): of kind 1, sorted hashes and their counts, with the sum of these; of kind 2, the
    segment of the filter."""
    rows = counted.groupBy("kind", "bucket").agg(F.collect_list(F.struct("n", "keys", "counts")).alias("found"))

    def build(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        give_back_memory()
        for part in parts:
            out = []
            for kind, bucket, found in zip(part["kind"], part["bucket"], part["found"]):
                keys = np.concatenate([unpacked(f["keys"], f["n"]) for f in found])
                counts = np.concatenate([np.frombuffer(f["counts"], dtype="<u4" if len(f["counts"]) == 4 * f["n"] else "<i8").astype(np.int64) for f in found])
                keys, counts = _counted(keys, counts)
                if kind == 1:
                    out.append((kind, bucket, keys.tobytes(), counts.astype(_narrow(counts)).tobytes(), int(counts.sum())))
                    continue
                begins = np.flatnonzero(np.concatenate([[True], np.diff(keys >> _FOLLOWER_BITS) != 0]))
                contexts, followers = keys[begins] >> _FOLLOWER_BITS << _FOLLOWER_BITS, np.diff(np.append(begins, len(keys)))
                items = []
                for what, levels, least in ((keys, levels_of(counts, base), 1), (contexts ^ _FOLLOWERS, levels_of(followers, base), 2)):
                    for level in range(least, int(levels.max()) + 1):
                        items.append((what[levels >= level], level))
                size = max(1, -(-sum(len(x) for x, _ in items) * bits // 64))
                words = np.zeros(size, dtype=np.uint64)
                for what, level in items:
                    at, mask = _slots(what, level, np.array(size))
                    np.bitwise_or.at(words, at, mask)
                out.append((kind, bucket, words.tobytes(), b"", 0))
            yield pd.DataFrame(out, columns=["kind", "bucket", "a", "b", "tokens"])

    return rows.mapInPandas(build, "kind int, bucket int, a binary, b binary, tokens long")


class Piece:
    """The model over a run of buckets, as arrays."""

    def __init__(self, rows: list, low: int, high: int, n_buckets: int):
        ones = sorted((r for r in rows if r["kind"] == 1), key=lambda r: r["bucket"])
        twos = sorted((r for r in rows if r["kind"] == 2), key=lambda r: r["bucket"])
        self.low, self.high, self.n_buckets = low, high, n_buckets
        self.hashes = np.frombuffer(b"".join(r["a"] for r in ones), dtype=np.uint64)
        counts = [np.frombuffer(r["b"], dtype="<u4" if 2 * len(r["b"]) == len(r["a"]) else "<i8") for r in ones]
        self.counts = np.concatenate(counts) if counts else np.zeros(0, dtype="<u4")
        self.words = np.frombuffer(b"".join(r["a"] for r in twos), dtype=np.uint64)
        self.sizes = np.zeros(high - low, dtype=np.int64)
        for r in twos:
            self.sizes[r["bucket"] - low] = len(r["a"]) // 8
        self.begins = np.cumsum(self.sizes) - self.sizes

    def stored(self) -> tuple[list[bytes], dict]:
        """Its arrays as bytes, one after another, and what it takes to read them again."""
        arrays = [self.hashes, self.words, self.sizes.astype("<i8"), self.counts]
        return [np.ascontiguousarray(a).tobytes() for a in arrays], {"low": self.low, "high": self.high, "n_buckets": self.n_buckets, "lengths": [len(a) for a in arrays], "narrow": self.counts.dtype.itemsize == 4}

    @classmethod
    def mapped(cls, path: str, told: dict) -> Piece:
        """The piece of a file that stored() has written, without reading it: its pages come as they are probed."""
        piece = cls([], told["low"], told["high"], told["n_buckets"])
        with pa.memory_map(path) as source:
            raw = source.read_buffer()
        at = 0
        for name, kind, n in zip(("hashes", "words", "sizes", "counts"), ("<u8", "<u8", "<i8", "<u4" if told["narrow"] else "<i8"), told["lengths"]):
            setattr(piece, name, np.frombuffer(raw, dtype=kind, count=n, offset=at))
            at += n * np.dtype(kind).itemsize
        piece.begins = np.cumsum(piece.sizes) - piece.sizes
        return piece

    def unigrams(self, tokens: np.ndarray) -> np.ndarray:
        """Counts of tokens whose buckets are here."""
        if not len(self.hashes):
            return np.zeros(len(tokens), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.hashes, tokens), len(self.hashes) - 1)
        return np.where(self.hashes[at] == tokens, self.counts[at], 0).astype(np.int64)

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the segments of n-grams whose buckets are here begin, and how long they are."""
        segments = _buckets(keys, self.n_buckets) - self.low
        return self.begins[segments], self.sizes[segments]


def _by_piece(keys: np.ndarray, cuts: np.ndarray, n_buckets: int) -> list[tuple[int, int, int]]:
    """(piece, from, to) of sorted keys; cuts: the first bucket of each piece."""
    return _runs(np.searchsorted(cuts, _buckets(keys, n_buckets), side="right") - 1)


def _probe(runs: list[tuple[Piece, int, int]], keys: np.ndarray, begins: np.ndarray, sizes: np.ndarray, first: int) -> np.ndarray:
    """Level after level, over all pieces at once: the last that is present, 0 if none is. runs: (piece, from, to) of keys."""
    levels = np.zeros(len(keys), dtype=np.uint8)
    here, level, ends = np.flatnonzero(sizes > 0), first, [y for _, _, y in runs]
    while len(here):
        at, mask = _slots(keys[here], level, sizes[here])
        at += begins[here]
        words, x = np.empty(len(here), dtype=np.uint64), 0
        for (piece, _, _), y in zip(runs, np.searchsorted(here, ends).tolist()):
            if x < y:
                words[x:y] = piece.words[at[x:y]]
            x = y
        here = here[(words & mask) == mask]
        levels[here] = level
        level += 1
    return levels


def _levels(runs: list[tuple[Piece, int, int]], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Levels of sorted n-grams, and of the followers of their contexts. A context is probed once for all its n-grams,
    which lie side by side."""
    if not len(keys):
        return np.zeros(0, dtype=np.uint8), np.zeros(0, dtype=np.uint8)
    begins, sizes = (np.concatenate(x) for x in zip(*(piece.places(keys[x:y]) for piece, x, y in runs)))
    contexts = keys >> _FOLLOWER_BITS << _FOLLOWER_BITS
    once = np.flatnonzero(np.concatenate([[True], contexts[1:] != contexts[:-1]]))
    runs_once = [(piece, *np.searchsorted(once, [x, y]).tolist()) for piece, x, y in runs]
    followers = _probe(runs_once, contexts[once] ^ _FOLLOWERS, begins[once], sizes[once], 2)
    return _probe(runs, keys, begins, sizes, 1), np.repeat(followers, np.diff(np.append(once, len(keys))))


def _chunks(parts: Iterator[pa.RecordBatch], order: int) -> Iterator[list[tuple[pa.RecordBatch, Tokens]]]:
    """Blocks of texts of about CHUNK_TOKENS tokens together."""
    hasher, held, size = WordHasher(), [], 0
    for part in parts:
        for a, b, data, offsets in blocks(part, "text"):
            held.append((part.slice(a, b - a), Tokens(hasher.words(data, offsets), order)))
            size += len(held[-1][1].token)
            if size >= CHUNK_TOKENS:
                yield held
                held, size = [], 0
    if held:
        yield held


def _longer(chunk: list[tuple[pa.RecordBatch, Tokens]]) -> np.ndarray:
    return np.concatenate([np.zeros(0, dtype=np.uint64), *(k for _, t in chunk for k in t.keys)])


def token_scores(tokens: Tokens, counts: np.ndarray, found: np.ndarray, n: int, v: int, texts: int, base: float) -> tuple[np.ndarray, np.ndarray]:
    """log10 probabilities of the tokens: of the add-half unigram, and of the interpolated model."""
    p = (counts + 0.5) / (n + 0.5 * (v + 1))
    plain = np.log10(p)
    before = np.empty(len(counts))  # how often the context was seen: exactly for one word, else from the filter
    before[1:] = counts[:-1]
    before[tokens.start] = texts
    for k in range(len(tokens.keys)):
        whole = np.minimum(count_at(found[2 * k], base), before)
        others = np.minimum(np.maximum(count_at(found[2 * k + 1], base), 1.0), np.maximum(before, 1.0))
        p = np.where(before > 0, (whole + others * p) / (before + others), p)
        longer = np.empty_like(before)
        longer[1:] = whole[:-1]
        longer[tokens.start] = texts
        before = longer
    return plain, np.log10(p)


_RESULT = "n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scored(keys: pa.Array, tokens: Tokens, counts: np.ndarray, levels: np.ndarray, known: tuple[int, int, int], base: float) -> pa.RecordBatch:
    """Sums over each text, from the counts of its tokens and, order by order, the levels of its longer n-grams and of their
    contexts' followers. known: tokens, distinct tokens and texts of the training part."""
    n, v, texts = known
    plain, full = token_scores(tokens, counts, levels, n, v, texts, base)
    sums = lambda x: np.add.reduceat(x, tokens.first[:-1])  # noqa: E731  every text has an end
    return pa.RecordBatch.from_arrays(
        [keys, pa.array(np.diff(tokens.first), pa.int64()), pa.array(sums((counts > 0).astype(np.int64)), pa.int64()), pa.array([n] * len(keys), pa.int64()), pa.array(sums(plain)), pa.array(sums(full))],
        names=["key", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    )


def _probed(todo: DataFrame, kind: str, order: int, base: float, n_buckets: int, cuts: np.ndarray, known: tuple[int, int, int], pieces_of: Callable[[], Callable[[int], Piece]]) -> DataFrame:
    """Texts stay where they are. pieces_of() is called once a task and gives the pieces by number."""

    def apply(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back_memory()
        piece = pieces_of()
        for chunk in _chunks(parts, order):
            ones, of_one = distinct_places(np.concatenate([t.token for _, t in chunk]))
            twos, of_two = distinct_places(_longer(chunk))
            counts, levels = np.zeros(len(ones), dtype=np.int64), np.zeros((2, len(twos)), dtype=np.uint8)
            for p, x, y in _by_piece(ones, cuts, n_buckets):
                counts[x:y] = piece(p).unigrams(ones[x:y])
            for low in range(0, len(twos), PROBED):
                some = twos[low : low + PROBED]
                levels[:, low : low + PROBED] = _levels([(piece(p), x, y) for p, x, y in _by_piece(some, cuts, n_buckets)], some)
            at = 0
            for batch, tokens in chunk:
                m, low = len(tokens.token), at * (order - 1)
                found = levels[:, of_two[low : low + m * (order - 1)]].reshape(2, order - 1, m).swapaxes(0, 1).reshape(-1, m)
                yield _scored(batch.column("key"), tokens, counts[of_one[at : at + m]], found, known, base)
                at += m

    return staged(todo.mapInArrow(apply, f"key {kind}, {_RESULT}"), "scores")


def _cuts(n_buckets: int, n_pieces: int) -> np.ndarray:
    """The first bucket of each piece."""
    return np.array([n_buckets * k // n_pieces for k in range(n_pieces)], dtype=np.int64)


def _scored_in_place(todo: DataFrame, model: DataFrame, kind: str, order: int, base: float, n_buckets: int, n_pieces: int, known: tuple[int, int, int]) -> DataFrame:
    """The model is broadcast."""
    context = todo.sparkSession.sparkContext
    cuts = _cuts(n_buckets, n_pieces)
    shared = []
    for low, high in zip(cuts.tolist(), [*cuts[1:].tolist(), n_buckets]):
        rows = model.where(F.col("bucket").between(low, high - 1)).select("kind", "bucket", "a", "b").collect()
        shared.append(context.broadcast(Piece(rows, low, high, n_buckets)))
        del rows
        give_back_memory()

    def pieces() -> Callable[[int], Piece]:
        held = [p.value for p in shared]
        return held.__getitem__

    try:
        return _probed(todo, kind, order, base, n_buckets, cuts, known, pieces)
    finally:
        for p in shared:
            p.destroy()


def _local(folder: str) -> str | None:
    """The path under which a folder can be mapped, if it lies in a file system of the machine, as a mounted share does."""
    store, path = stores.FileSystem.from_uri(folder)
    return path if isinstance(store, stores.LocalFileSystem) else None


def _scored_mapped(todo: DataFrame, model: DataFrame, kind: str, order: int, base: float, n_buckets: int, n_pieces: int, known: tuple[int, int, int]) -> DataFrame:
    """The model is written to the shared folder, a file a piece, and mapped by the workers. The driver learns the files'
    names. A task that runs again writes under another name."""
    cuts = _cuts(n_buckets, n_pieces)
    folder = f"{_local(staging_dir(todo.sparkSession))}/filter-{uuid.uuid4().hex}"
    stores.LocalFileSystem().create_dir(folder, recursive=True)

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None

        def given() -> pa.RecordBatch:
            piece = Piece(held, int(cuts[at]), int(cuts[at + 1]) if at + 1 < n_pieces else n_buckets, n_buckets)
            arrays, told = piece.stored()
            name = uuid.uuid4().hex
            with stores.LocalFileSystem().open_output_stream(f"{folder}/{name}") as out:
                for raw in arrays:
                    out.write(raw)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([name]), pa.array([json.dumps(told)])], names=["piece", "name", "told"])

        for part in parts:
            for r in part.to_pylist():
                if held and r["piece"] != at:
                    yield given()
                at = r["piece"]
                held.append(r)
        if held:
            yield given()

    piece = F.floor((F.col("bucket").cast("long") * n_pieces + n_pieces - 1) / n_buckets).cast("int")
    dealt = model.select(piece.alias("piece"), "kind", "bucket", "a", "b").repartition(n_pieces, "piece").sortWithinPartitions("piece", "bucket")
    files = {r["piece"]: (r["name"], json.loads(r["told"])) for r in dealt.mapInArrow(write, "piece int, name string, told string").collect()}

    def pieces() -> Callable[[int], Piece]:
        held: dict[int, Piece] = {}

        def piece(p: int) -> Piece:
            if p not in held:
                held[p] = Piece.mapped(f"{folder}/{files[p][0]}", files[p][1]) if p in files else Piece([], int(cuts[p]), int(cuts[p + 1]) if p + 1 < n_pieces else n_buckets, n_buckets)
            return held[p]

        return piece

    return _probed(todo, kind, order, base, n_buckets, cuts, known, pieces)


def _scored_by_shuffles(todo: DataFrame, model: DataFrame, kind: str, order: int, base: float, n_buckets: int, n_pieces: int, known: tuple[int, int, int]) -> DataFrame:
    """Distinct hashes of a chunk of texts go to the piece of the model that has their buckets, and the counts and levels
    found come back to the chunk. A task streams through its rows in order and holds one piece, or one chunk."""
    cuts = _cuts(n_buckets, n_pieces)
    piece = F.floor((F.col("bucket").cast("long") * n_pieces + n_pieces - 1) / n_buckets).cast("int")

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _chunks(parts, order):
            shape = pa.schema([("chunk", pa.string()), ("piece", pa.int32()), ("keys", pa.list_(held[0][0].schema.field("key").type)), ("texts", pa.list_(pa.string())), ("ones", pa.binary()), ("twos", pa.binary())])
            chunk = uuid.uuid4().hex
            rows = [{"chunk": chunk, "piece": -1, "keys": [k for b, _ in held for k in b.column("key").to_pylist()], "texts": [t for b, _ in held for t in b.column("text").to_pylist()]}]
            of_ones, of_twos = ({p: packed(x[i:j]) + (j - i).to_bytes(4, "little") for p, i, j in _by_piece(x, cuts, n_buckets)} for x in (distinct(np.concatenate([t.token for _, t in held])), distinct(_longer(held))))
            rows += [{"chunk": chunk, "piece": p, "ones": of_ones.get(p), "twos": of_twos.get(p)} for p in sorted(of_ones.keys() | of_twos.keys())]
            yield pa.RecordBatch.from_pylist(rows, schema=shape)

    chunks = staged(todo.mapInArrow(cut, f"chunk string, piece int, keys array<{kind}>, texts array<string>, ones binary, twos binary"), "chunks")
    tables = model.select(piece.alias("piece"), F.lit("").alias("chunk"), "kind", "bucket", "a", "b")
    asked = chunks.where("piece >= 0").select("piece", "chunk", F.lit(0).alias("kind"), F.lit(0).alias("bucket"), F.col("ones").alias("a"), F.col("twos").alias("b"))

    def given(raw: bytes | None) -> np.ndarray:
        return unpacked(raw[:-4], int.from_bytes(raw[-4:], "little")) if raw else np.zeros(0, dtype=np.uint64)

    def probe(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, now, at = [], None, None
        for part in parts:
            out = []
            for r in part.to_pylist():
                if r["piece"] != at:
                    rows, now, at = [], None, r["piece"]
                if not r["chunk"]:  # the piece's own rows come first
                    rows.append(r)
                    continue
                now = now or Piece(rows, int(cuts[at]), int(cuts[at + 1]) if at + 1 < n_pieces else n_buckets, n_buckets)
                rows = []
                ones, twos = given(r["a"]), given(r["b"])
                levels, followers = _levels([(now, 0, len(twos))], twos)
                out.append((r["chunk"], at, now.unigrams(ones).tobytes(), levels.tobytes() + followers.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.string(), pa.int32(), pa.binary(), pa.binary()))], names=["chunk", "piece", "counts", "levels"])

    dealt = tables.unionByName(asked).repartition(n_pieces, "piece").sortWithinPartitions("piece", "chunk", "bucket")
    answers = dealt.mapInArrow(probe, "chunk string, piece int, counts binary, levels binary")
    back = chunks.where("piece >= 0").select("chunk", "piece", "ones", "twos").join(answers, ["chunk", "piece"])
    none = F.lit(None)
    back = back.select("chunk", "piece", none.cast(f"array<{kind}>").alias("keys"), none.cast("array<string>").alias("texts"), "ones", "twos", "counts", "levels")
    whole = back.unionByName(chunks.where("piece < 0").select("chunk", "piece", "keys", "texts", *[none.cast("binary").alias(c) for c in ("ones", "twos", "counts", "levels")]))
    whole = whole.repartition("chunk").sortWithinPartitions("chunk", "piece")

    def finish(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def give() -> Iterator[pa.RecordBatch]:
            keys, texts, kinds, answers = held
            ones, counts = (np.concatenate([x[k] for x in answers]) for k in (0, 1))
            twos, levels = np.concatenate([x[2] for x in answers]), np.concatenate([x[3] for x in answers], axis=1)
            # pieces are runs of buckets and so of keys: what comes back in order of pieces is sorted
            batch = pa.RecordBatch.from_arrays([pa.array(keys, kinds), pa.array(texts, pa.string())], names=["key", "text"])
            for chunk in _chunks(iter([batch]), order):
                for part, tokens in chunk:
                    found = [levels[:, np.searchsorted(twos, k)] for k in tokens.keys]
                    yield _scored(part.column("key"), tokens, counts[np.searchsorted(ones, tokens.token)], np.concatenate(found) if found else np.zeros((0, len(tokens.token)), dtype=np.uint8), known, base)

        for part in parts:
            kinds = part.schema.field("keys").type.value_type
            for r in part.to_pylist():
                if r["piece"] < 0:
                    if held:
                        yield from give()
                    held = (r["keys"], r["texts"], kinds, [])
                else:
                    twos = given(r["twos"])
                    held[3].append((given(r["ones"]), np.frombuffer(r["counts"], dtype=np.int64), twos, np.frombuffer(r["levels"], dtype=np.uint8).reshape(2, len(twos))))
        if held:
            yield from give()

    return staged(whole.mapInArrow(finish, f"key {kind}, {_RESULT}"), "scores")


def score(docs: DataFrame, training: DataFrame, key: str = "doc_id", text: str = "text", order: int = ORDER, base: float = BASE, bits: int = BITS_PER_ITEM, max_broadcast: int = MAX_BROADCAST, max_mapped: int = MAX_MAPPED) -> DataFrame:
    """Per row of docs: key, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are runs of bytes other than ASCII white space, A-Z lower-cased, then one end for each text; null and empty
    texts are one end. base_score sums log10 of the add-half unigram with exact counts, score that of the model. Rows
    that repeat count and are scored as often as they occur. With no training text at all, both scores take the uniform
    add-half value of an empty model. Other columns are not read.
    """
    kind = dict(docs.dtypes)[key]
    # one small row: how much there is to count
    chars, texts = training.agg(F.coalesce(F.sum(F.length(text)), F.lit(0)), F.count(F.lit(1))).first()
    n_buckets = max(16, -(-chars // BUCKET_CHARS))
    model = staged(_segments(_ngram_blocks(training, text, order, n_buckets), base, bits), "model")
    held = model.groupBy().agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("kind") == 1, F.length("a") / 8)), F.lit(0)).cast("long").alias("v"), F.coalesce(F.sum(F.length("a") + F.length("b")), F.lit(0)).alias("bytes")).first()
    # buckets are even, so equal runs of them are even too
    pieces = min(n_buckets, max(1, -(-held["bytes"] // min(PIECE, max_broadcast))))
    mappable = held["bytes"] <= max_mapped and _local(staging_dir(docs.sparkSession)) is not None
    way = _scored_in_place if held["bytes"] <= max_broadcast else _scored_mapped if mappable else _scored_by_shuffles
    todo = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    return way(todo, model, kind, order, base, n_buckets, pieces, (held["n"], held["v"], texts)).withColumnRenamed("key", key)
