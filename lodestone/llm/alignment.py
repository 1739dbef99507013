"""Alignment of two tokenizers over a corpus: which ids of one stand for which ids of the other.

Every text is encoded by a byte-level vocabulary (A) and by a piece model (B) over the same bytes. Where tokens of both end
at the same byte, a group ends; each pair of tokens whose byte ranges overlap is a link. A pair of ids counts the documents
that hold it linked.

Pairs are packed into one 64-bit integer. Each task counts its own by ``np.unique`` and hands on partial counts; these are
dealt out by ranges of the key and sorted, and runs of one key are summed. The sums are written as sorted shards, raw
arrays in the folder that all executors share. Lookups memory-map the shards and search them by ``np.searchsorted``; from
a store that can't be mapped, a task reads one shard at a time. Only the shards' names and bounds reach the driver, and one
number for each id of A.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyarrow import fs as stores
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.byte_pairs import vocabulary_path
from lodestone.llm.packing import byte_encoding, share_ids
from lodestone.llm.textblocks import distinct, distinct_places, slices
from lodestone.session import staged, staging_dir

PIECES = "piece_bpe_32k.model"
#: Tokens of A whose links exist at once in a task; a longer text is a run of its own.
RUN_TOKENS = 1 << 17
#: Distinct pairs that a task holds before it hands on their counts.
HELD_PAIRS = 1 << 20
#: Keys in one shard at most.
SHARD_KEYS = 1 << 20


def share_pieces(spark, path: str) -> Broadcast:
    """The bytes of a piece model (about 0.5 MB, whatever the corpus). Only the driver opens the file."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def piece_bytes(model: sentencepiece.SentencePieceProcessor) -> list[bytes]:
    """The bytes that each id of B stands for."""
    name = model.id_to_piece
    return [bytes([int(name(i)[3:5], 16)]) if model.is_byte(i) else name(i).replace("▁", " ").encode() for i in range(model.get_piece_size())]


def encoded(docs: DataFrame, a_vocabulary: Broadcast, b_model: Broadcast, text: str, keep: list[str]) -> DataFrame:
    """The columns keep, a and b: packed unsigned 32-bit ids of space and text. Texts that are null or empty, or that the
    ids of A or B don't give back byte by byte, have none."""
    types = dict(docs.dtypes)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = a_vocabulary.value
        encode = byte_encoding(shared, special=False).encode_to_numpy
        entries = {i: raw for raw, i in shared["ids"].items()}
        model = sentencepiece.SentencePieceProcessor(model_proto=b_model.value)
        pieces = piece_bytes(model)

        def both(t: str) -> tuple[bytes, bytes]:
            if not t:
                return b"", b""
            spaced = " " + t
            raw, a, b = spaced.encode(), encode(spaced), model.encode(t)
            if b"".join(map(pieces.__getitem__, b)) != raw or b"".join(map(entries.__getitem__, a.tolist())) != raw:
                return b"", b""
            return a.astype("<u4").tobytes(), np.array(b, dtype="<u4").tobytes()

        for part in parts:
            for rows, texts in slices(part, text):
                a, b = zip(*map(both, texts))
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in keep), pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=[*keep, "_a", "_b"])

    schema = ", ".join([f"`{c}` {types[c]}" for c in keep] + ["_a binary", "_b binary"])
    return docs.select(*[docs[c] for c in dict.fromkeys([*keep, text])]).mapInArrow(run, schema)


class Lengths:
    """Bytes of each id, and how many bits an id of B takes in a packed pair. Fits one broadcast: two vocabularies."""

    def __init__(self, a_entries: dict, b_pieces: list[bytes]):
        self.a = np.zeros(max(a_entries.values()) + 1, dtype=np.int64)
        for raw, i in a_entries.items():
            self.a[i] = len(raw)
        self.b = np.array([len(p) for p in b_pieces], dtype=np.int64)
        self.bits = max(1, len(self.b) - 1).bit_length()
        self.all_bits = self.bits + max(1, len(self.a) - 1).bit_length()


def _ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a column of packed ids, and where each row's begin."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1] // 4
    raw = column.buffers()[2]
    return (np.frombuffer(raw, dtype="<u4")[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, "<u4")).astype(np.int64), offsets - offsets[0]


def _runs(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about RUN_TOKENS tokens."""
    offsets, at = _ids(part.column("_a"))[1], 0
    while at < part.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + RUN_TOKENS, side="right")) - 1)
        yield part.slice(at, end - at)
        at = end


class Links:
    """The links of a run of rows, in order: every end of a token, of A or B, ends the overlap of exactly one pair."""

    def __init__(self, rows: pa.RecordBatch, lengths: Lengths):
        self.n = rows.num_rows
        (self.a, self.a_first), (self.b, self.b_first) = _ids(rows.column("_a")), _ids(rows.column("_b"))
        self.a_ends, self.b_ends = np.cumsum(lengths.a[self.a]), np.cumsum(lengths.b[self.b])
        ends = distinct(np.concatenate([self.a_ends, self.b_ends]))
        at_a, at_b = np.searchsorted(self.a_ends, ends), np.searchsorted(self.b_ends, ends)
        self.doc = np.repeat(np.arange(self.n), np.diff(self.a_first))[at_a] if len(ends) else ends
        common = (self.a_ends[at_a] == ends) & (self.b_ends[at_b] == ends)
        self.common = ends[common]
        self.link_a = self.a[at_a]
        self.keys = (self.link_a << lengths.bits) | self.b[at_b]
        self.n_links = np.bincount(self.doc, minlength=self.n)
        self.n_groups = np.bincount(self.doc[common], minlength=self.n)

    def distinct_keys(self, bits: int) -> np.ndarray:
        """Keys, each once a document."""
        return distinct((self.doc.astype(np.int64) << bits) | self.keys) & ((1 << bits) - 1)

    def groups(self, tables: dict[str, np.ndarray]) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` of each row. tables: texts of ids with what may follow them."""
        a_group, b_group = np.searchsorted(self.common, self.a_ends), np.searchsorted(self.common, self.b_ends)
        out = np.empty(len(self.a) + len(self.b), dtype=object)
        last = self.common[a_group] == self.a_ends
        out[np.arange(len(self.a)) + np.searchsorted(b_group, a_group)] = np.where(last, tables["|"][self.a], tables[","][self.a])
        last = self.common[b_group] == self.b_ends
        texts = np.where(last, tables[";"][self.b], tables[","][self.b])
        final = self.b_first[1:][np.diff(self.b_first) > 0] - 1
        texts[final] = tables[""][self.b[final]]
        out[np.arange(len(self.b)) + np.searchsorted(a_group, b_group, side="right")] = texts
        first = self.a_first + self.b_first
        return ["".join(out[first[i] : first[i + 1]].tolist()) for i in range(self.n)]


def partial_counts(ids: DataFrame, lengths: Broadcast) -> DataFrame:
    """(key, n): counts of documents that hold a pair, combined within each task as far as HELD_PAIRS go."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = lengths.value
        keys, counts, waiting, waits = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

        def combined() -> tuple[np.ndarray, np.ndarray]:
            fresh, own = np.unique(np.concatenate(waiting), return_counts=True)
            every, places = distinct_places(np.concatenate([keys, fresh]))
            return every, np.bincount(places, weights=np.concatenate([counts, own])).astype(np.int64)

        for part in parts:
            for rows in _runs(part):
                waiting.append(Links(rows, sizes).distinct_keys(sizes.all_bits))
                waits += len(waiting[-1])
                if waits >= HELD_PAIRS:
                    (keys, counts), waiting, waits = combined(), [], 0
                    if len(keys) >= HELD_PAIRS:
                        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["key", "n"])
                        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if waiting:
            keys, counts = combined()
        if len(keys):
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["key", "n"])

    return ids.select("_a", "_b").mapInArrow(run, "key long, n long")


def summed_runs(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, sums) of sorted (key, n) batches, each key once: the last run of a batch waits for the next."""
    keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for part in parts:
        keys = np.concatenate([keys, part.column("key").to_numpy()])
        sums = np.concatenate([sums, part.column("n").to_numpy()])
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        keys, sums = keys[starts], np.add.reduceat(sums, starts) if len(keys) else sums
        if len(keys) > SHARD_KEYS:
            yield keys[:SHARD_KEYS], sums[:SHARD_KEYS]
            keys, sums = keys[SHARD_KEYS:], sums[SHARD_KEYS:]
    if len(keys):
        yield keys, sums


def store_of(folder: str) -> tuple[stores.FileSystem, str]:
    return stores.FileSystem.from_uri(folder)


class Counts:
    """The shards' names and bounds, in order of their keys, and the highest count of each id of A. Grows by one entry for
    SHARD_KEYS pairs or a partition."""

    def __init__(self, folder: str, rows: list, lengths: Lengths):
        rows = sorted(rows, key=lambda r: r["low"])
        self.folder, self.names = folder, [r["name"] for r in rows]
        self.lows, self.sizes = np.array([r["low"] for r in rows], np.int64), [r["size"] for r in rows]
        self.best = np.zeros(len(lengths.a), np.int64)
        for r in rows:
            at = np.frombuffer(r["a"], "<i8")
            self.best[at] = np.maximum(self.best[at], np.frombuffer(r["best"], "<i8"))

    def reader(self) -> Callable[[np.ndarray], np.ndarray]:
        """A function from sorted distinct keys to their counts; 0 for a key that has none."""
        store, folder = store_of(self.folder)
        local, mapped = isinstance(store, stores.LocalFileSystem), {}

        def shard(i: int) -> tuple[np.ndarray, np.ndarray]:
            if i not in mapped:
                if not local:
                    mapped.clear()  # one shard at a time in memory
                path = f"{folder}/{self.names[i]}"
                with pa.memory_map(path) if local else store.open_input_file(path) as source:
                    values = np.frombuffer(source.read_buffer() if local else source.readall(), "<i8")
                mapped[i] = values[: self.sizes[i]], values[self.sizes[i] :]
            return mapped[i]

        def found(keys: np.ndarray) -> np.ndarray:
            out = np.zeros(len(keys), np.int64)
            cuts = [*np.searchsorted(keys, self.lows).tolist(), len(keys)]
            for i, (start, end) in enumerate(zip(cuts, cuts[1:])):
                if start < end:
                    held, counts = shard(i)
                    at = np.minimum(np.searchsorted(held, keys[start:end]), len(held) - 1)
                    out[start:end] = np.where(held[at] == keys[start:end], counts[at], 0)
            return out

        return found


def count_shards(partial: DataFrame, lengths: Broadcast) -> Counts:
    """Sorts partial counts by ranges, sums runs, and writes the shards. A task that is repeated writes under new names;
    only what a task that ended has told is read."""
    spark = partial.sparkSession
    folder = f"{staging_dir(spark).rstrip('/')}/pairs-{uuid.uuid4().hex}"
    store, path = store_of(folder)
    store.create_dir(path, recursive=True)

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = store_of(folder)
        bits = lengths.value.bits
        for keys, sums in summed_runs(parts):
            name = uuid.uuid4().hex
            with store.open_output_stream(f"{path}/{name}") as out:
                out.write(keys.astype("<i8").tobytes())
                out.write(sums.astype("<i8").tobytes())
            owners = keys >> bits
            starts = np.flatnonzero(np.concatenate([[True], owners[1:] != owners[:-1]]))
            best = np.maximum.reduceat(sums, starts)
            row = [[name], [int(keys[0])], [len(keys)], [owners[starts].astype("<i8").tobytes()], [best.astype("<i8").tobytes()]]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["name", "low", "size", "a", "best"])

    told = partial.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(write, "name string, low long, size long, a binary, best binary")
    return Counts(folder, told.collect(), lengths.value)


def pair_table(counts: Counts, spark, lengths: Lengths) -> DataFrame:
    """(a, b, n): the counted pairs as rows, read from the shards."""
    if not counts.names:
        return spark.createDataFrame([], "a long, b long, n long")
    shards = spark.createDataFrame(list(zip(counts.names, counts.sizes)), "name string, size long").repartition(min(len(counts.names), 200))
    folder, bits = counts.folder, lengths.bits

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = store_of(folder)
        for part in parts:
            for name, size in zip(part.column("name").to_pylist(), part.column("size").to_pylist()):
                with store.open_input_file(f"{path}/{name}") as source:
                    values = np.frombuffer(source.readall(), "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(values[:size] >> bits), pa.array(values[:size] & ((1 << bits) - 1)), pa.array(values[size:])], names=["a", "b", "n"])

    return shards.mapInArrow(run, "a long, b long, n long")


def aligned(docs: DataFrame, text: str = "text", keep: list[str] | None = None, a_path: str | None = None, b_path: str | None = None, digest: bool = False) -> DataFrame:
    """The columns ``keep`` (all but the text by default) and, for each row: n_a, n_b (tokens), n_groups, n_links, n_best
    (links whose pair has the highest count of its A id, ties included), count_sum (over links), groups (``a1,a2|b1;a3|b2``,
    decimal ids in order). With ``digest``, groups_sha256 takes the place of groups.

    Null and empty texts, and those that either tokenizer doesn't give back byte by byte, have zeros and an empty string.
    Repeated rows count as documents of their own; very long texts are taken whole. Columns of docs that have the new
    names are replaced. An empty table gives no rows.
    """
    spark = docs.sparkSession
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    last = "groups_sha256" if digest else "groups"
    kept = [c for c in (keep if keep is not None else docs.columns) if c not in (*names, last, "_a", "_b") and (keep is not None or c != text)]
    a_vocabulary = share_ids(spark, a_path or vocabulary_path())
    b_model = share_pieces(spark, b_path or vocabulary_path(PIECES))
    sizes = Lengths(a_vocabulary.value["ids"], piece_bytes(sentencepiece.SentencePieceProcessor(model_proto=b_model.value)))
    lengths = spark.sparkContext.broadcast(sizes)
    ids = staged(encoded(docs, a_vocabulary, b_model, text, kept), "ids")
    shared = spark.sparkContext.broadcast(count_shards(staged(partial_counts(ids, lengths), "pairs"), lengths))
    types = dict(docs.dtypes)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, counts = lengths.value, shared.value
        look_up, numbers = counts.reader(), range(max(len(sizes.a), len(sizes.b)))
        tables = {end: np.array([f"{i}{end}" for i in numbers], dtype=object) for end in (",", "|", ";", "")}
        for part in parts:
            for rows in _runs(part):
                links = Links(rows, sizes)
                keys, places = distinct_places(links.keys)
                count = look_up(keys)[places]
                sums = np.concatenate([[0], np.cumsum(count)])
                bounds = np.searchsorted(links.doc, np.arange(links.n + 1))
                best = np.bincount(links.doc, weights=count == counts.best[links.link_a], minlength=links.n).astype(np.int64)
                texts = links.groups(tables)
                if digest:
                    texts = [t and hashlib.sha256(t.encode()).hexdigest() for t in texts]
                values = [np.diff(links.a_first), np.diff(links.b_first), links.n_groups, links.n_links, best, sums[bounds[1:]] - sums[bounds[:-1]]]
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in kept), *(pa.array(v.astype(np.int64)) for v in values), pa.array(texts, pa.string())], names=[*kept, *names, last])

    schema = ", ".join([f"`{c}` {types[c]}" for c in kept] + [f"{n} long" for n in names] + [f"{last} string"])
    return ids.mapInArrow(run, schema)
