"""Byte-pair encoding and decoding with a contiguous rank array per word.

A text is cut at special tokens and then into words by the vocabulary's pattern. Each word's bytes are merged with two
small arrays held side by side: the boundaries of the parts, and the rank of each adjacent pair. The lowest rank is
found by a scan, its inner boundary is deleted, and the ranks next to it are refreshed. Scanning is quadratic in the
word's length, so words of more than ``SCAN_LIMIT`` bytes (rare: runs of punctuation, unbroken scripts) take the same
merges from a heap over a linked list, which gives the same parts in n log n.

Words repeat, so each task keeps the ids of the short words it has met, in at most ``CACHED_BYTES``.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame

from lodestone.llm.textblocks import slices

SCAN_LIMIT = 96
#: Of words and their ids in a task, counting ENTRY_BYTES for the objects of each.
CACHED_BYTES, ENTRY_BYTES = 24 << 20, 160
#: The longest word, in characters, that is worth keeping.
CACHED_CHARS = 48
NO_PAIR = 1 << 30

#: Fixed value: the pattern of byte-level vocabularies of this family.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


#: Of the public vocabulary files.
VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where the file lies; only the driver opens it."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in a vocabulary file: printable Latin-1 as itself, the others
    as the characters from 256 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


def read_vocabulary(path: str) -> dict:
    """The ranks of merges by their bytes, the bytes of every id, and special tokens, from a tokenizers file. Its size
    is fixed by the vocabulary (50,257 entries), whatever the corpus."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    symbols = byte_symbols()
    as_bytes = lambda token: bytes(symbols[c] for c in token)
    special = {t["content"]: t["id"] for t in told["added_tokens"]}
    vocab = {as_bytes(t): i for t, i in told["model"]["vocab"].items() if t not in special}
    merged = {}
    for rank, pair in enumerate(told["model"]["merges"]):
        left, right = pair if isinstance(pair, list) else pair.split(" ")
        merged.setdefault(as_bytes(left) + as_bytes(right), rank)
    texts = {i: t for t, i in vocab.items()} | {i: s.encode() for s, i in special.items()}
    return {"ranks": merged, "ids": vocab, "special": special, "bytes": [texts.get(i, b"") for i in range(max(texts) + 1)]}


def merged_by_scan(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Boundaries of the parts of a short word: both arrays stay contiguous, and a merge deletes one entry of each."""
    rank = ranks.get
    bounds = list(range(len(word) + 1))
    pair_rank = [rank(word[i : i + 2], NO_PAIR) for i in bounds[:-2]]
    while pair_rank:
        lowest = min(pair_rank)
        if lowest == NO_PAIR:
            break
        at = pair_rank.index(lowest)
        del bounds[at + 1], pair_rank[at]
        start = bounds[at]
        if at < len(pair_rank):
            pair_rank[at] = rank(word[start : bounds[at + 2]], NO_PAIR)
        if at:
            pair_rank[at - 1] = rank(word[bounds[at - 1] : bounds[at + 1]], NO_PAIR)
    return bounds


def merged_by_heap(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same boundaries for a long word. Part i starts at byte i; ``after`` and ``before`` link the living parts."""
    n = len(word)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    end = lambda i: after[i]  # noqa: E731  parts are contiguous, so a part ends where the next begins
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2], NO_PAIR)) != NO_PAIR]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or (j := after[i]) >= n or end(j) != stop:
            continue
        alive[j] = False
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
            if (r := ranks.get(word[i : end(after[i])], NO_PAIR)) != NO_PAIR:
                heapq.heappush(heap, (r, i, end(after[i])))
        if (h := before[i]) >= 0 and (r := ranks.get(word[h : after[i]], NO_PAIR)) != NO_PAIR:
            heapq.heappush(heap, (r, h, after[i]))
    return [i for i in range(n) if alive[i]] + [n]


class _Words(dict):
    """Packed little-endian ids by word; a miss is encoded and kept."""

    def __init__(self, ranks: dict[bytes, int], ids: dict[bytes, int]):
        super().__init__()
        self.ranks, self.size = ranks, 0
        self.packed = {part: i.to_bytes(4, "little") for part, i in ids.items()}

    def __missing__(self, word: str) -> bytes:
        raw, whole = word.encode(), self.packed
        bounds = (merged_by_scan if len(raw) <= SCAN_LIMIT else merged_by_heap)(raw, self.ranks)
        packed = b"".join([whole[raw[a:b]] for a, b in pairwise(bounds)])
        if len(word) <= CACHED_CHARS:
            entry = ENTRY_BYTES + len(raw) + len(packed)
            if self.size + entry > CACHED_BYTES:
                self.clear()
                self.size = 0
            self.size += entry
            self[word] = packed
        return packed


class BytePairs:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, vocabulary: dict):
        self.words = _Words(vocabulary["ranks"], vocabulary["ids"])
        self.bytes = vocabulary["bytes"]
        self.special = {s: np.array([i], dtype="<u4").tobytes() for s, i in vocabulary["special"].items()}
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.split = regex.compile(WORD_PATTERN).findall

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers. Special tokens in the text get their own ids."""
        pack = self.words.__getitem__
        if self.cut is None or not any(s in text for s in self.special):
            return b"".join(map(pack, self.split(text)))
        return b"".join(self.special[piece] if piece in self.special else b"".join(map(pack, self.split(piece))) for piece in self.cut.split(text))

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", "replace")


def share_vocabulary(spark, path: str) -> Broadcast:
    """Read on the driver and broadcast, so that executors need no copy of the file."""
    return spark.sparkContext.broadcast(read_vocabulary(path))


def encode_texts(docs: DataFrame, vocabulary: Broadcast, text: str = "text", ids: str = "ids", decoded: str | None = None, keep: list[str] | None = None, digest: bool = False) -> DataFrame:
    """Add the packed ids of every text, and its decoded form if ``decoded`` names a column.

    ``keep`` lists the columns to carry (all by default). Null and empty texts get zero ids. Columns that have the
    names of the new ones are replaced. With ``digest``, SHA-256 sums take the place of ids and decoded text (columns
    ``n_tokens``, ``ids_sha256``, ``decoded_sha256``), so that only a few bytes a row leave the Python worker.
    Rows stay where they are: no shuffle.
    """
    new = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"} if digest else {"n_tokens": "long", ids: "binary"} | ({decoded: "string"} if decoded else {})
    kept = [c for c in (keep if keep is not None else docs.columns) if c not in new]
    if text in new:
        raise ValueError(f"{text} is both an input and an output")
    read = list(dict.fromkeys([*kept, text]))
    types = dict(docs.dtypes)
    schema = ", ".join([f"`{c}` {types[c]}" for c in kept] + [f"`{c}` {t}" for c, t in new.items()])

    def encoded(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = BytePairs(vocabulary.value)
        for part in parts:
            for rows, texts in slices(part, text):
                packed = [coder.encode(t) for t in texts]
                out = [pa.array([len(p) // 4 for p in packed], pa.int64())]
                if digest:
                    out.append(pa.array([hashlib.sha256(p).hexdigest() for p in packed], pa.string()))
                    out.append(pa.array([hashlib.sha256(coder.decode(p).encode()).hexdigest() for p in packed], pa.string()))
                else:
                    out.append(pa.array(packed, pa.binary()))
                    if decoded:
                        out.append(pa.array([coder.decode(p) for p in packed], pa.string()))
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in kept), *out], names=[*kept, *new])

    return docs.select(*[docs[c] for c in read]).mapInArrow(encoded, schema)
