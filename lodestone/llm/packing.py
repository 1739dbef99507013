"""Packing of documents into sequences of a fixed size, by bounded-space online best fit.

Each partition keeps at most ``open_windows`` unfinished windows. A piece goes into the fullest window that still has room
for it; if none has, a new window is opened, and where that would be one too many the fullest is emitted. As documents may
be cut, the piece's head fills that window up first, so by default no emitted window is padded. Windows that are open at a
partition's end are merged: leftovers of ``FAN_IN`` partitions meet in one task and are packed again in the same way, then
those of FAN_IN such groups, until one group is left. Its open windows are joined to full ones, and what stays over (less
than a window, once for the whole corpus) is cut into sequences whose lengths are powers of two, which are not padded.

A partition's task holds its open windows and one slice of texts; a merging task FAN_IN times as many windows. Every round
is staged, so a lost executor repeats tasks of one round only.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.byte_pairs import WORD_PATTERN, read_vocabulary
from lodestone.llm.textblocks import slices
from lodestone.session import staged

SIZE, OPEN_WINDOWS, FAN_IN = 1024, 16, 64
#: The id that ends a document.
END = 0
#: Pieces are handed on once there are so many.
BATCH_ROWS = 4096


def share_ids(spark, path: str) -> Broadcast:
    """The ids of byte sequences and special tokens of a byte-level vocabulary file, whose size is fixed (about 50,000
    entries). Only the driver opens the file."""
    told = read_vocabulary(path)
    return spark.sparkContext.broadcast({"ids": told["ids"], "special": told["special"]})


def byte_encoding(shared: dict, special: bool = True) -> tiktoken.Encoding:
    """The encoder of one task. With ``special``, special tokens that stand in a text get their own ids; else they are text."""
    return tiktoken.Encoding("byte_pairs", pat_str=WORD_PATTERN, mergeable_ranks=shared["ids"], special_tokens=shared["special"] if special else {})


class Window:
    __slots__ = ("number", "fill", "pieces")

    def __init__(self, number: int):
        self.number, self.fill, self.pieces = number, 0, []


class Packer:
    """Open windows, and the pieces (row, start, ids, window number, offset) of those that were emitted."""

    def __init__(self, size: int, open_windows: int, first_number: int, spare: int = 0):
        self.size, self.most, self.next, self.spare = size, open_windows, first_number, spare
        self.open: list[Window] = []
        self.done: list[tuple] = []

    def _opened(self) -> Window:
        window = Window(self.next)
        self.next += 1
        return window

    def _put(self, window: Window, row: tuple, start: int, ids: np.ndarray) -> None:
        window.pieces.append((row, start, ids, window.number, window.fill))
        window.fill += len(ids)
        if window.fill == self.size:
            self._emit(window)

    def _emit(self, window: Window) -> None:
        if window in self.open:
            self.open.remove(window)
        self.done += window.pieces

    def add(self, row: tuple, start: int, ids: np.ndarray) -> None:
        """Whole windows of a long run of ids are emitted at once, the rest is placed."""
        whole = len(ids) - len(ids) % self.size
        for at in range(0, whole, self.size):
            self._put(self._opened(), row, start + at, ids[at : at + self.size])
        start, rest = start + whole, ids[whole:].copy()  # a view would keep the whole document alive
        while len(rest):
            roomy = [w for w in self.open if w.fill + len(rest) <= self.size]
            if roomy:
                target, taken = max(roomy, key=lambda w: w.fill), len(rest)
            elif len(self.open) < self.most:
                target, taken = self._opened(), len(rest)
                self.open.append(target)
            else:
                target = max(self.open, key=lambda w: w.fill)
                taken = self.size - target.fill
                if taken <= self.spare:
                    self._emit(target)
                    continue
            self._put(target, row, start, rest[:taken])
            start, rest = start + taken, rest[taken:]

    def close(self) -> None:
        """Joins the open windows, fullest first, to full ones; cuts the rest into powers of two."""
        pieces = [p for w in sorted(self.open, key=lambda w: -w.fill) for p in w.pieces]
        left = sum(len(p[2]) for p in pieces)
        self.open, self.most = [], 1
        sizes = [self.size] * (left // self.size) + [1 << b for b in range(self.size.bit_length(), -1, -1) if left % self.size >> b & 1]
        todo = iter(sizes)
        window, room = None, 0
        for row, start, ids, _, _ in pieces:
            while len(ids):
                if not room:
                    window, room = self._opened(), next(todo)
                taken = min(room, len(ids))
                self.done.append((row, start, ids[:taken], window.number, window.fill))
                window.fill += taken
                room, start, ids = room - taken, start + taken, ids[taken:]


def pack(docs: DataFrame, vocabulary: Broadcast, text: str = "text", keep: list[str] | None = None, size: int = SIZE, open_windows: int = OPEN_WINDOWS, spare: int = 0, digest: bool = False) -> DataFrame:
    """One row a piece: the columns ``keep`` of its document (all but the text by default), start (its document's ids
    before it), length, ids (packed little-endian unsigned 32-bit integers), ids_crc32, doc_tokens (with the id that ends
    the document), sequence_id, offset (in its sequence, without gaps from 0). With ``digest`` ids are left out, so that
    only open windows carry them between rounds. A window whose room is at most ``spare`` is emitted with that much
    padding, in place of cutting a document that fits nowhere: fewer cuts for a little padding.

    Every id lies in exactly one piece. Null and empty texts are documents of one id, END. Very long texts fill windows
    of their own. Repeated rows are documents of their own: (key, start) then repeats, (sequence_id, offset) never does.
    Columns of docs that have the new names are replaced. An empty table gives no rows.
    """
    new = {"start": "long", "length": "long", **({} if digest else {"ids": "binary"}), "ids_crc32": "long", "doc_tokens": "long", "sequence_id": "long", "offset": "long"}
    held = ("_ids", "_part", "_open")
    kept = [c for c in (keep if keep is not None else docs.columns) if c not in new and c not in held and (keep is not None or c != text)]
    types = dict(docs.dtypes)
    schema = ", ".join([f"`{c}` {types[c]}" for c in kept] + ["start long", "length long", "ids_crc32 long", "doc_tokens long", "sequence_id long", "offset long", "_ids binary", "_part long", "_open boolean"])

    def batch_of(pieces: list[tuple], kinds: list[pa.DataType], part: int, is_open: bool) -> pa.RecordBatch:
        raw = [p[2].astype("<u4").tobytes() for p in pieces]
        rows = [p[0] for p in pieces]
        columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
        longs = [[p[1] for p in pieces], [len(p[2]) for p in pieces], [zlib.crc32(r) for r in raw], [r[-1] for r in rows], [p[3] for p in pieces], [p[4] for p in pieces]]
        columns += [pa.array(v, pa.int64()) for v in longs]
        columns.append(pa.array(raw if is_open or not digest else [None] * len(raw), pa.binary()))
        columns += [pa.array([part] * len(raw), pa.int64()), pa.array([is_open] * len(raw), pa.bool_())]
        return pa.RecordBatch.from_arrays(columns, names=[*kept, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *held])

    def packed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_encoding(vocabulary.value).encode_to_numpy
        part = TaskContext.get().partitionId()
        packer, kinds, end = Packer(size, open_windows, part << 32, spare), [], np.array([END], dtype=np.uint32)
        for rows in parts:
            kinds = [rows.schema.field(c).type for c in kept]
            for some, texts in slices(rows, text):
                own = [some.column(c).to_pylist() for c in kept]
                for i, t in enumerate(texts):
                    ids = np.concatenate([encode(t, allowed_special="all"), end])
                    packer.add((*(c[i] for c in own), len(ids)), 0, ids)
                    if len(packer.done) >= BATCH_ROWS:
                        yield batch_of(packer.done, kinds, part, False)
                        packer.done = []
        if packer.done:
            yield batch_of(packer.done, kinds, part, False)
        if packer.open:
            yield batch_of([p for w in packer.open for p in w.pieces], kinds, part, True)

    def merging(level: int, last: bool) -> Callable[[tuple, pa.Table], pa.Table]:
        def merged(key: tuple, rows: pa.Table) -> pa.Table:
            group = key[0].as_py()
            packer = Packer(size, open_windows, (level << 56) + (group << 32), spare)
            rows = rows.combine_chunks().sort_by([("length", "descending"), ("sequence_id", "ascending"), ("offset", "ascending")])
            kinds = [rows.schema.field(c).type for c in kept]
            own = [rows.column(c).to_pylist() for c in [*kept, "doc_tokens"]]
            for i, (start, ids) in enumerate(zip(rows.column("start").to_pylist(), rows.column("_ids").to_pylist())):
                packer.add(tuple(c[i] for c in own), start, np.frombuffer(ids, dtype="<u4"))
            if last:
                packer.close()
            return pa.Table.from_batches([batch_of(packer.done, kinds, group, False), batch_of([p for w in packer.open for p in w.pieces], kinds, group, True)])

        return merged

    read = list(dict.fromkeys([*kept, text]))
    done = staged(docs.select(*[docs[c] for c in read]).mapInArrow(packed, schema), "packed")
    open_, out, level = done.where("_open"), done.where("not _open"), 0
    groups = open_.agg(F.max("_part")).first()[0]
    while groups is not None:  # the number of rounds is the logarithm of the number of partitions to the base FAN_IN
        groups, level = groups // FAN_IN, level + 1
        met = open_.withColumn("_part", F.floor(F.col("_part") / FAN_IN)).groupBy("_part").applyInArrow(merging(level, groups == 0), schema)
        met = staged(met, "packed")
        out, open_ = out.unionByName(met.where("not _open")), met.where("_open")
        if groups == 0:
            break
    if not digest:
        out = out.withColumnRenamed("_ids", "ids")
    return out.select(*kept, *new)
