"""Hardest examples of each batch for metric losses, from similarity matrices that never leave a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.collection import DIGITS

#: Rows of batches that a task holds at once; one batch has to fit on its own.
HELD_ROWS = 4096


def hardest(rows: DataFrame, batch: str, ident: str, label: str, vector: str, block: int = 512) -> DataFrame:
    """(batch, ident, label, positive, positive_score, negative, negative_score) for each row: of its batch, the row of
    the same label with the lowest cosine and the one of another label with the highest; ties by ident. Null where there
    is none. No pair leaves its task: one row an anchor does, whatever the batch's size.

    Rows whose vector is null, zero or of another length than the batch's first one are no anchors and no partners; rows
    of a null batch or label neither. A batch's vectors are held by one task, and its matrix ``block`` rows at a time.
    """
    types = dict(rows.dtypes)
    dealt = rows.select(batch, ident, label, vector).dropna().repartition(batch).sortWithinPartitions(batch, ident)
    schema = f"`{batch}` {types[batch]}, `{ident}` {types[ident]}, `{label}` {types[label]}, positive {types[ident]}, positive_score double, negative {types[ident]}, negative_score double"

    def mined(one: pa.Table) -> pa.RecordBatch | None:
        vectors = [np.asarray(v, dtype=float) for v in one.column(vector).to_pylist()]
        good = np.array([i for i, v in enumerate(vectors) if len(v) == len(vectors[0]) and np.dot(v, v) > 0], dtype=np.int64)
        if not len(good):
            return None
        one = one.take(pa.array(good))
        v = np.stack([vectors[i] for i in good])
        v /= np.sqrt((v * v).sum(axis=1, keepdims=True))
        codes = one.column(label).combine_chunks().dictionary_encode().indices.to_numpy()
        found = {"positive": ([], []), "negative": ([], [])}
        for at in range(0, len(v), block):
            scores = np.round(v[at : at + block] @ v.T, DIGITS)
            same = codes[at : at + block, None] == codes[None, :]
            own = np.zeros_like(same)
            own[np.arange(len(own)), np.arange(at, at + len(own))] = True
            for name, from_, worst, pick in (("positive", same & ~own, np.inf, np.argmin), ("negative", ~same, -np.inf, np.argmax)):
                held = np.where(from_, scores, worst)
                place = pick(held, axis=1)  # the first of equals, and rows are in order of ident
                found[name][0].append(np.where(from_.any(axis=1), place, -1))
                found[name][1].append(held[np.arange(len(held)), place])
        ids = one.column(ident).combine_chunks()
        out = [one.column(c).combine_chunks() for c in (batch, ident, label)]
        for name in ("positive", "negative"):
            place, score = np.concatenate(found[name][0]), np.concatenate(found[name][1])
            out += [ids.take(pa.array(place, mask=place < 0)), pa.array(score, mask=place < 0)]
        return pa.RecordBatch.from_arrays(out, names=[batch, ident, label, "positive", "positive_score", "negative", "negative_score"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def of(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            keys = rows.column(batch).combine_chunks().dictionary_encode().indices.to_numpy()
            starts = [*np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])).tolist(), len(keys)]
            for a, b in zip(starts, starts[1:]):
                if (done := mined(rows.slice(a, b - a))) is not None:
                    yield done

        for part in parts:
            if not part.num_rows:
                continue
            held.append(part)
            if sum(p.num_rows for p in held) >= HELD_ROWS:
                rows = pa.Table.from_batches(held)
                keys = rows.column(batch).combine_chunks().dictionary_encode().indices.to_numpy()
                last = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if (keys != keys[-1]).any() else 0
                if last:
                    yield from of(rows.slice(0, last))
                held = rows.slice(last).combine_chunks().to_batches()
        if held:
            yield from of(pa.Table.from_batches(held))

    return dealt.mapInArrow(run, schema)
