"""Ordered folds: running averages whose next value depends on the last accepted row.

Rows are put in order within partitions by key and stream through a task that carries one state, so a key may have any
number of rows. A key of more than ``BLOCK_ROWS`` rows is not left to one task: its rows are dealt out in blocks by ranges
of the order, each block is summed up on its own, and a scan over the blocks (one row each, or the few rows in which a
gate may open) gives every block the state it starts from.

* A step of a running average is an affine map z -> (1 - w) z + w v. Maps compose, so a block is two numbers.
* A gate opens at the first row far enough after the last that counted. Each row of a block points to the next one that
  would count after it; pointers are doubled until they leave the block. What the scan needs of a block are the rows at
  which the gate may open first, those within one gate of its beginning, with the row that counts last from there on.

Rows with a null time or value are left out. A null key is a key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.session import staged

#: Rows of one key that a single task folds; a key with more is cut into blocks of about so many.
BLOCK_ROWS = 1 << 20
_KINDS = {"long": pa.int64(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}


def run_starts(part: pa.RecordBatch, width: int) -> np.ndarray:
    """Where runs of rows begin that have the same values in the first ``width`` columns."""
    fresh = np.zeros(part.num_rows, dtype=bool)
    fresh[:1] = True
    for i in range(width):
        codes = part.column(i).dictionary_encode(null_encoding="encode").indices.to_numpy()
        fresh[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(fresh)


def _column(values, kind: str) -> pa.Array:
    if kind == "array<double>":
        rows = np.atleast_2d(np.asarray(values, dtype=float))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))
    return pa.array(np.asarray(values), _KINDS[kind])


def streamed(rows: DataFrame, keys: list[str], result: str, fold: Callable) -> DataFrame:
    """One row a key, of rows that stand in order by ``keys``, which come first. fold(state, part, starts) takes an Arrow
    batch and where its keys begin, and gives the state of each of them at the batch's end, as one array for each column
    of ``result`` (a schema). state: that of the batch's first key so far, or None."""
    fields = [c.strip().split(" ", 1) for c in result.split(",")]
    types = dict(rows.dtypes)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held, state = [*keys, *(n for n, _ in fields)], None, None

        def batch(own: list[pa.Array], states: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*own, *(_column(s, t) for s, (_, t) in zip(states, fields))], names=names)

        for part in parts:
            if not part.num_rows:
                continue
            starts = run_starts(part, len(keys))
            first = [part.column(i).slice(0, 1) for i in range(len(keys))]
            goes_on = state is not None and repr([x.to_pylist() for x in first]) == repr([x.to_pylist() for x in held])
            if state is not None and not goes_on:
                yield batch(held, [[s] for s in state])
            states = fold(state if goes_on else None, part, starts)
            last = int(starts[-1])
            if len(starts) > 1:
                yield batch([part.column(i).take(pa.array(starts[:-1])) for i in range(len(keys))], [s[:-1] for s in states])
            held, state = [part.column(i).slice(last, 1) for i in range(len(keys))], [s[-1] for s in states]
        if state is not None:
            yield batch(held, [[s] for s in state])

    return rows.mapInArrow(run, ", ".join(f"`{k}` {types[k]}" for k in keys) + f", {result}")


def in_order(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of a key in one partition, in order; the keys are the first columns."""
    return rows.select(*keys, *[c for c in rows.columns if c not in keys]).repartition(*keys).sortWithinPartitions(*keys, *order)


def hot_keys(rows: DataFrame, key: str) -> DataFrame:
    """(key, _n): keys of more than BLOCK_ROWS rows. There are fewer than rows / BLOCK_ROWS."""
    return staged(rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > BLOCK_ROWS), "hot-keys")


def in_blocks(rows: DataFrame, key: str, order: list[str], count: int) -> DataFrame:
    """The rows with their ``_block``: ranges of (key, order) of about BLOCK_ROWS rows, numbered in order."""
    return staged(rows.repartitionByRange(-(-count // BLOCK_ROWS) + 1, key, *order).withColumn("_block", F.spark_partition_id()), "blocks")


def _split(rows: DataFrame, key: str, order: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """The rows of keys that one task can fold, and those of hot keys in blocks, if there are any."""
    hot = hot_keys(rows, key)
    total = hot.agg(F.sum("_n")).first()[0]
    if not total:
        return rows, None
    known = hot.select(F.col(key).alias("_hot"))
    is_hot = rows[key].eqNullSafe(known["_hot"])
    return rows.join(known, is_hot, "left_anti"), in_blocks(rows.join(known, is_hot, "left_semi"), key, order, total)


def _tails(part: pa.RecordBatch, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the runs, and how many rows of its run follow each row."""
    sizes = np.diff(np.append(starts, part.num_rows))
    return sizes, np.repeat(starts + sizes, sizes) - 1 - np.arange(part.num_rows)


def _loop(z: float, values: np.ndarray, w: float) -> float:
    for v in values.tolist():
        z = v * w + z * (1 - w) if z else v
    return z


def _ewma_maps(values: np.ndarray, part: pa.RecordBatch, starts: np.ndarray, w: float) -> tuple[np.ndarray, ...]:
    """Of each run: (a, b) of the map z -> a z + b that it is for z other than 0, the value it has from 0 on, and its
    lowest and highest value. From 0 on, the first value that is not 0 counts in full."""
    sizes, after = _tails(part, starts)
    power = (1 - w) ** after
    place = np.where(values != 0, np.arange(len(values)), len(values))
    begins = np.repeat(np.minimum.reduceat(place, starts), sizes) == np.arange(len(values))
    return (1 - w) ** sizes, np.add.reduceat(w * power * values, starts), np.add.reduceat(np.where(begins, power, w * power) * values, starts), np.minimum.reduceat(values, starts), np.maximum.reduceat(values, starts)


def ewma(df: DataFrame, key: str, order: list[str], value: str, weight: float = 0.1) -> DataFrame:
    """(key, z). The average starts anew where it is 0.

    As long as all values of a key have one sign, the average never gets back to 0, and blocks compose. Where signs are
    mixed it may, at one value only: then each block is run from the start that the scan gave it, and the scan is
    repeated with what the blocks really end at until no start changes."""
    columns = list(dict.fromkeys([*order, value]))
    rows, hot = _split(df.select(key, *columns).dropna(subset=[order[0], value]), key, order)

    def fold(state, part, starts):
        values = part.column(value).to_numpy(zero_copy_only=False).astype(float)
        a, b, z, low, high = _ewma_maps(values, part, starts, weight)
        if state is not None and state[0]:
            z[0] = a[0] * state[0] + b[0]
        start = state[0] if state is not None else 0.0
        low[0], high[0] = min(low[0], start), max(high[0], start)
        ends = np.append(starts[1:], len(values))
        for i in np.flatnonzero((low < 0) & (high > 0)):  # may meet 0 on its way
            z[i] = _loop(start if i == 0 else 0.0, values[starts[i] : ends[i]], weight)
        return [z]

    found = streamed(in_order(rows, [key], order), [key], "z double", fold)
    return found if hot is None else found.unionByName(_ewma_of_blocks(hot, key, order, value, weight))


def _ewma_of_blocks(hot: DataFrame, key: str, order: list[str], value: str, w: float) -> DataFrame:
    def summed(state, part, starts):
        values = part.column(value).to_numpy(zero_copy_only=False).astype(float)
        a, b, z, low, high = _ewma_maps(values, part, starts, w)
        if state is not None:
            b[0], a[0], low[0], high[0], z[0] = a[0] * state[1] + b[0], a[0] * state[0], min(low[0], state[3]), max(high[0], state[4]), a[0] * state[2] + b[0] if state[2] else z[0]
        return [a, b, z, low, high]

    def run_from(state, part, starts):
        values, firsts = part.column(value).to_numpy(zero_copy_only=False).astype(float), part.column("_start").to_numpy(zero_copy_only=False)
        ends = np.append(starts[1:], len(values))
        return [np.array([_loop(state[0] if i == 0 and state is not None else firsts[s], values[s:e], w) for i, (s, e) in enumerate(zip(starts, ends))])]

    def scanned(maps: DataFrame) -> DataFrame:
        """(key, _block, _start, z): the average before and after each block."""
        types = dict(maps.dtypes)

        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, z = None, 0.0
            for part in parts:
                keys, out, back = part.column(0).to_pylist(), [], []
                for k, a, b, z0 in zip(keys, *(part.column(c).to_pylist() for c in ("a", "b", "z"))):
                    if repr(k) != now:
                        now, z = repr(k), 0.0
                    back.append(z)
                    z = a * z + b if z else z0
                    out.append(z)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(back, pa.float64()), pa.array(out, pa.float64())], names=[key, "_block", "_start", "z"])

        return staged(in_order(maps.select(key, "_block", "a", "b", "z"), [key], ["_block"]).mapInArrow(run, f"`{key}` {types[key]}, _block int, _start double, z double"), "scan")

    maps = staged(streamed(in_order(hot, [key, "_block"], order), [key, "_block"], "a double, b double, z double, low double, high double", summed), "maps")
    scan = scanned(maps)
    mixed = maps.groupBy(key).agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < 0 and high > 0").select(F.col(key).alias("_mixed"))
    if not mixed.isEmpty():
        mixed = staged(mixed, "mixed")
        some = hot.join(mixed, hot[key].eqNullSafe(mixed["_mixed"]), "left_semi")
        while True:  # each round sets at least the first block right whose start was wrong
            starts = scan.select(F.col(key).alias("_key"), F.col("_block").alias("_at"), "_start")
            given = some.join(starts, some[key].eqNullSafe(starts["_key"]) & (some["_block"] == starts["_at"])).drop("_key", "_at")
            ends = streamed(in_order(given, [key, "_block"], order), [key, "_block"], "end double", run_from).select(F.col(key).alias("_key"), F.col("_block").alias("_at"), "end")
            real = maps.join(ends, maps[key].eqNullSafe(ends["_key"]) & (maps["_block"] == ends["_at"]), "left")
            fixed = F.col("end").isNotNull()
            real = real.select(key, "_block", F.when(fixed, 0.0).otherwise(F.col("a")).alias("a"), F.when(fixed, F.col("end")).otherwise(F.col("b")).alias("b"), F.coalesce("end", "z").alias("z"))
            again = scanned(real)
            old = scan.select(F.col(key).alias("_key"), F.col("_block").alias("_at"), F.col("_start").alias("_old"))
            moved = again.join(old, again[key].eqNullSafe(old["_key"]) & (again["_block"] == old["_at"])).where(F.abs(F.col("_start") - F.col("_old")) > 1e-12 * F.greatest(F.abs("_start"), F.abs("_old")))
            scan, done = again, moved.isEmpty()
            if done:
                break
    return scan.groupBy(key).agg(F.max_by("z", "_block").alias("z"))


def _pairs(run: np.ndarray, time: np.ndarray) -> np.ndarray:
    out = np.empty(len(run), dtype=complex)
    out.real, out.imag = run, time
    return out


class Gate:
    """Opens for a row that lies more than ``width`` (at least so much, if inclusive) after the last that counted."""

    def __init__(self, width: float, inclusive: bool):
        self.width, self.inclusive = width, inclusive

    def passes(self, late: np.ndarray, early: np.ndarray) -> np.ndarray:
        return late - early >= self.width if self.inclusive else late - early > self.width

    def opens(self, times: np.ndarray, runs: np.ndarray, ends: np.ndarray, run: np.ndarray, last: np.ndarray, at_least: np.ndarray) -> np.ndarray:
        """Of each (run, time that counted last): the first place in the run, from ``at_least`` on, that passes; the run's
        end if none does. Times ascend within runs; pairs of (run, time) are searched in the order of complex numbers."""
        found = np.searchsorted(_pairs(runs, times), _pairs(run, last + self.width))
        found = np.clip(found, at_least, ends[run])
        while True:  # the rule is about differences, which may round otherwise than the sum
            back = (found > at_least) & self.passes(times[np.maximum(found - 1, 0)], last)
            ahead = ~back & (found < ends[run]) & ~self.passes(times[np.minimum(found, len(times) - 1)], last)
            if not (back.any() or ahead.any()):
                return found
            found = found - back + ahead

    def next(self, times: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The place that counts next after each row, and the runs and their ends."""
        ends = np.append(starts[1:], len(times))
        runs = np.repeat(np.arange(len(starts)), ends - starts)
        return self.opens(times, runs, ends, runs, times, np.arange(len(times)) + 1), runs, ends

    def counted(self, times: np.ndarray, starts: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places that count, how many of each run). last: the time that counted last before each run, NaN for none."""
        after, runs, ends = self.next(times, starts)
        fresh = np.isnan(last)
        first = np.where(fresh, starts, self.opens(times, runs, ends, np.arange(len(starts)), np.where(fresh, -np.inf, last), starts))
        places, sizes, follow = [], [], after.tolist()
        for i, end in zip(first.tolist(), ends.tolist()):
            before = len(places)
            while i < end:
                places.append(i)
                i = follow[i]
            sizes.append(len(places) - before)
        return np.array(places, dtype=np.int64), np.array(sizes, dtype=np.int64)


def _entries(hot: DataFrame, key: str, at: str, order: list[str], gate: Gate) -> DataFrame:
    """(key, _block, at, exit, n): the rows at which the gate may open first in a block, the time that counts last from
    there on within the block, and how many count. A task holds the times of one block."""
    types = dict(hot.dtypes)

    def of(times: np.ndarray) -> tuple[np.ndarray, ...]:
        after = gate.next(times, np.zeros(1, np.int64))[0]
        n, last, alive = np.ones(len(times), np.int64), np.arange(len(times)), after < len(times)
        while alive.any():  # pointers are doubled
            to = after[alive]
            n[alive] += n[to]
            last[alive] = last[to]
            after[alive] = after[to]
            alive = after < len(times)
        until = int(gate.opens(times, np.zeros(len(times), np.int64), np.array([len(times)]), np.zeros(1, np.int64), times[:1], np.ones(1, np.int64))[0])
        first = np.flatnonzero(np.concatenate([[True], times[1 : until + 1] != times[: len(times[1 : until + 1])]]))  # the first of equal times
        return times[first], times[last[first]], n[first]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None

        def handed() -> pa.RecordBatch:
            values = of(np.concatenate([t for _, t in held]))
            own = held[0][0]
            rows = pa.array(np.zeros(len(values[0]), np.int64))
            return pa.RecordBatch.from_arrays([*(own.column(i).take(rows) for i in (0, 1)), *(pa.array(v) for v in values)], names=[key, "_block", "at", "exit", "n"])

        for part in parts:
            times = part.column(at).to_numpy(zero_copy_only=False).astype(float)
            starts = run_starts(part, 2).tolist()
            for s, e in zip(starts, [*starts[1:], part.num_rows]):
                one = part.slice(s, 1)
                if held and (this := repr([one.column(i).to_pylist() for i in (0, 1)])) != now:
                    yield handed()
                    held.clear()
                now = repr([one.column(i).to_pylist() for i in (0, 1)])
                held.append((one.select([0, 1]), times[s:e]))
        if held:
            yield handed()

    return in_order(hot.select(key, "_block", *order), [key, "_block"], order).mapInArrow(run, f"`{key}` {types[key]}, _block int, at double, exit double, n long")


def _gate_scan(entries: DataFrame, key: str, gate: Gate) -> DataFrame:
    """(key, _block, _last, n): the time that counted last before each block, null for the first, and how many rows of the
    block count. Rows stream through with one state; a task holds the entries of one block."""
    types = dict(entries.dtypes)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key_now, block_now, last, open_, rows = None, None, None, True, []

        def handed() -> pa.RecordBatch:
            done = list(rows)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], t) for i, t in enumerate((kind, pa.int32(), pa.float64(), pa.int64()))], names=[key, "_block", "_last", "n"])

        for part in parts:
            kind = part.schema.field(0).type
            for k, block, at, leaves, n in zip(*(part.column(c).to_pylist() for c in (key, "_block", "at", "exit", "n"))):
                if repr(k) != key_now:
                    key_now, block_now, last = repr(k), None, None
                if block != block_now:
                    block_now, open_ = block, True
                    rows.append([k, block, last, 0])
                if open_ and (last is None or gate.passes(at, last)):  # entries ascend: the first that passes is it
                    rows[-1][3], last, open_ = n, leaves, False
            if len(rows) > 1:
                held = rows.pop()
                yield handed()
                rows.append(held)
        if rows:
            yield handed()

    return staged(in_order(entries, [key], ["_block", "at"]).mapInArrow(run, f"`{key}` {types[key]}, _block int, _last double, n long"), "gate-scan")


def _values(part: pa.RecordBatch, value: str, places: np.ndarray) -> np.ndarray:
    """Values of the rows at some places: one column for numbers, one for each element of vectors."""
    column = part.column(value).take(pa.array(places))
    if pa.types.is_list(column.type):
        return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(places), -1)
    return column.to_numpy(zero_copy_only=False).astype(float)[:, None]


def gated_ewma(df: DataFrame, key: str, at: str, value: str, gate: float, weight: float = 0.1, ties: tuple[str, ...] = ()) -> DataFrame:
    """(key, t, z, n): a row counts if it lies more than ``gate`` after the last that counted; the first always does. z is
    the running average of what counted, numbers or vectors (of one length a key); n how many did; t the time of the last.
    ``ties`` orders rows of one time."""
    vector = dict(df.dtypes)[value].startswith("array")
    order, kind, rule = [at, *ties], "array<double>" if vector else "double", Gate(gate, False)
    columns = list(dict.fromkeys([*order, value]))
    rows, hot = _split(df.select(key, *columns).dropna(subset=[at, value]), key, order)

    def counted(part, starts, last):
        """Of each run: (time that counted last, a, b, value from the first on, how many count)."""
        times = part.column(at).to_numpy(zero_copy_only=False).astype(float)
        places, sizes = rule.counted(times, starts, last)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        power = (1 - weight) ** (np.repeat(bounds[1:], sizes) - 1 - np.arange(len(places)))[:, None]
        values = _values(part, value, places) if len(places) else np.zeros((0, 1))
        firsts = np.zeros(len(places), bool)
        firsts[bounds[:-1][sizes > 0]] = True
        sums = lambda x: np.array([x[s:e].sum(axis=0) for s, e in zip(bounds, bounds[1:])]) if len(starts) < 4 else np.add.reduceat(np.vstack([x, np.zeros((1, x.shape[1]))]), bounds[:-1]) * (sizes > 0)[:, None]
        b, fresh = sums(weight * power * values), sums(np.where(firsts[:, None], power, weight * power) * values)
        t = np.where(sizes > 0, times[places[np.maximum(bounds[1:] - 1, 0)]] if len(places) else np.nan, last)
        return t, (1 - weight) ** sizes, b, fresh, sizes

    def shaped(z: np.ndarray) -> np.ndarray:
        return z if vector else z[:, 0]

    def fold(state, part, starts):
        last = np.full(len(starts), np.nan)
        if state is not None:
            last[0] = state[0]
        t, a, b, z, n = counted(part, starts, last)
        if state is not None:
            before = np.atleast_1d(state[1])
            z = np.array([before if n[0] == 0 else a[0] * before + b[0], *z[1:]])
            n[0] += state[2]
        return [t, shaped(z), n]

    found = streamed(in_order(rows, [key], order), [key], f"t double, z {kind}, n long", fold)
    if hot is None:
        return found

    def block(state, part, starts):
        given = part.column("_last").to_numpy(zero_copy_only=False)[starts].astype(float)
        if state is not None:
            given[0] = state[0]
        t, a, b, z, n = counted(part, starts, given)
        if state is not None and n[0] == 0:
            a[0], b, z = state[1], np.array([np.atleast_1d(state[2]), *b[1:]]), np.array([np.atleast_1d(state[3]), *z[1:]])
        elif state is not None and state[4]:  # maps compose
            b, z, a[0] = np.array([a[0] * np.atleast_1d(state[2]) + b[0], *b[1:]]), np.array([a[0] * np.atleast_1d(state[3]) + b[0], *z[1:]]), a[0] * state[1]
        if state is not None:
            n[0] += state[4]
        return [t, a, shaped(b), shaped(z), n]

    def joined(state, part, starts):
        t, a, n = (part.column(c).to_numpy(zero_copy_only=False) for c in ("t", "a", "n"))
        b, z = (_values(part, c, np.arange(part.num_rows)) for c in ("b", "z"))
        out = [[], [], []]
        for s, e in zip(starts, np.append(starts[1:], part.num_rows)):
            now, seen, at_ = (np.atleast_1d(state[1]), state[2], state[0]) if s == 0 and state is not None else (None, 0, np.nan)
            for i in range(s, e):
                now, seen, at_ = z[i] if now is None else a[i] * now + b[i], seen + n[i], t[i]
            for column, v in zip(out, (at_, now, seen)):
                column.append(v)
        return [np.array(out[0]), shaped(np.array(out[1])), np.array(out[2])]

    scan = _gate_scan(_entries(hot, key, at, order, rule), key, rule)
    counts = scan.where("n > 0").select(F.col(key).alias("_key"), F.col("_block").alias("_at"), "_last")
    given = hot.join(counts, hot[key].eqNullSafe(counts["_key"]) & (hot["_block"] == counts["_at"])).drop("_key", "_at")
    maps = staged(streamed(in_order(given, [key, "_block"], order), [key, "_block"], f"t double, a double, b {kind}, z {kind}, n long", block), "maps")
    return found.unionByName(streamed(in_order(maps, [key], ["_block"]), [key], f"t double, z {kind}, n long", joined))


def every_n(df: DataFrame, key: str, at: str, n: float) -> DataFrame:
    """(key, emitted): how many rows pass a gate that opens every n units (inclusive)."""
    rule = Gate(n, True)
    rows, hot = _split(df.select(key, at).dropna(subset=[at]), key, [at])

    def fold(state, part, starts):
        last = np.full(len(starts), np.nan)
        if state is not None:
            last[0] = state[1]
        times = part.column(at).to_numpy(zero_copy_only=False).astype(float)
        places, sizes = rule.counted(times, starts, last)
        ends = np.cumsum(sizes) - 1
        t = np.where(sizes > 0, times[places[np.maximum(ends, 0)]] if len(places) else np.nan, last)
        if state is not None:
            sizes[0] += state[0]
        return [sizes, t]

    found = streamed(in_order(rows, [key], [at]), [key], "emitted long, t double", fold).select(key, "emitted")
    if hot is None:
        return found
    scan = _gate_scan(_entries(hot, key, at, [at], rule), key, rule)
    return found.unionByName(scan.groupBy(key).agg(F.sum("n").alias("emitted")))
