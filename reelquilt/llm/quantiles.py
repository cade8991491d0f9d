"""Mergeable percentiles per group: dyadic Count-sketches.

Values are encoded as integers of ``bits`` bits over a fixed range.  For every binary resolution a sketch counts how many
values fall into each of its cells: exactly at the resolution of ``top`` cells (the coarser ones are its sums), and at each
finer one by a signed Count-sketch, ``depth`` rows of ``width`` counters, a cell's count being the median over the rows.
All counters are sums, so sketches of separate batches are merged by addition, and a value is deleted by adding it with
weight -1.  A percentile is found by descending the resolutions to the cell that holds its rank; at each step both halves
of a cell are looked up, as together they hold what the cell holds.

A group of at most ``raw`` values is kept as those values (encoded, equal ones added up) and turned into a sketch once it
has more: the sketch of so few would be larger than they are.  Kept values are merged and deleted in the same way.

Error: a kept group's values are off by half a cell of the finest resolution, (high - low) / 2^(bits + 1).  A sketched
group's ranks are exact down to the top resolution, so a value is never off by more than its cell, (high - low) / top;
below that a cell's count is off by about n * sqrt(sum of squared shares of the cells / width), whatever n is, which
is a few thousandths of n at most for values that aren't concentrated in a few cells, and nothing for those that are.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from reelquilt.llm.batches import codes, distinct, glued, groups


@dataclass(frozen=True)
class DyadicSketch:
    """Shape of a sketch; only sketches of one shape can be merged.  ``top`` is ``width``, if not given."""

    low: float = -1.0
    high: float = 1.0
    bits: int = 12
    width: int = 1024
    depth: int = 3
    top: int | None = None
    raw: int = 8192
    seed: int = 1234

    def __post_init__(self) -> None:
        for x in (self.width, self.width if self.top is None else self.top):
            if x & (x - 1) or not 2 <= x <= 1 << self.bits or self.bits > 24:
                raise ValueError("width and top must be powers of two of at most 2^bits, bits at most 24")

    @property
    def exact_bits(self) -> int:
        return (self.top or self.width).bit_length() - 1

    @property
    def levels(self) -> range:
        """Resolutions that are sketched."""
        return range(self.exact_bits + 1, self.bits + 1)

    @property
    def values(self) -> int:
        """Cells of the finest resolution; a kept value's number is its cell, counters are numbered after them."""
        return 1 << self.bits

    @property
    def cells(self) -> int:
        """Kept values and counters that a group may have."""
        return self.values + (1 << self.exact_bits) + len(self.levels) * self.depth * self.width

    @cached_property
    def _factors(self) -> np.ndarray:
        return np.random.default_rng(self.seed).integers(1, 1 << 32, size=(self.bits + 1, self.depth, 4), dtype=np.uint64) | np.uint64(1)

    def _hash(self, level: int, row: int, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counter and sign of nodes of a resolution in a row of its sketch."""
        a, b, c, d = self._factors[level, row]
        x = node.astype(np.uint64)
        mask = np.uint64(0xFFFFFFFF)
        at = ((a * x + b) & mask) >> np.uint64(32 - self.width.bit_length() + 1)
        sign = 1 - 2 * ((((c * x + d) & mask) >> np.uint64(31)).astype(np.int64))
        base = self.values + (1 << self.exact_bits) + self.width * ((level - self.exact_bits - 1) * self.depth + row)
        return base + at.astype(np.int64), sign

    def encode(self, values: np.ndarray) -> np.ndarray:
        """Cell of the finest resolution; values beyond the range count in its first or last cell."""
        scaled = (np.clip(values, self.low, self.high) - self.low) * (self.values / (self.high - self.low))
        return np.minimum(scaled.astype(np.int64), self.values - 1)

    def decode(self, cells: np.ndarray) -> np.ndarray:
        return self.low + (cells + 0.5) * ((self.high - self.low) / self.values)

    def sketched(self, keys: np.ndarray, sums: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Kept values of groups with more than ``raw`` of them, or with counters already, as counters.

        Keys are group * cells + number, ascending; ``n`` has the size of each group.
        """
        group, number = keys // self.cells, keys % self.cells
        due = n > self.raw
        due[group[number >= self.values]] = True
        kept = number < self.values
        move = due[group] & kept
        if not move.any():
            return keys, sums
        group, x, weights = group[move] * self.cells, number[move], sums[move]
        new_keys, new_sums = [keys[~move], group + self.values + (x >> (self.bits - self.exact_bits))], [sums[~move], weights]
        for level in self.levels:
            for row in range(self.depth):
                at, sign = self._hash(level, row, x >> (self.bits - level))
                new_keys.append(group + at)
                new_sums.append(weights * sign)
        return merged(np.concatenate(new_keys), np.concatenate(new_sums))

    def invert(self, keys: np.ndarray, sums: np.ndarray, group: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        """Values at 0-based ranks of groups; keys and sums as from :meth:`sketched`."""
        number = keys % self.cells
        of_counters = np.zeros(int(group.max(initial=-1)) + 1, dtype=bool)
        counted = keys[number >= self.values] // self.cells
        of_counters[counted[counted < len(of_counters)]] = True
        by_counters = of_counters[group]
        cell = np.zeros(len(group), dtype=np.int64)
        kept, top = number < self.values, (number >= self.values) & (number < self.values + (1 << self.exact_bits))
        for some, entries, first in ((~by_counters, kept, 0), (by_counters, top, self.values)):
            if some.any():
                node, rest, parent = self._locate(keys[entries], sums[entries], group[some], ranks[some])
                cell[some] = node - first
                if first:
                    cell[some] = self._descend(keys, sums, group[some], node - first, rest, parent)
        return self.decode(cell)

    def _locate(self, keys: np.ndarray, sums: np.ndarray, group: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The number that holds each rank, the rank within it, and its count, from exact counts."""
        counts = np.maximum(sums, 0)
        ends = np.cumsum(counts)
        before = np.concatenate([[0], ends])
        base = before[np.searchsorted(keys, group * self.cells)]
        at = np.minimum(np.searchsorted(ends, base + ranks, side="right"), max(len(keys) - 1, 0))
        return keys[at] % self.cells, base + ranks - before[at], counts[at]

    def _estimates(self, keys: np.ndarray, sums: np.ndarray, group: np.ndarray, level: int, node: np.ndarray) -> np.ndarray:
        """What each row of a resolution's sketch says of nodes."""
        out = np.zeros((self.depth, len(node)))
        for row in range(self.depth):
            at, sign = self._hash(level, row, node)
            key = group * self.cells + at
            found = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            out[row] = np.where(keys[found] == key, sums[found], 0) * sign
        return out

    def _descend(self, keys: np.ndarray, sums: np.ndarray, group: np.ndarray, node: np.ndarray, rest: np.ndarray, parent: np.ndarray) -> np.ndarray:
        for level in self.levels:
            node = node * 2
            halves = (self._estimates(keys, sums, group, level, node) + parent - self._estimates(keys, sums, group, level, node + 1)) / 2
            left = np.clip(np.rint(np.median(halves, axis=0)).astype(np.int64), 0, parent)
            right = rest >= left
            rest = np.where(right, rest - left, rest)
            parent = np.where(right, parent - left, left)
            node = node + right
        return node


def merged(keys: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, sums = keys[order], sums[order]
    if not len(keys):
        return keys, sums
    heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    keys, sums = keys[heads], np.add.reduceat(sums, heads)
    return keys[sums != 0], sums[sums != 0]


def _lists(keys: np.ndarray, sums: np.ndarray, groups: int, cells: int) -> tuple[pa.ListArray, pa.ListArray]:
    offsets = pa.array(np.searchsorted(keys, np.arange(groups + 1) * cells).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array((keys % cells).astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(sums))


def _sketch_type(keys: Sequence[T.StructField]) -> T.StructType:
    return T.StructType([*keys, T.StructField("n", T.LongType()), T.StructField("cells", T.ArrayType(T.IntegerType())), T.StructField("counts", T.ArrayType(T.LongType()))])


def sketch(rows: DataFrame, keys: Sequence[str], value: str, *, shape: DyadicSketch = DyadicSketch(), weight: str | None = None, sort: bool = True) -> DataFrame:
    """Partial sketches of the groups: the keys, ``n``, ``cells`` and ``counts``.

    One row per group and batch of rows that were read together, without a shuffle; :func:`combine` makes it one row per
    group.  Null and NaN values aren't counted, a group without any other value has ``n`` = 0.  ``weight`` names a column
    of whole numbers (-1 deletes; null counts as 0).  Null keys form a group as in ``groupBy``.  Values beyond the range
    count at its ends.  Other columns are ignored.
    """
    own = rows.select(*keys, F.nanvl(F.col(value).cast("double"), F.lit(None)).alias("__value"), (F.coalesce(F.col(weight), F.lit(0)) if weight else F.lit(1)).cast("long").alias("__weight"))
    if sort:
        own = own.sortWithinPartitions(*keys)
    schema = _sketch_type([own.schema[k] for k in keys])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            heads, group = groups(batch, len(keys))
            values = batch.column(len(keys))
            there = pc.is_valid(values).to_numpy(zero_copy_only=False)
            x = values.to_numpy(zero_copy_only=False)[there]
            w = batch.column(len(keys) + 1).to_numpy(zero_copy_only=False)[there].astype(np.int64)
            k, s = merged(group[there] * shape.cells + shape.encode(x), w)
            n = np.zeros(len(heads), dtype=np.int64)
            np.add.at(n, group[there], w)
            cells, counts = _lists(k, s, len(heads), shape.cells)
            at = pa.array(heads)
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in range(len(keys))), pa.array(n), cells, counts], names=schema.names)

    return own.mapInArrow(run, schema)


def _pack(rows: DataFrame, stretch: int, salts: int = 256) -> DataFrame:
    """``k``, ``part`` and the lists ``p``, ``f``, ``v`` of the rows of a sequence's stretch that were read together.

    Repeats within them are dropped.  Rows without a position are spread by their value.
    """
    schema = T.StructType([rows.schema["k"], T.StructField("part", T.LongType()), *(T.StructField(c, T.ArrayType(rows.schema[c].dataType)) for c in ("p", "f", "v"))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            place = batch.column(1)
            known = pc.is_valid(place).to_numpy(zero_copy_only=False)
            p = pc.fill_null(place, 0).to_numpy(zero_copy_only=False).astype(np.int64)
            v = pc.fill_null(batch.column(3), np.nan).to_numpy(zero_copy_only=False) + 0.0
            bits = v.view(np.int64)
            part = np.where(known, p // stretch, -(1 << 40) - np.where(np.isnan(v), 0, (bits ^ (bits >> 29)) % salts))
            order, fresh = distinct([codes(batch.column(0)), part, codes(batch.column(2)), np.where(known, p, -(1 << 40)), bits])
            order = order[fresh]
            k, part = codes(batch.column(0))[order], part[order]
            heads = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (part[1:] != part[:-1])]))
            offsets = pa.array(np.append(heads, len(order)).astype(np.int32))
            take = pa.array(order)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take.take(pa.array(heads))), pa.array(part[heads]), *(pa.ListArray.from_arrays(offsets, batch.column(i).take(take)) for i in (1, 2, 3))], names=schema.names
            )

    return rows.mapInArrow(run, schema)


def sketch_sequences(rows: DataFrame, *, sequence: str, position: str, feature: str, value: str, shape: DyadicSketch = DyadicSketch(), stretch: int = 1024) -> DataFrame:
    """Partial sketches of ``value`` per ``sequence`` and ``feature``, in which exact repeats of a row count once.

    Rows are packed by stretches of positions before they are shuffled, so that repeats meet in one task however long a
    sequence is; a task adds up the stretches of a sequence that it has and sends one sketch for each feature.  Positions
    are whole numbers.  Null keys form groups, rows without a position are compared like any others.  Nulls, NaN and values
    beyond the range as in :func:`sketch`.
    """
    own = rows.select(F.col(sequence).alias("k"), F.col(position).alias("p"), F.col(feature).alias("f"), F.nanvl(F.col(value).cast("double"), F.lit(None)).alias("v"))
    packed = _pack(own, stretch).repartition("k", "part").sortWithinPartitions("k", "part")
    schema = _sketch_type([T.StructField(sequence, own.schema["k"].dataType), T.StructField(feature, own.schema["f"].dataType)])

    def partial(part: pa.RecordBatch) -> pa.RecordBatch:
        """Sketches of whole stretches: rows of (k, f, n, cells, counts), ordered by k as it comes."""
        _, stretch_of = groups(part, 2)
        k_heads, k_of = groups(part, 1)
        sizes = pc.list_value_length(part.column(2)).to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(part.num_rows), sizes)
        places, features, values = (pc.list_flatten(part.column(i)) for i in (2, 3, 4))
        p = pc.fill_null(places, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        p = np.where(pc.is_valid(places).to_numpy(zero_copy_only=False), p, -(1 << 40))
        f = codes(features)
        v = pc.fill_null(values, np.nan).to_numpy(zero_copy_only=False) + 0.0
        order, fresh = distinct([stretch_of[owner], f, p, v.view(np.int64)])
        order = order[fresh]
        group_k, group_f, x = k_of[owner][order], f[order], v[order]
        wide = group_k * (len(features) + 2) + group_f + 1
        names, first, group = np.unique(wide, return_index=True, return_inverse=True)
        there = ~np.isnan(x)
        keys, sums = merged(group[there] * shape.cells + shape.encode(x[there]), np.ones(int(there.sum()), dtype=np.int64))
        n = np.bincount(group[there], minlength=len(names)).astype(np.int64)
        k_col = part.column(0).take(pa.array(k_heads[group_k[first]]))
        return pa.RecordBatch.from_arrays([k_col, features.take(pa.array(order[first])), pa.array(n), *_lists(keys, sums, len(names), shape.cells)], names=schema.names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_rows: pa.RecordBatch | None = None  # sketches of the last sequence, which may go on

        def joined(new: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            nonlocal open_rows
            both = new if open_rows is None else glued(open_rows, new)
            heads, group = groups(both, 1)
            order = np.lexsort([codes(both.column(1)), group])
            both = both.take(pa.array(order))
            rows_of = merged_rows(both, 2, shape)
            heads, _ = groups(rows_of, 1)
            last = int(heads[-1])
            open_rows = rows_of.slice(last)
            if last:
                yield rows_of.slice(0, last)

        waiting: pa.RecordBatch | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            both = batch if waiting is None else glued(waiting, batch)
            heads, _ = groups(both, 2)
            cut = int(heads[-1])
            waiting = both.slice(cut)
            if cut:
                yield from joined(partial(both.slice(0, cut)))
        if waiting is not None:
            yield from joined(partial(waiting))
        if open_rows is not None:
            yield open_rows

    return packed.mapInArrow(run, schema)


def _sums(part: pa.RecordBatch, heads: np.ndarray, group: np.ndarray, n_keys: int, shape: DyadicSketch) -> tuple[list[pa.Array], np.ndarray, np.ndarray, np.ndarray]:
    """Sums of sketches that follow each other: key columns, n, counter keys, sums."""
    lists, sums = part.column(n_keys + 1), part.column(n_keys + 2)
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    owner = np.repeat(group, sizes)
    k, s = merged(owner * shape.cells + pc.list_flatten(lists).to_numpy(zero_copy_only=False).astype(np.int64), pc.list_flatten(sums).to_numpy(zero_copy_only=False).astype(np.int64))
    n = np.zeros(len(heads), dtype=np.int64)
    np.add.at(n, group, part.column(n_keys).to_numpy(zero_copy_only=False))
    return [part.column(i).take(pa.array(heads)) for i in range(n_keys)], n, *shape.sketched(k, s, n)


def merged_rows(part: pa.RecordBatch, n_keys: int, shape: DyadicSketch) -> pa.RecordBatch:
    """One sketch for each stretch of equal keys."""
    heads, group = groups(part, n_keys)
    cols, n, k, s = _sums(part, heads, group, n_keys, shape)
    return pa.RecordBatch.from_arrays([*cols, pa.array(n), *_lists(k, s, len(n), shape.cells)], names=part.schema.names)


def _merge_stream(batches: Iterable[pa.RecordBatch], n_keys: int, shape: DyadicSketch) -> Iterator[tuple[list[pa.Array], np.ndarray, np.ndarray, np.ndarray]]:
    """Whole groups of a stream sorted by key: key columns, n, counter keys, sums.  The last group waits for the next batch."""
    held: pa.RecordBatch | None = None
    for big in batches:
        for at in range(0, big.num_rows, 1024):
            batch = big.slice(at, 1024)
            batch = batch if held is None else glued(held, batch)
            heads, group = groups(batch, n_keys)
            cut = int(heads[-1])
            if cut:
                yield _sums(batch.slice(0, cut), heads[:-1], group[:cut], n_keys, shape)
            held = batch.slice(cut)
            if held.num_rows > 1:  # partial sketches of one group are added up at once, so that what waits stays small
                held = merged_rows(held, n_keys, shape)
    if held is not None:
        yield _sums(held, np.zeros(1, dtype=np.int64), np.zeros(held.num_rows, dtype=np.int64), n_keys, shape)


def _by_group(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    return sketches.select(*keys, "n", "cells", "counts").repartition(*keys).sortWithinPartitions(*keys)


def combine(sketches: DataFrame, keys: Sequence[str], *, shape: DyadicSketch = DyadicSketch()) -> DataFrame:
    """The sum of all sketches of each group, as one row; sketches of other batches or days go in by ``unionByName``."""
    own = _by_group(sketches, keys)
    names = own.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, n, k, s in _merge_stream(batches, len(keys), shape):
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n), *_lists(k, s, len(n), shape.cells)], names=names)

    return own.mapInArrow(run, own.schema)


def quantiles(sketches: DataFrame, keys: Sequence[str], probabilities: Sequence[float], *, shape: DyadicSketch = DyadicSketch()) -> DataFrame:
    """The keys, ``n`` and ``quantiles`` (in the order asked, linearly interpolated between ranks; null where ``n`` is 0).

    Takes partial sketches as well as combined ones and needs one shuffle, of sketches, not of values.
    """
    asked = np.asarray(probabilities, dtype=np.float64)
    if ((asked < 0) | (asked > 1)).any():
        raise ValueError("probabilities must lie between 0 and 1")
    own = _by_group(sketches, keys)
    schema = T.StructType([*(own.schema[k] for k in keys), T.StructField("n", T.LongType()), T.StructField("quantiles", T.ArrayType(T.DoubleType()))])
    names = schema.names

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, n, k, s in _merge_stream(batches, len(keys), shape):
            some = np.flatnonzero(n > 0)
            spot = asked[None, :] * (n[some, None] - 1)
            low = np.floor(spot).astype(np.int64)
            high = np.minimum(low + 1, n[some, None] - 1)
            group = np.repeat(some, len(asked))
            if len(some):
                a, b = shape.invert(k, s, group, low.ravel()), shape.invert(k, s, group, high.ravel())
                flat = a + (b - a) * (spot - low).ravel()
            else:
                flat = np.zeros(0)
            offsets = np.concatenate([[0], np.cumsum((n > 0) * len(asked))])
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat), mask=pa.array(n <= 0))
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n), lists], names=names)

    return own.mapInArrow(run, schema)
