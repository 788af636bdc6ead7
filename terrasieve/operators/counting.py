"""Counts of the values of many columns in Arrow batches, before Spark adds them up.

A row of hundreds of columns exploded gives as many rows to the aggregation, each with its own look-up.
Here a task gathers rows, sorts each column inside each group, and passes on one row a distinct value.
Where groups are too small for that, values go on as they are.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa

#: Values gathered before they are counted, distinct values a task holds before it passes them on, and rows of a group below which sorting doesn't pay.
GATHERED, HELD, SHORT = 1 << 23, 1 << 23, 32


def _groups(keys: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """The distinct rows, the order of rows that brings each one's together, and where each one's begin, with the end."""
    if not keys.num_columns:
        return keys.slice(0, 0), np.arange(len(keys)), np.array([0, len(keys)])
    found = keys.append_column("_i", pa.array(np.arange(len(keys)))).group_by(keys.column_names, use_threads=False).aggregate([("_i", "list")])
    rows = found.column("_i_list").combine_chunks()
    return found.select(keys.column_names), rows.flatten().to_numpy(), rows.offsets.to_numpy() - rows.offsets[0].as_py()


class _Group:
    """What is counted of a group: of each column its distinct values, ascending, with their counts, and its nulls and NaNs."""

    def __init__(self, keys: list[pa.Scalar], columns: int):
        self.keys = keys
        self.values: list[tuple[np.ndarray, np.ndarray] | None] = [None] * columns
        self.nulls, self.nans = np.zeros(columns, np.int64), np.zeros(columns, np.int64)

    def add(self, c: int, x: np.ndarray) -> int:
        """Counts the values of a column, which are sorted in place; returns how many of them are new."""
        x.sort()
        if len(x) and np.isnan(x[-1]):
            known = int(np.searchsorted(x, np.nan))
            self.nans[c] += len(x) - known
            x = x[:known]
        if not len(x):
            return 0
        first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
        values, counts = x[first], np.diff(first, append=len(x))
        if self.values[c] is None:
            self.values[c] = values, counts
            return len(values)
        before, sums = self.values[c]
        at = np.searchsorted(before, values)
        hit = before[np.minimum(at, len(before) - 1)] == values
        sums[at[hit]] += counts[hit]
        if hit.all():
            return 0
        new = ~hit
        self.values[c] = np.insert(before, at[new], values[new]), np.insert(sums, at[new], counts[new])
        return int(new.sum())

    def rows(self, by: Sequence[str]) -> Iterator[pa.RecordBatch]:
        known = [(c, *x) for c, x in enumerate(self.values) if x is not None]
        nulls, nans = np.flatnonzero(self.nulls), np.flatnonzero(self.nans)
        c = np.concatenate([*[np.full(len(v), c) for c, v, _ in known], nans, nulls]).astype(np.int32)
        v = np.concatenate([*[v for _, v, _ in known], np.full(len(nans), np.nan), np.zeros(len(nulls))])
        n = np.concatenate([*[n for *_, n in known], self.nans[nans], self.nulls[nulls]]).astype(np.int64)
        null = np.arange(len(v)) >= len(v) - len(nulls)
        yield _batch(by, [pa.repeat(k, len(v)) for k in self.keys], c, pa.array(v, mask=null), n)


def _batch(by: Sequence[str], keys: list, c: np.ndarray, v: pa.Array, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*keys, pa.array(c, pa.int32()), v, pa.array(n, pa.int64())], [*by, "_c", "_v", "_n"])


def counted(batches: Iterator[pa.RecordBatch], by: Sequence[str], gathered: int = GATHERED, most: int = HELD) -> Iterator[pa.RecordBatch]:
    """(by, columns of doubles) to (by, _c, _v, _n): how often the c-th column has the value v; the same value may come again."""
    groups: dict[tuple, _Group] = {}
    held, rows, size = [], 0, 0

    def count() -> Iterator[pa.RecordBatch]:
        nonlocal size
        t = pa.Table.from_batches(held)
        held.clear()
        keys, columns = t.select(list(range(len(by)))), t.columns[len(by) :]
        found, order, starts = _groups(keys)
        if len(order) < SHORT * (len(starts) - 1):
            for c, x in enumerate(columns):
                for k in t.select(list(range(len(by)))).append_column("_v", x).to_batches():
                    yield _batch(by, k.columns[:-1], np.full(len(k), c), k.column(len(by)), np.ones(len(k)))
            return
        named = []
        for i in range(len(starts) - 1):
            key = [x[i] for x in found.columns]
            name = tuple(x.as_py() for x in key)
            if name not in groups:
                groups[name] = _Group(key, len(columns))
                size += len(columns)
            named.append(groups[name])
        for c, x in enumerate(columns):
            null = x.is_null().to_numpy()[order] if x.null_count else None
            values = x.fill_null(0.0).to_numpy()[order]
            for g, a, b in zip(named, starts[:-1].tolist(), starts[1:].tolist()):
                some = values[a:b]
                if null is not None:
                    some = some[~null[a:b]]
                    g.nulls[c] += b - a - len(some)
                size += g.add(c, some)

    def passed_on() -> Iterator[pa.RecordBatch]:
        nonlocal size
        for g in groups.values():
            yield from g.rows(by)
        groups.clear()
        size = 0

    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows * batch.num_columns >= gathered:
            yield from count()
            rows = 0
            if size > most:
                yield from passed_on()
    if held:
        yield from count()
    yield from passed_on()
