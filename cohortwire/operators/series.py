"""Functions of whole groups of rows, such as a device's series, many groups to an Arrow batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows given back at once, about.
GIVEN_ROWS = 10_000


def _groups(batches: Iterator[pa.RecordBatch], n_keys: int, names: list[str]) -> Iterator[tuple[tuple, dict[str, np.ndarray]]]:
    """(key, columns) of each run of rows with equal keys, also of those that go on in the next batch."""
    held_key, held = None, []
    whole = lambda: {c: np.concatenate([p[i] for p in held]) if len(held) > 1 else held[0][i] for i, c in enumerate(names)}
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows - 1, bool)
        for k in range(n_keys):
            codes = batch.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy()
            new |= codes[1:] != codes[:-1]
        starts = np.concatenate([[0], np.flatnonzero(new) + 1])
        firsts = batch.take(pa.array(starts))
        keys = list(zip(*[firsts.column(k).to_pylist() for k in range(n_keys)], strict=True))
        values = [batch.column(n_keys + i).to_numpy(zero_copy_only=False) for i in range(len(names))]
        for key, a, b in zip(keys, starts.tolist(), [*starts[1:].tolist(), batch.num_rows], strict=True):
            if held and key != held_key:
                yield held_key, whole()
                held = []
            held_key = key
            held.append([v[a:b] for v in values])
    if held:
        yield held_key, whole()


def over_groups(rows: DataFrame, keys: list[str], one: Callable[[tuple, dict[str, np.ndarray]], dict | None], given: dict[str, str], order: list[str] = ()) -> DataFrame:
    """keys and the `given` columns (name: type): what one(key, columns) returns for each group, arrays of one length, or
    None.  Columns are rows' others, numbers only, in the order of `order` within a group.

    As applyInPandas(), but small groups cost little, as they come and go many to a batch.  A group is held by one task.
    """
    names = [c for c in rows.columns if c not in keys]

    def run(batches):
        kinds: list[pa.DataType] = []

        def seen():
            for batch in batches:
                kinds[:] = [batch.column(k).type for k in range(len(keys))]
                yield batch

        at, sizes, parts = [], [], []

        def made() -> pa.RecordBatch:
            repeat = pa.array(np.repeat(np.arange(len(at)), sizes))
            columns = [pa.array([key[k] for key in at], kind).take(repeat) for k, kind in enumerate(kinds)]
            columns += [pa.array(np.concatenate([p[c] for p in parts])) for c in given]
            return pa.RecordBatch.from_arrays(columns, [*keys, *given])

        for key, columns in _groups(seen(), len(keys), names):
            found = one(key, columns)
            size = len(next(iter(found.values()))) if found else 0
            if size:
                at.append(key)
                sizes.append(size)
                parts.append(found)
            if sum(sizes) >= GIVEN_ROWS:
                yield made()
                at, sizes, parts = [], [], []
        if at:
            yield made()

    schema = ", ".join([*[f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys], *[f"`{c}` {kind}" for c, kind in given.items()]])
    return rows.select(*keys, *names).repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
