"""Reading chunks one after the other, as Arrow batches; a plain generator, usable without Spark.

Filter columns are read first; a chunk that no row of which can pass is skipped before its other columns are read. The next
chunks' bytes are fetched ahead by a few threads where the store is remote.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from decimal import Decimal

import numpy as np
import pyarrow as pa

from gridloom.errors import ColumnRequestError, ComputeError
from gridloom.operators.grid import Grid, nth, plan, share, spread
from gridloom.operators.predicates import column_of, passes
from gridloom.sources.stores import TYPES, ArrayMeta, Store, open_store

BATCH_ROWS = 65_536
AHEAD = 4


def to_arrow(values: np.ndarray, kind: str) -> pa.Array:
    if kind == "uint64":
        return pa.array([Decimal(int(v)) for v in values], TYPES[kind][2])
    if kind == "string":
        return pa.array(values.tolist(), pa.string())
    return pa.array(np.ascontiguousarray(values)).cast(TYPES[kind][2])


class Reader:
    """Columns of single chunks; keeps the chunks of one-axis arrays that it saw last."""

    def __init__(self, store: Store, metas: dict[str, ArrayMeta], grid: Grid):
        self.store, self.metas, self.grid = store, metas, grid
        self._last: dict[tuple[str, int], np.ndarray] = {}

    def along(self, name: str, start: int, end: int) -> np.ndarray:
        """Elements of a one-axis array, however it is chunked."""
        meta, parts = self.metas[name], []
        for i in range(start // meta.chunks[0], -(-end // meta.chunks[0])):
            if (name, i) not in self._last:
                if len(self._last) > 256:
                    self._last.clear()
                self._last[name, i] = self.store.chunk(meta, (i,))
            at = i * meta.chunks[0]
            parts.append(self._last[name, i][max(0, start - at) : end - at])
        return np.concatenate(parts) if parts else np.zeros(0, meta.dtype)

    def column(self, name: str, index: tuple[int, ...]) -> np.ndarray:
        axis, extent = self.grid.axis[name], self.grid.extent(index)
        if axis is not None:
            return spread(self.along(name, *extent[axis]), axis, extent)
        values = self.store.chunk(self.metas[name], index)
        size = tuple(b - a for a, b in extent)
        if values.shape != size:
            raise ComputeError(f"a chunk of {name} has the shape {values.shape} where {size} is due")
        return values.ravel()


def read_chunks(reader: Reader, names: list[str], chunks: Iterator[tuple[int, ...]], tests: list[tuple] = (), rows: int = BATCH_ROWS, ahead: int = 1, predicate: Callable[[pa.RecordBatch], object] | None = None) -> Iterator[pa.RecordBatch]:
    """Batches of some chunks; small ones are put together up to so many rows (rows=0: a batch for each chunk)."""
    first = list(dict.fromkeys(column_of(t) for t in tests if column_of(t) in reader.metas))

    def load(index):
        columns = {n: reader.column(n, index) for n in first}
        if tests and not passes([t for t in tests if column_of(t) in columns], columns):
            return None
        for n in names:
            if n not in columns:
                columns[n] = reader.column(n, index)
        return [columns[n] for n in names]

    def loaded():
        if ahead <= 1:
            yield from map(load, chunks)
            return
        with ThreadPoolExecutor(ahead) as pool:
            waiting = []
            for index in chunks:
                waiting.append(pool.submit(load, index))
                if len(waiting) > ahead:
                    yield waiting.pop(0).result()
            for x in waiting:
                yield x.result()

    def batch(held):
        return pa.RecordBatch.from_arrays([to_arrow(np.concatenate(c) if len(c) > 1 else c[0], reader.metas[n].kind) for n, c in zip(names, zip(*held))], names=names)

    held, size = [], 0
    for columns in loaded():
        if columns is None:
            continue
        if predicate is not None and not np.asarray(predicate(batch([columns])), bool).any():
            continue
        held.append(columns)
        size += len(columns[0])
        if size >= rows:
            yield batch(held)
            held, size = [], 0
    if held:
        yield batch(held)


def iter_batches(path: str, columns: list[str] | None = None, n_partitions: int = 1, partition: int = 0, predicate: Callable[[pa.RecordBatch], object] | None = None, tests: list[tuple] = (), kind: str = "zarr", rows: int = 0) -> Iterator[pa.RecordBatch]:
    """The batches of one partition of a store, a chunk each.

    predicate: takes a chunk's batch and returns a row mask; chunks without a true row are skipped. tests: the same as plain
    comparisons such as ("lt", "lat", 41), for which only the columns they name are read first.
    """
    store = open_store(path, kind)
    metas = store.arrays(columns)
    for c in columns or ():
        if c not in metas:
            raise ColumnRequestError(f"there is no column {c!r}; columns are {', '.join(store.arrays())}")
    names = list(columns or metas)
    grid = plan([metas[n] for n in names])
    kept = [np.arange(n) for n in grid.counts]
    own = share(int(np.prod(grid.counts)), n_partitions, partition)
    yield from read_chunks(Reader(store, metas, grid), names, (nth(kept, k) for k in own), tests, rows, AHEAD if store.remote else 1, predicate)
