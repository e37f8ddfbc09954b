"""The Spark data source "zarr": a store of arrays as a table.

Options: path; columns (names, joined by commas: which arrays make the table; default all); grid (names: the arrays that fix the rows, where these
are more than the columns); numPartitions, or else minPartitions and as many as the bytes ask for; kind (zarr or icechunk);
batchRows; tests (comparisons of columns, packed: chunks without a row that passes are skipped) and prune (false: they are not). Spark
filters the rows again. Filters and column lists come from plans.pruning; Spark's own pushdown is not taken (see there).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from gridloom.errors import ColumnRequestError, MetadataError
from gridloom.operators.grid import nth, plan, share
from gridloom.operators.predicates import column_of, mask, unpack
from gridloom.sources.stores import TYPES, open_store
from gridloom.streaming.batches import AHEAD, BATCH_ROWS, Reader, read_chunks


PART_BYTES = 128 << 20  # of decoded arrays, for each partition


class ChunkRun(InputPartition):
    """A run of the chunks whose index is kept on every axis (the planner's reader isn't the one that tasks get, so a run says all).

    An axis is told by the stretches of indices that are kept.
    """

    def __init__(self, start: int, stop: int, kept: list[np.ndarray]):
        self.start, self.stop = start, stop
        self.stretches = []
        for own in kept:
            first = np.flatnonzero(np.diff(own, prepend=-2) != 1)
            self.stretches.append((own[first], np.diff(np.append(first, len(own)))))

    @property
    def kept(self) -> list[np.ndarray]:
        return [np.concatenate([np.arange(a, a + n) for a, n in zip(*s)]) if len(s[0]) else np.zeros(0, np.int64) for s in self.stretches]


def fields_of(metas: dict) -> str:
    return ", ".join(f"`{n}` {TYPES[m.kind][1]}" for n, m in metas.items())


def chosen(store, columns: list[str] | None) -> dict:
    metas = store.arrays(columns)
    if missing := [c for c in columns or () if c not in metas]:
        raise ColumnRequestError(f"Schema error: there is no column {missing[0]!r}; valid fields are {', '.join(store.arrays())}")
    if not metas:
        raise MetadataError(f"{store.url} holds no arrays")
    return metas


def check_declared(metas: dict, declared: StructType) -> None:
    for f in declared:
        kind = TYPES[metas[f.name].kind][1]
        if f.dataType.simpleString() != kind:
            raise ColumnRequestError(f"the type of column {f.name} does not match: {f.dataType.simpleString()} is declared, {kind} is stored")


class ZarrReader(DataSourceReader):
    def __init__(self, store, metas: dict, options: dict):
        """metas: of the columns; the option grid names the arrays whose grid their rows are."""
        self.store, self.metas, self.names = store, metas, list(metas)
        fixed = [n for n in options.get("grid", "").split(",") if n] or self.names
        self.grid = plan(list((metas if fixed == self.names else chosen(store, fixed)).values()))
        size = int(np.prod(self.grid.shape, dtype=object)) * sum(max(1, m.dtype.itemsize) for m in metas.values())
        self.parts = int(options.get("numpartitions") or max(int(options.get("minpartitions", 8)), -(-size // PART_BYTES)))
        self.rows = int(options.get("batchrows", BATCH_ROWS))
        tests = unpack(options.get("tests", "")) if options.get("prune", "true").lower() != "false" else []
        self.tests = [t for t in tests if column_of(t) in self.metas]

    def partitions(self):
        """One plan for all tasks: on every axis only chunks in which a coordinate can pass its tests stay."""
        reader, kept = Reader(self.store, self.metas, self.grid), [np.arange(n) for n in self.grid.counts]
        for name, axis in self.grid.axis.items():
            own = [t for t in self.tests if column_of(t) == name]
            if axis is None or not own:
                continue
            size, length = self.grid.chunks[axis], self.grid.shape[axis]
            ok = []
            for i in kept[axis]:
                values = {name: reader.along(name, int(i) * size, min(int(i) * size + size, length))}
                masks = [m for m in (mask(t, values) for t in own) if m is not None]
                ok.append(not masks or bool(np.logical_and.reduce(masks).any()))
            kept[axis] = kept[axis][np.array(ok, bool)]
        n = int(np.prod([len(k) for k in kept]))
        runs = [share(n, self.parts, p) for p in range(self.parts)]
        return [ChunkRun(r.start, r.stop, kept) for r in runs if len(r)] or [ChunkRun(0, 0, kept)]

    def read(self, partition):
        reader = Reader(self.store, self.metas, self.grid)
        kept = partition.kept
        chunks = (nth(kept, k) for k in range(partition.start, partition.stop))
        yield from read_chunks(reader, self.names, chunks, self.tests, self.rows, AHEAD if self.store.remote else 1)


class ZarrSource(DataSource):
    @classmethod
    def name(cls):
        return "zarr"

    def _open(self):
        path = self.options.get("path")
        if not path:
            raise ColumnRequestError("the option path is missing (tables made by CREATE TABLE lose it: use a view)")
        names = [c.strip() for c in self.options.get("columns", "").split(",") if c.strip()]
        return open_store(path, self.options.get("kind", "zarr")), names or None

    def schema(self):
        store, names = self._open()
        return fields_of(chosen(store, names))

    def reader(self, schema):
        store, _ = self._open()
        metas = chosen(store, schema.names)
        check_declared(metas, schema)
        return ZarrReader(store, metas, {k.lower(): v for k, v in self.options.items()})
