"""Writing stores: single arrays (fixtures) and, as Spark jobs, tables as one-axis arrays or as grids over coordinates."""

from __future__ import annotations

import json
import math
import os
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.errors import ColumnRequestError, StorageError
from gridloom.sources.codecs import Chain
from gridloom.sources.stores import TYPES

BLOSC = [{"name": "bytes", "configuration": {"endian": "little"}}, {"name": "blosc", "configuration": {"cname": "lz4", "clevel": 5, "shuffle": "noshuffle", "typesize": 8, "blocksize": 0}}]
STRINGS = [{"name": "vlen-utf8"}, {"name": "zstd", "configuration": {"level": 1, "checksum": False}}]


def _path(url: str) -> str:
    return url.removeprefix("file://")


def describe(url: str, name: str, kind: str, shape, chunks, dims=None, fill=None, codecs=None, encoding: dict | None = None) -> dict:
    """Writes an array's metadata."""
    fill = ("" if kind == "string" else False if kind == "bool" else 0) if fill is None else fill
    if isinstance(fill, float) and not math.isfinite(fill):
        fill = "NaN" if fill != fill else "Infinity" if fill > 0 else "-Infinity"
    meta = {
        "zarr_format": 3, "node_type": "array", "shape": list(shape), "data_type": kind, "fill_value": fill, "attributes": {},
        "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": list(chunks)}}, "codecs": codecs or (STRINGS if kind == "string" else BLOSC),
        "chunk_key_encoding": encoding or {"name": "default", "configuration": {"separator": "/"}},
    }
    if dims is not None:
        meta["dimension_names"] = list(dims)
    os.makedirs(f"{_path(url)}/{name}", exist_ok=True)
    with open(f"{_path(url)}/{name}/zarr.json", "w") as f:
        json.dump(meta, f)
    root = f"{_path(url)}/zarr.json"
    if not os.path.exists(root):
        with open(root, "w") as f:
            json.dump({"zarr_format": 3, "node_type": "group", "attributes": {}}, f)
    return meta


def put_chunk(url: str, meta: dict, name: str, index: tuple[int, ...], values: np.ndarray) -> None:
    """Writes one chunk; what a chunk at the edge lacks is filled. Whole or not at all: another task may write the same."""
    kind, chunks, fill = meta["data_type"], meta["chunk_grid"]["configuration"]["chunk_shape"], meta["fill_value"]
    dtype = np.dtype(TYPES[kind][0])
    fill = float(fill.replace("Infinity", "inf")) if isinstance(fill, str) and kind != "string" else fill
    if values.shape == tuple(chunks) and values.dtype == dtype:
        whole = values
    else:
        whole = np.full(chunks, fill, dtype)
        whole[tuple(slice(n) for n in values.shape)] = values
    keys = meta["chunk_key_encoding"]
    sep = (keys.get("configuration") or {}).get("separator", "." if keys["name"] == "v2" else "/")
    key = sep.join([*(["c"] if keys["name"] == "default" else []), *map(str, index)])
    to = f"{_path(url)}/{name}/{key}"
    os.makedirs(os.path.dirname(to), exist_ok=True)
    part = f"{to}.{os.getpid()}.part"
    with open(part, "wb") as f:
        f.write(Chain(meta["codecs"], dtype, fill).encode(whole))
    os.replace(part, to)


def write_array(url: str, name: str, values: np.ndarray, chunks, dims=None, kind: str | None = None, fill=None, codecs=None, encoding=None, skip_fill: bool = False, skip=()) -> None:
    """Writes a whole array; skip_fill: chunks of fill values alone are not stored; skip: neither are these."""
    kind = kind or ("string" if values.dtype.kind in "OU" else values.dtype.name)
    meta = describe(url, name, kind, values.shape, chunks, dims, fill, codecs, encoding)
    for index in product(*(range(math.ceil(s / c)) for s, c in zip(values.shape, chunks))):
        part = values[tuple(slice(i * c, i * c + c) for i, c in zip(index, chunks))]
        if index in skip or skip_fill and (part == meta["fill_value"]).all():
            continue
        put_chunk(url, meta, name, index, part)


#: Timestamps without a zone are stored as microseconds.
_KIND = {v[1]: k for k, v in reversed(TYPES.items())} | {"timestamp_ntz": "int64"}


def _cast(column: pa.ChunkedArray, name: str, kind: str) -> pa.ChunkedArray:
    try:
        return column.cast(pa.string() if kind == "string" else pa.from_numpy_dtype(np.dtype(TYPES[kind][0])))
    except pa.ArrowInvalid as e:
        raise ColumnRequestError(f"column {name} has values that are no {kind}: {e}") from e


def write_table(df: DataFrame, url: str, chunk: int = 4096, kinds: dict[str, str] | None = None) -> int:
    """A table as one-axis arrays without dimension names, rows as Spark reads them; a task writes whole chunks. Returns the rows.

    A task writes the chunks that lie within its partition as it reads them. Only rows of chunks that begin or end in another partition
    are shuffled, and what a partition has beyond twice its fair share, as of a file that can't be split.
    df must read the same way twice, as a table from files does. kinds: other types than the columns' own; a value outside them is an error.
    """
    own = {f.name: _KIND[f.dataType.simpleString()] for f in df.schema}
    kinds = own | {n: k for n, k in (kinds or {}).items() if n in own}
    sizes = {r[0]: r[1] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()}  # a row for each partition
    starts, n = {}, 0
    for p in sorted(sizes):
        starts[p], n = n, n + sizes[p]
    metas = {name: describe(url, name, kind, (n,), (chunk,)) for name, kind in kinds.items()}
    names, share = df.columns, -(-2 * n // max(1, df.sparkSession.sparkContext.defaultParallelism))

    def put(t: pa.Table, index: int) -> None:
        for name in names:
            plain = kinds[name] == own[name] and not pa.types.is_timestamp(t[name].type)
            column = t[name] if plain else _cast(t[name], name, kinds[name])
            put_chunk(url, metas[name], name, (index,), column.to_numpy().astype(TYPES[kinds[name]][0], copy=False))

    def pieces(batches, at):
        """The rows from at on, cut where a chunk ends: the position of each piece's first row, and the piece."""
        for b in batches:
            i = 0
            while i < len(b):
                size = min(len(b) - i, chunk - at % chunk)
                yield at, b.slice(i, size)
                i, at = i + size, at + size

    def write(batches):
        p = TaskContext.get().partitionId()
        first = done = starts.get(p, 0)
        end = first + sizes.get(p, 0)
        held = []
        for at, piece in pieces(batches, first):
            done, index = at + len(piece), at // chunk
            whole = index * chunk >= first and min(index * chunk + chunk, n) <= end
            if whole and index * chunk - first < share:
                held.append(piece)
                if done == min(index * chunk + chunk, n):
                    put(pa.Table.from_batches(held), index)
                    held = []
            else:
                pos = pa.array(np.arange(at, done))
                yield pa.RecordBatch.from_arrays([*piece.columns, pos, pa.array(np.full(len(piece), index))], names=[*names, "__pos", "__chunk"])
        if done != end:
            raise StorageError(f"partition {p} of the table had {end - first} rows when they were counted, and {done - first} when they were read")

    def gather(t: pa.Table) -> pa.Table:
        put(t.sort_by("__pos"), t["__chunk"][0].as_py())
        return pa.table({"n": [len(t)]})

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    df.mapInArrow(write, f"{kind}, __pos long, __chunk long").groupBy("__chunk").applyInArrow(gather, "n long").agg(F.sum("n")).first()
    return n


def write_grid(df: DataFrame, url: str, dims: list[str], values: list[str], chunks, fill=0, wide: list[str] = ()) -> tuple[int, ...]:
    """A grid over the distinct values of the dims, a cell for each combination: df has a row for each of those that isn't fill.

    Coordinates are one-axis arrays (those in wide are stored over the first two axes); chunks of fill values alone are not stored. The
    coordinates' values are gathered on the driver, as they are when the store is read.
    """
    kinds = {f.name: _KIND[f.dataType.simpleString()] for f in df.schema}
    at = {d: np.array([r[0] for r in df.select(d).distinct().orderBy(d).collect()]) for d in dims}
    shape = tuple(len(at[d]) for d in dims)
    for i, d in enumerate(dims):
        if d in wide:
            form = [1] * len(dims)
            form[i] = -1
            write_array(url, d, np.broadcast_to(at[d].reshape(form), shape), chunks, dims, kinds[d])
        else:
            write_array(url, d, at[d], (chunks[i],), (d,), kinds[d])
    metas = {v: describe(url, v, kinds[v], shape, chunks, dims, float(fill) if kinds[v].startswith("float") else int(fill)) for v in values}

    def put(t: pa.Table) -> pa.Table:
        place = [np.searchsorted(at[d], t[d].to_numpy()) for d in dims]
        index = tuple(int(p[0]) // c for p, c in zip(place, chunks))
        size = tuple(min(c, s - i * c) for i, c, s in zip(index, chunks, shape))
        for v in values:
            cells = np.full(size, fill, TYPES[kinds[v]][0])
            cells[tuple(p - i * c for p, i, c in zip(place, index, chunks))] = t[v].to_numpy()
            if not (cells == fill).all():
                put_chunk(url, metas[v], v, index, cells)
        return pa.table({"n": [len(t)]})

    def box(batches):
        for b in batches:
            ids = [pa.array(np.searchsorted(at[d], b.column(d).to_numpy()) // c) for d, c in zip(dims, chunks)]
            yield pa.RecordBatch.from_arrays([*b.columns, *ids], names=[*b.schema.names, *(f"__{d}" for d in dims)])

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    df.mapInArrow(box, kind + "".join(f", __{d} long" for d in dims)).groupBy(*(f"__{d}" for d in dims)).applyInArrow(put, "n long").agg(F.sum("n")).first()
    return shape
