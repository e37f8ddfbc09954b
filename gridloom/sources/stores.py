"""Where arrays are kept: local folders, S3, and versioned repositories; and their metadata."""

from __future__ import annotations

import json
import math
import os
from dataclasses import dataclass, field
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa

from gridloom.errors import MetadataError, StorageError, TypeSupportError
from gridloom.sources.codecs import Chain

#: Element types: numpy type, Spark type and Arrow type of the column. Spark has no unsigned integers: they widen.
TYPES = {
    "bool": ("?", "boolean", pa.bool_()),
    "int8": ("i1", "tinyint", pa.int8()),
    "int16": ("i2", "smallint", pa.int16()),
    "int32": ("i4", "int", pa.int32()),
    "int64": ("i8", "bigint", pa.int64()),
    "uint8": ("u1", "smallint", pa.int16()),
    "uint16": ("u2", "int", pa.int32()),
    "uint32": ("u4", "bigint", pa.int64()),
    "uint64": ("u8", "decimal(20,0)", pa.decimal128(20, 0)),
    "float32": ("f4", "float", pa.float32()),
    "float64": ("f8", "double", pa.float64()),
    "string": ("O", "string", pa.string()),
}


def _fill(value, kind: str):
    """A fill value as the metadata give it: a number, a name such as NaN, or the bits in hexadecimal."""
    dtype = np.dtype(TYPES[kind][0])
    if kind == "string":
        return "" if value is None else str(value)
    if isinstance(value, str) and value.startswith("0x"):
        return np.array(int(value, 16), f"u{dtype.itemsize}").view(dtype).item()
    if isinstance(value, str):
        value = float({"Infinity": "inf", "-Infinity": "-inf"}.get(value, value))
    return np.array(0 if value is None else value).astype(dtype).item()


@dataclass
class ArrayMeta:
    """One array of a store: a column."""

    name: str
    kind: str
    shape: tuple[int, ...]
    chunks: tuple[int, ...]
    fill: object
    dims: tuple[str | None, ...] | None
    codecs: list = field(repr=False)
    separator: str = "/"
    prefix: str = "c"

    @classmethod
    def parse(cls, name: str, text: bytes) -> ArrayMeta | None:
        """None for what isn't an array."""
        try:
            meta = json.loads(text)
        except ValueError as e:
            raise MetadataError(f"the metadata of {name} can't be read: {e}") from e
        if meta.get("zarr_format") != 3 or meta.get("node_type") != "array":
            return None
        kind = meta["data_type"]
        if not isinstance(kind, str) or kind not in TYPES:
            raise TypeSupportError(f"array {name} has the type {kind}, which is not supported")
        grid = meta["chunk_grid"]
        if grid["name"] != "regular":
            raise MetadataError(f"array {name} has no regular chunk grid")
        keys = meta.get("chunk_key_encoding", {"name": "default"})
        conf = keys.get("configuration") or {}
        v2 = keys["name"] == "v2"
        dims = meta.get("dimension_names")
        return cls(name, kind, tuple(meta["shape"]), tuple(grid["configuration"]["chunk_shape"]), _fill(meta.get("fill_value"), kind), tuple(dims) if dims is not None else None, meta["codecs"], conf.get("separator", "." if v2 else "/"), "" if v2 else "c")

    @property
    def rank(self) -> int:
        return len(self.shape)

    @property
    def is_coordinate(self) -> bool:
        return self.rank == 1 and self.dims == (self.name,)

    @property
    def grid(self) -> tuple[int, ...]:
        return tuple(math.ceil(s / c) for s, c in zip(self.shape, self.chunks))

    @property
    def dtype(self) -> np.dtype:
        return np.dtype(TYPES[self.kind][0])

    def key(self, index: tuple[int, ...]) -> str:
        parts = [self.prefix] * bool(self.prefix) + [str(i) for i in index]
        return f"{self.name}/{self.separator.join(parts) or '0'}"


class Store:
    """A folder of arrays, on the local file system or on S3."""

    def __init__(self, url: str):
        self.url = url
        parts = urlparse(url) if "://" in url or url.startswith("file:") else None
        if parts is None:
            self.path, self.remote = url, False
        elif parts.scheme == "file":
            self.path, self.remote = unquote(parts.path), False
        elif parts.scheme == "s3":
            self.path, self.remote = parts.netloc + parts.path, True
        else:
            raise StorageError(f"a zarr store can't be opened by the scheme {parts.scheme!r}: {url}")
        self._fs = None

    def __getstate__(self):
        return self.__dict__ | {"_fs": None}

    @property
    def fs(self):
        if self._fs is None:
            from pyarrow import fs

            self._fs = fs.S3FileSystem()  # credentials and region from the environment
        return self._fs

    def read(self, key: str) -> bytes | None:
        """None for a key that isn't there."""
        try:
            if self.remote:
                with self.fs.open_input_stream(f"{self.path}/{key}") as f:
                    return f.read()
            with open(os.path.join(self.path, key), "rb") as f:
                return f.read()
        except FileNotFoundError:
            return None
        except OSError as e:
            raise StorageError(f"{key} of {self.url} can't be read: {e}") from e

    def names(self) -> list[str]:
        try:
            if self.remote:
                from pyarrow import fs

                return sorted(x.base_name for x in self.fs.get_file_info(fs.FileSelector(self.path)) if x.type == fs.FileType.Directory)
            return sorted(x.name for x in os.scandir(self.path) if x.is_dir())
        except OSError as e:
            raise StorageError(f"{self.url} can't be listed: {e}") from e

    def arrays(self, names: list[str] | None = None) -> dict[str, ArrayMeta]:
        """The store's arrays by name, in alphabetical order (or just the named ones, in theirs); deeper groups don't count."""
        found = {}
        for name in self.names() if names is None else names:
            text = self.read(f"{name}/zarr.json")
            if text is not None and (meta := ArrayMeta.parse(name, text)):
                found[name] = meta
        return found

    def chunk(self, meta: ArrayMeta, index: tuple[int, ...]) -> np.ndarray:
        """A chunk without what sticks out over the array's edges; fill values where it isn't stored."""
        size = tuple(min(c, s - i * c) for i, c, s in zip(index, meta.chunks, meta.shape))
        data = self.read(meta.key(index))
        if data is None:
            out = np.empty(size, meta.dtype)
            out[...] = meta.fill
            return out
        whole = Chain(meta.codecs, meta.dtype, meta.fill).decode(data, meta.chunks)
        return whole[tuple(slice(n) for n in size)]


class VersionedStore(Store):
    """A snapshot of a versioned repository: branch main as of now, resolved once; needs the icechunk package."""

    def __init__(self, url: str):
        super().__init__(url)
        try:
            import icechunk
        except ImportError as e:
            raise StorageError("versioned repositories need the icechunk package, which isn't installed") from e
        self.snapshot = icechunk.Repository.open(self._storage()).lookup_branch("main")

    def _storage(self):
        import icechunk

        if self.remote:
            bucket, _, prefix = self.path.partition("/")
            return icechunk.s3_storage(bucket=bucket, prefix=prefix, from_env=True)
        return icechunk.local_filesystem_storage(self.path)

    def _session(self):
        if self._fs is None:
            import icechunk

            self._fs = icechunk.Repository.open(self._storage()).readonly_session(snapshot_id=self.snapshot).store
        return self._fs

    def read(self, key: str) -> bytes | None:
        import asyncio

        from zarr.core.buffer import default_buffer_prototype

        found = asyncio.run(self._session().get(key, default_buffer_prototype()))
        return None if found is None else found.to_bytes()

    def names(self) -> list[str]:
        import asyncio

        async def listed():
            return [x async for x in self._session().list_dir("")]

        return sorted(x.rstrip("/") for x in asyncio.run(listed()))


def open_store(url: str, kind: str = "zarr") -> Store:
    return VersionedStore(url) if kind == "icechunk" else Store(url)
