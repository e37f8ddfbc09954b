"""The mapping of arrays to rows: which axis each array lies on, which chunks there are, who reads them."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from gridloom.errors import MetadataError
from gridloom.sources.stores import ArrayMeta


@dataclass
class Grid:
    """Rows are the cells of shape, chunk by chunk in row-major order. axis: of an array that lies along one axis only, else None."""

    shape: tuple[int, ...]
    chunks: tuple[int, ...]
    axis: dict[str, int | None]

    @property
    def counts(self) -> tuple[int, ...]:
        return tuple(math.ceil(s / c) for s, c in zip(self.shape, self.chunks))

    def extent(self, index: tuple[int, ...]) -> list[tuple[int, int]]:
        """First and end cell of a chunk on every axis."""
        return [(i * c, min(i * c + c, s)) for i, c, s in zip(index, self.chunks, self.shape)]


def _named(metas: list[ArrayMeta]) -> None:
    for m in metas:
        if m.dims is not None and (len(m.dims) != m.rank or any(d is None for d in m.dims)):
            raise MetadataError(f"array {m.name} has {m.rank} axes, of which not all have a name")
        if not m.rank:
            raise MetadataError(f"array {m.name} is a single value, which makes no rows: leave it out with columns=")


def _alike(metas: list[ArrayMeta], what: str) -> None:
    for name, values in (("shapes", {m.shape for m in metas}), ("chunk shapes", {m.chunks for m in metas}), ("dimension names", {m.dims for m in metas if m.dims is not None})):
        if len(values) > 1:
            raise MetadataError(f"{what} {', '.join(m.name for m in metas)} have different {name}: {sorted(map(str, values))}; choose arrays that fit together with columns=")


def plan(metas: list[ArrayMeta]) -> Grid:
    """The grid of some arrays, in the order of the columns."""
    if not metas:
        raise MetadataError("there are no arrays to read")
    _named(metas)
    data = [m for m in metas if m.rank > 1]
    if data:
        _alike(data, "the arrays")
        dims, first, axis = next((m.dims for m in data if m.dims is not None), None), data[0], {}
        for m in metas:
            if m.rank > 1:
                axis[m.name] = None
                continue
            if dims is None or any(d.dims is None for d in data):
                raise MetadataError(f"array {m.name} has one axis, and arrays of more axes have no dimension names to place it by")
            if not m.is_coordinate or m.name not in dims:
                raise MetadataError(f"array {m.name} has one axis and is no coordinate of {list(dims)}")
            axis[m.name] = dims.index(m.name)
            if m.shape[0] != first.shape[axis[m.name]]:
                raise MetadataError(f"coordinate {m.name} has {m.shape[0]} values for an axis of {first.shape[axis[m.name]]}")
        return Grid(first.shape, first.chunks, axis)
    if all(m.is_coordinate for m in metas):
        return Grid(tuple(m.shape[0] for m in metas), tuple(m.chunks[0] for m in metas), {m.name: i for i, m in enumerate(metas)})
    if sum(m.is_coordinate for m in metas) > 1:
        raise MetadataError("several coordinates and other arrays of one axis: neither a product nor a row by row reading is meant for certain")
    _alike(metas, "the arrays")
    return Grid(metas[0].shape, metas[0].chunks, {m.name: None for m in metas})


def share(n: int, parts: int, part: int) -> range:
    """Which of n chunks a part reads: contiguous runs of equal length; the last parts may have fewer or none."""
    if not 0 <= part < parts:
        raise IndexError(f"there is no part {part} of {parts}")
    size = -(-n // parts)
    return range(min(n, part * size), min(n, part * size + size))


def nth(kept: list[np.ndarray], k: int) -> tuple[int, ...]:
    """The k-th chunk, in row-major order, of those whose index is kept on every axis."""
    return tuple(int(a[i]) for a, i in zip(kept, np.unravel_index(k, [len(a) for a in kept])))


def spread(values: np.ndarray, axis: int, extent: list[tuple[int, int]]) -> np.ndarray:
    """The values of one axis for every cell of a chunk."""
    size = [b - a for a, b in extent]
    form = [1] * len(size)
    form[axis] = size[axis]
    return np.broadcast_to(values.reshape(form), size).ravel()
