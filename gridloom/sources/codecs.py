"""Zarr v3 codec chains: bytes, vlen-utf8, transpose, gzip, zstd, blosc, crc32c and sharding, after the public specifications."""

from __future__ import annotations

import gzip
import math
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from gridloom.errors import ComputeError, MetadataError

_MISSING = (1 << 64) - 1


_POLYNOMIAL = 0x82F63B78  # fixed value: Castagnoli's polynomial, bits reversed
_LANES = 1024


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = c >> 1 ^ np.where(c & 1, np.uint32(_POLYNOMIAL), np.uint32(0))
    return c


_CRC = _crc_table()
_CRC_INTS = _CRC.tolist()


@lru_cache(64)
def _over_zeros(n: int) -> list[list[int]]:
    """What n zero bytes make of a register, as four tables, one for each of its bytes: a linear map, found by squaring."""
    def apply(columns: list[int], x: int) -> int:
        out = 0
        for i, c in enumerate(columns):
            if x >> i & 1:
                out ^= c
        return out

    power = [(1 << i) >> 8 ^ _CRC_INTS[(1 << i) & 255] for i in range(32)]
    out = [1 << i for i in range(32)]
    while n:
        if n & 1:
            out = [apply(power, c) for c in out]
        power = [apply(power, c) for c in power]
        n >>= 1
    return [[apply(out, b << 8 * k) for b in range(256)] for k in range(4)]


def crc32c(data: bytes) -> int:
    """Long data go in lanes of equal length, all of them a byte at a time; the lanes' registers are then put together."""
    c, at = 0xFFFFFFFF, 0
    if len(data) >= 4 * _LANES:
        size = len(data) // _LANES
        at = size * _LANES
        lanes = np.ascontiguousarray(np.frombuffer(data, np.uint8, at).reshape(_LANES, size).T)
        register = np.zeros(_LANES, np.uint32)
        for column in lanes:
            register = register >> np.uint32(8) ^ _CRC[(register ^ column) & np.uint32(255)]
        t0, t1, t2, t3 = _over_zeros(size)
        for own in register.tolist():
            c = t0[c & 255] ^ t1[c >> 8 & 255] ^ t2[c >> 16 & 255] ^ t3[c >> 24] ^ own
    for b in data[at:]:
        c = c >> 8 ^ _CRC_INTS[(c ^ b) & 255]
    return c ^ 0xFFFFFFFF


_NEAR = 8191  # fixed value: distances beyond it take two more bytes


def blosclz_decode(data: bytes, size: int) -> bytes:
    """Bytes under 32 tell how many literals follow, less one; others are a match: a length in three bits, and a distance of five and eight bits.

    The first byte's upper bits don't count. A length of seven goes on in further bytes as long as these are 255; the largest distance goes on
    in sixteen bits.
    """
    out, at = bytearray(), 1
    control = data[0] & 31 if data else 0
    while at <= len(data) and data:
        if control < 32:
            out += data[at : at + control + 1]
            at += control + 1
        else:
            length, distance = (control >> 5) - 1, (control & 31) << 8
            if length == 6:
                while True:
                    length += data[at]
                    at += 1
                    if data[at - 1] != 255:
                        break
            length += 3
            far = data[at] == 255 and distance == 31 << 8
            distance += data[at]
            at += 1
            if far:
                distance = (data[at] << 8) + data[at + 1] + _NEAR
                at += 2
            start = len(out) - distance - 1
            if start < 0:
                raise ComputeError("a match begins before the block")
            while length > 0:  # what a match copies may be part of itself
                piece = out[start : start + length]
                out += piece
                start, length = start + len(piece), length - len(piece)
        if at >= len(data):
            break
        control = data[at]
        at += 1
    if len(out) != size:
        raise ComputeError(f"a block has {len(out)} bytes where {size} are due")
    return bytes(out)


def _unshuffle(raw: bytes, size: int) -> bytes:
    n = len(raw) // size
    body = np.frombuffer(raw, np.uint8, n * size).reshape(size, n).T
    return body.tobytes() + raw[n * size :]


def _bit_unshuffle(raw: bytes, size: int) -> bytes:
    n = len(raw) // size & ~7
    planes = np.frombuffer(raw, np.uint8, n * size).reshape(size, 8, n // 8)
    bits = np.unpackbits(planes, axis=2, bitorder="little")  # byte, bit, element
    body = np.packbits(bits.transpose(2, 0, 1), axis=2, bitorder="little")
    return body.tobytes() + raw[n * size :]


def blosc_decode(frame: bytes) -> bytes:
    _, _, flags, size, total, block, _ = struct.unpack_from("<BBBBIII", frame)
    if flags & 2:
        return frame[16 : 16 + total]
    kind = flags >> 5

    def one(data: bytes, n: int) -> bytes:
        if len(data) == n:
            return data
        if kind == 0:
            return blosclz_decode(data, n)
        if kind == 1:
            return pa.Codec("lz4_raw").decompress(data, n).to_pybytes()
        if kind == 2:
            return pa.Codec("snappy").decompress(data, n).to_pybytes()
        if kind == 3:
            return zlib.decompress(data)
        if kind == 4:
            return pa.Codec("zstd").decompress(data, n).to_pybytes()
        raise ComputeError("blosc frames of this compressor can't be decoded")

    blocks = -(-total // block) if total else 0
    out = []
    for i, at in enumerate(struct.unpack_from(f"<{blocks}i", frame, 16)):
        n = min(block, total - i * block)
        parts = size if not flags & 16 and 1 < size <= 16 and block // size >= 128 and n == block else 1
        raw = b""
        for _ in range(parts):
            (c,) = struct.unpack_from("<i", frame, at)
            raw += one(frame[at + 4 : at + 4 + c], n // parts)
            at += 4 + c
        if flags & 1 and size > 1:
            raw = _unshuffle(raw, size)
        elif flags & 4:
            raw = _bit_unshuffle(raw, size)
        out.append(raw)
    return b"".join(out)


def blosc_encode(raw: bytes, size: int) -> bytes:
    """One unshuffled block of LZ4, or a plain copy where that isn't shorter."""
    packed = pa.Codec("lz4_raw").compress(raw).to_pybytes() if raw else b""
    if not raw or len(packed) >= len(raw):
        return struct.pack("<BBBBIII", 2, 1, 2 | 1 << 5, size, len(raw), len(raw), 16 + len(raw)) + raw
    return struct.pack("<BBBBIII", 2, 1, 16 | 1 << 5, size, len(raw), len(raw), 24 + len(packed)) + struct.pack("<ii", 20, len(packed)) + packed


def strings_encode(texts: list[str]) -> bytes:
    """The number of texts; then each after its length in bytes. All lengths are put in place at once."""
    sizes = pc.binary_length(pa.array(texts, pa.large_string())).to_numpy()
    body = np.frombuffer("".join(texts).encode(), np.uint8)
    heads = np.cumsum(sizes + 4) - sizes - 4
    out, is_size = np.empty(4 * len(texts) + len(body), np.uint8), np.zeros(4 * len(texts) + len(body), bool)
    is_size[(heads[:, None] + np.arange(4)).ravel()] = True
    out[is_size], out[~is_size] = sizes.astype("<u4").view(np.uint8), body
    return struct.pack("<I", len(texts)) + out.tobytes()


class Chain:
    """The codecs of one array, for chunks of one shape; dtype is a numpy type, or object for strings."""

    def __init__(self, codecs: list[dict], dtype: np.dtype, fill):
        self.dtype, self.fill = dtype, fill
        self.orders, self.outer, self.inner = [], [], None
        for c in codecs:
            name, conf = c["name"], c.get("configuration") or {}
            if name == "transpose":
                self.orders.append(conf["order"])
            elif name in ("bytes", "endian"):
                self.inner = ("bytes", "<" if conf.get("endian", "little") == "little" else ">")
            elif name in ("vlen-utf8", "vlen_utf8"):
                self.inner = ("strings",)
            elif name == "sharding_indexed":
                self.inner = ("shard", tuple(conf["chunk_shape"]), Chain(conf["codecs"], dtype, fill), Chain(conf.get("index_codecs", [{"name": "bytes"}, {"name": "crc32c"}]), np.dtype("u8"), 0), conf.get("index_location", "end"))
            elif name in ("gzip", "zstd", "blosc", "crc32c"):
                self.outer.append((name, conf))
            else:
                raise MetadataError(f"codec {name!r} is not supported")
        if self.inner is None:
            raise MetadataError("no codec turns the array into bytes")

    def fixed_size(self, n: int) -> int:
        """Encoded size of n elements, for chains without compression."""
        return n * self.dtype.itemsize + sum(4 for name, _ in self.outer if name == "crc32c")

    def decode(self, data: bytes, shape: tuple[int, ...]) -> np.ndarray:
        try:
            for name, _ in reversed(self.outer):
                if name == "gzip":
                    data = gzip.decompress(data)
                elif name == "zstd":
                    data = pa.input_stream(pa.py_buffer(data), compression="zstd").read()
                elif name == "blosc":
                    data = blosc_decode(data)
                else:
                    data, mark = data[:-4], struct.unpack("<I", data[-4:])[0]
                    if crc32c(data) != mark:
                        raise ComputeError("a checksum doesn't fit its data")
            stored = shape
            for order in self.orders:
                stored = tuple(stored[i] for i in order)
            out = self._array(data, stored)
            for order in reversed(self.orders):
                out = out.transpose(np.argsort(order))
            return out
        except (ValueError, struct.error, OSError, zlib.error, pa.ArrowException, IndexError) as e:
            raise ComputeError(f"a chunk can't be decoded: {e}") from e

    def _array(self, data: bytes, shape: tuple[int, ...]) -> np.ndarray:
        n = math.prod(shape)
        if self.inner[0] == "bytes":
            return np.frombuffer(data, self.dtype.newbyteorder(self.inner[1]), n).astype(self.dtype, copy=False).reshape(shape)
        if self.inner[0] == "strings":
            (count,), at, out = struct.unpack_from("<I", data), 4, np.empty(n, object)
            if count != n:
                raise ComputeError(f"{count} strings in a chunk of {n}")
            for i in range(n):
                (size,) = struct.unpack_from("<I", data, at)
                out[i] = data[at + 4 : at + 4 + size].decode()
                at += 4 + size
            return out.reshape(shape)
        _, inner, chain, index, where = self.inner
        grid = tuple(s // c for s, c in zip(shape, inner))
        size = index.fixed_size(2 * math.prod(grid))
        table = index.decode(data[:size] if where == "start" else data[-size:], (*grid, 2))
        out = np.empty(shape, self.dtype)
        for at in np.ndindex(*grid):
            offset, length = (int(x) for x in table[at])
            place = tuple(slice(i * c, i * c + c) for i, c in zip(at, inner))
            out[place] = self.fill if offset == _MISSING and length == _MISSING else chain.decode(data[offset : offset + length], inner)
        return out

    def encode(self, array: np.ndarray) -> bytes:
        for order in self.orders:
            array = array.transpose(order)
        if self.inner[0] == "bytes":
            data = np.ascontiguousarray(array).astype(self.dtype.newbyteorder(self.inner[1])).tobytes()
        elif self.inner[0] == "strings":
            data = strings_encode([str(x) for x in array.ravel()])
        else:
            _, inner, chain, index, where = self.inner
            grid = tuple(s // c for s, c in zip(array.shape, inner))
            table = np.full((*grid, 2), _MISSING, "u8")
            at = index.fixed_size(2 * math.prod(grid)) if where == "start" else 0
            parts = []
            for i in np.ndindex(*grid):
                part = array[tuple(slice(k * c, k * c + c) for k, c in zip(i, inner))]
                if not (part == self.fill).all():
                    parts.append(chain.encode(part))
                    table[i] = at, len(parts[-1])
                    at += len(parts[-1])
            data = b"".join([index.encode(table), *parts] if where == "start" else [*parts, index.encode(table)])
        for name, conf in self.outer:
            if name == "gzip":
                data = gzip.compress(data, conf.get("level", 5), mtime=0)
            elif name == "zstd":
                data = pa.Codec("zstd", compression_level=max(1, conf.get("level", 1))).compress(data).to_pybytes()
            elif name == "blosc":
                data = blosc_encode(data, max(1, self.dtype.itemsize if self.dtype != object else 1))
            else:
                data += struct.pack("<I", crc32c(data))
        return data
