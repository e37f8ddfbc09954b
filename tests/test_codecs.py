import struct

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.errors import ComputeError, MetadataError
from gridloom.sources.codecs import Chain, blosc_decode, crc32c

LITTLE = {"name": "bytes", "configuration": {"endian": "little"}}
CHAINS = {
    "plain": [LITTLE],
    "big": [{"name": "bytes", "configuration": {"endian": "big"}}],
    "gzip": [LITTLE, {"name": "gzip", "configuration": {"level": 5}}],
    "zstd": [LITTLE, {"name": "zstd", "configuration": {"level": 3, "checksum": False}}],
    "blosc": [LITTLE, {"name": "blosc", "configuration": {"cname": "lz4", "clevel": 5, "shuffle": "noshuffle"}}],
    "crc": [LITTLE, {"name": "crc32c"}],
    "transpose": [{"name": "transpose", "configuration": {"order": [1, 0]}}, LITTLE, {"name": "gzip"}],
    "shard": [{"name": "sharding_indexed", "configuration": {"chunk_shape": [2, 3], "codecs": [LITTLE, {"name": "gzip"}], "index_codecs": [LITTLE, {"name": "crc32c"}], "index_location": "end"}}],
    "shard_start": [{"name": "sharding_indexed", "configuration": {"chunk_shape": [1, 3], "codecs": [LITTLE], "index_codecs": [LITTLE, {"name": "crc32c"}], "index_location": "start"}}],
}


@pytest.mark.parametrize("name", CHAINS)
@pytest.mark.parametrize("kind", ["i1", "u2", "i4", "i8", "u8", "f4", "f8", "?"])
def test_round_trip(name, kind):
    values = (np.arange(24).reshape(4, 6) % 5).astype(kind)
    chain = Chain(CHAINS[name], np.dtype(kind), np.dtype(kind).type(0).item())
    assert (chain.decode(chain.encode(values), (4, 6)) == values).all()


@given(st.lists(st.text(max_size=20), min_size=1, max_size=12))
@settings(max_examples=30, deadline=None)
def test_strings(texts):
    values = np.array(texts, object)
    chain = Chain([{"name": "vlen-utf8"}, {"name": "zstd"}], np.dtype("O"), "")
    assert chain.decode(chain.encode(values), (len(texts),)).tolist() == texts


def test_known_checksum():
    assert crc32c(b"123456789") == 0xE3069283


def plain_crc32c(data):
    c = 0xFFFFFFFF
    for b in data:
        c ^= b
        for _ in range(8):
            c = c >> 1 ^ (0x82F63B78 if c & 1 else 0)
    return c ^ 0xFFFFFFFF


@pytest.mark.parametrize("n", [0, 1, 4095, 4096, 4097, 10_007])
def test_checksum_in_lanes(n):
    data = np.random.default_rng(n).integers(0, 256, n, np.uint8).tobytes()
    assert crc32c(data) == plain_crc32c(data)


def test_large_chunks_are_verified():
    chain = Chain([LITTLE, {"name": "crc32c"}], np.dtype("i4"), 0)
    data = bytearray(chain.encode(np.arange(1 << 19, dtype="i4")))
    assert len(data) > 1 << 20 and (chain.decode(bytes(data), (1 << 19,)) == np.arange(1 << 19)).all()
    data[1 << 20] ^= 4
    with pytest.raises(ComputeError):
        chain.decode(bytes(data), (1 << 19,))


def blosclz(data, far=False):
    """A frugal encoder of the format: the longest match at any distance, or literals."""
    out, at, literals = bytearray(), 0, bytearray()

    def flush():
        for i in range(0, len(literals), 32):
            piece = literals[i : i + 32]
            out.append(len(piece) - 1)
            out.extend(piece)
        literals.clear()

    while at < len(data):
        best, back = 0, 0
        for start in range(max(0, at - 70_000), at) if at else ():
            if data[start] != data[at]:
                continue
            n = 0
            while at + n < len(data) and n < 600 and data[start + n] == data[at + n]:
                n += 1
            if n > best:
                best, back = n, at - start
        if best < 5 or not out and not literals:
            literals.append(data[at])
            at += 1
            continue
        flush()
        length, distance = best - 3, back - 1
        far = distance >= 8191
        high = 31 if far else distance >> 8
        out.append((min(length + 1, 7) << 5) + high)
        if length >= 6:
            rest = length - 6
            while rest >= 255:
                out.append(255)
                rest -= 255
            out.append(rest)
        out += bytes([255]) + (distance - 8191).to_bytes(2, "big") if far else bytes([distance & 255])
        at += best
    flush()
    return bytes(out)


def test_blosclz():
    from gridloom.sources.codecs import blosclz_decode

    rnd = np.random.default_rng(1)
    noise = rnd.integers(0, 256, 9000, np.uint8).tobytes()
    for data in (b"abc", b"a" * 1000, b"abcabcabcabcabc" * 40 + b"xyz", bytes(range(100)) * 3, noise[:300] + b"z" * 900 + noise[:300], noise + noise[:700]):
        packed = blosclz(data)
        assert blosclz_decode(packed, len(data)) == data
    raw = (b"abcabcabcabcabc" * 40)[:600]
    body = blosclz(raw)
    frame = struct.pack("<BBBBIII", 2, 1, 16, 1, len(raw), len(raw), 24 + len(body)) + struct.pack("<ii", 20, len(body)) + body
    assert blosc_decode(frame) == raw
    with pytest.raises(ComputeError):
        blosclz_decode(body, len(raw) + 1)


def test_shuffled_blosc_blocks():
    """A hand-built frame: byte shuffle, split streams, two blocks of which the last is short."""
    values = np.arange(300, dtype="<i4")
    raw, block = values.tobytes(), 1024
    body, offsets = b"", []
    for at in range(0, len(raw), block):
        part = raw[at : at + block]
        planes = np.frombuffer(part, np.uint8).reshape(-1, 4).T.tobytes()
        offsets.append(16 + 4 * 2 + len(body))
        size = len(part) // 4
        streams = [planes[i * size : i * size + size] for i in range(4)] if len(part) == block else [planes]
        for s in streams:
            packed = pa.Codec("lz4_raw").compress(s).to_pybytes()
            packed = packed if len(packed) < len(s) else s
            body += struct.pack("<i", len(packed)) + packed
    frame = struct.pack("<BBBBIII", 2, 1, 1 | 1 << 5, 4, len(raw), block, 24 + len(body)) + struct.pack("<2i", *offsets) + body
    assert blosc_decode(frame) == raw


def test_damage_is_noticed():
    chain = Chain(CHAINS["crc"], np.dtype("i4"), 0)
    data = bytearray(chain.encode(np.arange(4, dtype="i4")))
    data[0] ^= 1
    with pytest.raises(ComputeError):
        chain.decode(bytes(data), (4,))
    with pytest.raises(ComputeError):
        Chain(CHAINS["gzip"], np.dtype("i4"), 0).decode(b"no gzip", (4,))


def test_unknown_codec():
    with pytest.raises(MetadataError):
        Chain([LITTLE, {"name": "pack_bits"}], np.dtype("i4"), 0)
