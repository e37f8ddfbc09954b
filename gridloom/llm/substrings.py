"""Exact substring dedup: removes every byte covered by a string of LENGTH bytes that starts anywhere else too.

The suffixes are sorted blockwise, as in difference-cover suffix sorting, to the depth that is asked (LENGTH):

0. Whole texts that repeat are found by their hashes: they go, and one of each stands in for all in what follows.
1. Cover samples.  Of every text the positions in a difference cover modulo V are taken (10 of 91): for any two
   positions some shift below V takes both into the cover.  Two equal strings of LENGTH bytes so hold two equal samples of LENGTH - V + 1
   bytes.  Samples are dealt into buckets by hash and each bucket is sorted by itself; a sample's class is repeated or not.
2. Suffix buckets.  Only suffixes with a repeated sample in reach can be repeated to the full depth (in prose without repeats,
   none); they are dealt into buckets by their LENGTH-byte key and each bucket is sorted by itself.  Equal neighbours are repeats.

Buckets hold some million keys each, whatever the input, and a text's equal keys are merged before they are dealt, so no string is
too frequent.  A key has two hashes of the bytes: one tells the bucket (a stretch of its range), 64 bits of the other are sent; what a comparison of ranks would decide for
ties is decided by both, and two different strings or texts would be taken as equal with a chance of one in 2^64 buckets a pair: the buckets grow with the
input, so that of 10^13 candidates some one pair may be.  (Samples have 40 bits and the bucket: a chance hit makes work, not an error.)

Buckets answer with a bit for each key, and a missing answer or one of another number of keys is an error.  Texts are read once, packed in
numbered batches and written to the scratch folder; every pass reads these, so a batch has the same rows in all of them, however
files are split or executors come and go.  Defined cases: null is the empty text; rows are separate
texts even if they share a doc_id; texts under LENGTH bytes lose nothing; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, blobs, by_part, docs_of, part_of, parts_for, schema, slice_bytes, slices, unblob
from .words import _BYTE, _MUL, U64, _power, flat, mix64, span_hashes

LENGTH = 200
# A perfect difference set modulo 91.
V, COVER = 91, (0, 1, 3, 9, 27, 49, 56, 61, 77, 81)
SLICE = 4 << 20
LEVEL = 6  # of zstd: packed texts are written once and shuffled twice
_CHUNK = 1 << 20
_DEALT = schema(batch="long", stage="int", part="int", keys="binary", many="binary")
_ANSWER = schema(batch="long", stage="int", part="int", n="long", bits="binary", first="binary")
WIDTH = {0: 8, 1: 5, 2: 8}  # bytes sent of the keys of texts, samples and suffixes
_PACKED = schema(batch="long", ids="binary", offsets="binary", data="binary")


_OTHER = mix64(_BYTE + _MUL[60])


def window_hashes(data: np.ndarray, start: np.ndarray, length: int, table: np.ndarray = _BYTE) -> np.ndarray:
    """64-bit hashes of the strings of this length at ascending positions, a bounded stretch of the bytes at a time."""
    out, i = np.empty(len(start), U64), 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(start, start[i] + _CHUNK, "right")))
        a, b = int(start[i]), int(start[j - 1]) + length
        up, down = _power(b - a + 1)
        sums = np.zeros(b - a + 1, U64)
        np.cumsum(table[data[a:b]] * up[: b - a], out=sums[1:])
        s = start[i:j] - a
        out[i:j] = mix64((sums[s + length] - sums[s]) * down[s])
        i = j
    return out


def _runs(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each run: its number and 0, 1, 2 ... below its count, one after the other."""
    run = np.repeat(np.arange(len(count)), count)
    return run, np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)


def samples(offs: np.ndarray, length: int) -> np.ndarray:
    """Cover positions of every text that have a sample's length of bytes from there on."""
    need, sizes = length - V + 1, np.diff(offs)
    most = int(sizes.max(initial=0))
    cover = (np.arange(0, most + V, V)[:, None] + np.array(COVER)).ravel()
    run, k = _runs(offs[:-1], np.searchsorted(cover, sizes - need, "right"))
    return offs[:-1][run] + cover[k]


def in_reach(offs: np.ndarray, at: np.ndarray, repeated: np.ndarray, length: int) -> np.ndarray:
    """Starts of strings of full length, within one text, that hold the start of a repeated sample among their first V bytes."""
    total = int(offs[-1])
    s = at[repeated]
    if not len(s):
        return s
    row = np.searchsorted(offs, s, "right") - 1
    low, high = np.maximum(s - V + 1, offs[row]), np.minimum(s, offs[row + 1] - length) + 1
    ok = high > low
    steps = np.bincount(low[ok], minlength=total + 1) - np.bincount(high[ok], minlength=total + 1)
    return np.flatnonzero(np.cumsum(steps[:total]) > 0)


def _parted(keys: np.ndarray, parts: int, sent: np.ndarray | None = None):
    """The order of the keys, each key's place among the distinct ones, and of these: the first in that order, the parts (ascending) and their edges."""
    order = np.argsort(keys)
    k = keys[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    if sent is not None:
        new[1:] |= sent[order[1:]] != sent[order[:-1]]
    place = np.empty(len(k), np.int64)
    place[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    part = part_of(k[first], parts)
    own = np.unique(part)
    return order, place, first, own, np.append(np.searchsorted(part, own), len(part))


def _deal(batch: int, stage: int, keys: np.ndarray, parts: int, sent: np.ndarray | None = None, more: np.ndarray | None = None) -> pa.RecordBatch:
    """keys tell the bucket, and are sent where sent isn't given; more: keys known to be repeated elsewhere."""
    order, _, first, own, edges = _parted(keys, parts, sent)
    many = np.diff(np.append(first, len(keys))) > 1
    if more is not None and len(keys):
        many |= np.logical_or.reduceat(more[order], first)
    raw = (keys if sent is None else sent)[order[first]].view(np.uint8).reshape(-1, 8)[:, : WIDTH[stage]]
    n = len(own)
    bits = pa.array([np.packbits(many[a:b]).tobytes() for a, b in zip(edges, edges[1:])], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([batch] * n, pa.int64()), pa.array([stage] * n, pa.int32()), pa.array(own.astype(np.int32)), blobs(raw, edges), bits], names=_DEALT.names)


def _numbered(batches, most: int):
    task, i = TaskContext.get().partitionId(), 0
    for whole in batches:
        for b in slices(whole, "text", most):
            yield (task << 32) | i, b
            i += 1


def _texts(data: np.ndarray, offs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows whose texts have the full length at least, and two 64-bit hashes of these texts."""
    rows = np.flatnonzero(np.diff(offs) >= length)
    return rows, *(span_hashes(data, offs[:-1][rows], offs[1:][rows], lower=False, salt=k) for k in (0, 2))


def _sampled(parts: int, length: int):
    def run(batches):
        for whole in batches:
            for i in range(whole.num_rows):
                packed = whole.slice(i, 1)
                data, offs = _opened(packed)
                keys = window_hashes(data, samples(offs, length), length - V + 1)
                if len(keys):
                    batch, texts = packed["batch"][0].as_py(), _texts(data, offs, length)
                    yield _deal(batch, 0, texts[1], parts, texts[2])
                    yield _deal(batch, 1, keys, parts)

    return run


def _pack(parts: int):
    def run(batches):
        for batch, b in _numbered(batches, slice_bytes(parts, SLICE)):
            data, offs = flat(b.column("text"))
            ids = b.column("doc_id")
            own = np.stack([ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False).astype(np.int64)], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array([batch]), pa.array([own.tobytes()], pa.binary()), pa.array([offs.tobytes()], pa.binary()), pa.array([pa.Codec("zstd", compression_level=LEVEL).compress(data.tobytes()).to_pybytes() if len(data) else b""], pa.binary())], names=_PACKED.names)

    return run


def _sorted_bucket(batches):
    """One bucket: which of its keys occur more than once (bits), and which rows hold a key for the first time (first)."""
    whole = pa.Table.from_batches(batches)
    stages = whole["stage"].to_numpy()
    for stage in np.unique(stages):
        t = whole.filter(pa.array(stages == stage))
        raw, edges = unblob(t["keys"], np.uint8)
        wide = np.zeros((len(raw) // WIDTH[stage], 8), np.uint8)
        wide[:, : WIDTH[stage]] = raw.reshape(-1, WIDTH[stage])
        keys, edges = wide.view("<u8").ravel(), edges // WIDTH[stage]
        again = np.concatenate([np.unpackbits(np.frombuffer(m.as_buffer(), np.uint8), count=n) for m, n in zip(t["many"], np.diff(edges))]).astype(bool)
        order = np.argsort(keys)
        k = keys[order]
        same = k[1:] == k[:-1]
        twice = np.zeros(len(k), bool)
        twice[1:] |= same
        twice[:-1] |= same
        again[order[twice]] = True
        # A repeated text is dealt on by one batch alone, any of those that hold it.
        leads = np.zeros(len(k), bool)
        leads[order[np.concatenate([[True], ~same])]] = True
        bits, first = (pa.array([np.packbits(x[a:b]).tobytes() for a, b in zip(edges, edges[1:])], pa.binary()) for x in (again, leads))
        yield from pa.table([t["batch"], t["stage"], t["part"], pa.array(np.diff(edges)), bits, first if stage == 0 else pa.nulls(len(t), pa.binary())], names=_ANSWER.names).to_batches()


def _answered(keys: np.ndarray, parts: int, answers: pa.Table, stage: int, sent: np.ndarray | None = None, column: str = "bits") -> np.ndarray:
    """For each key, in its own order, the bit of its answer; every part with keys must have answered once, for as many keys."""
    _, place, distinct, own, edges = _parted(keys, parts, sent)
    out, at, told = np.zeros(len(distinct), bool), dict(zip(own.tolist(), range(len(own)))), 0
    for s, p, n, bits in zip(answers["stage"].to_pylist(), answers["part"].to_pylist(), answers["n"].to_pylist(), answers[column]):
        if s == stage:
            i = at.pop(p, None)
            if i is None or n != edges[i + 1] - edges[i]:
                raise ValueError(f"an answer of stage {stage} is for {n} keys of part {p}, others were asked: the batch has changed")
            out[edges[i] : edges[i + 1]] = np.unpackbits(np.frombuffer(bits.as_buffer(), np.uint8), count=n).astype(bool)
            told += n
    if told != len(distinct):
        raise ValueError(f"answers of stage {stage} are for {told} keys, {len(distinct)} were asked: the batch has changed")
    return out[place]


def _opened(packed: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    offs = np.frombuffer(packed["offsets"][0].as_buffer(), np.int64)
    raw = pa.Codec("zstd").decompress(packed["data"][0].as_buffer(), int(offs[-1])) if offs[-1] else b""
    return np.frombuffer(raw, np.uint8), offs


def _candidates(packed: pa.Table, answers: pa.Table, parts: int, length: int):
    """Bytes and offsets; which rows repeat as a whole; the suffixes to sort, and their keys.

    A text that repeats as a whole is known to go; of its copies one alone deals its suffixes, for others that hold parts of it.
    """
    data, offs = _opened(packed)
    rows, texts, other = _texts(data, offs, length)
    whole, leaves = np.zeros(len(offs) - 1, bool), np.zeros(len(offs) - 1, bool)
    if len(rows):
        whole[rows] = _answered(texts, parts, answers, 0, other)
        here = np.zeros(len(rows), bool)
        here[np.unique(np.stack([texts, other]), axis=1, return_index=True)[1]] = True
        leaves[rows] = whole[rows] & ~(here & _answered(texts, parts, answers, 0, other, "first"))
    at = samples(offs, length)
    if not len(at):
        return data, offs, whole, at, np.zeros(0, U64), np.zeros(0, U64)
    repeated = _answered(window_hashes(data, at, length - V + 1), parts, answers, 1)
    repeated &= ~leaves[np.searchsorted(offs, at, "right") - 1]
    start = in_reach(offs, at, repeated, length)
    return data, offs, whole, start, window_hashes(data, start, length), window_hashes(data, start, length, _OTHER)


def _suffixes(parts: int, length: int):
    def run(packed: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(packed) or not len(answers):
            return pa.Table.from_batches([_deal(0, 2, np.zeros(0, U64), parts)])
        _, offs, whole, start, keys, sent = _candidates(packed, answers, parts, length)
        return pa.Table.from_batches([_deal(packed["batch"][0].as_py(), 2, keys, parts, sent, whole[np.searchsorted(offs, start, "right") - 1])])

    return run


_OUT = {"n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept_sha256": "string", "kept": "binary"}


def _removed(parts: int, length: int, want: list[str]):
    def run(packed: pa.Table, answers: pa.Table) -> pa.Table:
        data, offs, whole, start, keys, sent = _candidates(packed, answers, parts, length)
        start = start[_answered(keys, parts, answers, 2, sent)] if len(start) else start
        n = len(data)
        steps = np.bincount(start, minlength=n + 1) - np.bincount(start + length, minlength=n + 1)
        gone = np.cumsum(steps[:n]) > 0
        gone |= np.repeat(whole, np.diff(offs))
        total = np.concatenate([[0], np.cumsum(gone)])
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        firsts = offs[:-1][offs[:-1] < n]
        begins[firsts] = gone[firsts]  # no run goes on into the next text
        runs = np.concatenate([[0], np.cumsum(begins)])
        ids = np.frombuffer(packed["ids"][0].as_buffer(), np.int64).reshape(-1, 2)
        kept = [data[a:b][~gone[a:b]].tobytes() if total[b] > total[a] else data[a:b].tobytes() for a, b in zip(offs, offs[1:])]
        out = {"n_bytes": pa.array(np.diff(offs)), "n_removed": pa.array(total[offs[1:]] - total[offs[:-1]]), "n_spans": pa.array(runs[offs[1:]] - runs[offs[:-1]])}
        if "kept_sha256" in want:
            out["kept_sha256"] = pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())
        if "kept" in want:
            out["kept"] = pa.array(kept, pa.binary())
        return pa.table([pa.array(ids[:, 0], mask=ids[:, 1] == 0), *(out[c] for c in want)], names=["doc_id", *want])

    return run


def dedup_substrings(docs: DataFrame, columns: tuple[str, ...] = ("n_bytes", "n_removed", "n_spans", "kept"), length: int = LENGTH, stable: bool = True) -> DataFrame:
    """doc_id and the wanted of n_bytes, n_removed, n_spans, kept (binary) and kept_sha256 for every row; stable is without effect, as texts are read once."""
    if length < V + 8:
        raise ValueError(f"strings must have {V + 8} bytes at least")
    scratch = Scratch(docs.sparkSession, "substrings")
    docs = docs_of(docs, "doc_id", "text")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = parts_for(total * len(COVER) // V)

    def bucketed(dealt: DataFrame) -> DataFrame:
        # Answers are small: dealt by batch, in which they are read, they make a few files instead of one for each part.
        return scratch.keep(by_part(dealt, parts, _sorted_bucket, _ANSWER).repartition("batch"), small=True)

    packed = scratch.keep(docs.mapInArrow(_pack(parts), _PACKED))
    first = bucketed(packed.mapInArrow(_sampled(parts, length), _DEALT))
    second = bucketed(packed.groupBy("batch").cogroup(first.groupBy("batch")).applyInArrow(_suffixes(parts, length), _DEALT))
    answers = first.union(second)
    out = schema(doc_id="long", **{c: _OUT[c] for c in columns})
    return packed.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(_removed(parts, length, list(columns)), out)
