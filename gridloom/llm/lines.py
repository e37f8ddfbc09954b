"""Line dedup by a segment-partition edit join.

Lines are the runs between line feeds.  Lines of at least LEAST bytes take part; two are near when their UTF-8
bytes differ by at most EDITS edits, and classes are the connected components of that.  A class keeps its first line (by doc_id, then
line number); its others go, in whatever document.  With short=True shorter lines that aren't blank take part too, as
classes of equal lines: they are in no index, their hashes are grouped.

A line of length l is cut into EDITS + 1 even segments.  If two lines are near, one segment of the shorter occurs in the
longer one, at a place that the length difference allows (multi-match-aware windows); so each line is indexed
under its segments (with length and ordinal) and probes those of lines up to EDITS shorter.  Entries travel as packed
blobs, dealt by hash.  Lines that meet are compared by byte histograms and then, exactly, by a banded bit-parallel
edit distance.

A key that more than HOT different lines meet under (a template's segment) first pairs each line with one pivot.  After merging,
its lines get finer keys: EDITS edits move at most 2 EDITS of the histogram's counts, so of 2 EDITS + 2 groups of counts two are
equal in near lines, and each pair of groups makes a key.  Under such a key lines outside its largest class meet all others, in
blocks of bounded size.

Occurrences are merged before they are dealt: a batch of texts sends one row for each different line, with the places that
it has it in, so a common line has a row for each batch and no more.  Equal lines are told by 128 bits.

Defined cases: a null or empty text has no lines; rows of one doc_id count as one document, in which a line at
the same place is not a repeat; a null doc_id comes last; shorter lines that are blank (ASCII white space alone) always stay, other shorter ones
unless short=True; extra columns are ignored or kept.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, blobs, by_part, components, give_back, part_of, parts_for, ramp, schema, slice_bytes, slices, unblob
from .words import _BYTE, _IS_WORD, _MUL, U64, _power, flat, mix64, span_hashes

EDITS = 2
LEAST = 24
HOT = 64
BLOCK = 4096
_INDEX = schema(part="int", lines="binary", sigs="binary", keys="binary", at="binary", role="binary")
_FOUND = schema(key="long", u="long", v="long", sig="long")
_LINES = schema(h="long", g="long", k="long", line="int", last_k="long", last="int", at="binary")
_FINER = schema(key="long", h="long", sig="long", root="long")
_PAIR = schema(u="long", v="long")
_PLACE = np.dtype([("k", "<i8"), ("t", "<i8"), ("line", "<i4")])


def line_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, row and number of every line of every non-empty text."""
    feeds = np.flatnonzero(data == 10)
    row_of_feed = np.searchsorted(offs, feeds, "right") - 1
    full = np.flatnonzero(np.diff(offs) > 0)
    start = np.concatenate([offs[:-1][full], feeds + 1])
    row = np.concatenate([full, row_of_feed])
    order = np.lexsort((start, row))
    start, row = start[order], row[order]
    end = np.concatenate([start[1:] - 1, [0]])
    last = np.ones(len(row), bool)
    last[:-1] = row[1:] != row[:-1]
    end[last] = offs[1:][row[last]]
    first = np.searchsorted(row, row)
    return start, end, row, np.arange(len(row)) - first


def _long_lines(data: np.ndarray, offs: np.ndarray, least: int, short: bool = False):
    """Lines of at least so many bytes; with short also the shorter ones that aren't blank."""
    start, end, row, number = line_spans(data, offs)
    keep = end - start >= least
    if short:
        inked = np.concatenate([[0], np.cumsum(_IS_WORD[data])])
        keep |= inked[end] > inked[start]
    start, end, row, number = start[keep], end[keep], row[keep], number[keep]
    return start, end, row, number, span_hashes(data, start, end, lower=False)


def _other_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A second 64-bit hash of each line, by another table of bytes."""
    return span_hashes(data, start, end, lower=False, salt=1)


def _occurrences(least: int, short: bool):
    """Each different line of a batch: its hashes, first and last place (k, line), and all of them (at)."""
    def run(batches):
        for whole in batches:
            for b in slices(whole, "text"):
                data, offs = flat(b.column("text"))
                start, end, row, number, h = _long_lines(data, offs, least, short)
                if not len(h):
                    continue
                g = _other_hashes(data, start, end)
                place = np.zeros(len(h), _PLACE)
                for c in "kt":
                    place[c] = b.column(c).to_numpy()[row]
                place["line"] = number
                order = np.lexsort((number, place["k"], g, h))
                h, g, place = h[order], g[order], place[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(h)) - 1
                columns = [h[first].view(np.int64), g[first].view(np.int64), place["k"][first], place["line"][first], place["k"][last], place["line"][last]]
                yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(x)) for x in columns), blobs(place.view(np.uint8), np.append(first, len(h)) * _PLACE.itemsize)], names=_LINES.names)

    return run


def _all_but_first(batches):
    """The places of each row but the first one of its class."""
    for b in batches:
        place, edges = unblob(b.column("at"), _PLACE)
        k, line = (np.repeat(b.column(c).to_numpy(), np.diff(edges)) for c in ("first_k", "first_line"))
        gone = place[(place["k"] != k) | (place["line"] != line)]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(gone[c])) for c in ("k", "t", "line")], names=["k", "t", "line"])


def segments(length: np.ndarray, edits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Start and length of the edits + 1 even segments of lines of these lengths (the last ones longer by one)."""
    n, out, at = edits + 1, [], np.zeros(len(length), np.int64)
    for i in range(n):
        size = length // n + (i >= n - length % n)
        out.append((at, size))
        at = at + size
    return out


def _entries(length: np.ndarray, edits: int):
    """(lines, role, length of the indexed line, ordinal, start, size) of index (role 0) and probe (role 1) substrings."""
    every = np.arange(len(length))
    for i, (at, size) in enumerate(segments(length, edits)):
        yield every, 0, length, i, at, size
    for d in range(edits + 1):
        of = length - d
        for i, (at, size) in enumerate(segments(of, edits)):
            left, right = i, edits - i
            for shift in range(max(-left, d - right), min(left, d + right) + 1):
                s = at + shift
                ok = (s >= 0) & (s + size <= length)
                yield every[ok], 1, of[ok], i, s[ok], size[ok]


def _signature(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sixteen counts of bytes by low bits, each modulo 16."""
    size = end - start
    first = np.cumsum(size) - size
    at = np.repeat(start - first, size) + np.arange(size.sum())
    counts = np.bincount(np.repeat(np.arange(0, 16 * len(start), 16), size) + (data[at] & 15), minlength=16 * len(start)).reshape(-1, 16)
    return ((counts & 15).astype(U64) << (U64(4) * np.arange(16, dtype=U64))).sum(1, dtype=U64)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distance of two signatures: at most two for each edit."""
    out = np.zeros(len(a), np.int64)
    for c in range(16):
        d = ((a >> U64(4 * c)) - (b >> U64(4 * c))) & U64(15)
        out += np.minimum(d, U64(16) - d).astype(np.int64)
    return out


def _index(parts: int, edits: int, least: int):
    def run(batches):
        for whole in batches:
            for b in slices(whole, "text", slice_bytes(parts, 1 << 20)):
                data, offs = flat(b.column("text"))
                start, end, _, _, h = _long_lines(data, offs, least)
                _, one = np.unique(h, return_index=True)
                one.sort()
                start, end, h = start[one], end[one], h[one]
                if not len(h):
                    continue
                sig = _signature(data, start, end)
                up, down = _power(len(data) + 1)
                sums = np.zeros(len(data) + 1, U64)
                np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
                keys, at, role = [], [], []
                for lines, r, of, i, s, size in _entries(end - start, edits):
                    a = start[lines] + s
                    keys.append(mix64((sums[a + size] - sums[a]) * down[a] + of.astype(U64) * _MUL[40] + _MUL[i]))
                    at.append(lines)
                    role.append(np.full(len(lines), r, np.uint8))
                keys, at, role = np.concatenate(keys), np.concatenate(at), np.concatenate(role)
                part = part_of(keys, parts)
                order = np.lexsort((at, part))
                part, keys, at, role = part[order], keys[order], at[order], role[order]
                edges = np.searchsorted(part, np.arange(parts + 1))
                own = np.flatnonzero(np.diff(edges))
                edges = np.append(edges[own], edges[-1])
                new = np.ones(len(at), bool)
                new[1:] = (at[1:] != at[:-1]) | (part[1:] != part[:-1])
                first = np.flatnonzero(new)
                of_line = np.searchsorted(first, edges)
                local = np.cumsum(new) - 1 - np.repeat(of_line[:-1], np.diff(edges))
                lines = at[first]
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), blobs(h[lines], of_line), blobs(sig[lines], of_line), blobs(keys, edges), blobs(local.astype("<u4"), edges), blobs(role, edges)], names=_INDEX.names)
        give_back()

    return run


def _meet(edits: int, hot: int):
    """Within one part: pairs of different lines under one key; of a hot key its lines, each with v null."""
    def run(batches):
        t = pa.Table.from_batches(batches)
        h, base = unblob(t["lines"], "<u8")
        sig, role = unblob(t["sigs"], "<u8")[0], unblob(t["role"], "u1")[0]
        keys, edges = unblob(t["keys"], "<u8")
        at = unblob(t["at"], "<u4")[0].astype(np.int64) + np.repeat(base[:-1], np.diff(edges))
        # Equal lines of several batches are one.
        h, first, same = np.unique(h, return_index=True, return_inverse=True)
        sig, at = sig[first], same.ravel()[at]
        order = np.lexsort((role, at, keys))
        keys, at, role = keys[order], at[order], role[order]
        keep = np.ones(len(keys), bool)
        keep[1:] = (keys[1:] != keys[:-1]) | (at[1:] != at[:-1])  # a line's index entry stands for its probes under the same key
        keys, at, role = keys[keep], at[keep], role[keep]
        start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        size = np.diff(np.append(start, len(keys)))
        indexed = np.concatenate([[0], np.cumsum(role == 0)])
        n_index = indexed[start + size] - indexed[start]
        some = (size > 1) & (n_index > 0)
        pairs = []
        for m in np.unique(size[some & (size <= hot)]):
            i, j = np.triu_indices(int(m), 1)
            starts = start[some & (size == m)]
            step = max(1, (1 << 20) // len(i))
            for c in range(0, len(starts), step):
                s = starts[c : c + step, None]
                x, y = (s + i).ravel(), (s + j).ravel()
                ok = (role[x] == 0) | (role[y] == 0)
                a, b = at[x[ok]], at[y[ok]]
                ok = _apart(sig[a], sig[b]) <= 2 * edits
                pairs.append(np.unique(np.minimum(a[ok], b[ok]) * len(h) + np.maximum(a[ok], b[ok])))
        pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        signed = h.view(np.int64)
        if len(pairs):
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(pairs), np.int64)), pa.array(signed[pairs // len(h)]), pa.array(signed[pairs % len(h)]), pa.array(np.zeros(len(pairs), np.int64))], names=_FOUND.names)
        warm = some & (size > hot)
        if warm.any():
            run, x = ramp(start[warm], size[warm])
            yield pa.RecordBatch.from_arrays([pa.array(keys[start[warm]].view(np.int64)[run]), pa.array(signed[at[x]]), pa.nulls(len(x), pa.int64()), pa.array(sig[at[x]].view(np.int64))], names=_FOUND.names)

    return run


def _alike(edits: int):
    """Pairs (u, v) whose signatures su, sv allow so few edits."""
    def run(batches):
        for b in batches:
            su, sv = (b.column(c).to_numpy().view(U64) for c in ("su", "sv"))
            yield b.select(["u", "v"]).filter(pa.array(_apart(su, sv) <= 2 * edits))

    return run


def finer_keys(sig: np.ndarray, edits: int):
    """Keys by pairs of groups of a signature's counts: of 2 * edits + 2 groups two are equal in lines within so many edits."""
    groups = [sum(15 << 4 * int(c) for c in g) for g in np.array_split(np.arange(16), 2 * edits + 2) if len(g)]
    if len(groups) < 2 * edits + 2:
        yield np.zeros(len(sig), U64)  # too many edits for sixteen counts
        return
    for i in range(len(groups)):
        for j in range(i):
            yield mix64(sig & U64(groups[i] | groups[j])) + U64(i * 16 + j)


def _finer(edits: int):
    def run(batches):
        for b in batches:
            key, sig = (b.column(c).to_numpy().view(U64) for c in ("key", "sig"))
            for k in finer_keys(sig, edits):
                yield pa.RecordBatch.from_arrays([pa.array(mix64(key ^ k).view(np.int64)), b.column("h"), b.column("sig"), b.column("root")], names=_FINER.names)

    return run


def _across(edits: int):
    """Pairs of different classes within a pair of blocks of a hot key: those outside its largest class, and all."""
    def run(t: pa.Table) -> pa.Table:
        h, g, c, stray = t["h"].to_numpy(), t["sig"].to_numpy().view(U64), t["root"].to_numpy(), t["stray"].to_numpy(zero_copy_only=False)
        left, right = np.flatnonzero(stray), np.flatnonzero(~stray)
        out = [np.zeros((2, 0), np.int64)]
        for i in range(0, len(left), 256):
            x, y = np.repeat(left[i : i + 256], len(right)), np.tile(right, len(left[i : i + 256]))
            ok = c[x] != c[y]
            x, y = x[ok], y[ok]
            ok = _apart(g[x], g[y]) <= 2 * edits
            out.append(np.unique(np.sort(np.stack([h[x[ok]], h[y[ok]]]), axis=0), axis=1))
        u, v = np.concatenate(out, axis=1)
        return pa.table([pa.array(u), pa.array(v)], names=["u", "v"])

    return run


def edit_within(a: list[bytes], b: list[bytes], edits: int) -> np.ndarray:
    """Whether each pair of byte strings is within so many edits; many pairs at a time.

    A column of the banded matrix is a few bits for each pair: bit k of column j stands for row j - edits + k; VP and VN
    hold where a cell exceeds or falls short of the one above.
    """
    out = np.array([x == y for x, y in zip(a, b)], bool)
    swap = [(y, x) if len(x) > len(y) else (x, y) for x, y in zip(a, b)]
    todo = sorted((i for i in range(len(a)) if not out[i] and len(swap[i][1]) - len(swap[i][0]) <= edits), key=lambda i: -len(swap[i][1]))
    w, at = 2 * edits + 1, 0
    full, bottom = U64((1 << w) - 1), U64(2 * edits)
    while at < len(todo):
        most = len(swap[todo[at]][1])
        own = todo[at : at + max(1, min(4096, (4 << 20) // (most + 1)))]
        at += len(own)
        m, n = (np.array([len(swap[i][k]) for i in own]) for k in (0, 1))
        rows = np.full((most + 2 * edits + 1, len(own)), 256, np.uint16)
        cols = np.full((most, len(own)), 257, np.uint16)
        for c, i in enumerate(own):
            rows[edits : edits + m[c], c] = np.frombuffer(swap[i][0], np.uint8)
            cols[: n[c], c] = np.frombuffer(swap[i][1], np.uint8)
        vp = np.full(len(own), ((1 << edits) - 1) << (edits + 1), U64)
        vn = np.full(len(own), (1 << (edits + 1)) - 1, U64)
        value = np.full(len(own), edits, np.int64)
        live = len(own)
        for j in range(most):
            while live and n[live - 1] <= j:
                live -= 1
            eq = np.zeros(live, U64)
            for k in range(w):
                eq |= (rows[j + k, :live] == cols[j, :live]).astype(U64) << U64(k)
            p, q = (vp[:live] >> U64(1)) | (U64(1) << bottom), vn[:live] >> U64(1)
            d0 = ((((eq & p) + p) ^ p) | eq | q) & full
            hp, hn = q | (~(d0 | p) & full), d0 & p
            hp, hn = ((hp << U64(1)) | U64(1)) & full, (hn << U64(1)) & full
            vp[:live] = hn | (~(d0 | hp) & full)
            vn[:live] = d0 & hp
            value[:live] += 1 - ((d0 >> bottom) & U64(1)).astype(np.int64)
            if j % 64 == 63 and (value > 3 * edits).all():
                break
        above = full & ~((U64(1) << (m - n + edits + 1).astype(U64)) - U64(1))
        out[own] = value - np.bitwise_count(vp & above).astype(np.int64) + np.bitwise_count(vn & above) <= edits
    return out


def _verify(edits: int):
    """Near pairs, with the second hashes of their lines."""
    def run(batches):
        for b in batches:
            tu, tv = b.column("tu"), b.column("tv")
            ok = pa.array(edit_within(tu.to_pylist(), tv.to_pylist(), edits))
            second = []
            for x in (tu, tv):
                data, offs = flat(x.filter(ok))
                second.append(pa.array(_other_hashes(data, offs[:-1], offs[1:]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([*b.select(["u", "v"]).filter(ok).columns, *second], names=["u", "v", "gu", "gv"])

    return run


_VERIFIED = schema(u="long", v="long", gu="long", gv="long")
MOST_BITS = 1 << 28  # of the bitmap that is broadcast (32 MiB)
_STRETCH = 1 << 20


def _texts(needed, least: int):
    """The lines whose hash is in the bitmap (where that is dense, more lines come than are needed)."""
    def run(batches):
        raw = np.frombuffer(needed.value, np.uint8)
        n = U64(8 * len(raw))
        for whole in batches:
            for b in slices(whole, "text"):
                data, offs = flat(b.column("text"))
                start, end, _, _, h = _long_lines(data, offs, least)
                place = (mix64(h) % n).astype(np.int64)
                hit = np.flatnonzero(raw[place >> 3] >> (place & 7).astype(np.uint8) & 1)
                _, one = np.unique(h[hit], return_index=True)
                hit = hit[one]
                text = data.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(h[hit].view(np.int64)), pa.array([text[s:e] for s, e in zip(start[hit], end[hit])], pa.binary())], names=["h", "line"])

    return run


def _marks(bits: int):
    """Places of the hashes in the bitmap, by stretches of it."""
    def run(batches):
        for b in batches:
            at = np.unique((mix64(b.column("h").to_numpy().view(U64)) % U64(bits)).astype(np.int64))
            own, first = np.unique(at // _STRETCH, return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), blobs((at % _STRETCH).astype("<u4"), np.append(first, len(at)))], names=["part", "at"])

    return run


def _stretch(t: pa.Table) -> pa.Table:
    bits = np.zeros(_STRETCH, np.uint8)
    bits[unblob(t["at"], "<u4")[0]] = 1
    return pa.table([t["part"][:1], pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], names=["part", "at"])


class LineDedup:
    def __init__(self, docs: DataFrame, edits: int = EDITS, least: int = LEAST, short: bool = False, hot: int = HOT, block: int = BLOCK):
        if least <= edits:
            raise ValueError("lines must be longer than the edits allowed")
        self.spark, self.edits, self.least, self.short, self.hot, self.block = docs.sparkSession, edits, least, short, hot, block
        self.scratch = Scratch(self.spark, "lines")
        self.docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("k"), F.col("text").cast("string").alias("text"))
        self.texts = self.docs.select("text")

    def _verified(self, pairs: DataFrame) -> DataFrame:
        pairs = self.scratch.keep(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
        ends = pairs.select(F.col("u").alias("h")).union(pairs.select(F.col("v").alias("h")))
        # Some sixteen bits an end, up to a bitmap of fixed size.
        bits = min(MOST_BITS, max(_STRETCH, 1 << (32 * pairs.count()).bit_length()))
        kind = schema(part="int", at="binary")
        raw = np.zeros(bits // 8, np.uint8)
        for r in ends.mapInArrow(_marks(bits), kind).groupBy("part").applyInArrow(_stretch, kind).toArrow().to_pylist():
            raw[r["part"] * _STRETCH // 8 :][: _STRETCH // 8] = np.frombuffer(r["at"], np.uint8)
        needed = self.spark.sparkContext.broadcast(raw.tobytes())
        lines = self.scratch.keep(self.texts.mapInArrow(_texts(needed, self.least), schema(h="long", line="binary")).groupBy("h").agg(F.min("line").alias("line")))
        for c in "uv":
            pairs = pairs.join(lines.select(F.col("h").alias(c), F.col("line").alias("t" + c)), c)
        return self.scratch.keep(pairs.mapInArrow(_verify(self.edits), _VERIFIED))

    def links(self) -> DataFrame:
        """Near pairs (u, v) of line hashes, with second hashes (gu, gv): enough to connect every class."""
        lines = "least(octet_length(text) div {} + 1, 1 + octet_length(text) - octet_length(replace(text, '\n', '')))".format(self.least + 1)
        total = self.texts.agg(F.sum(F.expr(lines))).first()[0] or 0
        parts = parts_for(total * 5 * (self.edits + 1))
        found = self.scratch.keep(by_part(self.texts.mapInArrow(_index(parts, self.edits, self.least), _INDEX), parts, _meet(self.edits, self.hot), _FOUND))
        pairs = found.where("v is not null").select("u", "v")
        hot = found.where("v is null").select("key", F.col("u").alias("h"), "sig")
        pivots = hot.groupBy("key").agg(F.min(F.struct("h", "sig")).alias("p"))
        if pivots.isEmpty():
            return self._verified(pairs)
        stars = hot.join(pivots, "key").where("h <> p.h").select(F.col("p.h").alias("u"), F.col("h").alias("v"), F.col("p.sig").alias("su"), F.col("sig").alias("sv"))
        first = self._verified(pairs.union(stars.mapInArrow(_alike(self.edits), _PAIR)))
        roots = components(self.spark, first.select("u", "v"), self.scratch)
        left = hot.join(roots.withColumnRenamed("node", "h"), "h", "left").withColumn("root", F.coalesce("root", "h"))
        several = left.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("key")
        finer = self.scratch.keep(left.join(several, "key").select("key", "h", "sig", "root").mapInArrow(_finer(self.edits), _FINER))
        sizes = finer.groupBy("key", "root").agg(F.count("*").alias("c"))
        top = sizes.groupBy("key").agg(F.max(F.struct("c", "root")).alias("top"), F.sum("c").alias("m"))
        top = top.selectExpr("key", "top.root as main", "m - top.c as strays", "m").where("strays > 0")
        top = top.selectExpr("key", "main", f"cast(ceil(strays / {self.block}) as int) as groups", f"cast(ceil(m / {self.block}) as int) as blocks")
        rows = finer.join(top, "key")
        # Lines outside the largest class go to all blocks as left members; all go to their own block as right ones.
        right = rows.selectExpr("key", "h", "sig", "root", "false as stray", "explode(sequence(0, groups - 1)) as i", "cast(pmod(xxhash64(h), blocks) as int) as j")
        out = rows.where("root <> main").selectExpr("key", "h", "sig", "root", "true as stray", "cast(pmod(xxhash64(h, 7), groups) as int) as i", "explode(sequence(0, blocks - 1)) as j")
        rest = right.union(out).groupBy("key", "i", "j").applyInArrow(_across(self.edits), _PAIR)
        return first.union(self._verified(rest))

    def repeats(self) -> DataFrame:
        """(k, t, line): the lines that go; k is the doc_id, the largest long for null, and t the hash of the text."""
        lines = self.docs.withColumn("t", F.xxhash64("text")).mapInArrow(_occurrences(self.least, self.short), _LINES)
        links = self.links()
        roots = components(self.spark, links.select("u", "v"), self.scratch)
        second = links.selectExpr("u as node", "gu as g").union(links.selectExpr("v as node", "gv as g")).distinct()
        roots = roots.join(second, "node").select(F.col("node").alias("h"), "g", "root")
        # A class is a root, or the 128 bits of a line that is near to no other.
        of = lines.join(roots, ["h", "g"], "left").select(F.coalesce("root", "h").alias("c"), F.when(F.col("root").isNull(), F.col("g")).otherwise(F.lit(0)).alias("d"), "k", "line", "last_k", "last", "at")
        of = self.scratch.keep(of)
        first = of.groupBy("c", "d").agg(F.min(F.struct("k", "line")).alias("first"), F.max(F.struct(F.col("last_k").alias("k"), F.col("last").alias("line"))).alias("last")).where("first <> last")
        first = first.select("c", "d", F.col("first.k").alias("first_k"), F.col("first.line").alias("first_line"))
        return of.select("c", "d", "at").join(first, ["c", "d"]).select("at", "first_k", "first_line").mapInArrow(_all_but_first, schema(k="long", t="long", line="int"))


def _cut(want: list[str], own: list[str]):
    kinds = {"n_lines": pa.int64(), "n_removed": pa.int64()}

    def run(batches):
        for b in batches:
            out = {c: [] for c in want}
            for text, gone in zip(b.column("text"), b.column("gone")):
                kept = text.as_py()
                lines = kept.split("\n") if kept else []
                marks = set(gone.as_py() or ())
                if marks:
                    kept = "\n".join([x for i, x in enumerate(lines) if i not in marks])
                row = {"n_lines": len(lines), "n_removed": len(marks), "kept": kept}
                if "kept_sha256" in want:
                    row["kept_sha256"] = hashlib.sha256((kept or "").encode()).hexdigest()
                for c in want:
                    out[c].append(row[c])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in own), *(pa.array(out[c], kinds.get(c, pa.string())) for c in want)], names=[*own, *want])

    return run


def dedup_lines(docs: DataFrame, columns: tuple[str, ...] = ("n_lines", "n_removed", "kept"), edits: int = EDITS, least: int = LEAST, keep: tuple[str, ...] | None = None, short: bool = False, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """A row of docs each: the columns in keep (doc_id if None), then of n_lines, n_removed, kept (the text left) and kept_sha256 those wanted."""
    keep = ("doc_id",) if keep is None else keep
    gone = LineDedup(docs, edits, least, short, hot, block).repeats().groupBy("k", "t").agg(F.collect_set("line").alias("gone"))
    text = F.col("text").cast("string")
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("__k"), F.xxhash64(text).alias("__t"), text.alias("__text"), *[F.col(c) for c in keep])
    rows = own.join(gone.select(F.col("k").alias("__k"), F.col("t").alias("__t"), F.col("gone").alias("__gone")), ["__k", "__t"], "left").withColumnsRenamed({"__text": "text", "__gone": "gone"})
    kinds = {"n_lines": "long", "n_removed": "long", "kept": "string", "kept_sha256": "string"}
    out = T.StructType([*docs.select(*keep).schema, *schema(**{c: kinds[c] for c in columns})])
    return rows.mapInArrow(_cut(list(columns), list(keep)), out)
