"""N-gram Jaccard join by token-combination prefixes.

Two documents link when the Jaccard similarity of their sets of 5-word shingles (the tokens) reaches 0.75.

1. Every token's document frequency is counted exactly.  Tokens travel as packed blobs, dealt by stretches of the hash
   range, so a frequent token is as cheap as a rare one.  Only tokens of two or more documents come back: the others
   cannot be shared.  A document with too few shared tokens can have no link and is done.
2. Equal sets form classes; one representative of each goes on.
3. Tokens are ordered by frequency.  Links share a token in their prefixes (the n - ceil(0.75 n) + 1 rarest tokens), and
   g + 1 tokens in prefixes longer by g.  Rare tokens are indexed alone.  The frequent ones of the longer prefix are
   dealt by hash into g token classes, and every pair of tokens of one class is a key (the k-token combination, k = 2):
   of g + 1 shared frequent tokens two share a class.  g grows with the set (one to GROUP tokens of the size's power of
   two), so a set has some two combinations a token whatever its size; near the next power of two it is indexed for that one, too.
   A set whose whole prefix is rare needs no combinations.
4. Members of a bucket are compared by length, position and parity bitmaps (a bound on the overlap that holds
   always), and what is left is verified exactly.
5. For components, a first round pairs a bucket's members with pivots alone (the member whose tokens are the most shared,
   then the best one near to no pivot yet) and merges what it verifies; the second one takes all pairs of a bucket between
   different components, so that nothing depends on the pivots.
6. A combination that more than HOT documents may have is split: in the first round each block of its members is a bucket
   of its own; in the second one, members outside the key's largest component meet all others, block by block.

Tokens are 48 bits of a 64-bit hash and the stretch of the range they lie in.  What that decides is the overlap within one
verified pair: its chance of being off is some n * n / 2**54 at least, for sets of n tokens.  Equal sets are told by 128 bits.

Defined cases: a null text is empty; an empty set links with nothing; a null doc_id has a null component
and links with nothing; rows that share a doc_id are one node, linked through any of its texts, and each row is
returned; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEYS, Scratch, blobs, by_part, components, docs_of, give_back, part_of, parts_for, ramp, schema, slice_bytes, slices, unblob
from .words import U64, distinct_shingles, flat, mix64

RARE = 64  # most documents of a token that is indexed alone
STARS = 32  # pivots of a bucket in the first round, one after the other
GROUP = 32  # a set of 2**i to 2**(i+1) tokens has 2**i / GROUP token classes, one at least
HOT = 1 << 16  # most documents of a bucket of the first round
BITS = 2048  # of a parity bitmap, at most
WIDTH = 6  # bytes of a token that are sent
ENTRY = 16  # bytes of a key in the index
_ODD = U64(0x9E3779B97F4A7C15)
_PARTS = schema(part="int", batch="long", wide="boolean", runs="binary", tokens="binary", info="binary")
_SHARED = schema(part="int", batch="long", wide="boolean", runs="binary", tokens="binary", df="binary", info="binary")
_SETS = schema(doc_id="long", n="int", fp="binary", uniq="int", n_rare="int", score="float", seq="binary", df="binary")
_INDEX = schema(part="int", docs="binary", bits="binary", keys="binary", at="binary", pos="binary")
_ENTRY = schema(key="long", blocks="int", doc_id="long", comp="long", n="int", uniq="int", pos="int", bits="binary")
_SIZES = schema(rows="double", whole="double", keys="double")
_PAIR = schema(u="long", v="long")
_DOC = np.dtype([("id", "<i8"), ("comp", "<i8"), ("n", "<i4"), ("uniq", "<i4"), ("score", "<f4")])
_INFO = np.dtype([("valid", "u1"), ("id", "<i8"), ("n", "<i4"), ("fp", "V16")])


def _needed(n, num):
    """Least overlap of a set of n tokens with any set similar enough: ceil(num / 100 * n)."""
    return -(-n * num // 100)


def _edges(sorted_parts: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The parts that occur, and the edges of their stretches."""
    edges = np.searchsorted(sorted_parts, np.arange(parts + 1))
    own = np.flatnonzero(np.diff(edges))
    return own, np.append(edges[own], edges[-1])


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal values starts."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _deal(parts: int, k: int):
    def run(batches):
        task, i = TaskContext.get().partitionId(), 0
        for whole in batches:
            for b in slices(whole, "text", slice_bytes(parts, 4 << 20)):
                data, offs = flat(b.column("text"))
                h, o = distinct_shingles(data, offs, k)
                m, n = len(b), np.diff(o)
                info = np.zeros(m, _INFO)
                ids = b.column("doc_id")
                info["valid"] = ids.is_valid().to_numpy(zero_copy_only=False)
                info["id"] = ids.fill_null(0).to_numpy(zero_copy_only=False)
                info["n"] = n
                sums = np.zeros((m, 2), U64)
                for c, salt in enumerate((0x1234567, 0x7654321ABCDEF)):
                    total = np.concatenate([np.zeros(1, U64), np.cumsum(mix64(h ^ U64(salt)), dtype=U64)])
                    sums[:, c] = total[o[1:]] - total[o[:-1]]
                info["fp"] = sums.view("V16").ravel()
                part = part_of(h, parts)
                order = np.argsort(part.astype(np.uint16) if parts < 1 << 16 else part, kind="stable")
                part, doc = part[order], np.repeat(np.arange(m), n)[order]
                own, edges = _edges(part, parts)
                # Within a part a document's tokens are one run.
                first = _starts(part, doc)
                runs = np.stack([doc[first], np.diff(np.append(first, len(doc)))], axis=1)
                wide = m >= 1 << 16 or int(n.max(initial=0)) >= 1 << 16
                low = h[order].view(np.uint8).reshape(-1, 8)[:, :WIDTH]
                batch, rows = (task << 32) | i, len(own)
                i += 1
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array([batch] * rows, pa.int64()), pa.array([wide] * rows), blobs(runs.astype("<u4" if wide else "<u2"), np.searchsorted(first, edges)), blobs(low, edges), pa.nulls(rows, pa.binary())], names=_PARTS.names)
                yield pa.RecordBatch.from_arrays([pa.array([batch % parts], pa.int32()), pa.array([batch], pa.int64()), pa.array([wide]), pa.array([b""], pa.binary()), pa.array([b""], pa.binary()), pa.array([info.tobytes()], pa.binary())], names=_PARTS.names)
        give_back()

    return run


def _tokens(column, part=None) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of all blobs, and the blobs' edges; with the numbers of the blobs' parts above the bytes that are sent."""
    raw, edges = unblob(column, np.uint8)
    wide = np.zeros((len(raw) // WIDTH, 8), np.uint8)
    wide[:, :WIDTH] = raw.reshape(-1, WIDTH)
    out, edges = wide.view("<u8").ravel(), edges // WIDTH
    if part is not None:
        out |= np.repeat((part.to_numpy().astype(U64) & U64(0xFFFF)) << U64(48), np.diff(edges))
    return out, edges


def _runs(wide, column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents and counts of all runs, and the blobs' edges."""
    parts = [np.frombuffer(x.as_buffer(), "<u4" if w.as_py() else "<u2").reshape(-1, 2).astype(np.int64) for w, x in zip(wide, column)]
    both = np.concatenate(parts) if parts else np.zeros((0, 2), np.int64)
    return both[:, 0], both[:, 1], np.cumsum([0] + [len(x) for x in parts])


def _df_class(df: np.ndarray) -> np.ndarray:
    """Frequencies in one byte, in order: exact up to 200, then by powers of two."""
    return np.where(df <= 200, df, 193 + np.log2(np.maximum(df, 1)).astype(np.int64)).astype(np.uint8)


def _df_most(c: np.ndarray) -> np.ndarray:
    """The largest frequency of a class."""
    c = c.astype(np.int64)
    return np.where(c < 200, c, (1 << np.maximum(c - 192, 0)) - 1)


def _frequencies(batches):
    """One part: the tokens that two or more documents have, back to their batches."""
    t = pa.Table.from_batches(batches)
    tokens, edges = _tokens(t["tokens"])
    order = np.argsort(tokens)
    first = _starts(tokens[order])
    size = np.diff(np.append(first, len(tokens)))
    df = np.empty(len(tokens), np.int64)
    df[order] = np.repeat(size, size)
    del order
    keep = df > 1
    doc, count, run_edges = _runs(t["wide"], t["runs"])
    kept = np.concatenate([[0], np.cumsum(keep)])
    at = np.concatenate([[0], np.cumsum(count)])
    count = kept[at[1:]] - kept[at[:-1]]
    full = np.concatenate([[0], np.cumsum(count > 0)])
    runs, wide = np.stack([doc, count], axis=1)[count > 0], t["wide"].to_pylist()
    run_edges = full[run_edges]
    runs = pa.array([runs[a:b].astype("<u4" if w else "<u2").tobytes() for w, a, b in zip(wide, run_edges, run_edges[1:])], pa.binary())
    low = tokens[keep].view(np.uint8).reshape(-1, 8)[:, :WIDTH]
    yield from pa.table([t["part"], t["batch"], t["wide"], runs, blobs(low, kept[edges]), blobs(_df_class(df[keep]), kept[edges]), t["info"]], names=_SHARED.names).to_batches()


def _gather(num: int, rare: int):
    def run(t: pa.Table) -> pa.Table:
        info = np.frombuffer(next(x.as_py() for x in t["info"] if x.is_valid), _INFO)
        d, count, _ = _runs(t["wide"], t["runs"])
        doc = np.repeat(d, count)
        tok, _ = _tokens(t["tokens"], t["part"])
        df, _ = unblob(t["df"], np.uint8)
        order = np.lexsort((tok, df, doc))
        doc, tok, df = doc[order], tok[order], df[order]
        o = np.searchsorted(doc, np.arange(len(info) + 1))
        shared, n = np.diff(o), info["n"].astype(np.int64)
        often = np.concatenate([[0], np.cumsum(df > rare)])
        n_rare = shared - (often[o[1:]] - often[o[:-1]])
        weight = np.concatenate([[0], np.cumsum(np.log2(np.maximum(df, 1).astype(float)))])
        score = (weight[o[1:]] - weight[o[:-1]]) / np.maximum(n, 1)
        left = (shared >= _needed(n, num)) & (n > 0)
        return pa.table([
            pa.array(info["id"].astype(np.int64), mask=info["valid"] == 0), pa.array(info["n"]), pa.array([x.tobytes() for x in info["fp"]], pa.binary()),
            pa.array((n - shared).astype(np.int32)), pa.array(n_rare.astype(np.int32)), pa.array(score.astype(np.float32)),
            pa.array([tok[o[i] : o[i + 1]].tobytes() if left[i] else None for i in range(len(info))], pa.binary()),
            pa.array([df[o[i] : o[i + 1]].tobytes() if left[i] else None for i in range(len(info))], pa.binary()),
        ], names=_SETS.names)

    return run


def _log2(n: np.ndarray) -> np.ndarray:
    """The power of two at or below n > 0, exactly."""
    return np.frexp(n.astype(np.float64))[1].astype(np.int64) - 1


def _words_of(n: np.ndarray) -> np.ndarray:
    """64-bit words of the parity bitmap of a set of n tokens: one to two bits a token, up to BITS."""
    return np.maximum(1, np.minimum(BITS, 1 << _log2(np.maximum(2 * n - 1, 1))) >> 6)


def _bitmaps(seq: np.ndarray, edges: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The parity bitmaps of some sets, one after the other, as 64-bit words."""
    first = np.cumsum(words) - words
    doc = np.repeat(np.arange(len(words)), np.diff(edges))
    at = first[doc] * 64 + (mix64(seq) & (words[doc] * 64 - 1).astype(U64)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=int(words.sum()) * 64).astype(np.uint8) & 1, bitorder="little").view("<u8")


def index_keys(seq: np.ndarray, df: np.ndarray, edges: np.ndarray, n: np.ndarray, uniq: np.ndarray, n_rare: np.ndarray, num: int):
    """(set, key, position of its last token, most documents) of every index key of some sets."""
    size, prefix = np.diff(edges), n - _needed(n, num) + 1 - uniq
    floor = int(_log2(np.array([GROUP]))[0])
    low, high = np.maximum(_log2(n), floor), np.maximum(_log2(n * 100 // num), floor)
    plain = n_rare >= prefix  # the whole prefix is rare
    alone = np.where(plain, prefix, np.minimum(n_rare, prefix + (1 << high) // GROUP))
    doc, at = ramp(np.zeros(len(n), np.int64), np.minimum(alone, size))
    yield doc, seq[edges[doc] + at], at + uniq[doc], np.ones(len(doc), np.int64)
    for step in range(int((high - low).max(initial=0)) + 1):
        level = low + step
        of = np.flatnonzero(~plain & (level <= high))
        groups = (1 << level[of]) // GROUP
        most = np.minimum(size[of], prefix[of] + groups)
        few = np.minimum(n_rare[of], most)
        run, at = ramp(few, most - few)
        doc = of[run]
        tok = seq[edges[doc] + at]
        own = (mix64(tok ^ U64(0xC1A55)) % groups[run].astype(U64)).astype(np.int64)
        order = np.lexsort((at, own, run))
        run, doc, at, tok, own = run[order], doc[order], at[order], tok[order], own[order]
        first = _starts(run, own)
        length = np.diff(np.append(first, len(run)))
        end = np.repeat(first + length, length)
        i, j = ramp(np.arange(len(run)) + 1, end - np.arange(len(run)) - 1)
        key = mix64(tok[i] * _ODD + mix64(tok[j]) + (level[doc[i]].astype(U64) << U64(32)))
        most = _df_most(np.minimum(df[edges[doc[i]] + at[i]], df[edges[doc[i]] + at[j]]))
        yield doc[i], key, at[j] + uniq[doc[i]], most


def key_counts(size: np.ndarray, n: np.ndarray, uniq: np.ndarray, n_rare: np.ndarray, num: int) -> np.ndarray:
    """How many keys index_keys makes of sets with so many shared tokens: single tokens exactly, combinations as hashes deal them on average."""
    prefix, floor = n - _needed(n, num) + 1 - uniq, int(_log2(np.array([GROUP]))[0])
    low, high = np.maximum(_log2(n), floor), np.maximum(_log2(n * 100 // num), floor)
    plain = n_rare >= prefix
    out = np.minimum(np.where(plain, prefix, np.minimum(n_rare, prefix + (1 << high) // GROUP)), size).astype(np.float64)
    for step in range(int((high - low).max(initial=0)) + 1):
        groups = (1 << (low + step)) // GROUP
        most = np.minimum(size, prefix + groups)
        often = most - np.minimum(n_rare, most)
        out += np.where(~plain & (low + step <= high), often * (often - 1) / (2 * groups), 0)
    return out


def index_parts(rows: float, whole: float, keys: float) -> int:
    """Parts for an index of so many keys, so that each is as large as KEYS keys are.

    rows: bytes of all documents' rows and bitmaps, once each; whole: the same once for each of their keys. A part has each document once at
    most, and all parts together have it once a key at most.
    """
    size, entries = KEYS * ENTRY, keys * ENTRY
    return parts_for(int(min(whole + entries, entries * size / (size - rows) if rows < size else np.inf)) // ENTRY, 12)


def _sizes(num: int):
    """For each batch of nodes what index_parts asks for."""
    def run(batches):
        for b in batches:
            n, uniq, n_rare, size = (b.column(c).to_numpy().astype(np.int64) for c in ("n", "uniq", "n_rare", "size"))
            keys, row = key_counts(size, n, uniq, n_rare, num), _DOC.itemsize + 8 * _words_of(n)
            yield pa.RecordBatch.from_arrays([pa.array([float(x)]) for x in (row.sum(), (row * keys).sum(), keys.sum())], names=_SIZES.names)

    return run


def _entries(b: pa.RecordBatch, num: int, hot: int):
    """The documents of a batch of nodes, their bitmaps and index keys."""
    docs = np.zeros(len(b), _DOC)
    for a, c in (("id", "doc_id"), ("comp", "comp"), ("n", "n"), ("uniq", "uniq"), ("score", "score")):
        docs[a] = b.column(c).to_numpy(zero_copy_only=False)
    seq, edges = unblob(b.column("seq"), "<u8")
    df, _ = unblob(b.column("df"), np.uint8)
    n, uniq, n_rare = docs["n"].astype(np.int64), docs["uniq"].astype(np.int64), b.column("n_rare").to_numpy().astype(np.int64)
    words = _words_of(n)
    found = list(index_keys(seq, df, edges, n, uniq, n_rare, num))
    at, keys, pos, most = (np.concatenate(c) for c in zip(*found))
    return docs, words, _bitmaps(seq, edges, words), at, keys, pos, -(-most // hot)


def _index_slices(batches, parts: int):
    for whole in batches:
        yield from slices(whole, "seq", min(8 << 20, slice_bytes(parts, 1 << 20)))


def _index(parts: int, num: int, stars: bool, most: int):
    """Blobs of index entries; keys that may be hot are split in blocks in the first round and left out in the second."""
    def run(batches):
        for b in _index_slices(batches, parts):
            docs, words, bits, at, keys, pos, blocks = _entries(b, num, most)
            hot = np.flatnonzero(blocks > 1)
            if stars:
                block = mix64(keys[hot] ^ mix64(docs["id"][at[hot]].astype(U64))) % blocks[hot].astype(U64)
                keys[hot] = mix64(keys[hot] + (block + U64(1)) * _ODD)
            else:
                keep = blocks <= 1
                at, keys, pos = at[keep], keys[keep], pos[keep]
            if not len(keys):
                continue
            part = part_of(mix64(keys), parts)
            order = np.lexsort((at, part))
            part, at, keys, pos = part[order], at[order], keys[order], pos[order]
            own, edges = _edges(part, parts)
            first = _starts(part, at)
            doc = at[first]
            of_doc = np.searchsorted(first, edges)
            local = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(at)))) - np.repeat(of_doc[:-1], np.diff(edges))
            _, word = ramp((np.cumsum(words) - words)[doc], words[doc])
            word_edges = np.concatenate([[0], np.cumsum(words[doc])])[of_doc]
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), blobs(docs[doc].view(np.uint8), of_doc * _DOC.itemsize), blobs(bits[word], word_edges), blobs(keys, edges), blobs(local.astype("<u4"), edges), blobs(pos.astype("<u4"), edges)], names=_INDEX.names)

    return run


def _hot_entries(num: int, most: int):
    """The entries of keys that may be hot, a row each."""
    def run(batches):
        for b in _index_slices(batches, 0):
            docs, words, bits, at, keys, pos, blocks = _entries(b, num, most)
            hot = np.flatnonzero(blocks > 1)
            doc, first = at[hot], np.cumsum(words) - words
            _, word = ramp(first[doc], words[doc])
            columns = [keys[hot].view(np.int64), blocks[hot].astype(np.int32), docs["id"][doc], docs["comp"][doc], docs["n"][doc], docs["uniq"][doc], pos[hot].astype(np.int32)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), blobs(bits[word], np.concatenate([[0], np.cumsum(words[doc])]))], names=_ENTRY.names)

    return run


class _Members:
    """Documents, their bitmaps, and the tests that drop a pair of entries for certain."""

    def __init__(self, docs: np.ndarray, raw: np.ndarray, at: np.ndarray, pos: np.ndarray, num: int):
        self.docs, self.at, self.pos, self.num = docs, at, pos, num
        self.n = docs["n"].astype(np.int64)
        self.words = _words_of(self.n)
        start = np.cumsum(self.words) - self.words
        self.bits, self.row = {}, np.zeros(len(docs), np.int64)
        for w in np.unique(self.words):
            of = np.flatnonzero(self.words == w)
            self.row[of] = np.arange(len(of))
            self.bits[int(w)] = raw[start[of][:, None] + np.arange(w)]

    def fit(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether the entries i and j (of one bucket) may stand for a link."""
        a, b = self.at[i], self.at[j]
        na, nb = self.n[a], self.n[b]
        need = -(-(na + nb) * self.num // (100 + self.num))
        pa_, pb = self.pos[i], self.pos[j]
        most = np.minimum(pa_, pb) + 1 + np.minimum(na - pa_ - 1, nb - pb - 1)
        return (self.docs["comp"][a] != self.docs["comp"][b]) & (np.minimum(na, nb) >= need) & (most >= need)

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Parity bitmaps of the shared tokens: the overlap is at most (their numbers - differing bits) / 2."""
        out = np.zeros(len(a), bool)
        swap = self.words[a] > self.words[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        for wa, wb in set(zip(self.words[a].tolist(), self.words[b].tolist())):
            of = np.flatnonzero((self.words[a] == wa) & (self.words[b] == wb))
            for c in range(0, len(of), 1 << 14):
                x = of[c : c + (1 << 14)]
                y = self.bits[wb][self.row[b[x]]]
                while y.shape[1] > wa:  # bit positions are hashes modulo a power of two: halves fold
                    y = y[:, : y.shape[1] // 2] ^ y[:, y.shape[1] // 2 :]
                differ = np.bitwise_count(self.bits[wa][self.row[a[x]]] ^ y).sum(1, dtype=np.int64)
                total = self.n[a[x]] + self.n[b[x]]
                shared = total - self.docs["uniq"][a[x]] - self.docs["uniq"][b[x]]
                out[x] = (shared - differ) // 2 >= -(-total * self.num // (100 + self.num))
        return out

    def distinct(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = self.at[i], self.at[j]
        return np.unique(np.minimum(a, b) * len(self.docs) + np.maximum(a, b))

    def ids(self, pairs: np.ndarray) -> pa.RecordBatch:
        u, v = self.docs["id"][pairs // len(self.docs)], self.docs["id"][pairs % len(self.docs)]
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], names=["u", "v"])


class _Bucket(_Members):
    """One part of the index."""

    def __init__(self, t: pa.Table, num: int):
        docs, base = unblob(t["docs"], _DOC)
        keys, edges = unblob(t["keys"], "<u8")
        at = unblob(t["at"], "<u4")[0].astype(np.int64) + np.repeat(base[:-1], np.diff(edges))
        pos = unblob(t["pos"], "<u4")[0].astype(np.int64)
        order = np.lexsort((docs["id"][at], keys))
        keys = keys[order]
        super().__init__(docs, unblob(t["bits"], "<u8")[0], at[order], pos[order], num)
        self.start = _starts(keys)
        self.size = np.diff(np.append(self.start, len(keys)))

    def stars(self):
        """Near pairs of a pivot and others of its bucket: the best member first, then the best of those near to no pivot yet, and so on."""
        of = np.repeat(np.arange(len(self.size)), self.size)
        left = np.lexsort((self.docs["id"][self.at], -self.docs["score"][self.at], of))
        left = left[self.size[of[left]] > 1]
        for _ in range(STARS):
            bucket = of[left]
            first = _starts(bucket)
            size = np.diff(np.append(first, len(left)))
            pivot = np.repeat(left[first], size)
            other = np.ones(len(left), bool)
            other[first] = False
            near = np.zeros(len(left), bool)
            for c in range(0, len(left), 1 << 18):
                x, y, some = pivot[c : c + (1 << 18)], left[c : c + (1 << 18)], np.flatnonzero(other[c : c + (1 << 18)])
                some = some[self.fit(x[some], y[some])]
                near[c + some] = self.near(self.at[x[some]], self.at[y[some]])
            yield self.distinct(pivot[near], left[near])
            again = other & ~near
            left = left[again & (np.repeat(np.add.reduceat(again, first), size) > 1)] if len(left) else left
            if not len(left):
                return

    def all(self):
        """All pairs within buckets, some two million at a time whatever a bucket's size."""
        def sized(m, starts):
            i, j = np.triu_indices(m, 1)
            step = max(1, (1 << 21) // len(i))
            for c in range(0, len(starts), step):
                s = starts[c : c + step, None]
                yield (s + i).ravel(), (s + j).ravel()

        def found():
            for m in np.unique(self.size[(self.size > 1) & (self.size <= 512)]):
                yield from sized(int(m), self.start[self.size == m])
            for s, m in zip(self.start[self.size > 512], self.size[self.size > 512]):
                comp = self.docs["comp"][self.at[s : s + m]]
                order = s + np.argsort(comp, kind="stable")
                upper = np.searchsorted(comp := np.sort(comp), comp, "right")
                step = max(1, (1 << 21) // int(m))
                for r in range(0, int(m), step):
                    rows = np.arange(r, min(r + step, int(m)))
                    run, y = ramp(upper[rows], m - upper[rows])
                    yield order[rows[run]], order[y]

        for i, j in found():
            ok = self.fit(i, j)
            pairs = self.distinct(i[ok], j[ok])
            yield pairs[self.near(pairs // len(self.docs), pairs % len(self.docs))]


def _distinct_runs(found, most: int = 1 << 20):
    """Distinct values of some arrays, in runs: a value may come in several of them."""
    held, size = [], 0
    for x in found:
        held.append(x)
        size += len(x)
        if size > most:
            held = [np.unique(np.concatenate(held))]
            size = len(held[0])
            if size > most // 2:
                yield held[0]
                held, size = [], 0
    if size:
        yield np.unique(np.concatenate(held))


def _candidates(num: int, stars: bool):
    def run(batches):
        b = _Bucket(pa.Table.from_batches(batches), num)
        for pairs in _distinct_runs(b.stars() if stars else b.all()):
            yield b.ids(pairs)

    return run


def _across(num: int):
    """Between two blocks of a hot key: members outside its largest component, and all."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        docs = np.zeros(len(t), _DOC)
        for a, c in (("id", "doc_id"), ("comp", "comp"), ("n", "n"), ("uniq", "uniq")):
            docs[a] = t[c].to_numpy()
        b = _Members(docs, unblob(t["bits"], "<u8")[0], np.arange(len(t)), t["pos"].to_numpy().astype(np.int64), num)
        stray = t["stray"].to_numpy(zero_copy_only=False)
        left, right = np.flatnonzero(stray), np.flatnonzero(~stray)

        def found():
            step = max(1, (1 << 20) // max(1, len(right)))
            for c in range(0, len(left), step):
                x, y = np.repeat(left[c : c + step], len(right)), np.tile(right, len(left[c : c + step]))
                ok = b.fit(x, y)
                pairs = b.distinct(x[ok], y[ok])
                yield pairs[b.near(pairs // len(docs), pairs % len(docs))]

        for pairs in _distinct_runs(found()):
            yield b.ids(pairs)

    return run


def _verify(num: int):
    def run(batches):
        for b in batches:
            nu, nv = b.column("nu").to_numpy(), b.column("nv").to_numpy()
            ok = np.zeros(len(b), bool)
            for i, (x, y) in enumerate(zip(b.column("su"), b.column("sv"))):
                both = np.sort(np.concatenate([np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")]))
                o = int((both[1:] == both[:-1]).sum())
                ok[i] = 100 * o >= num * (int(nu[i]) + int(nv[i]) - o)
            yield b.select(["u", "v"]).filter(pa.array(ok))

    return run


class JaccardJoin:
    """The join over one table of documents; holds the written intermediates."""

    def __init__(self, docs: DataFrame, k: int = 5, percent: int = 75, rare: int = RARE, hot: int = HOT):
        self.spark, self.num, self.hot = docs.sparkSession, percent, hot
        self.scratch = Scratch(self.spark, "jaccard")
        docs = docs_of(docs, "doc_id", "text")
        total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        parts = parts_for(total // 6)
        shared = by_part(docs.mapInArrow(_deal(parts, k), _PARTS), parts, _frequencies, _SHARED)
        #: every row of the table: doc_id, set size n, fingerprint fp; seq: its shared tokens, if it may have a link
        self.sets = self.scratch.keep(shared.groupBy("batch").applyInArrow(_gather(percent, rare), _SETS))
        first = self.sets.where("n > 0 and doc_id is not null").groupBy("fp").agg(F.min(F.struct("doc_id", "n", "uniq", "n_rare", "score", "seq", "df")).alias("r"))
        #: a representative of each class of equal sets
        self.classes = self.scratch.keep(first.select("fp", "r.*"))
        self.nodes = self.classes.where("seq is not null").drop("fp")
        sizes = self.nodes.select("n", "uniq", "n_rare", (F.octet_length("seq") / 8).cast("int").alias("size")).mapInArrow(_sizes(percent), _SIZES)
        self.parts = index_parts(*(x or 0 for x in sizes.agg(*[F.sum(c) for c in _SIZES.names]).first()))
        self.may_be_hot = self.nodes.count() > hot

    def _pairs(self, comps: DataFrame | None, stars: bool) -> DataFrame:
        nodes = self.nodes.withColumn("comp", F.col("doc_id")) if comps is None else self.nodes.join(comps.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("comp", F.coalesce("root", "doc_id")).drop("root")
        index = nodes.mapInArrow(_index(self.parts, self.num, stars, self.hot), _INDEX)
        found = by_part(index, self.parts, _candidates(self.num, stars), _PAIR)
        if not stars and self.may_be_hot:
            found = found.union(self._hot_pairs(nodes))
        found = found.distinct()
        for c in "uv":
            found = found.join(self.nodes.select(F.col("doc_id").alias(c), F.col("n").alias("n" + c), F.col("seq").alias("s" + c)), c)
        # Verified pairs are few bytes in as many tasks as the join has.
        return self.scratch.keep(found.mapInArrow(_verify(self.num), _PAIR).hint("rebalance"), small=True)

    def _hot_pairs(self, nodes: DataFrame) -> DataFrame:
        """Pairs of different components under keys that may be hot; of a key's largest component each member is in one block."""
        hot = self.scratch.keep(nodes.mapInArrow(_hot_entries(self.num, self.hot), _ENTRY))
        sizes = hot.groupBy("key", "comp").agg(F.count("*").alias("c"))
        top = sizes.groupBy("key").agg(F.max(F.struct("c", "comp")).alias("top"), F.sum("c").alias("m"))
        top = top.select("key", F.col("top.comp").alias("main"), (F.col("m") - F.col("top.c")).alias("strays")).where("strays > 0")
        rows = hot.join(top, "key").withColumn("groups", F.expr(f"cast(ceil(strays / {self.hot}) as int)")).withColumn("own", F.expr("cast(pmod(xxhash64(doc_id), blocks) as int)"))
        # Every stray goes to all blocks as a left member, all go to their own block as right ones.
        right = rows.withColumn("stray", F.lit(False)).withColumn("i", F.explode(F.expr("sequence(0, groups - 1)"))).withColumn("j", F.col("own"))
        left = rows.where("comp <> main").withColumn("stray", F.lit(True)).withColumn("i", F.expr("cast(pmod(xxhash64(doc_id, 7), groups) as int)")).withColumn("j", F.explode(F.expr("sequence(0, blocks - 1)")))
        return right.union(left).groupBy("key", "i", "j").applyInArrow(_across(self.num), _PAIR)

    def links(self) -> DataFrame:
        """All links (u, v) between representatives of different sets, u > v."""
        return self._pairs(None, stars=False)

    def membership(self) -> DataFrame:
        """Every row's doc_id, n, fp and the representative of its class (null for an empty set or null id)."""
        return self.sets.select("doc_id", "n", F.when(F.expr("n > 0 and doc_id is not null"), F.col("fp")).alias("fp")).join(self.classes.select("fp", F.col("doc_id").alias("rep")), "fp", "left")

    def components(self) -> DataFrame:
        """doc_id, n_shingles, component_id for every row of the table."""
        first = components(self.spark, self._pairs(None, stars=True), self.scratch)
        rest = self._pairs(first, stars=False)
        of = self.scratch.keep(self.membership(), small=True)
        several = of.where("doc_id is not null").groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b").select("doc_id")
        same = of.join(several, "doc_id").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
        comps = components(self.spark, first.selectExpr("node as u", "root as v").union(rest).union(same), self.scratch)
        out = of.withColumn("node", F.coalesce("rep", "doc_id")).join(comps, "node", "left")
        return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("root", "node").alias("component_id"))


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 75, hot: int = HOT) -> DataFrame:
    return JaccardJoin(docs, k, percent, hot=hot).components()
