"""Approximate nearest neighbours by inner product, with shifted Hilbert curves.

Vectors become points whose nearest neighbours are those of largest inner product (one component more takes up
shorter norms).  Each of CURVES orderings projects the points on a few random directions, drawn with the covariance of the data (so
principal directions weigh more), shifts and quantises them, and sorts by Hilbert key: a range partitioning in Spark.  Its
quantiles cut the curve into boxes of equal numbers of distinct points.  A query's candidates are the boxes within a window around its own box in
each ordering; the best of all orderings merge, and are ranked by exact inner products of the original vectors.

Points travel once for each ordering, packed, to the task that holds their stretch of boxes; queries, which are fewer, go
to each stretch that their window touches: no side is copied for each block of the other.

The window is measured, not assumed: for SAMPLE_QUERIES queries the true neighbours are found by brute force, and the half
width is the smallest that holds the TARGET share of them in some ordering.  Data that have near neighbours get
narrow windows; vectors without structure (random directions in 64 dimensions) need windows of a good part of the table.

Equal vectors are one point of the index, told by 128 bits: a batch sends one of them, so copies neither fill windows nor skew
partitions, and the smallest ids of each, as many as a result can hold, are put back at the end.  Fitted on a bounded sample (directions: SAMPLE
points); quantiles are of all points, and all points are indexed.  Defined cases: see vectors.clean; zero vectors take no part; a vector's candidates are those of
its length; ties go to the smaller id; fewer than k candidates: all that are found; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, blobs, by_part, schema, unblob
from .vectors import by_length, clean, matrix, one_each
from .words import U64, mix64

CURVES = 3
DIMS, BITS = 6, 10
SAMPLE = 16_384
SAMPLE_QUERIES, TARGET = 128, 0.96
BOXES = 65_536  # of a curve at most, and at least BOX points in each
BOX = 256
STRETCH = 4096, 32_768  # points that a task holds: least and most, as the window asks
QUERY_CHUNK = 512
_KEYED = schema(d0="long", d1="long", vec_id="long", **{f"k{c}": "long" for c in range(CURVES)})
_SORTED = schema(curve="int", key="long", part="int", at="long")
_DEALT = schema(part="int", kind="int", ids="binary", boxes="binary", vs="binary")
_HIT = schema(query="long", rep="long", score="double")
_RESULT = schema(query_id="long", rank="int", vec_id="long", score="double")


def hilbert_keys(x: np.ndarray, bits: int) -> np.ndarray:
    """Position of integer points (rows of x, below 2**bits) on the Hilbert curve; Skilling's transform, all rows at a time."""
    x = x.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip, q = np.zeros(x.shape[1], np.int64), 1 << (bits - 1)
    while q > 1:
        flip ^= np.where(x[n - 1] & q, q - 1, 0)
        q >>= 1
    x ^= flip
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b) & 1
    return key


class Curves:
    """The fitted orderings: directions, quantile edges and shifts; and, once known, the keys between boxes."""

    def __init__(self, sample: np.ndarray, longest: float, seed: int = 7):
        self.longest, self.bounds = longest, None
        points = self.points(sample, False)
        rng = np.random.default_rng(seed)
        centred = points - points.mean(0)
        cov = centred.T @ centred / max(1, len(points)) + 1e-9 * np.eye(points.shape[1])
        root = np.linalg.cholesky(cov)
        self.directions, self.edges, self.shifts = [], [], []
        for _ in range(CURVES):
            d = np.linalg.qr(root @ rng.standard_normal((points.shape[1], min(DIMS, points.shape[1]))))[0]
            self.directions.append(d)
            self.edges.append(np.quantile(points @ d, np.linspace(0, 1, 1 << (BITS - 1))[1:-1], axis=0))
            self.shifts.append(rng.integers(0, 1 << (BITS - 1), d.shape[1]))

    def points(self, v: np.ndarray, query: bool) -> np.ndarray:
        v = v.astype(np.float64)
        if query:
            return np.hstack([v / np.linalg.norm(v, axis=1)[:, None], np.zeros((len(v), 1))])
        v = v / self.longest
        return np.hstack([v, np.sqrt(np.maximum(0, 1 - (v * v).sum(1)))[:, None]])

    def keys(self, v: np.ndarray, query: bool):
        p = self.points(v, query)
        for d, edges, shift in zip(self.directions, self.edges, self.shifts):
            at = p @ d
            cell = np.stack([np.searchsorted(edges[:, i], at[:, i]) + shift[i] for i in range(at.shape[1])], axis=1)
            yield hilbert_keys(cell, BITS)

    def boxes(self, v: np.ndarray, query: bool):
        """The box of each row, curve by curve."""
        for bounds, key in zip(self.bounds, self.keys(v, query)):
            yield np.searchsorted(bounds, key, "right")


def digests(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each row."""
    words = (v + v.dtype.type(0)).view(np.uint32 if v.dtype.itemsize == 4 else np.uint64)  # no negative zeros
    out = []
    for salt in (0x243F6A88, 0x13198A2E):
        h = np.full(len(v), salt, U64)
        for j in range(v.shape[1]):
            h = mix64(h + words[:, j].astype(U64) * U64(0x9E3779B97F4A7C15) + U64(salt))
        out.append(h.view(np.int64))
    return out[0], out[1]


def _one_of_each(ids: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of equal vectors the one with the smallest id."""
    d0, d1 = digests(v)
    order = np.lexsort((ids, d1, d0))
    new = np.ones(len(ids), bool)
    new[1:] = (d0[order[1:]] != d0[order[:-1]]) | (d1[order[1:]] != d1[order[:-1]])
    return ids[order[new]], v[order[new]]


def _keyed(curves):
    def run(batches):
        for b in batches:
            if len(b):
                v = matrix(b.column("v"))
                yield pa.RecordBatch.from_arrays([*map(pa.array, digests(v)), b.column("vec_id"), *map(pa.array, curves.value.keys(v, False))], names=_KEYED.names)

    return run


def _digested(batches):
    for b in batches:
        if len(b):
            yield pa.RecordBatch.from_arrays([*map(pa.array, digests(matrix(b.column("v")))), b.column("vec_id")], names=["d0", "d1", "vec_id"])


def _number(batches):
    """Within a sorted partition, how many points of the curve came before each row."""
    from pyspark import TaskContext

    part, seen = TaskContext.get().partitionId(), {}
    for b in batches:
        if not len(b):
            continue
        curve, at = b.column("curve").to_numpy(), np.zeros(len(b), np.int64)
        for c in np.unique(curve):
            of = np.flatnonzero(curve == c)
            at[of] = seen.get(c, 0) + np.arange(len(of))
            seen[c] = seen.get(c, 0) + len(of)
        yield pa.RecordBatch.from_arrays([b.column("curve"), b.column("key"), pa.array(np.full(len(b), part, np.int32)), pa.array(at)], names=_SORTED.names)


def exact_scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of rows in pairs, added up in order of component, so that equal vectors get equal scores anywhere."""
    s = np.zeros(len(q))
    for j in range(q.shape[1]):
        s += q[:, j] * c[:, j]
    return s


class _Best:
    """The most similar candidates of each query of a chunk so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors.astype(np.float64), k
        self.rep = np.zeros((len(ids), 0), np.int64)
        self.score = np.zeros((len(ids), 0))

    def see(self, reps: np.ndarray, vectors: np.ndarray, outside=None) -> None:
        vectors = vectors.astype(np.float64)
        s = self.vectors @ vectors.T
        if outside is not None:
            s[outside] = -np.inf
        few = min(self.k + 4, s.shape[1])  # some to spare for sums rounded in another order
        top = np.argpartition(-s, few - 1, axis=1)[:, :few]
        rows = np.repeat(np.arange(len(s)), few)
        exact = exact_scores(self.vectors[rows], vectors[top.ravel()]).reshape(top.shape)
        exact[np.take_along_axis(s, top, 1) == -np.inf] = -np.inf
        score, rep = np.hstack([self.score, exact]), np.hstack([self.rep, reps[top]])
        order = np.lexsort((rep, -score))[:, : self.k]
        self.score, self.rep = np.take_along_axis(score, order, 1), np.take_along_axis(rep, order, 1)

    def rows(self) -> pa.RecordBatch:
        ok = self.score > -np.inf
        q = np.repeat(self.ids[:, None], self.rep.shape[1], 1)
        return pa.RecordBatch.from_arrays([pa.array(q[ok]), pa.array(self.rep[ok]), pa.array(self.score[ok])], names=_HIT.names)


def _brute(queries, k: int):
    """The best rows for each query, none of its own id."""
    def run(batches):
        best = _Best(*queries.value, k)
        for b in batches:
            for i in range(0, len(b), 4096):
                own = b.column("vec_id").to_numpy()[i : i + 4096]
                best.see(own, matrix(b.column("v").slice(i, 4096)), best.ids[:, None] == own[None, :])
        yield best.rows()

    return run


class _Layout:
    """Which boxes a task holds: stretches of wide boxes of each curve."""

    def __init__(self, boxes: int, half: int, step: int):
        self.boxes, self.half = boxes, half
        self.wide = max(1, min(STRETCH[1], max(STRETCH[0], 2 * half * step)) // step)
        self.stretches = -(-boxes // self.wide)

    @property
    def parts(self) -> int:
        return CURVES * self.stretches


def _packed(part: np.ndarray, kind: int, ids: np.ndarray, boxes: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    order = np.argsort(part, kind="stable")
    own, first = np.unique(part[order], return_index=True)
    edges = np.append(first, len(part))
    return pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(np.full(len(own), kind, np.int32)), blobs(ids[order], edges), blobs(boxes[order].astype("<i4"), edges), blobs(v[order], edges)], names=_DEALT.names)


def _deal_points(curves, layout: _Layout):
    def run(batches):
        for b in batches:
            if len(b):
                ids, v = _one_of_each(b.column("vec_id").to_numpy(), matrix(b.column("v")))
                for c, box in enumerate(curves.value.boxes(v, False)):
                    yield _packed(c * layout.stretches + box // layout.wide, 0, ids, box, v)

    return run


def _deal_queries(curves, layout: _Layout):
    def run(batches):
        for b in batches:
            if len(b):
                ids, v = b.column("vec_id").to_numpy(), matrix(b.column("v"))
                for c, box in enumerate(curves.value.boxes(v, True)):
                    low, high = np.maximum(box - layout.half, 0) // layout.wide, np.minimum(box + layout.half, layout.boxes - 1) // layout.wide
                    count = high - low + 1
                    row = np.repeat(np.arange(len(ids)), count)
                    part = low[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                    yield _packed(c * layout.stretches + part, 1, ids[row], box[row], v[row])

    return run


def _search(half: int, k: int, kind: str, dim: int):
    """One stretch: the best of its points within each query's window."""
    def held(t: pa.Table, own: int):
        t = t.filter(pa.array(t["kind"].to_numpy() == own))
        return unblob(t["ids"], "<i8")[0], unblob(t["boxes"], "<i4")[0], unblob(t["vs"], kind)[0].reshape(-1, dim)

    def run(batches):
        t = pa.Table.from_batches(batches)
        ids, box, v = held(t, 0)
        d0, d1 = digests(v)
        order = np.lexsort((ids, d1, d0))  # copies from other batches
        new = np.ones(len(ids), bool)
        new[1:] = (d0[order[1:]] != d0[order[:-1]]) | (d1[order[1:]] != d1[order[:-1]])
        order = order[new]
        order = order[np.argsort(box[order], kind="stable")]
        ids, box, v = ids[order], box[order], v[order]
        q_ids, q_box, q_v = held(t, 1)
        order = np.argsort(q_box, kind="stable")
        q_ids, q_box, q_v = q_ids[order], q_box[order], q_v[order]
        for i in range(0, len(q_ids), QUERY_CHUNK):
            some = slice(i, i + QUERY_CHUNK)
            best = _Best(q_ids[some], q_v[some], k)
            a, b = np.searchsorted(box, [q_box[some][0] - half, q_box[some][-1] + half + 1])
            for c in range(a, b, 4096):
                near = slice(c, min(c + 4096, b))
                best.see(ids[near], v[near], np.abs(box[None, near] - q_box[some][:, None]) > half)
            yield best.rows()

    return run


def _some(d: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    t = d.orderBy(F.xxhash64("vec_id"), "vec_id").limit(most).toArrow()
    return t["vec_id"].to_numpy(), matrix(t["v"])


def _nearest(rows: DataFrame, dim: int, every: int, k: int, half: int | None, scratch: Scratch) -> DataFrame | None:
    """Among vectors of one length."""
    spark, kind = rows.sparkSession, "<f4" if rows.schema["v"].dataType.elementType.typeName() == "float" else "<f8"
    ids = one_each(rows.where(F.col("vec_id") % every == 0))
    ids = scratch.keep(ids.groupBy("v").agg(F.min("vec_id").alias("query")).join(ids, "v").select("query", "vec_id", F.when(F.col("query") == F.col("vec_id"), F.col("v")).alias("v")))
    queries = ids.where("v is not null").select(F.col("query").alias("vec_id"), "v")
    longest = rows.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)))).first()[0]
    if longest is None or queries.isEmpty():
        return None
    fit = Curves(_some(rows, SAMPLE)[1], longest * (1 + 1e-12))
    keyed = rows.mapInArrow(_keyed(spark.sparkContext.broadcast(fit)), _KEYED)  # of fixed size
    keyed = keyed.groupBy("d0", "d1").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), *[F.min(f"k{c}").alias(f"k{c}") for c in range(CURVES)])
    keyed = scratch.keep(keyed)
    n, copies = keyed.agg(F.count("*"), F.max("n")).first()
    # The keys between boxes: every step-th of each curve's points in order.
    step = max(BOX, -(-n // BOXES))
    points = keyed.select(F.explode(F.array(*[F.struct(F.lit(c).alias("curve"), F.col(f"k{c}").alias("key")) for c in range(CURVES)])).alias("x")).select("x.*")
    placed = scratch.keep(points.repartitionByRange(max(8, -(-n * CURVES // 1_000_000)), "curve", "key").sortWithinPartitions("curve", "key").mapInArrow(_number, _SORTED))
    before = Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("curve", "part").agg(F.count("*").alias("c")).select("curve", "part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("c0"))
    cuts = placed.join(F.broadcast(offsets), ["curve", "part"]).where(f"(c0 + at) % {step} = 0 and c0 + at > 0").select("curve", "key").toArrow()  # BOXES a curve at most
    fit.bounds = [np.sort(cuts["key"].to_numpy()[cuts["curve"].to_numpy() == c]) for c in range(CURVES)]
    boxes = -(-n // step)
    if half is None:
        sample = spark.sparkContext.broadcast(_some(queries, SAMPLE_QUERIES))
        best = Window.partitionBy("query").orderBy(F.desc("score"), "rep")
        true = rows.mapInArrow(_brute(sample, k), _HIT).withColumn("n", F.row_number().over(best)).where(F.col("n") <= k)
        # SAMPLE_QUERIES * k rows at most.
        near = rows.join(F.broadcast(true), rows["vec_id"] == true["rep"]).groupBy("query", "rep").agg(F.min("v").alias("v")).toArrow()
        own = dict(zip(sample.value[0].tolist(), range(len(sample.value[0]))))
        at, far = np.array([own[q] for q in near["query"].to_pylist()], int), []
        if len(at):
            for p, q in zip(fit.boxes(matrix(near["v"]), False), fit.boxes(sample.value[1], True)):
                far.append(np.abs(p - q[at]))
        half = int(np.quantile(np.min(far, axis=0), TARGET)) + 1 if far else 1
    else:
        half = half // step + 1
    layout, curves = _Layout(boxes, half, step), spark.sparkContext.broadcast(fit)
    dealt = rows.mapInArrow(_deal_points(curves, layout), _DEALT).union(queries.mapInArrow(_deal_queries(curves, layout), _DEALT))
    hits = by_part(dealt, layout.parts, _search(half, k + 1, kind, dim), _HIT).distinct()
    best = Window.partitionBy("query").orderBy(F.desc("score"), "rep")
    hits = hits.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).drop("n")
    if copies > 1:
        again = keyed.where("n > 1").select("d0", "d1", "rep")
        members = rows.mapInArrow(_digested, schema(d0="long", d1="long", vec_id="long")).join(again, ["d0", "d1"]).select("rep", F.col("vec_id").alias("member"))
        # k rows of each id, and 2 k in all: without those of any one id k are left.
        first = members.withColumn("n", F.row_number().over(Window.partitionBy("rep", "member").orderBy("member"))).where(F.col("n") <= k)
        first = first.withColumn("n", F.row_number().over(Window.partitionBy("rep").orderBy("member"))).where(F.col("n") <= 2 * k)
        hits = hits.join(scratch.keep(first.drop("n")), "rep", "left").withColumn("member", F.coalesce("member", "rep"))
    else:
        hits = hits.withColumn("member", F.col("rep"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "member")
    full = hits.withColumn("n", F.row_number().over(order)).where(F.col("n") <= 2 * k)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "member")
    out = full.join(ids.select("query", F.col("vec_id").alias("query_id")), "query").where("member <> query_id").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return out.select("query_id", "rank", F.col("member").alias("vec_id"), "score")


def nearest(df: DataFrame, every: int = 20, k: int = 20, vector: str = "embedding", half: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose id is divisible by every, among all other rows.

    half: half width of the windows in points of a curve, measured if None.
    """
    scratch, out = Scratch(df.sparkSession, "ann"), None
    for n, rows in by_length(clean(df, vector).where(F.exists("v", lambda x: x != 0))):
        found = _nearest(rows, n, every, k, half, scratch)
        if found is not None:
            out = found if out is None else out.union(found)
    return out if out is not None else df.sparkSession.createDataFrame([], _RESULT)
