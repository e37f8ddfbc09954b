"""Exact top-k search by distributed histogram selection.

Queries go in blocks of bounded size (a broadcast of BLOCK_BYTES) against all candidates.  Every pass scores everything and counts, for each query, the
scores in equal bins of an interval that holds its k-th highest score; partial counts are added up in Spark and the
interval shrinks to the k-th score's bin, until at most a few times k scores lie at or above its lower end or one score is
left.  The last pass filters by these bounds; each task passes on its k best of a query at most (ties to the smaller id), which
bounds what ties at the k-th score can send, and a window ranks them.

Scores are integers: floor(1024 x) of the components (the largest double where 1024 x is beyond it), inner products exact (in doubles while those hold them, else in
Python integers, and then saturated to 64 bits).  Defined cases: see vectors.clean; a vector's candidates are those of its length (empty ones score 0);
rows that share an id are each candidates;
a query has no row with its own id as candidate; fewer than k candidates: all; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, schema
from .vectors import by_length, clean, matrix, one_each

BLOCK_BYTES = 32 << 20  # of query vectors, as doubles
COUNTS = 1 << 21  # of a task's histograms, over all queries of a block
ROWS = 2048  # candidates scored at a time
QUERIES = 1024  # against so many queries
_FAR = 1 << 62
_HIT = schema(query_id="long", vec_id="long", score="long")
_RESULT = schema(query_id="long", rank="int", vec_id="long", score="long")


def _whole(v: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        most = np.finfo(np.float64).max
        return np.clip(np.floor(1024.0 * v.astype(np.float64)), -most, most)


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of integer vectors held in doubles; exact."""
    with np.errstate(over="ignore"):
        most = (np.abs(q).max(initial=0)) * (np.abs(c).max(initial=0)) * q.shape[1]
    if most < 2**53:
        return (q @ c.T).astype(np.int64)
    a, b = np.array([[int(x) for x in r] for r in q], object), np.array([[int(x) for x in r] for r in c], object)
    return np.clip((a @ b.T).astype(object), -(2**63), 2**63 - 1).astype(np.int64)


def _scored(block, batches):
    """(first query, queries' ids, candidates' ids, scores) of each piece of the block with each piece of the batches."""
    ids, q = block.value
    for b in batches:
        own, m = b.column("vec_id").to_numpy(), matrix(b.column("v"))
        for i in range(0, len(own), ROWS):
            c = _whole(m[i : i + ROWS])
            for j in range(0, len(ids), QUERIES):
                yield j, ids[j : j + QUERIES], own[i : i + ROWS], _scores(q[j : j + QUERIES], c)


def _histogram(block, low: np.ndarray, width: np.ndarray, bins: int):
    """Counts by (query, bin) of scores from low on, in bins of the width; the last bin is all above, scores below count nowhere."""
    def run(batches):
        counts = np.zeros(len(low) * (bins + 1), np.int64)
        for j, ids, own, s in _scored(block, batches):
            edge, step = low[j : j + len(ids), None], width[j : j + len(ids), None]
            s = np.clip(s, -_FAR + 1, _FAR - 1)
            at = np.minimum((s - edge) // step, bins) + np.arange(len(ids))[:, None] * (bins + 1)
            ok = (s >= edge) & (ids[:, None] != own[None, :])
            counts[j * (bins + 1) : (j + len(ids)) * (bins + 1)] += np.bincount(at[ok], minlength=len(ids) * (bins + 1))
        hit = np.flatnonzero(counts)
        for i in range(0, len(hit), 1 << 16):
            h = hit[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(h // (bins + 1)), pa.array(h % (bins + 1)), pa.array(counts[h])], names=["q", "bin", "n"])

    return run


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores.astype(object) if scores.min(initial=0) == -(2**63) else -scores))[:k]


def _filter(block, low: np.ndarray, k: int):
    def run(batches):
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for j, ids, own, s in _scored(block, batches):
            rows, cols = np.nonzero((s >= low[j : j + len(ids), None]) & (ids[:, None] != own[None, :]))
            edges = np.searchsorted(rows, np.arange(len(ids) + 1))
            for i in np.unique(rows):
                mine = cols[edges[i] : edges[i + 1]]
                old = held.get(ids[i], (np.zeros(0, np.int64), np.zeros(0, np.int64)))
                v, x = np.concatenate([old[0], own[mine]]), np.concatenate([old[1], s[i, mine]])
                best = _best(v, x, k)
                held[ids[i]] = v[best], x[best]
        if held:
            n = [len(v) for v, _ in held.values()]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(list(held), n)), pa.array(np.concatenate([v for v, _ in held.values()])), pa.array(np.concatenate([x for _, x in held.values()]))], names=_HIT.names)

    return run


def _select(rows: DataFrame, ids: np.ndarray, vectors: np.ndarray, most: float, k: int, bins: int) -> DataFrame:
    """One block of queries against all rows."""
    spark = rows.sparkSession
    block = spark.sparkContext.broadcast((ids, vectors))  # BLOCK_BYTES at most
    with np.errstate(over="ignore", invalid="ignore"):
        bound = np.nan_to_num(np.ceil(np.sqrt((vectors**2).sum(1)) * most) + 1, nan=2.0**61, posinf=2.0**61)
    bound = np.minimum(bound, 2.0**61).astype(np.int64)
    low, high = -bound, bound
    # Scores beyond the bound, where even 64 bits are few, lie in the first or the last bin.
    low[bound == 2**61] = -_FAR + 1
    done = np.zeros(len(ids), bool)
    while not done.all():
        width = np.maximum(1, (high - low) // bins + 1)
        width[done] = np.iinfo(np.int64).max // 4
        edge = np.where(done, np.int64(_FAR), low)
        found = rows.mapInArrow(_histogram(block, edge, width, bins), schema(q="long", bin="long", n="long"))
        # The k-th score's bin of each query: where the counts from above reach k.
        down = F.sum("n").over(Window.partitionBy("q").orderBy(F.desc("bin")))
        kth = found.groupBy("q", "bin").agg(F.sum("n").alias("n")).withColumn("from_top", down)
        got = kth.where(F.col("from_top") >= k).groupBy("q").agg(F.max(F.struct("bin", "n", "from_top")).alias("r")).select("q", "r.*").toArrow()
        i, at, top = (got[c].to_numpy() for c in ("q", "bin", "from_top"))
        done[np.setdiff1d(np.flatnonzero(~done), i)] = True  # fewer than k scores: all from low on
        beyond = at == bins
        low[i], high[i] = np.where(beyond, np.minimum(high[i] + 1, _FAR - 1), low[i] + at * width[i]), np.where(beyond, _FAR - 1, low[i] + (at + 1) * width[i] - 1)
        done[i[(top <= 4 * k) | (width[i] == 1) & ~beyond | (low[i] >= high[i])]] = True
    low[low <= -_FAR + 1] = -(2**63)
    hits = rows.mapInArrow(_filter(block, low, k), _HIT)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(*_RESULT.names)


def exact_top_k(df: DataFrame, every: int = 100, k: int = 10, vector: str = "embedding", block_bytes: int = BLOCK_BYTES, counts: int = COUNTS) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest scores of each row whose id is divisible by every, among all other rows."""
    spark = df.sparkSession
    scratch = Scratch(spark, "topk")
    one, several = None, None
    for n, rows in by_length(clean(df, vector)):
        queries = scratch.keep(one_each(rows.where(F.col("vec_id") % every == 0)))
        norm = F.sqrt(F.aggregate(F.transform("v", lambda x: F.abs(x.cast("double")) * 1024.0 + 1.0), F.lit(0.0), lambda a, x: a + x * x))
        most = rows.select(norm.alias("r")).agg(F.max("r")).first()[0] or 0.0
        last, size = -(2**63), max(1, block_bytes // (8 * max(1, n)))
        bins = max(4, min(512, counts // min(size, max(1, queries.count()))))
        while True:
            # Queries come to the driver a block at a time, in order of id.
            block = queries.where(F.col("vec_id") > last).orderBy("vec_id").limit(size).toArrow()
            if not len(block):
                break
            ids = block["vec_id"].to_numpy()
            found = _select(rows, ids, _whole(matrix(block["v"])), most, k, bins)
            if one is not None and several is None:
                several = scratch.add(one, "found")
            one, several = found, scratch.add(found, "found") if several is not None else None
            last = int(ids[-1])
            if len(block) < size:
                break
    if several is not None:
        return several
    return one if one is not None else spark.createDataFrame([], _RESULT)
