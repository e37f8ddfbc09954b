"""Mixing sources to target weights, in DataFrame and SQL functions only.

Targets: sources in order of name weigh 5, 2, 1, repeating, and share the words of all documents; a target stops at
three times its source's words and the excess is shared anew by weight (the fixed point is found by sorting, not by rounds).

Every source's documents are dealt by hash into blocks, more for larger sources: a random permutation of the documents, cut in
blocks of some BLOCK_BYTES.  A source's quota is an exact number of block copies: whole passes over its blocks, then the first blocks of one
more pass, the last of which is taken in part, and the next document or one later block, as it fits what is then missing.  A splitting tree deals the
quotas to the output shards, whose number follows the size of the documents: at each node, how many of each source's block copies go left is drawn from the
multivariate hypergeometric distribution (source by source, by inversion around the mode; beyond GROUP sources first for
groups of them, then within each group, which is the same distribution).  Each shard then draws its
quota as the next blocks of each source's permuted sequence, so draws are disjoint, and is shuffled locally.

All draws are hashes of fixed numbers: reruns agree.  Tables hold a row per source and block, or per source and shard; a row
holds GROUP sources at most.  Only the targets are found in one place, from a row for each source.  Defined cases: a null text has size 0; null is a source, the last one; rows that agree in doc_id and length share their draw;
an empty table gives an empty one; the caller's own columns are kept, those added come last (and replace columns of the same name).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

BLOCK_BYTES, LEAST_BLOCKS, MOST_BLOCKS = 1 << 20, 1024, 1 << 27  # blocks of the whole table
MOST = 3  # copies of a document
SHARD_BYTES, LEAST_SHARDS, MOST_SHARDS = 128 << 20, 64, 1 << 20
GROUP = 128  # sources in a row of the splitting tree
COARSE = 4096  # blocks added up together to find the one in which a source's last pass ends
BROADCAST_ROWS = 200_000  # of a source or a block, some 100 bytes each
_ADDED = ["size", "source_size", "target", "copies"]


def _sized(docs: DataFrame, source: str, fine: int) -> DataFrame:
    return docs.withColumns({
        "__source": F.col(source).cast("string"),
        "size": F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long"),
        "__h": F.expr("xxhash64(cast(doc_id as bigint), octet_length(text), 20240229)"),
    }).withColumn("__fine", F.expr(f"cast(pmod(__h, {fine}) as int)"))


def _draw(k: str, total: str, n: str, u: str) -> str:
    """SQL for a hypergeometric draw: how many of n items, out of total, are among k marked ones; u in (0, 1).

    Weights relative to the mode, on a range of twelve deviations to either side of it.
    """
    up = "a.w * ((x.k - a.k) * (x.n - a.k)) / ((a.k + 1) * (x.t - x.k - x.n + a.k + 1))"
    down = "a.w * (a.k * (x.t - x.k - x.n + a.k)) / ((x.k - a.k + 1) * (x.n - a.k + 1))"
    return f"""
    transform(transform(transform(array(named_struct('k', {k}, 't', {total}, 'n', {n}, 'u', {u})), x -> named_struct(
        'k', x.k, 't', x.t, 'n', x.n, 'u', x.u, 'lo', greatest(0D, x.n - x.t + x.k), 'hi', least(x.k, x.n),
        'm', least(least(x.k, x.n), greatest(0D, greatest(x.n - x.t + x.k, cast(floor((x.n + 1) * (x.k + 1) / (x.t + 2)) as double)))),
        's', sequence(1, 12 + cast(12 * sqrt(x.n * (x.k / greatest(x.t, 1D)) * (1 - x.k / greatest(x.t, 1D))) as int)))),
      x -> named_struct('x', x,
        'up', aggregate(x.s, named_struct('k', x.m, 'w', 1D, 'sum', 0D), (a, i) -> if(a.k >= x.hi, a, named_struct('k', a.k + 1, 'w', {up}, 'sum', a.sum + {up}))),
        'low', aggregate(x.s, named_struct('k', x.m, 'w', 1D, 'sum', 1D), (a, i) -> if(a.k <= x.lo, a, named_struct('k', a.k - 1, 'w', {down}, 'sum', a.sum + {down}))))),
      y -> transform(array(y.x), x -> aggregate(concat(x.s, x.s), named_struct('k', y.low.k, 'w', y.low.w, 'left', x.u * (y.up.sum + y.low.sum)),
        (a, i) -> if(a.left <= a.w or a.k >= x.hi, a, named_struct('k', a.k + 1, 'w', {up}, 'left', a.left - a.w)), a -> a.k))[0])[0]"""


_TOTAL = "aggregate(kids, 0D, (a, s) -> a + s.q)"


def _split(plan: DataFrame, sources: int, shards: int, scratch: Scratch) -> DataFrame:
    """(rank, shard, q): how many block copies of each source's quota each shard gets.

    A node of the tree is a stretch of shards. Its rows hold the quotas of GROUP sources, or groups of them, each: a row of groups draws
    how many copies of each group go left, and the row of a group's members draws from that number.
    """
    depth = 1
    while GROUP**depth < sources:
        depth += 1
    rows = []
    for j in range(depth):
        kids = plan.groupBy(F.expr(f"(rank - 1) div {GROUP ** (depth - 1 - j)}").alias("kid")).agg(F.sum("quota").cast("double").alias("q"))
        rows.append(kids.groupBy(F.expr(f"kid div {GROUP}").alias("parent")).agg(F.array_sort(F.collect_list(F.struct("kid", "q"))).alias("kids")).select(F.lit(0).cast("long").alias("node"), "parent", "kids"))
    for level in range(max(0, shards - 1).bit_length()):
        half, split = None, []
        for j, t in enumerate(rows):
            t = t.withColumn("n", F.expr(f"ceil({_TOTAL} / 2) * 1D")) if half is None else t.join(half, ["node", "parent"])
            u = f"(shiftrightunsigned(xxhash64({level}, node, s.kid, {977 + j}), 11) + 0.5D) / 9007199254740992D"
            left = f"""aggregate(kids, named_struct('t', {_TOTAL}, 'n', n, 'out', cast(array() as array<double>)),
                (a, s) -> transform(array({_draw("s.q", "a.t", "a.n", u)}), k -> named_struct('t', a.t - s.q, 'n', a.n - k, 'out', array_append(a.out, k)))[0], a -> a.out)"""
            t = t.withColumn("took", F.expr(left))
            if j + 1 < depth:
                half = t.select("node", F.expr("explode(zip_with(kids, took, (s, k) -> named_struct('parent', s.kid, 'n', k))) as x")).select("node", "x.*")
            split.append(t.selectExpr("parent", "explode(array("
                "named_struct('node', node * 2, 'kids', filter(zip_with(kids, took, (s, k) -> named_struct('kid', s.kid, 'q', k)), s -> s.q > 0)), "
                "named_struct('node', node * 2 + 1, 'kids', filter(zip_with(kids, took, (s, k) -> named_struct('kid', s.kid, 'q', s.q - k)), s -> s.q > 0)))) as x").select("x.node", "parent", "x.kids").where("size(kids) > 0"))  # fmt: skip
        rows = split
        if level % 8 == 5 or depth > 1 and level % 2:
            rows = [scratch.keep(t.repartition("node", "parent"), small=True) for t in rows]
    return rows[-1].selectExpr("cast(node as int) as shard", "explode(kids) as s").selectExpr("s.kid + 1 as rank", "shard", "cast(s.q as long) as q")


def _plan(words: DataFrame, fine: int, total: int) -> DataFrame:
    """Each source's words, number of blocks, target, whole passes, and the words to take in the last pass."""
    by = words.groupBy("__source").agg(F.sum("words").alias("source_size"))
    ordered = Window.orderBy(F.col("__source").asc_nulls_last())
    by = by.withColumn("rank", F.row_number().over(ordered).cast("long")).withColumn("w", F.expr("element_at(array(5D, 2D, 1D), cast((rank - 1) % 3 + 1 as int))"))
    by = by.withColumn("cap", F.col("source_size") * float(MOST)).withColumn("ratio", F.expr("cap / w"))
    full = Window.orderBy("ratio", "rank")
    before, after = full.rowsBetween(Window.unboundedPreceding, -1), full.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by = by.withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after))
    by = by.withColumn("level", F.min(F.when(F.expr("level <= ratio"), F.struct("ratio", "rank", "level"))).over(everything)["level"])
    by = by.withColumn("target", F.expr("least(cap, level * w)"))
    # A power of two, so that blocks are whole numbers of fine ones.
    by = by.withColumn("blocks", F.expr(f"cast(power(2, greatest(0, floor(log2(greatest(1D, {fine}D * source_size / {max(1, total)}D))))) as long)"))
    return by.withColumn("passes", F.expr(f"cast(if(source_size = 0, 0, least({MOST}, floor(target / source_size))) as int)")).withColumn("rest", F.expr("target - passes * source_size")).drop("w", "cap", "ratio", "level")


def _same(df: DataFrame, other: DataFrame, how: str = "inner") -> DataFrame:
    """A join by source, null being one; other's column is s."""
    return df.join(other, F.col("__source").eqNullSafe(F.col("s")), how)


def _layout(docs: DataFrame) -> tuple[int, int]:
    """Numbers of blocks and of shards, both powers of two, by the bytes of the texts."""
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0

    def power(n: int, least: int, most: int) -> int:
        return min(most, max(least, 1 << max(0, n - 1).bit_length()))

    return power(-(-size // BLOCK_BYTES), LEAST_BLOCKS, MOST_BLOCKS), power(-(-size // SHARD_BYTES), LEAST_SHARDS, MOST_SHARDS)


def mix(docs: DataFrame, source: str = "source", shards: int | None = None) -> DataFrame:
    """The documents with size, source_size, target and copies: array of (copy, shard, place); a place orders its shard."""
    fine, by_size = _layout(docs)
    return _mix(docs, source, fine, shards or by_size)


def _mix(docs: DataFrame, source: str, fine: int, shards: int) -> DataFrame:
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    own = docs.drop(*[c for c in docs.columns if c.lower() in _ADDED and c.lower() != source.lower()])
    rows = _sized(own, source, fine)
    words = scratch.keep(rows.groupBy("__source", "__fine").agg(F.sum("size").alias("words")), small=True)
    total, sources = words.agg(F.sum("words"), F.count_distinct(F.coalesce(F.concat(F.lit("x"), "__source"), F.lit("")))).first()
    plan = scratch.keep(_plan(words, fine, total or 0), small=True)

    def small(df):
        return F.broadcast(df) if sources <= BROADCAST_ROWS else df

    words = _same(words, small(plan.select(F.col("__source").alias("s"), "blocks", "rest"))).drop("s").withColumn("__block", F.expr("__fine % blocks"))
    words = scratch.keep(words.groupBy("__source", "rest", "__block").agg(F.sum("words").alias("words")), small=True)
    # The block in which a source's last pass ends: among sums of many blocks first, then within one of these.
    coarse = words.groupBy("__source", "rest", F.expr(f"__block div {COARSE}").alias("part")).agg(F.sum("words").alias("words"))
    coarse = coarse.withColumn("upto", F.sum("words").over(Window.partitionBy("__source").orderBy("part"))).where("upto > rest")
    coarse = coarse.groupBy(F.col("__source").alias("s")).agg(F.min(F.struct("part", (F.col("upto") - F.col("words")).alias("had"))).alias("c")).select("s", "c.*")
    cut = _same(words, small(coarse)).where(f"__block div {COARSE} = part").withColumn("upto", F.col("had") + F.sum("words").over(Window.partitionBy("s").orderBy("__block")))
    cut = cut.where("upto > rest").groupBy("s").agg(F.min(F.struct("__block", (F.col("rest") - F.col("upto") + F.col("words")).alias("part"))).alias("cut"))
    plan = _same(plan, cut, "left").drop("s").withColumn("cut_block", F.coalesce("cut.__block", F.lit(0).cast("long"))).withColumn("part", F.coalesce("cut.part", F.lit(0.0))).drop("cut")
    plan = scratch.keep(plan.withColumn("quota", F.expr("passes * blocks + cut_block + 1")), small=True)
    # Of that block: its documents by hash, as far as the target allows; then its next
    # document or the later block, whichever fits what is left better.
    ends = small(plan.select(F.col("__source").alias("s"), "blocks", "cut_block", "part"))
    at = _same(rows.select("__source", "__fine", "__h", "doc_id", "text", "size"), ends).where("__fine % blocks = cut_block")
    upto = F.sum("size").over(Window.partitionBy("s").orderBy("__h"))
    cut = at.select("s", "__h", "part", "size").withColumn("upto", upto)
    cut = cut.groupBy("s").agg(F.expr("max(if(upto <= part, __h, null)) as cut_h"), F.expr("sum(if(upto <= part, size, 0)) as had"), F.expr("min(if(upto > part, struct(upto - part as over, __h as h), null)) as next"))
    plan = scratch.keep(_same(plan, cut, "left").drop("s").withColumn("gap", F.expr("part - coalesce(had, 0)")), small=True)
    fits = _same(words, small(plan.select(F.col("__source").alias("s"), "cut_block", "gap")))
    fits = fits.where("__block > cut_block and words > 0 and words < 2 * gap").groupBy("s").agg(F.min(F.struct(F.abs(F.col("gap") - F.col("words")).alias("d"), "__block")).alias("f"))
    plan = _same(plan, fits.select("s", "f"), "left").drop("s").withColumn("one", F.expr("next.over < least(gap, coalesce(f.d, gap))"))
    plan = plan.withColumn("extra", F.expr("if(coalesce(one, false), null, f.__block)")).withColumn("cut_h", F.expr("if(coalesce(one, false), next.h, cut_h)"))
    plan = scratch.keep(plan.withColumn("quota", F.expr("quota + if(extra is null, 0, 1)")), small=True)
    # Each shard, in an order of the source's own, takes the next block copies of the source's sequence: (block, copies) with their shards.
    dealt = _split(plan.select("rank", "quota"), sources, shards, scratch)
    dealt = dealt.withColumn("from", F.sum("q").over(Window.partitionBy("rank").orderBy(F.xxhash64("rank", "shard"), "shard")) - F.col("q"))
    dealt = dealt.join(small(plan.select("rank", "blocks", "passes", "quota", "extra", F.col("__source").alias("s"))), "rank")
    dealt = dealt.withColumn("i", F.explode(F.expr("sequence(from, from + q - 1)"))).withColumn("last", F.expr("extra is not null and i = quota - 1"))
    dealt = dealt.selectExpr("s", "if(last, extra, i % blocks) as b", "struct(cast(if(last, passes, i div blocks) as int) as copy, shard) as c")
    dealt = scratch.keep(dealt.groupBy("s", "b").agg(F.array_sort(F.collect_list("c")).alias("drawn")), small=True)  # MOST + 1 at most
    n_blocks = dealt.count()
    of = small(plan.select(F.col("__source").alias("s"), "source_size", "target", "blocks", "passes", "cut_block", "cut_h", "extra"))
    rows = _same(rows, of).drop("s").withColumn("__block", F.expr("__fine % blocks"))
    rows = rows.join(F.broadcast(dealt) if n_blocks <= BROADCAST_ROWS else dealt, F.col("__source").eqNullSafe(F.col("s")) & (F.col("__block") == F.col("b")), "left")
    n = f"least({MOST}, passes + if(__block < cut_block or (__block = cut_block and __h <= cut_h) or __block = extra, 1, 0))"
    copies = f"coalesce(transform(filter(drawn, c -> c.copy < {n}), c -> named_struct('copy', c.copy, 'shard', c.shard, 'place', xxhash64(__h, c.copy, 5081))), array())"
    return rows.withColumn("copies", F.expr(copies).cast("array<struct<copy:int,shard:int,place:bigint>>")).select(*own.columns, *_ADDED)


def mixture(docs: DataFrame, source: str = "source", shards: int | None = None) -> DataFrame:
    """The mixed documents themselves, all columns of docs as they are: a row for each copy, a partition for each shard, each shuffled."""
    fine, by_size = _layout(docs)
    whole = docs.select(F.struct("*").alias("__row"), "doc_id", F.col("text").cast("string").alias("text"), F.col(source).alias("__name"))
    rows = _mix(whole, "__name", fine, shards or by_size).select("__row", F.explode("copies").alias("__copy"))
    return rows.repartitionById(shards or by_size, F.col("__copy.shard")).sortWithinPartitions("__copy.place").select("__row.*")
