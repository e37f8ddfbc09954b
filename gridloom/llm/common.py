"""What several operators share: scratch tables in the shared folder, input columns, connected components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only where that is unset (a single machine, as in tests) one of our own."""
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    return _own.setdefault("dir", tempfile.mkdtemp(prefix="gridloom-"))


ROW_GROUP = 16 << 20  # bytes a task buffers of a scratch table: rows may be large blobs
BATCH_BYTES = 16 << 20  # of a batch that goes to a Python worker
#: Where Hadoop's native library is missing, its local file system starts a process for every file, checksum file and folder that a task makes,
#: which counts as a second JVM until its program begins. Tables that go again need no checksum files; other file systems ignore this.
PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


class Scratch:
    """Tables that cut lineage: written once to the shared folder, so that a lost executor costs a re-read only.

    A result may read them until the application ends; then the folder is deleted.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.made: list[str] = []

    def keep(self, df: DataFrame, small: bool = False) -> DataFrame:
        """small: adaptive execution may join as many partitions as it likes; else even a few rows make a file for every core."""
        return self._write(df, str(len(self.made)), "error", small)

    def add(self, df: DataFrame, name: str) -> DataFrame:
        """The named table with these rows, too."""
        return self._write(df, name, "append", False)

    def _write(self, df: DataFrame, name: str, mode: str, small: bool) -> DataFrame:
        path, conf = f"{self.root}/{name}", self.spark.conf
        cores = "spark.sql.adaptive.coalescePartitions.parallelismFirst"
        # What is written needs its shuffle files no more: they go at once, not when the driver happens to collect its garbage.
        settings = {cores: "false" if small else conf.get(cores), "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES)}
        before = {k: conf.get(k) for k in settings}
        try:
            for k, v in settings.items():
                conf.set(k, v)
            df.write.mode(mode).options(**PLAIN_FILES).option("parquet.block.size", ROW_GROUP).parquet(path)
        finally:
            for k, v in before.items():
                conf.set(k, v)
        if not self.made:
            root = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
            root.getFileSystem(self.spark._jsc.hadoopConfiguration()).deleteOnExit(root)
        self.made.append(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that no later result reads."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t._scratch)
            path.getFileSystem(conf).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs_of(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns alone, ids as long and texts as string, whatever else the table has."""
    ids = {"doc_id", "vec_id", "page_id"}
    return df.select(*[F.col(c).cast("long" if c in ids else "string").alias(c) for c in columns])


KEYS, MOST_KEYS, MANY_PARTS = 1_000_000, 8_000_000, 4096
MOST_TASKS = 65_536


def parts_for(keys: int, least: int = 8) -> int:
    """How many parts to deal so many 8-byte keys into: KEYS in each, and from MANY_PARTS parts on up to MOST_KEYS.

    A part is sorted in one Python worker (some 50 bytes a key). Every batch of texts sends a blob to each part, so parts must not grow
    as fast as the input once there are thousands of them.
    """
    n = -(-keys // KEYS)
    return max(least, n if n <= MANY_PARTS else max(MANY_PARTS, -(-keys // MOST_KEYS)))


def by_part(dealt: DataFrame, parts: int, f, kind: T.StructType) -> DataFrame:
    """f on the rows of each part together, a task for each: f takes an iterator of batches and yields batches.

    A row's part is its partition, so nothing is hashed or sorted. Beyond MOST_TASKS parts a task has several, one after the other.
    """
    if parts <= MOST_TASKS:
        return dealt.repartitionById(parts, F.col("part")).mapInArrow(_one_part(f), kind)
    return dealt.repartition(MOST_TASKS, "part").groupBy("part").applyInArrow(_one_group(f), kind)


def give_back() -> None:
    """Returns freed memory to the system: workers live on beside the stages to come."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


def _one_part(f):
    def run(batches):
        rows = [b for b in batches if len(b)]
        if rows:
            yield from f(rows)
        del rows
        give_back()

    return run


def _one_group(f):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(list(batches))

    return run


def part_of(keys, parts: int):
    """Equal stretches of the 64-bit range."""
    return (((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def blobs(flat, edges) -> pa.Array:
    """A binary column of the stretches between edges (in items) of a flat array."""
    flat = np.ascontiguousarray(flat)
    size = flat.dtype.itemsize * (flat.shape[1] if flat.ndim > 1 else 1)
    edges = np.asarray(edges, np.int64) * size
    if len(edges) < 2:
        return pa.array([], pa.binary())
    return pa.BinaryArray.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(flat.reshape(-1).view(np.uint8))])


def unblob(column, kind) -> tuple:
    """The items of all blobs of a binary column, one after the other, and the edges of the blobs."""
    parts = [np.frombuffer(x.as_buffer(), kind) if x.is_valid else np.zeros(0, kind) for x in column]
    return np.concatenate(parts) if parts else np.zeros(0, kind), np.cumsum([0] + [len(x) for x in parts])


def ramp(first, count) -> tuple:
    """For runs that start at first and have count items: the run of each item, and first, first + 1, ... below first + count."""
    run = np.repeat(np.arange(len(count)), count)
    return run, np.arange(len(run)) + np.repeat(first - (np.cumsum(count) - count), count)


def slice_bytes(parts: int, least: int) -> int:
    """Text to take at a time, so that its keys make no tiny blobs where parts are many: a KiB for each part, 64 MiB at most."""
    return min(64 << 20, max(least, parts << 10))


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20):
    """The batch in runs of rows with at most so many bytes of text (one row at least)."""
    import pyarrow.compute as pc

    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total = np.concatenate([[0], np.cumsum(size)])
    i = 0
    while i < len(size):
        j = max(i + 1, int(np.searchsorted(total, total[i] + most, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def _pairs(df: DataFrame) -> DataFrame:
    return df.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()


def components(spark: SparkSession, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of the undirected edges (u, v), longs; root is the component's smallest node.

    Alternating large-star and small-star contraction: only aggregations and joins on the edges, which
    never gather a node's neighbours in one place; every round is written to the shared folder.
    """
    now = scratch.keep(_pairs(edges), small=True)
    mark = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _pairs(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = scratch.keep(_pairs(small.union(low.select("u", F.col("m").alias("v")))), small=True)
        seen = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(now)
        now = new
        if seen == mark or not seen[0]:
            break
        mark = seen
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


_TYPES = {"int": T.IntegerType, "long": T.LongType, "float": T.FloatType, "double": T.DoubleType, "string": T.StringType, "binary": T.BinaryType, "boolean": T.BooleanType}


def schema(**fields: str) -> T.StructType:
    """Made without a session: modules are also loaded by Python workers."""
    return T.StructType([T.StructField(k, T.ArrayType(_TYPES[v[6:-1]]()) if v.startswith("array<") else _TYPES[v]()) for k, v in fields.items()])
