"""Array stores made from the relational tables, so that queries over arrays can be held against plain SQL.

Each store is written once for a Spark application, in the shared folder (spark.checkpoint.dir; a folder of its own where that is
unset), by Spark jobs.
"""

from __future__ import annotations

import hashlib
import os
import tempfile

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.errors import StorageError
from gridloom.session import read_zarr
from gridloom.sources.writer import write_array, write_grid, write_table

_own: dict[str, str] = {}
_made: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not given:
        given = _own.setdefault("dir", tempfile.mkdtemp(prefix="gridloom-stores-"))
    if "://" in given and not given.startswith("file://"):
        raise StorageError(f"stores are written to a shared folder of files; {given} is none")
    return given.removeprefix("file://").removeprefix("file:").rstrip("/")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _flat_lineitem(spark, sf_dir, url):
    df = table(spark, sf_dir, "lineitem")
    # Spark's own cast of these to microseconds, by way of the session's time zone, takes a quarter of the time of reading all columns.
    plain = df.schema["l_shipdate"].dataType.simpleString() == "timestamp_ntz"
    ship = F.col("l_shipdate") if plain else F.unix_micros(F.col("l_shipdate").cast("timestamp"))
    write_table(df.withColumn("l_shipdate_us", ship).drop("l_shipdate"), url, 4096)


def _cells(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("suppkey"), F.col("l_linenumber").alias("linenumber"))
    return t.agg(F.sum("l_quantity").alias("qty"), F.sum("l_extendedprice").alias("price"))


def _grid(spark, sf_dir, url):
    write_grid(_cells(spark, sf_dir), url, ["suppkey", "linenumber"], ["qty", "price"], (16, 3), 0.0)


def _grid_mixed(spark, sf_dir, url):
    write_grid(_cells(spark, sf_dir), url, ["suppkey", "linenumber"], ["qty", "price"], (16, 3), 0.0, wide=["suppkey"])


def _cube(spark, sf_dir, url):
    t = table(spark, sf_dir, "lineitem").groupBy(F.date_format("l_shipdate", "yyyyMM").cast("int").alias("month"), F.col("l_suppkey").alias("suppkey"), F.col("l_linenumber").alias("linenumber"))
    write_grid(t.agg(F.count("*").alias("n")), url, ["month", "suppkey", "linenumber"], ["n"], (12, 16, 3))


def _emb(spark, sf_dir, url):
    t = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("dim", "value"))
    write_grid(t.select("vec_id", F.col("dim").cast("int").alias("dim"), F.col("value").cast("float").alias("value")), url, ["vec_id", "dim"], ["value"], (64, 16), 0.0)


def _events(spark, sf_dir, url):
    t = table(spark, sf_dir, "events").select(F.expr("unix_seconds(cast(ts as timestamp)) div 3600").alias("hour"), F.expr("cast(ascii(event_type) as int)").alias("etype"), "value")
    write_grid(t.groupBy("hour", "etype").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")), url, ["hour", "etype"], ["n", "total"], (24, 4))


#: The signed types that read as the same column, but for uint64, beyond which bigint has only what is below zero.
_SIGNED = {"uint8": "int16", "uint16": "int32", "uint32": "int64", "uint64": "int64"}


def _fitting(df: DataFrame, kinds: dict[str, str]) -> dict[str, str]:
    """The unsigned types where all values fit, signed ones where not: in a large table, keys times a factor leave uint32."""
    ends = df.agg(*(f(n).alias(f"{f.__name__}_{n}") for n in kinds for f in (F.min, F.max))).first()
    fits = {n: (ends[f"min_{n}"] or 0) >= 0 and (ends[f"max_{n}"] or 0) <= np.iinfo(k).max for n, k in kinds.items()}
    return {n: k if fits[n] else _SIGNED[k] for n, k in kinds.items()}


def _types(spark, sf_dir, url):
    t = table(spark, sf_dir, "part").selectExpr(
        "p_partkey", "p_size % 2 = 0 as c_bool", "cast(p_size as tinyint) as c_i8", "cast(p_partkey % 1000 as smallint) as c_i16", "p_size as c_i32", "-p_partkey as c_i64",
        "cast(p_size as smallint) as c_u8", "cast(p_partkey % 60000 as int) as c_u16", "p_partkey * 100000 as c_u32", "p_partkey * 1000000000000 as c_u64", "cast(p_size / 4 as float) as c_f32", "p_retailprice as c_f64", "p_name as c_str",
    )
    write_table(t, url, 300, _fitting(t, {"c_u8": "uint8", "c_u16": "uint16", "c_u32": "uint32", "c_u64": "uint64"}))


def _bench(spark, sf_dir, url):
    values = np.arange(512 * 512, dtype="i8").reshape(512, 512)
    for i in range(1, 9):
        write_array(url, f"var{i}", values, (64, 64))


def lat_lon(url: str, wide: bool = False, missing: bool = False, fill: float = 0.0) -> str:
    """Eight latitudes by eight longitudes with values 0 to 63, in chunks of three: chunks at both edges."""
    lat, lon = np.arange(35.0, 43.0), np.arange(-120.0, -112.0)
    if wide:
        write_array(url, "lat", np.repeat(lat[:, None], 8, 1), (3, 3), ("lat", "lon"))
    else:
        write_array(url, "lat", lat, (3,), ("lat",))
    write_array(url, "lon", lon, (3,), ("lon",))
    every = [(i, j) for i in range(3) for j in range(3)]
    write_array(url, "data", np.arange(64.0).reshape(8, 8), (3, 3), ("lat", "lon"), fill=fill, skip=every if missing else ())
    return url


def no_coords(url: str) -> str:
    write_array(url, "data_1", np.arange(8.0), (3,))
    write_array(url, "data_2", np.arange(100.0, 108.0), (3,))
    return url


_MAKERS = {"flat_lineitem": _flat_lineitem, "grid": _grid, "grid_mixed": _grid_mixed, "cube": _cube, "emb": _emb, "events": _events, "types_part": _types, "bench": _bench, "lat_lon": lambda s, d, u: lat_lon(u)}


def store(spark: SparkSession, sf_dir: str, name: str) -> str:
    """The path of one of the stores, written if this application hasn't yet."""
    mark = f"{spark.sparkContext.applicationId}|{sf_dir}|{name}"
    if mark not in _made:
        url = f"{folder(spark)}/stores-{hashlib.sha256(mark.encode()).hexdigest()[:16]}/{name}"
        os.makedirs(url, exist_ok=True)
        _MAKERS[name](spark, sf_dir, url)
        _made[mark] = url
    return _made[mark]


def scan(spark: SparkSession, sf_dir: str, name: str, **options) -> DataFrame:
    return read_zarr(spark, store(spark, sf_dir, name), **options)
