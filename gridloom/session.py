"""Entry points: registering the source, reading stores, and external tables in SQL."""

from __future__ import annotations

import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from gridloom.errors import GridError
from gridloom.plans.pruning import prune
from gridloom.sources.datasource import ZarrSource, check_declared, chosen
from gridloom.sources.stores import open_store

_DDL = re.compile(r"^\s*CREATE\s+EXTERNAL\s+TABLE\s+(IF\s+NOT\s+EXISTS\s+)?([\w.`\"]+)\s*(?:\((.*?)\)\s*)?STORED\s+AS\s+(\w+)\s+(?:OPTIONS\s*\((.*?)\)\s*)?LOCATION\s+'([^']*)'\s*(?:OPTIONS\s*\((.*?)\)\s*)?;?\s*$", re.I | re.S)
_KINDS = {"ZARR_STORE": "zarr", "ICECHUNK_REPO": "icechunk"}


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package's code to the workers, once for an application, so that they need no copy of it on their path."""
    app, top = spark.sparkContext.applicationId, Path(__file__).parent
    if app in _shipped or not top.is_dir():
        return
    to = Path(tempfile.mkdtemp(prefix="gridloom-code-")) / "gridloom.zip"
    with zipfile.ZipFile(to, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    spark.sparkContext.addPyFile(str(to))
    _shipped.add(app)


def register(spark: SparkSession) -> SparkSession:
    """Makes the format "zarr" known to a session."""
    spark.dataSource.register(ZarrSource)
    return spark


def read_zarr(spark: SparkSession, path: str, columns: list[str] | None = None, schema: StructType | str | None = None, partitions: int | None = None, kind: str = "zarr", **options: str) -> DataFrame:
    """A store as a DataFrame. The columns fix the table's grid: coordinates alone make their product, or with one its values.

    Pass what is made of it through prune(), which sql() does by itself: then only the columns and chunks that are used are read.
    """
    reader = register(spark).read.format("zarr").options(kind=kind, minPartitions=spark.sparkContext.defaultParallelism, **options)
    if partitions:
        reader = reader.option("numPartitions", partitions)
    if columns:
        reader = reader.option("columns", ",".join(columns))
    if schema is not None:
        declared = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
        check_declared(chosen(open_store(path, kind), declared.names), declared)
        reader = reader.schema(declared)
    return reader.load(path)


def read_icechunk(spark: SparkSession, path: str, **options) -> DataFrame:
    return read_zarr(spark, path, kind="icechunk", **options)


def register_zarr(spark: SparkSession, name: str, path: str, **options) -> DataFrame:
    df = read_zarr(spark, path, **options)
    df.createOrReplaceTempView(name)
    return df


def register_icechunk(spark: SparkSession, name: str, path: str, **options) -> DataFrame:
    return register_zarr(spark, name, path, kind="icechunk", **options)


def sql(spark: SparkSession, text: str) -> DataFrame:
    """spark.sql with pruned scans, and CREATE EXTERNAL TABLE … STORED AS ZARR_STORE | ICECHUNK_REPO LOCATION '…', which makes a temporary view."""
    m = _DDL.match(text)
    if not m:
        return prune(spark.sql(text))
    there, name, fields, kind, options, path, more = m.groups()
    if kind.upper() not in _KINDS:
        raise GridError(f"tables can't be stored as {kind}; known are {', '.join(_KINDS)}")
    name = name.strip('`"')
    if not (there and spark.catalog.tableExists(name)):
        given = dict(re.findall(r"'?([\w.]+)'?\s*[=\s]\s*'([^']*)'", options or more or ""))
        register_zarr(spark, name, path, schema=fields, kind=_KINDS[kind.upper()], **given)
    return spark.createDataFrame([], "name string")
