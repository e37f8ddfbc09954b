"""What shows on larger tables only, on tables that are just large enough."""

import struct

import pytest
from pyspark.sql import functions as F

from gridloom import session
from gridloom.plans import catalog
from gridloom.sources.codecs import strings_encode
from gridloom.sources.writer import write_table


def test_exact_median_and_no_state_for_each_order(spark, tmp_path):
    """300,001 of 600,000 are at most 25: on such numbers percentile_approx by itself was seen to take 26."""
    n = 600_000
    quantity = f"cast(if(id * 7919 % {n} <= {n // 2}, 1, 26) + id % 25 as double) as l_quantity"
    spark.range(0, n, 1, 3).selectExpr("id div 4 as l_orderkey", quantity, "timestamp_ntz '1995-01-01' as l_shipdate").write.parquet(f"{tmp_path}/lineitem.parquet")
    df = catalog.queries()["approx_distinct"](spark, str(tmp_path))
    assert tuple(df.first()) == (True, n // 4, 25.0)
    by_order = [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "keys=[l_orderkey" in x]
    assert by_order and not any("approx" in x or "percentile" in x for x in by_order)


def test_estimates_of_no_rows(spark, tmp_path):
    spark.range(0).selectExpr("id as l_orderkey", "cast(id as double) as l_quantity", "timestamp_ntz '1995-01-01' as l_shipdate").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert tuple(catalog.queries()["approx_distinct"](spark, str(tmp_path)).first()) == (True, 0, None)


def test_types_of_large_keys(spark, tmp_path):
    keys = [1, 42_949, 42_950, 119_999]
    rows = ", ".join(f"({k}L, 'name', 7, 1.5D)" for k in keys)
    spark.sql(f"SELECT * FROM VALUES {rows} AS t(p_partkey, p_name, p_size, p_retailprice)").write.parquet(f"{tmp_path}/part.parquet")
    df = catalog.queries()["scan_all_types"](spark, str(tmp_path))
    assert [(f.name, f.dataType.simpleString()) for f in df.schema if f.name.startswith("c_u")] == [("c_u8", "smallint"), ("c_u16", "int"), ("c_u32", "bigint"), ("c_u64", "double")]
    got = df.select("p_partkey", "c_u8", "c_u16", "c_u32", "c_u64").orderBy("p_partkey").collect()
    assert [tuple(r) for r in got] == [(k, 7, k % 60000, k * 100000, k * 1e12) for k in keys]


@pytest.mark.parametrize("value, kind", [(1 << 32, "uint32"), (-1, "uint64"), (200, "int8")])
def test_writer_wraps_nothing(spark, tmp_path, value, kind):
    with pytest.raises(Exception, match=f"column x has values that are no {kind}"):
        write_table(spark.range(1).selectExpr(f"{value}L as x"), str(tmp_path), 10, {"x": kind})


def _shuffled(spark) -> int:
    """Rows that this application has written to shuffles so far."""
    found = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(found.apply(i).shuffleWriteRecords() for i in range(found.size()))


def _same_as_written(spark, path, df, rows) -> None:
    back = session.read_zarr(spark, path, columns=df.columns).collect()
    assert len(back) == rows and sorted(map(tuple, back)) == sorted(map(tuple, df.collect()))


def test_only_rows_at_the_edges_are_shuffled(spark, tmp_path):
    """Partitions of 250 rows in chunks of 64: three chunks lie in two partitions each."""
    df = spark.range(0, 1000, 1, 4).select("id", F.concat(F.lit("ü" * 3), F.col("id") % 7).alias("name"), (F.col("id") % 3 == 0).alias("third"))
    before = _shuffled(spark)
    assert write_table(df, str(tmp_path), 64) == 1000
    assert _shuffled(spark) - before < 250
    _same_as_written(spark, str(tmp_path), df, 1000)


@pytest.mark.parametrize("rows, parts, chunk", [(1000, 1, 64), (64, 1, 64), (65, 3, 64), (7, 5, 64), (1000, 2, 1), (640, 5, 64)])
def test_partitions_and_chunks_of_any_size(spark, tmp_path, rows, parts, chunk):
    df = spark.range(0, rows, 1, parts).select("id", (F.col("id") * 0.5).alias("half"), F.col("id").cast("string").alias("name"))
    assert write_table(df, str(tmp_path), chunk) == rows
    assert [r[0] for r in session.read_zarr(spark, str(tmp_path), columns=["id"], partitions=1).collect()] == list(range(rows))
    _same_as_written(spark, str(tmp_path), df, rows)


def test_partition_beyond_its_share_is_divided(spark, tmp_path):
    spark.range(0, 1000, 1, 1).write.parquet(f"{tmp_path}/t")
    df, before = spark.read.parquet(f"{tmp_path}/t"), _shuffled(spark)
    assert write_table(df, str(tmp_path / "s"), 10) == 1000
    assert 450 < _shuffled(spark) - before < 550  # one of four threads writes half by itself
    assert [r[0] for r in session.read_zarr(spark, str(tmp_path / "s"), partitions=1).collect()] == list(range(1000))


def test_timestamps_do_not_depend_on_the_zone(spark, tmp_path):
    spark.sql("SELECT timestamp_ntz '1995-03-26 02:30:00.000001' AS t").write.parquet(f"{tmp_path}/t")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        write_table(spark.read.parquet(f"{tmp_path}/t"), str(tmp_path / "s"), 10)
        assert session.read_zarr(spark, str(tmp_path / "s")).first()[0] == 796185000000001
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_strings_as_one_by_one():
    for texts in ([], [""], ["", ""], ["a", "", "äöü€😀", "x" * 1000, ""]):
        each = [t.encode() for t in texts]
        assert strings_encode(texts) == struct.pack("<I", len(each)) + b"".join(struct.pack("<I", len(t)) + t for t in each)
