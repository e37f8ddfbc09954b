from pyspark.sql import functions as F

from gridloom import session
from gridloom.sources.writer import write_grid, write_table


def test_table_round_trip(spark, tmp_path):
    df = spark.range(0, 1000, 1, 5).select("id", (F.col("id") * 0.5).alias("half"), F.concat(F.lit("n"), "id").alias("name"), (F.col("id") % 200).cast("smallint").alias("small"))
    src = str(tmp_path / "src")
    df.write.parquet(src)
    df = spark.read.parquet(src)
    assert write_table(df, str(tmp_path / "s"), 64, {"small": "uint8"}) == 1000
    back = session.read_zarr(spark, str(tmp_path / "s"), columns=df.columns, partitions=3)
    assert back.exceptAll(df).count() == 0 and back.count() == 1000


def test_grid_round_trip(spark, tmp_path):
    df = spark.range(100).select((F.col("id") % 9).alias("x"), F.floor(F.col("id") / 9).cast("int").alias("y"), (F.col("id") + 1).alias("v")).where("v % 7 <> 0")
    shape = write_grid(df, str(tmp_path), ["x", "y"], ["v"], (4, 5))
    back = session.read_zarr(spark, str(tmp_path))
    assert back.count() == shape[0] * shape[1] == 9 * 12
    assert back.where("v <> 0").select("x", "y", "v").exceptAll(df).count() == 0 and back.where("v <> 0").count() == df.count()


def test_filter_reaches_the_scan(spark, tmp_path):
    write_table(spark.range(100).select("id"), str(tmp_path), 10)
    plan = session.read_zarr(spark, str(tmp_path)).where("id > 42")._jdf.queryExecution().executedPlan().toString()
    assert "zarr" in plan and "Filter" in plan
