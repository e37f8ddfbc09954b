import math

from pyspark.sql import functions as F

from gridloom import functions as G


def test_gcd_lcm(spark):
    pairs = [(0, 0), (0, 5), (12, 18), (-12, 18), (7, 13), (2**40, 2**35), (1134903170, 701408733)]
    rows = spark.createDataFrame(pairs, "a long, b long").select("a", "b", G.gcd(F.col("a"), F.col("b")).alias("g"), G.lcm(F.col("a"), F.col("b")).alias("l")).collect()
    assert all(r.g == math.gcd(r.a, r.b) and r.l == math.lcm(r.a, r.b) for r in rows)


def test_trunc_and_bins(spark):
    assert [r[0] for r in spark.sql("SELECT explode(array(-1.7D, -0.2D, 0.0D, 2.9D)) AS x").select(G.trunc(F.col("x"))).collect()] == [-1, 0, 0, 2]
    row = spark.sql("SELECT timestamp'2024-03-01 10:37:00' AS t, timestamp'2024-01-01 00:10:00' AS o")
    assert row.select(F.date_format(G.date_bin(900, F.col("t")), "HH:mm")).first()[0] == "10:30"
    assert row.select(F.date_format(G.date_bin(900, F.col("t"), F.col("o")), "HH:mm")).first()[0] == "10:25"
    assert row.select(F.date_format(G.date_bin(86400, F.lit("1969-12-30 05:00:00").cast("timestamp")), "yyyy-MM-dd HH")).first()[0] == "1969-12-30 00"


def test_weighted_percentile(spark):
    df = spark.createDataFrame([(1, 5), (2, 1), (3, 1)], "x int, w long")
    assert df.select(G.approx_percentile_weighted(F.col("x"), F.col("w"), 0.5)).first()[0] == 1
