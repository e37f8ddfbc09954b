import __spark_entry__ as entry


def test_contract(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["suppkey", "cells", "qty"] and rows.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {"range_join", "union_all", "grid3d_broadcast"} <= set(entry.queries())


def test_queries_take_session_and_folder(spark):
    assert entry.queries()["count_star"](spark, "/root/testdata/sf0.001").first()[0] == 70
