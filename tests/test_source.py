import numpy as np
import pytest

from gridloom import session
from gridloom.errors import GridError
from gridloom.operators.joins import range_join
from gridloom.plans.fixtures import lat_lon, no_coords
from gridloom.sources.writer import write_array


@pytest.fixture(scope="module")
def path(tmp_path_factory):
    return lat_lon(str(tmp_path_factory.mktemp("lat_lon")))


def test_schema_and_rows(spark, path):
    df = session.read_zarr(spark, path)
    assert df.schema.simpleString() == "struct<data:double,lat:double,lon:double>"
    assert all(r.data == 8 * (r.lat - 35) + r.lon + 120 for r in df.collect()) and df.count() == 64


def test_filter_skips_chunks(spark, path):
    df = session.prune(session.read_zarr(spark, path).where("lat < 38.1 AND lon > -116.9"))
    assert df.count() == 16 and df.groupBy().sum("data").first()[0] == 280
    assert "zarr" in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("where", ["lat < 38.1", "data > 60", "NOT lat = 36", "lat IN (35, 42)", "lat <=> 40", "data IS NULL", "lat > lon", "data % 7 = 3 OR lon = -113", "lat >= 36 AND data < 30 AND lon <> -115"])
def test_pruning_changes_nothing(spark, path, where):
    a = session.prune(session.read_zarr(spark, path).where(where))
    b = session.read_zarr(spark, path).where(where)
    assert sorted(a.collect()) == sorted(b.collect())


def test_nan_order(spark, tmp_path):
    write_array(str(tmp_path), "x", np.array([1.0, np.nan, -0.0, np.inf, 2.0, np.nan]), (2,))
    df = session.read_zarr(spark, str(tmp_path))
    for where, n in [("x > 5", 3), ("x = double('NaN')", 2), ("x >= double('NaN')", 2), ("x < double('NaN')", 4), ("x = 0", 1), ("NOT x > 1", 2)]:
        assert df.where(where).count() == session.prune(df.where(where)).count() == n, where


def test_ddl(spark, path):
    session.sql(spark, f"CREATE EXTERNAL TABLE geo_ddl STORED AS ZARR_STORE LOCATION '{path}'")
    assert spark.sql("SELECT lat, lon FROM geo_ddl").count() == 64
    assert spark.sql("SELECT * FROM geo_ddl LIMIT 10").count() == 10
    joined = spark.sql("WITH t AS (SELECT lat, lon, data * 2 AS data2 FROM geo_ddl) SELECT a.data, t.data2 FROM geo_ddl a JOIN t ON a.lat = t.lat AND a.lon = t.lon")
    assert joined.count() == 64 and joined.where("data2 <> 2 * data").count() == 0
    session.sql(spark, f"CREATE EXTERNAL TABLE IF NOT EXISTS two_cols(lat double, lon double) STORED AS ZARR_STORE LOCATION '{path}'")
    assert spark.table("two_cols").columns == ["lat", "lon"] and spark.table("two_cols").count() == 64


def test_ddl_errors(spark, path):
    with pytest.raises(GridError, match="latitude.*data, lat, lon"):
        session.sql(spark, f"CREATE EXTERNAL TABLE e1(latitude double, longitude double) STORED AS ZARR_STORE LOCATION '{path}'")
    with pytest.raises(GridError, match="does not match"):
        session.sql(spark, f"CREATE EXTERNAL TABLE e2(lat int, lon int) STORED AS ZARR_STORE LOCATION '{path}'")
    with pytest.raises(GridError, match="PARQUET"):
        session.sql(spark, f"CREATE EXTERNAL TABLE e3 STORED AS PARQUET LOCATION '{path}'")


def test_partial_coordinates_and_views(spark, path, tmp_path):
    assert session.read_zarr(spark, path, columns=["data", "lon"]).count() == 64
    assert session.read_zarr(spark, path, columns=["lat"]).count() == 8
    session.register_zarr(spark, "zipped", no_coords(str(tmp_path)))
    assert spark.sql("SELECT sum(data_2 - data_1) FROM zipped").first()[0] == 800


def test_partition_count(spark, path):
    assert session.read_zarr(spark, path, partitions=2).rdd.getNumPartitions() == 2
    assert session.read_zarr(spark, path, partitions=20).count() == 64


@pytest.mark.parametrize(("below", "above"), [(1, 1), (0, 3), (2.5, 0)])
def test_range_join(spark, below, above):
    a, b = spark.range(-20, 20).withColumnRenamed("id", "x"), spark.range(-15, 30, 2).withColumnRenamed("id", "y")
    got = range_join(a, b, "x", "y", below, above).selectExpr("__l.x", "__r.y").collect()
    want = [(x, y) for x in range(-20, 20) for y in range(-15, 30, 2) if x - below <= y <= x + above]
    assert sorted(map(tuple, got)) == sorted(want)
    assert "NestedLoop" not in range_join(a, b, "x", "y", below, above)._jdf.queryExecution().executedPlan().toString()


def reads(spark, path, query, monkeypatch):
    """A query of the table geo, and how many chunks of each array its scans read, in this process."""
    from collections import Counter

    from gridloom.plans.pruning import _nodes, _options
    from gridloom.sources.datasource import ZarrSource
    from gridloom.sources.stores import Store

    session.register_zarr(spark, "geo", path)
    df, seen, read = session.sql(spark, query), Counter(), Store.read
    monkeypatch.setattr(Store, "read", lambda self, key: (seen.update([key.split("/")[0]] if "/c/" in key else []), read(self, key))[1])
    for node in _nodes(df._jdf.queryExecution().analyzed()):
        if (options := _options(node)) is not None:
            source = ZarrSource({k.lower(): v for k, v in options.items()})
            from pyspark.sql.types import StructType

            reader = source.reader(StructType.fromDDL(source.schema()))
            for part in reader.partitions():
                list(reader.read(part))
    monkeypatch.setattr(Store, "read", read)
    return df, dict(seen)


@pytest.mark.parametrize(("query", "arrays", "rows"), [
    ("SELECT lat FROM geo", {"lat"}, 64), ("SELECT count(*) FROM geo", {"lat"}, 1), ("SELECT lat FROM geo WHERE lon > -116.9", {"lat", "lon"}, 32), ("SELECT sum(data) FROM geo", {"data"}, 1), ("SELECT * FROM geo", {"data", "lat", "lon"}, 64),
    ("SELECT a.lat FROM geo a JOIN (SELECT lon FROM geo WHERE lon < -119) b ON a.lon = b.lon", {"lat", "lon"}, 64), ("WITH x AS (SELECT lat, data FROM geo) SELECT x.lat, y.data FROM x JOIN x y ON x.data = y.data", {"lat", "data"}, 64),
    ("SELECT lat FROM geo g WHERE EXISTS (SELECT 1 FROM geo h WHERE h.lon = g.lon AND h.data > 60)", {"data", "lat", "lon"}, 24), ("SELECT lat, (SELECT max(data) FROM geo) AS m FROM geo", {"lat"}, 64),
    ("SELECT a.lat FROM (SELECT * FROM geo WHERE data > 60) a JOIN geo b ON a.lon = b.lon", {"data", "lat", "lon"}, 24), ("SELECT lat FROM geo WHERE data > 60 UNION ALL SELECT lat FROM geo WHERE data < 2", {"data", "lat"}, 5), ("SELECT lat, lon FROM geo UNION ALL SELECT lon, lat FROM geo", {"lat", "lon"}, 128), ("SELECT lat FROM geo INTERSECT SELECT lat FROM geo WHERE lon > -114", {"lat", "lon"}, 8),
    ("SELECT lat FROM geo EXCEPT SELECT lat FROM geo WHERE data > 20", {"lat", "data"}, 2), ("SELECT DISTINCT lat FROM geo ORDER BY lat LIMIT 3", {"lat"}, 3), ("SELECT lat, avg(lon) OVER (PARTITION BY lat) AS m FROM geo", {"lat", "lon"}, 64),
])
def test_scans_read_the_columns_that_are_used(spark, path, query, arrays, rows, monkeypatch):
    df, seen = reads(spark, path, query, monkeypatch)
    assert set(seen) == arrays
    plain = spark.sql(query).collect()
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, plain)) and len(plain) == rows


def test_pruned_dataframes(spark, path):
    df = session.read_zarr(spark, path)
    got = session.prune(df.where("lat < 37").groupBy("lat").count())
    assert sorted(map(tuple, got.collect())) == [(35.0, 8), (36.0, 8)]
    assert "data" not in got._jdf.queryExecution().optimizedPlan().toString() and session.prune(spark.range(3)).count() == 3


def test_partitions_follow_the_bytes(path, monkeypatch):
    import gridloom.sources.datasource as source
    from gridloom.sources.stores import open_store

    store = open_store(path)
    monkeypatch.setattr(source, "PART_BYTES", 256)
    assert source.ZarrReader(store, store.arrays(), {"minpartitions": "2"}).parts == 6
    assert source.ZarrReader(store, store.arrays(), {"numpartitions": "3"}).parts == 3


def test_kept_chunks_travel_as_stretches():
    from gridloom.sources.datasource import ChunkRun

    kept = [np.arange(100_000), np.array([1, 2, 3, 7, 9, 10]), np.zeros(0, np.int64)]
    run = ChunkRun(0, 5, kept)
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(run.kept, kept)) and len(run.stretches[0][0]) == 1


def test_remote_and_versioned_stores(path, monkeypatch):
    """The adapters against a file system under S3's name, and against a repository that keeps a snapshot."""
    import sys
    import types

    from pyarrow import fs

    from gridloom.sources.stores import Store, VersionedStore, open_store
    from gridloom.streaming.batches import iter_batches

    want = [b.to_pydict() for b in iter_batches(path)]
    monkeypatch.setattr(Store, "fs", fs.SubTreeFileSystem("/", fs.LocalFileSystem()))
    remote = open_store("s3:/" + path.replace("/", "//", 1) if not path.startswith("//") else path)
    assert remote.remote and list(remote.arrays()) == ["data", "lat", "lon"] and remote.read("data/nothing") is None
    assert [b.to_pydict() for b in iter_batches("s3:/" + path)] == want
    monkeypatch.undo()

    class Buffer:
        def __init__(self, raw):
            self.to_bytes = lambda: raw

    class Session:
        def __init__(self, root):
            self.root, self.store = root, self

        async def get(self, key, prototype):
            found = Store(self.root).read(key)
            return None if found is None else Buffer(found)

        async def list_dir(self, prefix):
            for name in Store(self.root).names():
                yield name + "/"

    class Repository:
        asked = []

        @classmethod
        def open(cls, storage):
            cls.root = storage
            return cls()

        def lookup_branch(self, name):
            return {"main": "snapshot-1"}[name]

        def readonly_session(self, snapshot_id):
            self.asked.append(snapshot_id)
            return Session(self.root)

    fake = types.ModuleType("icechunk")
    fake.Repository, fake.local_filesystem_storage, fake.s3_storage = Repository, lambda p: p, lambda bucket, prefix, from_env: f"/{bucket}/{prefix}"
    buffer = types.ModuleType("zarr.core.buffer")
    buffer.default_buffer_prototype = lambda: None
    for name, module in (("icechunk", fake), ("zarr", types.ModuleType("zarr")), ("zarr.core", types.ModuleType("zarr.core")), ("zarr.core.buffer", buffer)):
        monkeypatch.setitem(sys.modules, name, module)
    store = open_store(path, "icechunk")
    assert isinstance(store, VersionedStore) and store.snapshot == "snapshot-1" and list(store.arrays()) == ["data", "lat", "lon"]
    assert [b.to_pydict() for b in iter_batches(path, kind="icechunk")] == want and set(Repository.asked) == {"snapshot-1"}
    assert [b.to_pydict() for b in iter_batches("s3:/" + path, kind="icechunk")] == want


def test_filters_skip_chunks_of_their_own_scan_alone(spark, path, monkeypatch):
    """Coordinates rule out chunks before data are read; two references to a table have filters of their own."""
    _, seen = reads(spark, path, "SELECT data FROM geo WHERE lat < 38 AND lon > -115", monkeypatch)
    assert seen["data"] == 1
    _, seen = reads(spark, path, "SELECT data FROM geo WHERE lat < 38 UNION ALL SELECT data FROM geo WHERE lat > 41", monkeypatch)
    assert seen["data"] == 6
    df = session.read_zarr(spark, path)
    assert session.prune(df.where("data > 60").join(df, "lon")).count() == df.where("data > 60").join(df, "lon").count() == 24


def test_tests_travel_as_text():
    from decimal import Decimal

    from gridloom.operators.predicates import pack, unpack

    tests = [("lt", "a", 1.5), ("in", "b", [1, 2, None]), ("not", ("eq", "c", "x\"y")), ("ge", "d", Decimal("18446744073709551615")), ("null", "e", True), ("gt", "f", float("inf"))]
    assert unpack(pack(tests)) == tests and unpack(pack([("eq", "a", float("nan"))]))[0][2] != 0
