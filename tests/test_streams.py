import numpy as np
import pyarrow.compute as pc
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.errors import ColumnRequestError, MetadataError, StorageError, TypeSupportError
from gridloom.operators.grid import plan, share
from gridloom.plans.fixtures import lat_lon, no_coords
from gridloom.sources.stores import ArrayMeta, open_store
from gridloom.sources.writer import describe, write_array
from gridloom.streaming.batches import iter_batches


def cells(path, columns, **more):
    return [r for b in iter_batches(str(path), columns, **more) for r in zip(*(b[c].to_pylist() for c in columns))]


def test_full_read(tmp_path):
    batches = list(iter_batches(lat_lon(str(tmp_path)), ["data", "lat", "lon"]))
    assert len(batches) == 9
    assert batches[0]["data"].to_pylist() == [0, 1, 2, 8, 9, 10, 16, 17, 18]
    assert batches[2]["data"].to_pylist() == [6, 7, 14, 15, 22, 23]
    assert batches[8]["data"].to_pylist() == [54, 55, 62, 63]
    assert batches[8]["lat"].to_pylist() == [41, 41, 42, 42] and batches[8]["lon"].to_pylist() == [-114, -113, -114, -113]


def test_zip_without_names(tmp_path):
    batches = list(iter_batches(no_coords(str(tmp_path))))
    assert len(batches) == 3
    assert cells(tmp_path, ["data_1", "data_2"]) == [(float(i), 100.0 + i) for i in range(8)]


def test_chunk_predicate(tmp_path):
    def keep(b):
        return pc.and_(pc.less(b["lat"], 41), pc.greater(b["lon"], -118)).to_numpy(zero_copy_only=False)

    path = lat_lon(str(tmp_path))
    assert len(list(iter_batches(path, ["data", "lat", "lon"], predicate=keep))) == 4
    assert len(list(iter_batches(path, ["data", "lat", "lon"], tests=[("lt", "lat", 41), ("gt", "lon", -118)]))) == 4


def test_mixed_ranks(tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    a.mkdir(), b.mkdir()
    names = ["data", "lat", "lon"]
    assert sorted(cells(lat_lon(str(a)), names)) == sorted(cells(lat_lon(str(b), wide=True), names))


def test_missing_chunks_are_fill_values(tmp_path):
    lat_lon(str(tmp_path), missing=True, fill=1234.0)
    assert {x for x, _ in cells(tmp_path, ["data", "lat"])} == {1234.0}


@pytest.mark.parametrize(("parts", "part", "n"), [(2, 0, 5), (2, 1, 4), (20, 0, 1), (20, 8, 1), (20, 10, 0), (20, 19, 0)])
def test_partitions(tmp_path, parts, part, n):
    path = lat_lon(str(tmp_path))
    assert len(list(iter_batches(path, ["data"], parts, part))) == n
    with pytest.raises(IndexError):
        list(iter_batches(path, ["data"], parts, parts))


def test_coordinates_alone(tmp_path):
    lat_lon(str(tmp_path))
    assert len(cells(tmp_path, ["lon", "lat"])) == 64 and cells(tmp_path, ["lat"]) == [(35.0 + i,) for i in range(8)]
    assert cells(tmp_path, ["lon", "lat"])[:4] == [(-120, 35), (-120, 36), (-120, 37), (-119, 35)]


def test_every_type_and_fill(tmp_path):
    for kind in ["bool", "int8", "int16", "int32", "int64", "uint8", "uint16", "uint32", "uint64", "float32", "float64"]:
        write_array(str(tmp_path), kind, np.arange(7).astype(kind if kind != "bool" else "?"), (3,), kind=kind)
    write_array(str(tmp_path), "string", np.array(list("abcdefg"), object), (3,), fill="none", skip=[(1,)])
    rows = cells(tmp_path, ["uint64", "string", "bool", "float32"])
    assert rows[6] == (6, "g", True, 6.0) and rows[3][1] == "none" and len(rows) == 7
    for value, text in [(float("nan"), "nan"), (float("-inf"), "-inf")]:
        write_array(str(tmp_path), "f", np.zeros(2), (2,), fill=value, skip=[(0,)])
        assert [str(x) for (x,) in cells(tmp_path, ["f"])] == [text] * 2
    assert ArrayMeta.parse("x", b'{"zarr_format":3,"node_type":"array","shape":[1],"data_type":"float32","fill_value":"0x7fc00000","chunk_grid":{"name":"regular","configuration":{"chunk_shape":[1]}},"codecs":[]}').fill != 0


def test_chunk_keys(tmp_path):
    write_array(str(tmp_path), "x", np.arange(12).reshape(3, 4), (2, 2), encoding={"name": "v2"})
    assert (tmp_path / "x" / "1.1").exists() and sorted(x for (x,) in cells(tmp_path, ["x"])) == list(range(12))


def meta(name, shape, chunks, dims=None):
    return ArrayMeta(name, "float64", shape, chunks, 0.0, dims, [])


@pytest.mark.parametrize(
    "metas",
    [
        [meta("a", (4, 4), (2, 2), ("x", None))],
        [meta("a", (), ())],
        [meta("a", (4, 4), (2, 2), ("x", "y")), meta("b", (4, 4), (2, 2), ("y", "x"))],
        [meta("a", (4, 4), (2, 2)), meta("b", (4, 5), (2, 2))],
        [meta("a", (4, 4), (2, 2)), meta("b", (4, 4), (2, 1))],
        [meta("a", (4, 4), (2, 2), ("x", "y")), meta("z", (4,), (2,), ("z",))],
        [meta("a", (4, 4), (2, 2), ("x", "y")), meta("x", (5,), (2,), ("x",))],
        [meta("a", (4, 4), (2, 2)), meta("x", (4,), (2,), ("x",))],
        [meta("x", (4,), (2,), ("x",)), meta("y", (4,), (2,), ("y",)), meta("a", (4,), (2,))],
        [],
    ],
)
def test_metadata_errors(metas):
    with pytest.raises(MetadataError):
        plan(metas)


@given(st.integers(0, 50), st.integers(1, 20))
def test_shares_cover_all(n, parts):
    assert [i for p in range(parts) for i in share(n, parts, p)] == list(range(n))


@given(st.lists(st.tuples(st.integers(1, 7), st.integers(1, 4)), min_size=1, max_size=4), st.integers(1, 5), st.randoms(use_true_random=False))
@settings(max_examples=40, deadline=None)
def test_any_rank_equals_numpy(tmp_path_factory, axes, parts, rnd):
    path = str(tmp_path_factory.mktemp("store"))
    shape, chunks = tuple(a for a, _ in axes), tuple(c for _, c in axes)
    dims = tuple(f"d{i}" for i in range(len(axes))) if len(axes) > 1 else None
    values = np.arange(int(np.prod(shape))).reshape(shape)
    write_array(path, "v", values, chunks, dims)
    columns = ["v"]
    if dims:
        k = rnd.randrange(len(dims))
        write_array(path, dims[k], np.arange(shape[k]) * 10, (rnd.randint(1, 5),), (dims[k],))
        columns.append(dims[k])
    rows = [r for p in range(parts) for r in cells(path, columns, n_partitions=parts, partition=p)]
    want = [(int(v), int(i[k]) * 10) if dims else (int(v),) for i, v in np.ndenumerate(values)]
    assert sorted(rows) == sorted(want)


def test_errors(tmp_path):
    path = lat_lon(str(tmp_path))
    with pytest.raises(ColumnRequestError, match="latitude"):
        list(iter_batches(path, ["latitude"]))
    with pytest.raises(StorageError, match="ftp"):
        open_store("ftp://x/y")
    with pytest.raises(StorageError):
        open_store(str(tmp_path / "none")).arrays()
    with pytest.raises(StorageError, match="icechunk"):
        open_store(path, "icechunk")
    describe(path, "odd", "float64", (1,), (1,))
    text = (tmp_path / "odd" / "zarr.json").read_text().replace("float64", "complex64")
    (tmp_path / "odd" / "zarr.json").write_text(text)
    with pytest.raises(TypeSupportError):
        open_store(path).arrays()
