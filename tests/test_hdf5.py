"""HDF5 and NetCDF-4 files."""

import numpy as np
import pytest
from h5write import Writer, cube

from loamline.operators import uploads
from loamline.session import EngineError
from loamline.sources import hdf5, netcdf3, readers


@pytest.mark.parametrize("new,dense", [(False, False), (True, False), (True, True)])
def test_cube(new, dense):
    nc = hdf5.parse(cube(new, dense))
    assert set(nc.variables) == {"time", "lat", "lon", "sm"} and nc.attrs == {"title": "a cube"}
    assert nc.dim_names("sm") == ["time", "lat", "lon"] and dict(nc.dims) == {"time": 2, "lat": 2, "lon": 3}
    assert nc.variables["sm"].attrs == {"_FillValue": -9999.0, "units": "m3 m-3"}
    got = netcdf3.decoded(nc, "sm")
    assert np.isnan(got[1, 1, 2]) and got.reshape(-1)[:11].tolist() == list(range(11))


@pytest.mark.parametrize("new", [False, True])
def test_kinds_of_data(new):
    w = Writer(new)
    a = np.arange(30).reshape(5, 6)
    members = {
        "big": w.dataset(a.astype(">i4")), "small": w.dataset(a.astype("<u1"), compact=True), "wide": w.dataset(a.astype("<f8"), chunk=(2, 4), filters=(1,)),
        "gaps": w.dataset(a.astype("<i2"), chunk=(2, 4), fill=-7, skip={(2, 0)}), "text": w.dataset(np.array([b"ab", b"c"], "S4")), "empty": w.dataset(np.zeros((0, 3))),
        "group": w.group({"inner": w.dataset(np.array([1.5, 2.5])), "big": w.dataset(np.array([9]))}),
    }
    if new:
        members["one"] = w.dataset(a.astype("<f4"), chunk="single", filters=(2, 1))
        members["bare"] = w.dataset(np.zeros(4), {"CLASS": "DIMENSION_SCALE", "NAME": "This is a netCDF dimension but not a netCDF variable.         4"})
    f = hdf5.parse(w.finish(w.group(members)))
    for name in ("big", "small", "wide", *(["one"] if new else [])):
        np.testing.assert_array_equal(f.array(name), a)
    gaps = a.copy()
    gaps[2:4, :4] = -7
    np.testing.assert_array_equal(f.array("gaps"), gaps)
    assert f.array("inner").tolist() == [1.5, 2.5] and f.array("group/big").tolist() == [9] and f.groups == ["group"] and f.array("empty").shape == (0, 3)
    assert "bare" not in f.variables and (not new or dict(f.dims)["bare"] == 4)
    assert f.array("text").tolist() == [b"ab", b"c"]


def test_damaged_files_are_refused():
    raw = cube()
    for bad in (b"", b"no", raw[:9], raw[: len(raw) // 2], raw[:200]):
        with pytest.raises(EngineError):
            hdf5.parse(bad)
    w = Writer()
    odd = w.dataset(np.zeros((4, 4)), chunk=(2, 2), filters=(4,))
    with pytest.raises(EngineError, match="filter 4"):
        hdf5.parse(w.finish(w.group({"odd": odd}))).array("odd")


def test_images_and_stacks_from_files(spark, tmp_path):
    (tmp_path / "img_20000101.nc").write_bytes(cube(True))
    got = readers.read_images(spark, str(tmp_path), ["sm"], "%Y%m%d", "*.nc", offsets=[0, 43200])
    assert got.count() == 12 and got.where("sm IS NULL").count() == 1 and {r.time.hour for r in got.collect()} == {0, 12}
    stack = readers.read_stacks(spark, str(tmp_path), ["sm"]).collect()
    assert {(r.time.day, r.lat, r.lon): r.sm for r in stack}[2, 20.0, 1.0] == 10.0 and len(stack) == 12
    h5 = Writer()
    inner = h5.group({"soil_moisture": h5.dataset(np.array([0.1, 0.2, -9999.0], "<f4"))})
    (tmp_path / "swath").mkdir()
    (tmp_path / "swath" / "SMAP_20150811.h5").write_bytes(h5.finish(h5.group({"Soil_Moisture_Retrieval_Data": inner})))
    rows = readers.read_images(spark, str(tmp_path / "swath"), ["soil_moisture"], "%Y%m%d", "*.h5", opener="netcdf", fill=-9999.0)
    assert rows.count() == 3 and rows.where("soil_moisture IS NULL").count() == 1


def test_uploads():
    assert uploads.validate_upload("a.nc4", cube(True))[::2] == (True, 200) and uploads.validate_netcdf(cube()).info["format"] == "NetCDF4/HDF5"
    more = {"g": lambda w: w.group({"x": w.dataset(np.zeros(2))}), "pairs": lambda w: w.dataset(np.zeros(2, "<u8"), kind="compound"), "lists": lambda w: w.dataset(np.zeros((2, 2), "<u8"), kind="refs"), "words": lambda w: w.dataset(np.zeros((2, 2), "<u8"), kind="text")}
    errors = uploads.validate_netcdf(cube(True, extra=more)).errors
    assert any("groups found" in e for e in errors) and any("pairs is of a compound" in e for e in errors) and any("lists holds arrays of varying" in e for e in errors) and not any("words" in e for e in errors)
