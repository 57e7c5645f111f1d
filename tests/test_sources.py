"""Files, openers, attributes, missions and series sources."""

import os
import zipfile
from datetime import datetime
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest

from loamline import session
from loamline.functions import cf
from loamline.operators import images, sensors, series, swath, uploads
from loamline.session import EngineError
from loamline.sources import files, netcdf3, readers, writers
from loamline.sources.ingest import ingest_upload
from loamline.sources.openers import CsvOpener, NetCdfOpener, file_times, single_time

T0 = datetime(2000, 1, 1)


def context(master, folder=None):
    conf = SimpleNamespace(get=lambda k, d=None: folder)
    return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: None), sparkContext=SimpleNamespace(master=master, getConf=lambda: conf))


def test_no_local_folder_on_a_cluster():
    for master in ("yarn", "spark://host:7077", "k8s://x", "local-cluster[3,2,1000]"):
        with pytest.raises(EngineError, match="spark.checkpoint.dir"):
            session.shared_folder(context(master))
        assert session.shared_folder(context(master, "hdfs:///work/")) == "hdfs:///work"
    assert session.shared_folder(context("local[4]")).startswith("file:")


def cube(path, times, units="days since 2000-01-01", name="x"):
    netcdf3.write(str(path), {"time": len(times), "lat": 2, "lon": 3}, {
        "lat": (["lat"], np.array([10.0, 20.0]), {"units": "degrees_north"}), "lon": (["lon"], np.arange(3.0), {"units": "degrees_east"}), "time": (["time"], np.array(times, float), {"units": units}),
        name: (["time", "lat", "lon"], np.arange(6.0 * len(times)).reshape(len(times), 2, 3), {"units": "1"}),
    })


def test_files_are_tried_again(tmp_path, monkeypatch):
    files.stored(f"{tmp_path}/a/b.txt", b"whole")
    assert files.fetched(f"file:{tmp_path}/a/b.txt") == b"whole" and [p.name for p in (tmp_path / "a").iterdir()] == ["b.txt"]
    with pytest.raises(FileNotFoundError):
        files.fetched(f"{tmp_path}/none")
    calls = []
    system, name = files.located(f"{tmp_path}/a/b.txt")

    class Flaky:
        def open_input_file(self, n):
            calls.append(n)
            if len(calls) < 3:
                raise OSError("busy")
            return system.open_input_file(n)

    monkeypatch.setattr(files, "located", lambda p: (Flaky(), name))
    monkeypatch.setattr(files, "PAUSE_S", 0.0)
    assert files.fetched("x") == b"whole" and len(calls) == 3
    calls.clear()
    with pytest.raises(OSError, match="busy"):
        files.fetched("x", tries=2)


def test_one_time_of_a_file(spark, tmp_path):
    cube(tmp_path / "a.nc", [1.5])
    cube(tmp_path / "b.nc", [1, 2])
    one, two = ((tmp_path / n).read_bytes() for n in ("a.nc", "b.nc"))
    assert single_time(file_times(netcdf3.parse(one))) == int((946_684_800 + 1.5 * 86400) * 1e6)
    with pytest.raises(EngineError, match="exactly one"):
        single_time(file_times(netcdf3.parse(two)))
    rows = next(NetCdfOpener(flip=True, own_time=True).rows(one, ["x"]))
    assert rows.column("time")[0].as_py() == datetime(2000, 1, 2, 12) and rows.column("x").to_pylist() == [3, 4, 5, 0, 1, 2]
    assert NetCdfOpener().names(one) == ["x"]
    (tmp_path / "b.nc").unlink()
    cube(tmp_path / "img_20000105.nc", [4])
    got = readers.read_images(spark, readers.template_catalog(spark, str(tmp_path), "img_{datetime}.nc", "%Y%m%d"), ["x"], opener=NetCdfOpener())
    assert {r.time for r in got.select("time").distinct().collect()} == {datetime(2000, 1, 5)} and got.count() == 6


def test_csv_opener():
    text = b"gpi,a,b\n3,1.5,x\n,2,2\n4,,7\n"
    assert CsvOpener().names(text) == ["a", "b"]
    rows = next(CsvOpener().rows(text, ["b", "none"])).to_pydict()
    assert rows == {"slot": [0, 0], "gpi": [3, 4], "b": [None, 7.0], "none": [None, None]}


def test_missing_variables_and_levels(spark, tmp_path, recwarn):
    cube(tmp_path / "img_20000101.nc", [0])
    with pytest.raises(EngineError, match="no variables"):
        readers.read_images(spark, str(tmp_path), ["y"], "%Y%m%d", "*.nc")
    got = readers.read_images(spark, str(tmp_path), ["x", "y"], "%Y%m%d", "*.nc", fill=0.0, skip_missing=True)
    assert got.columns == ["time", "gpi", "slot", "x"] and sorted(r.x for r in got.collect() if r.x is not None) == [1, 2, 3, 4, 5]
    assert any("y is skipped" in str(w.message) for w in recwarn)
    mask = readers.mask_of(spark, f"{tmp_path}/img_20000101.nc:x")
    assert {r.gpi for r in mask.where("NOT is_land").collect()} == {0} and readers.mask_of(spark, "x", str(tmp_path)).count() == 6
    daily = readers.read_images(spark, str(tmp_path), ["x"], "%Y%m%d", "*.nc", average="daily", landmask=mask)
    assert {r.gpi: r.x for r in daily.collect()} == {0: None, 1: 1.0, 2: 2.0, 3: 3.0, 4: 4.0, 5: 5.0}


def test_netcdf_files_keep_attributes_and_order(spark, tmp_path):
    rows = [(i, float(i // 3), float(i % 3), T0, i * 1.0) for i in range(6)]
    obs = cf.with_attributes(spark.createDataFrame(rows, "gpi long, lat double, lon double, time timestamp_ntz, v double"), {"v": {"units": "m3 m-3"}})
    writers.write_netcdf_images(obs, ["v"], str(tmp_path / "n"), "img", north_first=True, include_time=False)
    nc = netcdf3.parse((tmp_path / "n" / "img_20000101T0000.nc").read_bytes())
    assert nc.variables["v"].attrs == {"units": "m3 m-3"} and nc.array("lat").tolist() == [1, 0] and nc.array("v").tolist() == [[3, 4, 5], [0, 1, 2]] and "time" not in nc.variables
    with pytest.raises(EngineError):
        writers.write_netcdf_images(obs, ["v"], str(tmp_path / "n"), "img", stepsize=2, include_time=False)
    assert nc.variables["lat"].attrs["units"] == "degrees_north" and cf.types_of(obs)["v"] == "double"
    assert cf.attributes_of(cf.with_attributes(obs, {"v": {"a": "b"}}, discard=True, coordinates=False)) == {"v": {"a": "b"}}


def test_periods_of_parts_of_dates(spark):
    df = spark.createDataFrame([(datetime(2020, m, d, 12),) for m in (1, 2, 12) for d in (1, 28)] + [(datetime(2021, 1, 1),)], "time timestamp_ntz")
    n = lambda a, b: images.in_period(df, a, b).count()
    assert (n("2020", "2020"), n("2020-02", "2020-02"), n("2020-02-28", "2020-12-01"), n("2020-12-28 12:00", "2021")) == (6, 2, 2, 2)


def test_a_mission_of_ones_own(spark):
    own = swath.Mission((r"OWN_(\d{8})\.bin", "%Y%m%d"), 0, ("gpi",), lambda df: df.where("good"), {})
    rows = spark.createDataFrame([(1, 86400.0, True), (2, 0.0, False), (9, 5.0, True)], "gpi long, acquisition_time double, good boolean")
    grid = spark.createDataFrame([(1, True), (2, True), (3, False)], "gpi long, is_land boolean")
    assert [(r.gpi, r.time) for r in own.series(rows, grid, only_land=True).collect()] == [(1, datetime(1970, 1, 2))]
    names = spark.createDataFrame([("OWN_20200102.bin",)], "n string")
    assert names.select(own.time_of(names.n).alias("t")).first().t == datetime(2020, 1, 2)


def test_series_sources(spark):
    class Memory(series.SeriesSource):
        def table(self):
            rows = [(g, float(g), 0.0, datetime(2020, 1, d), g + d / 10) for g in (1, 2) for d in (3, 1, 2)]
            return cf.with_attributes(spark.createDataFrame(rows, "gpi long, lat double, lon double, time timestamp_ntz, v double"), {"v": {"units": "1"}})

    source = Memory()
    assert [r.v for r in source.read(2).collect()] == [2.1, 2.2, 2.3] and source.attributes()["v"] == {"units": "1"}
    assert [r.v for r in source.read(1.2, 0.1, period=("2020-01-02", "2020-01-02")).collect()] == [1.2]
    with pytest.raises(EngineError):
        source.read(80.0, 0.0, max_km=10)
    with pytest.raises(EngineError):
        series.SeriesSource().table()
    stored = series.StoredSeries(source.table().selectExpr("*", "gpi AS cell"), source.grid().selectExpr("*", "gpi AS cell"))
    assert stored.read(1).count() == 3 and stored.read(77).count() == 0


def test_collocation_results(spark):
    df = spark.createDataFrame([(bytearray(b"NET "), 5.0, 200.0)], "network binary, snr double, n_obs double")
    (row,) = sensors.qualified(df).collect()
    assert (row.network, row.frm_class, row.criterion, row.station) == ("NET", "very representative", "ok", None)
    with pytest.raises(EngineError, match="n_obs"):
        sensors.collocation_results(df.drop("n_obs"))


def test_stand_alone_check(tmp_path):
    cube(tmp_path / "a.nc", [1, 2], name="sm")
    raw = (tmp_path / "a.nc").read_bytes()
    assert uploads.check_file("a.NC", raw) == (True, "valid") and uploads.check_file("a.csv", b"x")[0] and not uploads.check_file("a.nc", b"x")[0]
    assert not uploads.check_file("a.nc", b"\x89HDF\r\n\x1a\n")[0]
    assert uploads.format_of(raw) == "NetCDF Classic" and uploads.format_of(b"PK\x03\x04") == "ZIP" and uploads.format_of(b"") is None
    assert uploads.validate_netcdf(raw).info["format"] == "NetCDF Classic"


def test_uploads_without_name_or_content(spark):
    df = spark.createDataFrame([("a.zip", bytearray(b"no zip")), (None, bytearray(b"")), ("b.nc", None), ("", bytearray(b""))], "name string, content binary")
    assert {(r.name, r.status) for r in uploads.validate_uploads(df).collect()} == {("a.zip", 400), ("", 400)}
    assert uploads.validate_uploads(df.limit(0)).count() == 0


def test_overpasses_from_two_tables(spark):
    day = spark.createDataFrame([(T0, 1, 0.1)], "time timestamp_ntz, gpi long, sm double")
    got = readers.stack_overpasses(day, day, ["sm"], hours=(6, 18.5))
    assert [(r.time.hour, r.time.minute, r.slot) for r in got.orderBy("slot").collect()] == [(6, 0, 0), (18, 30, 1)]


def test_large_archives_are_written_series_by_series(spark, tmp_path):
    obs = spark.createDataFrame(pd.DataFrame({"gpi": np.repeat(np.arange(40), 50), "lat": np.repeat(np.arange(40.0), 50), "lon": 1.0, "v": np.arange(2000.0)})).selectExpr("gpi", "lat", "lon", "timestamp_ntz'2020-01-01' + make_dt_interval(CAST(v AS INT)) AS time", "v")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 70)
    path = writers.write_csv_dataset(obs, str(tmp_path), "many", ["v"])
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    back = readers.read_zipped_csv(spark, path)
    assert back.count() == 2000 and back.select("gpi").distinct().count() == 40
    with pytest.raises(EngineError):
        writers.write_csv_dataset(obs.limit(0), str(tmp_path), "none", ["v"])


def test_archives_are_read_and_written_by_several_tasks(spark, tmp_path, partitions):
    partitions(3)
    obs = spark.range(2400).selectExpr("2 * (id % 1200) AS gpi", "0.5D AS lat", "(id % 1200) / 10D AS lon", "timestamp_ntz'2020-01-01 01:02:03' + make_dt_interval(CAST(id DIV 1200 AS INT)) AS time", "id AS v")
    path = writers.write_csv_dataset(obs, str(tmp_path), "many", ["v"], {"a": 1})
    assert os.listdir(tmp_path) == ["many.zip"]
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None and z.namelist() == [*(f"many_gpi={2 * k}_lat=0.5_lon={k / 10}.csv" for k in range(1200)), "metadata.yml"]
    back = readers.read_zipped_csv(spark, path)
    assert back.rdd.getNumPartitions() > 1
    assert {(r.gpi, r.lon, r.time.day, r.value) for r in back.collect()} == {(2 * (k % 1200), k % 1200 / 10, 1 + k // 1200, float(k)) for k in range(2400)}
    assert [r.value for r in readers.read_zipped_csv(spark, path, 14).orderBy("time").collect()] == [7.0, 1207.0]
    out = ingest_upload(spark, path, str(tmp_path / "cells"))
    assert out.count() == 2400 and out.agg({"v": "sum"}).first()[0] == 2400 * 2399 / 2


def test_upload_rows_of_places(spark, tmp_path):
    head, times = "time,a b,none\n", ["2020-01-01", "2020-01-02 03:00:00"]
    with zipfile.ZipFile(tmp_path / "u.zip", "w") as z:
        z.writestr("x_gpi=1_lat=10.5_lon=20.0.csv", f"{head}{times[0]},1,\n{times[1]},,\nno time,7,\n", zipfile.ZIP_STORED)
        z.writestr("d/y_gpi=1_lat=10.5_lon=20.0.csv", f"time,c,a b\n{times[0]},5,0.5\n{times[1]},x,3\n{times[1]},,4\n", zipfile.ZIP_DEFLATED)
        z.writestr("x_gpi=1_lat=-60.0_lon=100.0.csv", f"{head}{times[0]},9,\n", zipfile.ZIP_BZIP2)
        z.writestr("x_gpi=2_lat=0.0_lon=0.0.csv", f"{head}{times[0]},,\n", zipfile.ZIP_DEFLATED)
    out = ingest_upload(spark, str(tmp_path / "u.zip"), str(tmp_path / "out"))
    assert sorted(out.columns) == ["a_b", "c", "cell", "gpi", "time"]
    rows = sorted((r.gpi, str(r.time), r.a_b, r.c or 0) for r in out.collect())
    assert rows == [(1, "2020-01-01 00:00:00", 1.0, 5.0), (1, "2020-01-01 00:00:00", 9.0, 0), (1, "2020-01-02 03:00:00", 4.0, 0)]  # each place once


def test_command_line_options(spark, tmp_path):
    from loamline import cli

    for day in (1, 2, 3):
        cube(tmp_path / f"img_2000010{day}.nc", [day - 1], name="sm")
    run = lambda command, out, *more: cli.main([command, str(tmp_path), str(tmp_path / out), "2000-01-01", "2000-01-31", "--parameter", "sm", *more])
    run("repurpose", "a", "--time_fmt", "%Y%m%d", "--lat", "10", "30", "10", "--lon", "0", "3", "1", "--timestamps", "6", "--skip_missing", "--landmask", f"{tmp_path}/img_20000101.nc:sm", "--only_land", "--cellsize", "5")
    got = spark.read.parquet(str(tmp_path / "a"))
    assert {r.time.hour for r in got.collect()} == {6} and got.count() == 15 and got.where("gpi = 0").count() == 0
    run("transpose", "b", "--latname", "lat", "--lonname", "lon", "--timename", "time", "--netcdf", "--bbox", "0", "5", "1", "25", "--cellsize", "180")
    back = readers.read_stacks(spark, str(tmp_path / "b"), ["sm"])
    assert back.count() == 3 * 4 and {(r.lat, r.lon) for r in back.collect()} == {(10.0, 0.0), (10.0, 1.0), (20.0, 0.0), (20.0, 1.0)}
    run("images", "c", "--stepsize", "2", "--memory", "1", "--fill_value", "5", "--rename", "x:y")
    assert sorted(p.name for p in (tmp_path / "c").iterdir()) == ["images_20000101T0000.nc", "images_20000103T0000.nc"]
    assert readers.read_stacks(spark, str(tmp_path / "c"), ["sm"]).where("sm IS NULL").count() == 3
    spark.createDataFrame([(1, T0, 0.5, 90.0, 1.0)], "gpi long, time timestamp_ntz, sm double, exact double, late double").write.parquet(str(tmp_path / "s"))
    spark.createDataFrame([(1, 0.0, 0.0)], "gpi long, lat double, lon double").write.parquet(str(tmp_path / "g"))
    cli.main(["repurpose", str(tmp_path / "s"), str(tmp_path / "d"), "2000-01-01", "2000-01-31", "--parameter", "sm", "--grid", str(tmp_path / "g"), "--timevarname", "exact", "--timevarunit", "minutes since 2000-01-01", "--timeoffsetvarname", "late", "--timeoffsetunit", "hours"])
    assert spark.read.parquet(str(tmp_path / "d")).first().time == datetime(2000, 1, 1, 2, 30)
    with pytest.raises(EngineError, match="--lat"):
        run("repurpose", "e", "--time_fmt", "%Y%m%d")
