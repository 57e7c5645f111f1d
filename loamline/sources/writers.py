"""Sinks: cell series, stacks, image files, CSV series."""

from __future__ import annotations

import json
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamline.functions.cf import COORDINATES, attributes_of
from loamline.functions.chunks import images_in
from loamline.functions.strptime import strptime_parts
from loamline.operators.grid import target_points, with_cells
from loamline.operators.images import in_time
from loamline.operators.sensors import class_counts, labelled, qualified
from loamline.operators.series import transposed
from loamline.session import EngineError, cut
from loamline.sources.files import located, stored
from loamline.sources.netcdf3 import encoded
from loamline.sources.readers import read_cells


def exists(df: DataFrame, path: str) -> bool:
    """Whether a path exists in its file system."""
    spark = df.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def write_cells(obs: DataFrame, grid: DataFrame, path: str, start=None, end=None, overwrite: bool = False, append: bool = False, cellsize: float | None = None, time: str = "time", files_per_cell: int | None = None) -> DataFrame:
    """Images to series by cell: ``path/cell=.../``, sorted by (gpi, time); returns the written table.

    Observations off the grid or without a time are dropped.  An existing target is left as it is unless ``overwrite`` or
    ``append`` is set (not both).  Large cells are cut into files of the advisory partition size and small ones share a task, as
    adaptive execution measures them; ``files_per_cell`` spreads each over that many tasks by gpi instead."""
    if overwrite and append:
        raise EngineError("overwrite and append exclude each other")
    if exists(obs, path) and not (overwrite or append):
        return read_cells(obs.sparkSession, path)
    cells = (grid if "cell" in grid.columns else with_cells(grid, cellsize)).select("gpi", "cell")
    return write_by_cell(in_time(obs.where(F.col(time).isNotNull()), start, end, time).drop("cell").join(cells, "gpi"), path, append, time, files_per_cell)


def write_by_cell(rows: DataFrame, path: str, append: bool = False, time: str = "time", files_per_cell: int | None = None) -> DataFrame:
    """``write_cells`` for rows that have their cell."""
    rows = rows.repartition("cell", F.pmod(F.xxhash64("gpi"), F.lit(files_per_cell))) if files_per_cell else rows.hint("rebalance", "cell")
    rows = rows.sortWithinPartitions("cell", "gpi", time)
    rows.write.mode("append" if append else "overwrite").partitionBy("cell").parquet(path)
    return read_cells(rows.sparkSession, path)


def write_transposed(obs: DataFrame, variables: list[str], path: str) -> None:
    """One row per gpi with its whole series."""
    transposed(obs, variables).write.mode("overwrite").parquet(path)


def _netcdf(frame: pd.DataFrame, variables: list[str], attrs: dict[str, dict], time_last: bool, north_first: bool = False, with_time: bool = True) -> bytes:
    """Rows (time, gpi, lat, lon, variables) as a NetCDF file: a regular grid (time, lat, lon) where the places are one, else
    (time, location); time goes last for series.  Missing values are NaN."""
    times = np.sort(frame["time"].unique())
    lats, lons = np.sort(frame["lat"].unique()), np.sort(frame["lon"].unique())
    places = frame[["gpi", "lat", "lon"]].drop_duplicates("gpi").sort_values("gpi")
    regular = len(places) == len(lats) * len(lons) == len(places.drop_duplicates(["lat", "lon"]))
    if north_first:
        lats = lats[::-1]
    step = np.searchsorted(times, frame["time"].to_numpy())
    if regular:
        y = np.searchsorted(np.sort(lats), frame["lat"].to_numpy())
        y, x = (len(lats) - 1 - y if north_first else y), np.searchsorted(lons, frame["lon"].to_numpy())
        space, at, dims = (len(lats), len(lons)), (y, x), {"lat": len(lats), "lon": len(lons)}
        coords = {"lat": (["lat"], lats, COORDINATES["lat"]), "lon": (["lon"], lons, COORDINATES["lon"])}
    else:
        space, at, dims = (len(places),), (np.searchsorted(places["gpi"].to_numpy(), frame["gpi"].to_numpy()),), {"location": len(places)}
        coords = {"lat": (["location"], places["lat"].to_numpy(), COORDINATES["lat"]), "lon": (["location"], places["lon"].to_numpy(), COORDINATES["lon"]), "gpi": (["location"], places["gpi"].to_numpy(float), {})}
    out = {}
    for v in variables:
        cube = np.full((len(times), *space), np.nan)
        cube[(step, *at)] = frame[v].to_numpy(float)
        cube, names = (np.moveaxis(cube, 0, -1), [*dims, "time"]) if time_last else (cube, ["time", *dims])
        if not with_time:
            cube, names = cube[..., 0] if time_last else cube[0], list(dims)
        out[v] = (names, cube, attrs.get(v, {}))
    if with_time:
        seconds = (times - np.datetime64("1970-01-01")) / np.timedelta64(1, "s")
        coords["time"] = (["time"], seconds, COORDINATES["time"] | {"units": "seconds since 1970-01-01"})
    return encoded(({"time": len(times)} if with_time else {}) | dims, coords | out)


def write_netcdf_series(obs: DataFrame, variables: list[str], folder: str, name: str = "series") -> DataFrame:
    """The transposed stack as NetCDF: one file per cell with time as the last dimension; returns (cell, file, bytes).  ``obs``
    needs cell, gpi, lat, lon and time; a cell is what one task holds, so its size bounds the memory."""
    attrs = {v: {k: x for k, x in a.items() if isinstance(x, str | int | float)} for v, a in attributes_of(obs).items()}

    def save(frame: pd.DataFrame) -> pd.DataFrame:
        cell = int(frame["cell"].iloc[0])
        content = _netcdf(frame, variables, attrs, True)
        stored(f"{folder}/{name}_{cell:04d}.nc", content)
        return pd.DataFrame({"cell": [cell], "file": [f"{folder}/{name}_{cell:04d}.nc"], "bytes": [len(content)]})

    return cut(obs.where("time IS NOT NULL").select("cell", "gpi", "lat", "lon", "time", *variables).groupBy("cell").applyInPandas(save, "cell int, file string, bytes long"), "written")


def _image_names(obs: DataFrame, stepsize: int, fmt: str) -> DataFrame:
    """Rows with the name of their file in ``image``: the first of ``stepsize`` consecutive times."""
    if stepsize == 1:
        return obs.withColumn("image", F.date_format("time", fmt))
    times = obs.select("time").distinct().withColumn("one", F.lit(1))
    step = F.floor((F.row_number().over(Window.partitionBy("one").orderBy("time")) - 1) / stepsize)  # one row per image time
    named = times.withColumn("step", step).withColumn("first", F.min("time").over(Window.partitionBy("step"))).select("time", F.date_format("first", fmt).alias("image"))
    return obs.join(named, "time")


def write_netcdf_images(obs: DataFrame, variables: list[str], folder: str, name: str, fmt: str = "%Y%m%dT%H%M", stepsize: int = 1, include_time: bool = True, north_first: bool = False, memory_gb: float | None = None) -> DataFrame:
    """One NetCDF file for every ``stepsize`` times, ``{name}_{time}.nc`` by the first of them; returns (file, bytes, pixels).
    Attributes on the columns go along, coordinates get theirs.  An image is what one task holds; files without their time
    hold one.  With ``memory_gb`` a file holds no more images than fit in it."""
    if memory_gb is not None:
        stepsize = min(stepsize, images_in(memory_gb, (obs.select("gpi").distinct().count() or 1,), 8, len(variables)))
    if not include_time and stepsize != 1:
        raise EngineError("only files of one time can leave it out")
    attrs = {v: {k: x for k, x in a.items() if isinstance(x, str | int | float)} for v, a in attributes_of(obs).items()}

    def save(frame: pd.DataFrame) -> pd.DataFrame:
        file = f"{folder}/{name}_{frame['image'].iloc[0]}.nc"
        content = _netcdf(frame, variables, attrs, False, north_first, include_time)
        stored(file, content)
        return pd.DataFrame({"file": [file], "bytes": [len(content)], "pixels": [len(frame)]})

    rows = _image_names(obs.where("time IS NOT NULL").select("gpi", "lat", "lon", "time", *variables), stepsize, strptime_parts(fmt)[1])
    return cut(rows.groupBy("image").applyInPandas(save, "file string, bytes long, pixels long"), "written")


def write_images(obs: DataFrame, path: str, fmt: str = "yyyyMMdd'T'HHmm", stepsize: int = 1, include_time: bool = True, north_first: bool = False) -> None:
    """Images by file: ``path/image=<time>/``; ``stepsize`` consecutive times share a folder named by the first."""
    rows = _image_names(obs, stepsize, fmt)
    order = [F.col("lat").desc(), F.col("lon")] if north_first else [F.col("gpi")]
    rows = rows.hint("rebalance", "image").sortWithinPartitions("image", "time", *order)
    (rows if include_time else rows.drop("time")).write.mode("overwrite").partitionBy("image").parquet(path)


def series_file(name: str, gpi: int, lat: float, lon: float) -> str:
    """The file name of a series."""
    return f"{name}_gpi={gpi}_lat={lat}_lon={lon}.csv"


def write_csv_series(obs: DataFrame, folder: str, name: str, variables: list[str]) -> DataFrame:
    """One CSV file per gpi in a folder all tasks share; returns (gpi, file, rows).  Each series is written by one task."""

    def save(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        file = f"{folder}/{series_file(name, int(first.gpi), float(first.lat), float(first.lon))}"
        stored(file, pdf.sort_values("time").set_index("time")[variables].to_csv().encode())
        return pd.DataFrame({"gpi": [int(first.gpi)], "file": [file], "rows": [len(pdf)]})

    return cut(obs.select("gpi", "lat", "lon", "time", *variables).groupBy("gpi").applyInPandas(save, "gpi long, file string, rows long"), "written")


def _zipped(folder: str, name: str, variables: list[str]):
    """A task's rows in the order of (gpi, time) into an archive of its own, series by series, so no more than one is held."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, target = TaskContext.get().partitionId(), f"{folder}/{uuid.uuid4().hex}.part"
        with tempfile.TemporaryFile() as f:
            files, held = 0, []

            def close(z: zipfile.ZipFile) -> None:
                table = pd.concat(held) if len(held) > 1 else held[0]
                first = table.iloc[0]
                z.writestr(series_file(name, int(first.gpi), float(first.lat), float(first.lon)), table.set_index("time")[variables].to_csv())

            with zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:
                for batch in batches:
                    for _, rows in batch.groupby("gpi", sort=False):
                        if held and held[-1]["gpi"].iloc[0] != rows["gpi"].iloc[0]:
                            close(z)
                            files, held = files + 1, []
                        held.append(rows)
                if held:
                    close(z)
                    files += 1
            f.seek(0)
            if files:
                stored(target, f)
        yield pd.DataFrame({"part": [part], "file": [target], "series": [files]})

    return run


def _joined(target: str, parts: list[str], metadata: str):
    """Archives into one: their files are copied as they lie there, compressed, and listed once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            with tempfile.TemporaryFile() as f:
                with zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:
                    for part in parts:
                        system, place = located(part)
                        with system.open_input_file(place) as source, zipfile.ZipFile(source) as own:
                            begin, left = f.tell(), own.start_dir
                            source.seek(0)
                            while left:
                                f.write(piece := source.read(min(left, 1 << 20)))
                                left -= len(piece)
                            for info in own.infolist():
                                info.header_offset += begin
                                z.filelist.append(info)
                                z.NameToInfo[info.filename] = info
                        z.start_dir = f.tell()
                    z.writestr("metadata.yml", metadata)
                f.seek(0)
                stored(target, f)
            yield batch

    return run


def write_csv_dataset(
    obs: DataFrame, folder: str, name: str, variables: list[str], metadata: dict | None = None, stations: DataFrame | None = None, radius_km: float = 2.0, only: list[tuple[float, float]] | None = None
) -> str:
    """A zip of CSV series with metadata.yml; with ``stations``, or ``only`` some places, the series near one (ids keep their
    numbers).  Tasks compress the series, in the order of gpi; one joins what they wrote into the archive, which is one file."""
    if stations is not None or only is not None:
        kept = target_points(obs.select("gpi", "lat", "lon").distinct(), stations, only, radius_km)
        obs = obs.join(kept.select("gpi"), "gpi", "left_semi")
    target = f"{folder}/{name}.zip"
    text = "".join(f"{json.dumps(str(k))}: {json.dumps(v, default=str)}\n" for k, v in (metadata or {}).items())  # JSON is YAML
    parts = f"{folder}/.{name}-{uuid.uuid4().hex}"
    rows = obs.select("gpi", "lat", "lon", "time", *variables).repartitionByRange("gpi").sortWithinPartitions("gpi", "time")
    made = sorted((r.part, r.file) for r in rows.mapInPandas(_zipped(parts, name, variables), "part int, file string, series long").where("series > 0").collect())
    if not made:
        raise EngineError("no series to write")
    obs.sparkSession.range(0, 1, 1, 1).mapInPandas(_joined(target, [file for _, file in made], text), "id long").collect()
    system, place = located(parts)
    system.delete_dir(place)
    return target


def write_ragged(obs: DataFrame, path: str, stations: DataFrame | None = None, radius_km: float = 2.0, cellsize: float | None = None, only: list[tuple[float, float]] | None = None) -> DataFrame:
    """Series with their own times by cell; with ``stations`` (or places in ``only``) those near one, and at least one is
    required."""
    points = target_points(obs.select("gpi", "lat", "lon").distinct(), stations, only, radius_km)
    if points.isEmpty():
        raise EngineError("no series near a station")
    return write_cells(obs.drop("lat", "lon"), points, path, overwrite=True, cellsize=cellsize)


def write_netcdf_ragged(obs: DataFrame, variables: list[str], folder: str, name: str = "ragged") -> DataFrame:
    """Series with their own times as contiguous ragged arrays, one NetCDF file per cell; returns (cell, file, bytes).  ``obs`` needs
    cell, gpi, lat, lon and time; a cell is what one task holds."""
    attrs = {v: {k: x for k, x in a.items() if isinstance(x, str | int | float)} for v, a in attributes_of(obs).items()}

    def save(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["gpi", "time"])
        places = frame.groupby("gpi", sort=True).agg(lat=("lat", "first"), lon=("lon", "first"), n=("lat", "size"))
        seconds = (frame["time"].to_numpy() - np.datetime64("1970-01-01")) / np.timedelta64(1, "s")
        content = encoded({"locations": len(places), "obs": len(frame)}, {
            "location_id": (["locations"], places.index.to_numpy(float), {}), "lat": (["locations"], places["lat"].to_numpy(), COORDINATES["lat"]), "lon": (["locations"], places["lon"].to_numpy(), COORDINATES["lon"]),
            "row_size": (["locations"], places["n"].to_numpy("i4"), {"sample_dimension": "obs"}), "time": (["obs"], seconds, COORDINATES["time"] | {"units": "seconds since 1970-01-01"}),
            **{v: (["obs"], frame[v].to_numpy(float), attrs.get(v, {})) for v in variables},
        })
        cell = int(frame["cell"].iloc[0])
        stored(f"{folder}/{name}_{cell:04d}.nc", content)
        return pd.DataFrame({"cell": [cell], "file": [f"{folder}/{name}_{cell:04d}.nc"], "bytes": [len(content)]})

    return cut(obs.where("time IS NOT NULL").select("cell", "gpi", "lat", "lon", "time", *variables).groupBy("cell").applyInPandas(save, "cell int, file string, bytes long"), "written")


def export_sensors(classified: DataFrame, stations: DataFrame, path: str) -> None:
    """Classified sensors with their station columns as one ``;`` CSV (a table of thousands of rows at most)."""
    classified.drop("criterion").join(stations, "idx").coalesce(1).write.mode("overwrite").option("sep", ";").option("header", "true").csv(path)


def export_qualified(results: DataFrame, path: str, fields: dict[str, str] | None = None, others: tuple[str, ...] = (), **limits) -> DataFrame:
    """From a triple-collocation result to its sensor file (``;`` CSV, without the criterion); returns the number of sensors by
    class and criterion, which is what a plot of them shows."""
    found = qualified(results, fields, others, **limits)
    keep = tuple(c for c in ("lat", "lon") if c in others)
    labelled(found, keep).drop("criterion").coalesce(1).write.mode("overwrite").option("sep", ";").option("header", "true").csv(path)
    return class_counts(found)
