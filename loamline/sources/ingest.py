"""Uploaded files into series by cell."""

from __future__ import annotations

import re
import zipfile

from pyspark.sql import DataFrame, SparkSession

from loamline.functions.cf import time_of
from loamline.operators.grid import infer_cellsize, with_cells, within_box
from loamline.operators.uploads import Variable, data_names, upload_kind
from loamline.session import EngineError
from loamline.sources import netcdf3
from loamline.sources.files import fetched, located, stored
from loamline.sources.readers import read_stacks, read_zipped_table
from loamline.sources.writers import write_by_cell, write_cells


def netcdf_stack(spark: SparkSession, path: str, variables: list[str] | None = None) -> DataFrame:
    """One NetCDF file with (time, y, x) variables as rows time, gpi, lat, lon and the variables, read by a task; regular,
    curvilinear and (time, location) grids are recognised by the coordinates' dimensions.  The driver sees its header only to
    name the variables."""
    if not variables:
        nc = netcdf3.opened(fetched(path))
        dims = {n: nc.dim_names(n) for n in nc.variables}
        time = time_of({n: v.attrs for n, v in nc.variables.items()}, dims)
        variables = data_names({n: Variable(d) for n, d in dims.items()}) or [n for n, d in dims.items() if d and d[0] == dims[time][0] and n != time]
    return read_stacks(spark, path, variables, "*").drop("path")


def ingest_upload(spark: SparkSession, path: str, out: str, most_gb: float = 30) -> DataFrame | str:
    """An upload into series by cell below ``out``: a NetCDF stack, or a zip of CSV series; a zip of finished NetCDF series
    is unpacked flat and its folder returned.  The upload itself is never changed."""
    low = path.lower()
    if low.endswith((".nc", ".nc4")):
        stack = netcdf_stack(spark, path)
        grid = with_cells(stack.select("gpi", "lat", "lon").distinct())
        return write_cells(stack.drop("lat", "lon"), grid, out, overwrite=True)
    if not low.endswith(".zip"):
        raise EngineError("an upload is .nc, .nc4 or .zip")
    system, name = located(path)
    with system.open_input_file(name) as source_file, zipfile.ZipFile(source_file) as z:  # only its directory is read
        infos = [i for i in z.infolist() if not i.is_dir()]
        if upload_kind([i.filename for i in infos], [i.file_size for i in infos], most_gb) == "netcdf":
            for i in infos:
                if i.filename.lower().endswith((".nc", ".nc4")):
                    stored(f"{out}/{i.filename.rsplit('/', 1)[-1]}", z.read(i))
            return out
    table, names = read_zipped_table(spark, path)
    if not names:
        raise EngineError("the archive holds no numbers")
    wide = table.toDF("gpi", "lat", "lon", "time", *(re.sub(r"[ ,;{}()\n\t=]", "_", n) for n in names))
    size = infer_cellsize(wide.select("gpi", "lat", "lon").distinct())
    return write_by_cell(with_cells(wide.where("time IS NOT NULL"), size).drop("lat", "lon"), out)


def reshuffle(obs: DataFrame, grid: DataFrame, out: str, start=None, end=None, lon_min: float = -180, lat_min: float = -90, lon_max: float = 180, lat_max: float = 90) -> DataFrame:
    """Images of a box into series by cells of five degrees."""
    return write_cells(obs.drop("lat", "lon"), within_box(grid, lon_min, lat_min, lon_max, lat_max).drop("cell"), out, start, end, overwrite=True, cellsize=5)
