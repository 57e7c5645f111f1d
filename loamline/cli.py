"""Command line: images to series by cell, to one array per location, or to image files of other times."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamline.operators import swath
from loamline.operators.grid import coord_range, grid_from_dims, grid_from_points, land_only, on_land, with_cells, within_box
from loamline.operators.images import daily_mean, in_time, with_landmask, without_fill
from loamline.operators.series import correct_time
from loamline.session import EngineError, build_session, purge
from loamline.sources.openers import StackOpener
from loamline.sources.readers import mask_of, read_images, read_stack, read_stacks
from loamline.sources.writers import write_cells, write_netcdf_images, write_netcdf_series, write_transposed


def pairs(values: list[str] | None) -> dict[str, str]:
    """``a:b`` arguments as a mapping."""
    out = {}
    for v in values or []:
        if v.count(":") != 1:
            raise EngineError(f"{v} is not of the form a:b")
        a, b = v.split(":")
        out[a] = b
    return out


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loamline", description=__doc__)
    p.add_argument("command", choices=["repurpose", "transpose", "images"])
    p.add_argument("input_root", help="folder of image files or NetCDF stacks, or a Parquet stack")
    p.add_argument("output_root")
    p.add_argument("start")
    p.add_argument("end")
    p.add_argument("--parameter", nargs="+", required=True)
    p.add_argument("--pattern", default="*.nc")
    p.add_argument("--time_fmt", default=None, help="the images' times are in their names; without it NetCDF files bring their own")
    p.add_argument("--time_regex_pattern", default=None)
    p.add_argument("--timestamps", nargs="+", type=float, metavar="HOURS", help="hours from a file's time to each of its steps")
    p.add_argument("--latname"), p.add_argument("--lonname"), p.add_argument("--timename")
    p.add_argument("--timevarname", help="a variable with the exact time"), p.add_argument("--timevarunit", default="seconds since 1970-01-01")
    p.add_argument("--timeoffsetvarname", help="a variable to add to the time"), p.add_argument("--timeoffsetunit", default="seconds")
    p.add_argument("--grid", default=None, help="Parquet table of the grid (gpi, lat, lon[, is_land])")
    p.add_argument("--landmask", default=None, help="Parquet table (gpi, is_land), or file:variable of a NetCDF file")
    p.add_argument("--average", choices=["daily"], default=None)
    p.add_argument("--bbox", nargs=4, type=float, metavar=("min_lon", "min_lat", "max_lon", "max_lat"))
    p.add_argument("--lat", nargs=3, type=float, metavar=("start", "stop", "step"), help="latitudes of a regular grid, with --lon")
    p.add_argument("--lon", nargs=3, type=float, metavar=("start", "stop", "step"))
    p.add_argument("--level", nargs="+", help="variable:index")
    p.add_argument("--rename", nargs="+", help="old:new")
    p.add_argument("--fill_value", type=float, default=None)
    p.add_argument("--skip_missing", action="store_true", help="variables that the images lack are left out")
    p.add_argument("--cellsize", type=float, default=None)
    p.add_argument("--files_per_cell", type=int, default=None)
    p.add_argument("--overwrite", action="store_true")
    p.add_argument("--append", action="store_true")
    p.add_argument("--only_land", action="store_true")
    p.add_argument("--netcdf", action="store_true", help="transpose: one NetCDF file per cell")
    p.add_argument("--stepsize", type=int, default=1, help="images: times in a file"), p.add_argument("--memory", type=float, default=None, help="images: GB that a file may take")
    p.add_argument("--mission", choices=sorted(swath.MISSIONS), help="the input is a table of orbit rows; needs --grid")
    p.add_argument("--add_overpass_flag", action="store_true")
    return p


def _swath(spark, a: argparse.Namespace) -> int:
    """Orbit rows to series by cell, each row under its own acquisition time."""
    if not a.grid:
        raise EngineError("orbit rows need a grid table")
    grid, orbit = spark.read.parquet(a.grid), spark.read.parquet(a.input_root)
    rows = swath.smos_rows(orbit, a.add_overpass_flag) if a.mission == "smos" else swath.smap_rows(orbit)
    names = [*a.parameter, *(["Overpass"] if a.add_overpass_flag and a.mission == "smos" else [])]
    points = within_box(grid, *a.bbox) if a.bbox else grid
    obs = swath.on_grid(rows, points, a.mission, a.only_land).select("gpi", "time", *names)
    out = write_cells(obs, points if "cell" in points.columns else with_cells(points, a.cellsize), a.output_root, a.start, a.end, a.overwrite, a.append, files_per_cell=a.files_per_cell)
    print(f"{out.count()} rows below {a.output_root}")
    return 0


def _observed(spark, a: argparse.Namespace) -> DataFrame:
    """The images as rows: by file name, from NetCDF stacks, or from a Parquet stack."""
    rename, levels = pairs(a.rename), {k: int(v) for k, v in pairs(a.level).items()}
    times = [n for n in (a.timevarname, a.timeoffsetvarname) if n]
    wanted = [*a.parameter, *times]
    if a.time_fmt:
        offsets = [round(h * 3600) for h in a.timestamps] if a.timestamps else None
        obs = read_images(spark, a.input_root, wanted, a.time_fmt, a.pattern, a.time_regex_pattern, None, rename, levels or None, a.fill_value, a.skip_missing, a.start, a.end, offsets)
    elif not exists_parquet(spark, a.input_root):
        back = {new: old for old, new in rename.items()}
        obs = read_stacks(spark, a.input_root, [back.get(v, v) for v in wanted], a.pattern, StackOpener(a.latname, a.lonname, a.timename)).drop("path").withColumnsRenamed(rename)
        obs = obs if a.fill_value is None else without_fill(obs, a.fill_value, a.parameter)
    else:
        obs = read_stack(spark, a.input_root, wanted, rename)
    if times:
        unit, _, epoch = a.timevarunit.partition(" since ")
        obs = correct_time(obs, a.timevarname, unit, epoch or "1970-01-01", a.timeoffsetvarname, a.timeoffsetunit)
    return obs


def exists_parquet(spark, folder: str) -> bool:
    """Whether a folder holds a Parquet table."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/*.parquet")
    return bool(len(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)))


def _grid(spark, a: argparse.Namespace, obs: DataFrame) -> DataFrame:
    if a.grid:
        grid = spark.read.parquet(a.grid)
    elif a.lat and a.lon:
        grid = grid_from_dims(coord_range(spark, *a.lat, "lat"), coord_range(spark, *a.lon, "lon"))
    elif {"lat", "lon"} <= set(obs.columns):
        grid = obs.select("lat", "lon").distinct() if "gpi" not in obs.columns else obs.select("gpi", "lat", "lon").distinct()
        grid = grid if "gpi" in grid.columns else grid_from_points(grid, ["lat", "lon"])
    else:
        raise EngineError("name a grid table, or --lat and --lon: the images have no coordinates")
    if a.landmask:
        grid = with_landmask(grid, mask_of(spark, a.landmask) if ":" in a.landmask.rsplit("/", 1)[-1] else spark.read.parquet(a.landmask))
    if a.only_land:
        grid = on_land(grid)
    return within_box(grid, *a.bbox) if a.bbox else grid


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = build_session("loamline-cli")
    if a.mission:
        return _swath(spark, a)
    obs = _observed(spark, a)
    grid, names = _grid(spark, a, obs), [v for v in a.parameter if v in obs.columns]
    if a.landmask:
        masked = obs.join(grid.select("gpi", "is_land"), "gpi")
        obs = masked.withColumns({v: land_only(F.col(v), F.col("is_land")) for v in names}).drop("is_land")
    if a.average:
        obs = daily_mean(obs, names)
    obs = obs.drop("lat", "lon", "slot")
    cells = grid if "cell" in grid.columns else with_cells(grid, a.cellsize)
    if a.command == "repurpose":
        out = write_cells(obs, cells, a.output_root, a.start, a.end, a.overwrite, a.append, files_per_cell=a.files_per_cell)
        print(f"{out.count()} rows below {a.output_root}")
    else:
        placed = in_time(obs, a.start, a.end).drop("cell").join(cells.select("gpi", "cell", "lat", "lon"), "gpi")
        if a.command == "images":
            print(f"{write_netcdf_images(placed, names, a.output_root, 'images', stepsize=a.stepsize, memory_gb=a.memory).count()} files below {a.output_root}")
        elif a.netcdf:
            print(f"{write_netcdf_series(placed, names, a.output_root).count()} files below {a.output_root}")
        else:
            write_transposed(placed, names, a.output_root)
    purge(spark)
    return 0


if __name__ == "__main__":
    sys.exit(main())
