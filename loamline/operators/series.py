"""Time series by location."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamline.functions.cf import attributes_of
from loamline.functions.times import absolute_time, shifted
from loamline.operators.grid import nearest_point
from loamline.operators.images import in_period
from loamline.session import EngineError


def correct_time(df: DataFrame, absolute: str | None = None, unit: str = "seconds", epoch: str = "1970-01-01", offset: str | None = None, offset_unit: str = "seconds") -> DataFrame:
    """``time`` replaced by an absolute time variable, then shifted by an offset variable; both are dropped.  Rows whose
    absolute time or offset is missing get a NULL time."""
    if absolute:
        df = df.withColumn("time", absolute_time(F.col(absolute), unit, epoch)).drop(absolute)
    if offset:
        df = df.withColumn("time", shifted(F.col("time"), F.col(offset), F.lit(offset_unit))).drop(offset)
    return df


def read_gpi(df: DataFrame, gpi: int, period: tuple[str, str] | None = None) -> DataFrame:
    """The series of one grid point in time order, optionally of a period."""
    out = df.where(F.col("gpi") == gpi)
    return (in_period(out, *period) if period else out).orderBy("time")


def read_place(grid: DataFrame, lat: float, lon: float, max_km: float | None = None) -> int:
    """The grid point nearest to a place; an error if none lies within ``max_km``."""
    place = grid.sparkSession.createDataFrame([(0, float(lat), float(lon))], "id long, lat double, lon double")
    hit = nearest_point(place, grid, "id", max_km).first()
    if hit is None:
        raise EngineError(f"no grid point near {lat}, {lon}")
    return hit.gpi


def read_near(df: DataFrame, grid: DataFrame, lat: float, lon: float, max_km: float | None = None) -> DataFrame:
    """The series of the grid point nearest to a place; an error if none lies within ``max_km``.  Any grid type will do."""
    return read_gpi(df, read_place(grid, lat, lon, max_km))


def read_exact(df: DataFrame, grid: DataFrame, lat: float, lon: float) -> DataFrame:
    """The series at exactly these coordinates; an error if the grid does not have them."""
    hit = grid.where((F.col("lat") == lat) & (F.col("lon") == lon)).select("gpi").first()
    if hit is None:
        raise EngineError(f"{lat}, {lon} is no grid point")
    return read_gpi(df, hit.gpi)


def transposed(df: DataFrame, variables: list[str]) -> DataFrame:
    """One row per gpi with its series as an array in time order (for export; tables stay long otherwise).  The array
    grows with the number of times of one location."""
    return df.groupBy("gpi").agg(F.array_sort(F.collect_list(F.struct("time", *variables))).alias("series"))


def swath_to_grid(orbit: DataFrame, grid: DataFrame, keys: tuple[str, ...] = ("gpi",), keep_grid: bool = False) -> DataFrame:
    """Orbit rows at their grid points by gpi, or by row and column: rows without a grid point are dropped; with
    ``keep_grid`` grid points without a row stay, their values NULL."""
    columns = [c for c in orbit.columns if c not in grid.columns or c in keys]
    return grid.join(orbit.select(*columns), list(keys), "left" if keep_grid else "inner")


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the last one in the given order; of rows with equal order the one with the greater values, column
    by column.  NULL orders come first."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max(F.struct(F.struct(*order).alias("_order"), *rest)).alias("_r")).select(*keys, *(F.col("_r")[c].alias(c) for c in rest))


class SeriesSource:
    """Series of one kind by grid point: ``table()`` is all of them, ``grid()`` their places.  A source of one's own brings these
    two and, if its tables can do it faster, ``of(gpi)``; reading by place, period and coordinates follows."""

    def table(self) -> DataFrame:
        raise EngineError(f"{type(self).__name__} brings no table")

    def grid(self) -> DataFrame:
        return self.table().select("gpi", "lat", "lon").distinct()

    def of(self, gpi: int) -> DataFrame:
        return self.table().where(F.col("gpi") == gpi)

    def attributes(self) -> dict[str, dict]:
        return attributes_of(self.table())

    def read(self, *place: float, period: tuple[str, str] | None = None, max_km: float | None = None) -> DataFrame:
        """The series of a gpi, or of the grid point nearest to (lat, lon), in time order."""
        if len(place) == 1:
            out = self.of(int(place[0]))
            return (in_period(out, *period) if period else out).orderBy("time")
        return self.read(read_place(self.grid(), *place, max_km=max_km), period=period)


class StoredSeries(SeriesSource):
    """Series by cell as ``write_cells`` leaves them; a gpi reads its cell only."""

    def __init__(self, cells: DataFrame, points: DataFrame):
        self.cells, self.points = cells, points

    def table(self) -> DataFrame:
        return self.cells

    def grid(self) -> DataFrame:
        return self.points

    def of(self, gpi: int) -> DataFrame:
        hit = self.points.where(F.col("gpi") == gpi).select("cell").first()
        out = self.cells.where(F.col("gpi") == gpi)
        return out.where(F.col("cell") == hit.cell) if hit else out.limit(0)
