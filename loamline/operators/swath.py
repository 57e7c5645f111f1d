"""Orbit swaths of the two soil-moisture missions, after their files have been read into rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamline.functions.missing import nan_to_null, present
from loamline.functions.times import orbit_seconds, overpass_code, plus_seconds, time_in_name
from loamline.operators.readings import EPOCH
from loamline.operators.series import swath_to_grid
from loamline.session import EngineError

#: Meaning of attributes and patterns of file names.
SMOS_NAME = (r"SM(?:_[A-Z]{4})?_MIR_SMUDP2_([0-9T]+)_.*\.nc", "%Y%m%dT%H%M%S")
SMAP_NAME = (r"SMAP_L2_SM_P_[0-9]+_[AD]+_([0-9T]+)_R.*\.h5", "%Y%m%dT%H%M%S")
SMAP_ATTRIBUTES = {"soil_moisture": {"units": "m3/m3", "valid_min": "0.02", "valid_max": "0.5"}, "quality_flag": {"flag_masks": "1,2,4,8"}, "acquisition_time": {"units": "seconds since 2000-01-01 12:00"}}
SMOS_ATTRIBUTES = {"acquisition_time": {"units": "seconds since 2000-01-01 00:00"}, "Overpass": {"flag_values": "0,1,2", "flag_meanings": "missing,ascending,descending"}}


def smos_rows(orbit: DataFrame, add_overpass: bool = False) -> DataFrame:
    """SMOS rows with ``acquisition_time`` (seconds since 2000-01-01, 0 is missing) instead of Days and Seconds, and, if
    wanted, ``Overpass`` from the orbit's Ascending_Flag."""
    df = nan_to_null(orbit).withColumn("acquisition_time", orbit_seconds(F.col("Days"), F.col("Seconds")).cast("double")).drop("Days", "Seconds")
    if add_overpass:
        if "Ascending_Flag" not in df.columns:
            raise EngineError("the rows carry no Ascending_Flag")
        df = df.withColumn("Overpass", overpass_code(F.col("Ascending_Flag"), F.col("Soil_Moisture")))
    return df


def smap_rows(orbit: DataFrame) -> DataFrame:
    """SMAP rows with -9999 and NaN as NULL in every number but the indices."""
    return orbit.select(*(present(F.col(c).cast("double"), -9999.0).alias(c) if t in ("double", "float") else F.col(c) for c, t in orbit.dtypes))


def on_grid(rows: DataFrame, grid: DataFrame, mission: str, only_land: bool = False) -> DataFrame:
    """Prepared swath rows at their grid points, with ``time`` from acquisition_time; rows off the grid or without a time are gone.
    SMOS joins by gpi, SMAP by row and column; nothing is densified to the global grid."""
    return replace(MISSIONS[mission], prepare=lambda df: df).series(rows, grid, only_land)


def orbit_time(name: Column, mission: str) -> Column:
    """The sensing start in a swath file's name."""
    return MISSIONS[mission].time_of(name)


def inside_valid_range(df: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """Values outside their declared valid range as NULL; opt-in, no source does it by itself."""
    return df.withColumns({c: F.when(F.col(c).between(*r), F.col(c)) for c, r in ranges.items()})


@dataclass(frozen=True)
class Mission:
    """What a swath product brings: how its files are named, how its rows are prepared, where its times begin, and by which
    columns its rows meet a grid.  A product of one's own is another instance."""

    name: tuple[str, str]
    epoch: int
    keys: tuple[str, ...]
    prepare: Callable[[DataFrame], DataFrame]
    attributes: dict[str, dict[str, str]]

    def series(self, rows: DataFrame, grid: DataFrame, only_land: bool = False) -> DataFrame:
        """Prepared rows at their grid points with ``time``; rows off the grid or without a time are gone."""
        points = grid.where("is_land") if only_land else grid
        joined = swath_to_grid(self.prepare(rows), points, self.keys)
        at = plus_seconds(F.lit("1970-01-01").cast("timestamp_ntz"), present(F.col("acquisition_time")) + self.epoch)
        return joined.withColumn("time", at).where("time IS NOT NULL")

    def time_of(self, name: Column) -> Column:
        """The sensing start in a file's name."""
        return time_in_name(name, self.name[1], self.name[0])


MISSIONS = {
    "smos": Mission(SMOS_NAME, EPOCH["smos"], ("gpi",), smos_rows, SMOS_ATTRIBUTES),
    "smap": Mission(SMAP_NAME, EPOCH["smap"], ("row_idx", "col_idx"), smap_rows, SMAP_ATTRIBUTES),
}
