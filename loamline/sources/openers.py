"""What turns one image file into rows, in a task: NetCDF (classic and HDF5-based) and CSV.  Other formats bring an opener of their own.

An opener has ``names(content)``, the variables a file offers, and ``rows(content, variables)``, batches with ``slot`` (the
time step in the file), ``gpi`` and the variables; with ``time`` among them the file's own time counts.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa

from loamline.functions.cf import coordinate_of, time_of
from loamline.functions.instants import unit_epoch
from loamline.session import EngineError
from loamline.sources import netcdf3


def _columns(slot: int, gpi: np.ndarray, values: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(gpi), slot), pa.int32()), pa.array(gpi, pa.int64()), *(pa.array(v.astype(float), from_pandas=True) for v in values.values())], names=["slot", "gpi", *values])


def file_times(nc, name: str | None = None) -> np.ndarray:
    """The times of a file as microseconds since 1970-01-01 UTC."""
    name = name or time_of({n: v.attrs for n, v in nc.variables.items()}, {n: nc.dim_names(n) for n in nc.variables})
    scale = unit_epoch(nc.variables[name].attrs.get("units", ""))
    if scale is None:
        raise EngineError(f"{name} has no unit of time since a date")
    return np.round((netcdf3.decoded(nc, name).reshape(-1) * scale[0] + scale[1]) * 1000).astype(np.int64)


def single_time(times: np.ndarray) -> int:
    """The only time of an image file; none or several are an error."""
    if len(times) != 1:
        raise EngineError(f"an image file holds exactly one time, not {len(times)}")
    return int(times[0])


@dataclass(frozen=True)
class NetCdfOpener:
    """NetCDF, classic or HDF5-based, and HDF5.  ``flip`` numbers pixels from the bottom row; ``own_time`` takes the one time of the file itself."""

    flip: bool = False
    own_time: bool = False

    def names(self, content: bytes) -> list[str]:
        nc = netcdf3.opened(content)
        return [n for n, v in nc.variables.items() if v.dims and n not in nc.dim_names(n) and " since " not in str(v.attrs.get("units", ""))]

    def rows(self, content: bytes, variables: list[str]) -> Iterator[pa.RecordBatch]:
        time = single_time(file_times(netcdf3.opened(content))) if self.own_time else None
        for slot, lo, values in netcdf3.images(content, variables, self.flip):
            out = _columns(slot, np.arange(lo, lo + len(values[0])), dict(zip(variables, values, strict=True)))
            yield out if time is None else out.append_column("time", pa.repeat(pa.scalar(time, pa.timestamp("us")), out.num_rows))


@dataclass(frozen=True)
class CsvOpener:
    """CSV with a header line, one row per pixel; without a ``gpi`` column rows are numbered.  What is no number is missing."""

    sep: str = ","

    def names(self, content: bytes) -> list[str]:
        return [c for c in pd.read_csv(io.BytesIO(content), sep=self.sep, nrows=0).columns if c != "gpi"]

    def rows(self, content: bytes, variables: list[str]) -> Iterator[pa.RecordBatch]:
        table = pd.read_csv(io.BytesIO(content), sep=self.sep, dtype=str)
        gpi = pd.to_numeric(table["gpi"], errors="coerce") if "gpi" in table else pd.Series(np.arange(len(table)))
        kept = gpi.notna()
        yield _columns(0, gpi[kept].to_numpy(np.int64), {v: pd.to_numeric(table[v], errors="coerce")[kept].to_numpy(float) if v in table else np.full(kept.sum(), np.nan) for v in variables})


@dataclass(frozen=True)
class StackOpener:
    """A NetCDF stack with coordinates: each row has its own time, lat and lon; regular, curvilinear and (time, location)
    grids are recognised by the coordinates' dimensions.  Names that are given count, else metadata decide."""

    lat: str | None = None
    lon: str | None = None
    time: str | None = None

    def rows(self, content: bytes, variables: list[str]) -> Iterator[pa.RecordBatch]:
        nc = netcdf3.opened(content)
        attrs = {n: v.attrs for n, v in nc.variables.items()}
        lat, lon = self.lat or coordinate_of(attrs, "latitude"), self.lon or coordinate_of(attrs, "longitude")
        a, o = netcdf3.decoded(nc, lat), netcdf3.decoded(nc, lon)
        if a.ndim == 1 and nc.dim_names(lat) != nc.dim_names(lon):
            a, o = np.meshgrid(a, o, indexing="ij")
        a, o, times = a.reshape(-1), o.reshape(-1), file_times(nc, self.time)
        axis = nc.dim_names(self.time or time_of(attrs, {n: nc.dim_names(n) for n in nc.variables}))[0]
        cubes = [np.moveaxis(netcdf3.decoded(nc, v), nc.dim_names(v).index(axis), 0).reshape(len(times), -1) for v in variables]
        for step, time in enumerate(times):
            for lo in range(0, len(a), netcdf3.PIXELS_AT_ONCE):
                part = slice(lo, lo + netcdf3.PIXELS_AT_ONCE)
                n = len(a[part])
                columns = [pa.repeat(pa.scalar(int(time), pa.timestamp("us")), n), pa.array(np.arange(lo, lo + n)), pa.array(a[part], from_pandas=True), pa.array(o[part], from_pandas=True), *(pa.array(c[step, part], from_pandas=True) for c in cubes)]
                yield pa.RecordBatch.from_arrays(columns, names=["time", "gpi", "lat", "lon", *variables])


@dataclass(frozen=True)
class RaggedOpener:
    """Series of their own times one after the other (contiguous ragged arrays): ``row_size`` says how many values a location
    has, ``location_id`` (or gpi) which one it is."""

    def rows(self, content: bytes, variables: list[str]) -> Iterator[pa.RecordBatch]:
        nc = netcdf3.opened(content)
        attrs = {n: v.attrs for n, v in nc.variables.items()}
        sizes = nc.array("row_size").astype(np.int64).reshape(-1)
        if (sizes < 0).any() or sizes.sum() != len(nc.array(variables[0]).reshape(-1)):
            raise EngineError("row_size does not add up to the values")
        ids = nc.array("location_id" if "location_id" in nc.variables else "gpi").astype(np.int64).reshape(-1)
        whose = np.repeat(np.arange(len(sizes)), sizes)
        lat, lon = (netcdf3.decoded(nc, coordinate_of({n: a for n, a in attrs.items() if n in ("lat", "lon", "latitude", "longitude")}, k)).reshape(-1) for k in ("latitude", "longitude"))
        times = file_times(nc, "time")
        values = [netcdf3.decoded(nc, v).reshape(-1) for v in variables]
        for lo in range(0, len(whose), netcdf3.PIXELS_AT_ONCE):
            part = slice(lo, lo + netcdf3.PIXELS_AT_ONCE)
            w = whose[part]
            columns = [pa.array(times[part], pa.timestamp("us")), pa.array(ids[w]), pa.array(lat[w], from_pandas=True), pa.array(lon[w], from_pandas=True), *(pa.array(v[part], from_pandas=True) for v in values)]
            yield pa.RecordBatch.from_arrays(columns, names=["time", "gpi", "lat", "lon", *variables])


OPENERS = {"netcdf": NetCdfOpener(), "csv": CsvOpener()}
