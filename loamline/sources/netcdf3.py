"""NetCDF classic files (CDF-1, CDF-2) after the public format description: headers, arrays, and a Spark data source."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from loamline.session import EngineError
from loamline.sources import hdf5
from loamline.sources.files import fetched

#: Fixed values of the format: type code -> (array protocol, size).
NC_TYPES = {1: (">i1", 1), 2: ("S1", 1), 3: (">i2", 2), 4: (">i4", 4), 5: (">f4", 4), 6: (">f8", 8)}
DIMENSION, VARIABLE, ATTRIBUTE = 10, 11, 12


@dataclass
class NcVariable:
    name: str
    dims: list[int]
    attrs: dict
    code: int
    size: int
    begin: int


@dataclass
class NcFile:
    """A parsed header with access to its arrays."""

    raw: bytes
    dims: list[tuple[str, int]] = field(default_factory=list)
    attrs: dict = field(default_factory=dict)
    variables: dict[str, NcVariable] = field(default_factory=dict)
    records: int = 0
    record_size: int = 0

    def dim_names(self, name: str) -> list[str]:
        return [self.dims[d][0] for d in self.variables[name].dims]

    def array(self, name: str) -> np.ndarray:
        """Values of a variable; record variables are gathered record by record."""
        v = self.variables[name]
        kind, width = NC_TYPES[v.code]
        shape = [self.records if self.dims[d][1] == 0 else self.dims[d][1] for d in v.dims]
        if v.dims and self.dims[v.dims[0]][1] == 0:
            per = int(np.prod(shape[1:], dtype=np.int64))
            parts = [np.frombuffer(self.raw, kind, per, v.begin + r * self.record_size) for r in range(self.records)]
            return (np.concatenate(parts) if parts else np.zeros(0, kind)).reshape(shape)
        return np.frombuffer(self.raw, kind, int(np.prod(shape, dtype=np.int64)), v.begin).reshape(shape)


def parse(raw: bytes) -> NcFile:
    """The header of a classic file; anything else is refused."""
    if raw[:3] != b"CDF" or raw[3:4] not in (b"\x01", b"\x02"):
        raise EngineError("no NetCDF classic file")
    wide, at = raw[3] == 2, 4

    def number(fmt: str = ">i") -> int:
        nonlocal at
        (value,) = struct.unpack_from(fmt, raw, at)
        at += struct.calcsize(fmt)
        return value

    def text() -> str:
        nonlocal at
        n = number()
        value = raw[at : at + n].decode("utf-8", "replace")
        at += -(-n // 4) * 4
        return value

    def attributes() -> dict:
        nonlocal at
        tag, n = number(), number()
        out = {}
        for _ in range(n if tag == ATTRIBUTE else 0):
            key, code, count = text(), number(), number()
            kind, width = NC_TYPES[code]
            chunk = raw[at : at + count * width]
            at += -(-count * width // 4) * 4
            values = np.frombuffer(chunk, kind)
            out[key] = chunk.decode("utf-8", "replace") if code == 2 else values[0].item() if count == 1 else values.tolist()
        return out

    nc = NcFile(raw, records=max(number(), 0))
    tag, n = number(), number()
    for _ in range(n if tag == DIMENSION else 0):
        nc.dims.append((text(), number()))
    nc.attrs = attributes()
    tag, n = number(), number()
    for _ in range(n if tag == VARIABLE else 0):
        name, rank = text(), number()
        v = NcVariable(name, [number() for _ in range(rank)], attributes(), number(), number(), number(">q" if wide else ">i"))
        nc.variables[name] = v
    record = [v for v in nc.variables.values() if v.dims and nc.dims[v.dims[0]][1] == 0]
    nc.record_size = sum(v.size for v in record)
    if len(record) == 1:  # a single record variable is not padded
        v = record[0]
        nc.record_size = int(np.prod([nc.dims[d][1] for d in v.dims[1:]], dtype=np.int64)) * NC_TYPES[v.code][1]
    return nc


def encoded(dims: dict[str, int], variables: dict[str, tuple[list[str], np.ndarray, dict]], attrs: dict | None = None) -> bytes:
    """A CDF-2 file of fixed dimensions; variables are (dimensions, values, attributes)."""
    codes = {"i1": 1, "S1": 2, "i2": 3, "i4": 4, "f4": 5, "f8": 6}
    pad = lambda b: b + b"\0" * (-len(b) % 4)
    label = lambda s: struct.pack(">i", len(s.encode())) + pad(s.encode())

    def attributes(d: dict | None) -> bytes:
        if not d:
            return struct.pack(">ii", 0, 0)
        out = struct.pack(">ii", ATTRIBUTE, len(d))
        for k, v in d.items():
            if isinstance(v, str):
                out += label(k) + struct.pack(">ii", 2, len(v.encode())) + pad(v.encode())
            else:
                values = np.atleast_1d(np.asarray(v, dtype=">f8"))
                out += label(k) + struct.pack(">ii", 6, len(values)) + pad(values.tobytes())
        return out

    names = list(dims)
    data = {}
    for n, (_, a, _) in variables.items():
        a = np.asarray(a)
        kind = a.dtype.str[1:] if a.dtype.str[1:] in codes else ("i4" if a.dtype.kind in "iu" else "f8")
        data[n] = (kind, np.ascontiguousarray(a, dtype=">" + kind).tobytes())
    head = b"CDF\x02" + struct.pack(">i", 0) + struct.pack(">ii", DIMENSION if dims else 0, len(dims)) + b"".join(label(d) + struct.pack(">i", s) for d, s in dims.items()) + attributes(attrs)

    def header(begins: dict[str, int]) -> bytes:
        out = head + struct.pack(">ii", VARIABLE if variables else 0, len(variables))
        for n, (d, _, a) in variables.items():
            out += label(n) + struct.pack(">i", len(d)) + b"".join(struct.pack(">i", names.index(x)) for x in d) + attributes(a)
            out += struct.pack(">iIq", codes[data[n][0]], min(len(pad(data[n][1])), 2**32 - 1), begins[n])
        return out

    begins, at = {}, len(header(dict.fromkeys(variables, 0)))
    for n in variables:
        begins[n] = at
        at += len(pad(data[n][1]))
    return header(begins) + b"".join(pad(data[n][1]) for n in variables)


def write(path: str, dims: dict[str, int], variables: dict[str, tuple[list[str], np.ndarray, dict]], attrs: dict | None = None) -> None:
    """``encoded`` into a local file."""
    Path(path).write_bytes(encoded(dims, variables, attrs))


def opened(raw: bytes) -> NcFile | hdf5.H5File:
    """A classic or an HDF5-based file, by its first bytes."""
    return hdf5.parse(raw) if raw[:8] == hdf5.MAGIC else parse(raw)


def decoded(nc: NcFile | hdf5.H5File, name: str) -> np.ndarray:
    """Values as float64 with fill values as NaN and scale and offset applied."""
    v = nc.variables[name]
    a = nc.array(name).astype(float)
    for key in ("_FillValue", "missing_value"):
        if isinstance(v.attrs.get(key), int | float):
            a = np.where(a == float(v.attrs[key]), np.nan, a)
    return a * float(v.attrs.get("scale_factor", 1.0)) + float(v.attrs.get("add_offset", 0.0))


PIXELS_AT_ONCE = 200_000


def images(raw: bytes, variables: list[str], flip: bool = False) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """(slot, first gpi, values by variable) of a file's images in slices, gpi row-major over the spatial dimensions.  Variables
    have one shape, with a leading time step where there are three dimensions; ``flip`` turns the rows over first."""
    nc = opened(raw)
    arrays = [decoded(nc, v) for v in variables]
    if len({a.shape for a in arrays}) != 1:
        raise EngineError("the variables differ in shape")
    shape = arrays[0].shape
    steps = shape[0] if len(shape) == 3 else 1
    cubes = [a.reshape(steps, *shape[-2:]) if len(shape) >= 2 else a.reshape(1, 1, -1) for a in arrays]
    cubes = [(c[:, ::-1] if flip else c).reshape(steps, -1) for c in cubes]
    for slot in range(steps):
        for lo in range(0, cubes[0].shape[1], PIXELS_AT_ONCE):
            yield slot, lo, [c[slot, lo : lo + PIXELS_AT_ONCE] for c in cubes]


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(0)
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        self.variables = [v.strip() for v in options["variables"].split(",")]

    def partitions(self):
        return [_File(p) for p in self.options["paths"].split("\n") if p]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        names = ["path", "slot", "gpi", *self.variables]
        for slot, lo, values in images(fetched(partition.path), self.variables):
            n = len(values[0])
            columns = [pa.repeat(partition.path, n), pa.repeat(pa.scalar(slot, pa.int32()), n), pa.array(np.arange(lo, lo + n)), *(pa.array(v, from_pandas=True) for v in values)]
            yield pa.RecordBatch.from_arrays(columns, names=names)


class NetCdf3Source(DataSource):
    """Format ``netcdf3``: options ``paths`` (one a line) and ``variables`` (comma-separated, all of one shape).

    One row per (file, time step, gpi), gpi row-major over the spatial dimensions; one partition per file, in Arrow batches."""

    @classmethod
    def name(cls) -> str:
        return "netcdf3"

    def schema(self) -> str:
        return "path string, slot int, gpi long, " + ", ".join(f"`{v.strip()}` double" for v in self.options["variables"].split(","))

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options))


def read_netcdf3(spark: SparkSession, paths: list[str], variables: list[str]):
    """Classic files as a table."""
    spark.dataSource.register(NetCdf3Source)
    return spark.read.format("netcdf3").option("paths", "\n".join(sorted(paths))).option("variables", ",".join(variables)).load()
