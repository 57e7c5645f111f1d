"""Sources: image directories, stacks, cell series, zipped CSV series, in-memory series."""

from __future__ import annotations

import io
import json
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from datetime import datetime

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamline.functions.missing import nan_to_null, present
from loamline.functions.times import plus_seconds, time_in_name
from loamline.operators.compaction import template_regex
from loamline.operators.grid import land_only
from loamline.operators.images import daily_mean, in_time, select_known, select_levels
from loamline.session import EngineError, cut, ship
from loamline.sources import netcdf3
from loamline.sources.files import fetched, located
from loamline.sources.openers import OPENERS, RaggedOpener, StackOpener


def file_catalog(spark: SparkSession, folder: str, pattern: str = "*.nc", fmt: str | None = None, regex: str | None = None) -> DataFrame:
    """(path, name, size, time) of the files below a folder whose name matches a glob; contents are not read.

    ``time`` comes from the name; it is NULL without ``fmt`` or where the name holds none.  No match is an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder).select("path", "length")
    out = files.select("path", F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), F.col("length").alias("size"))
    out = out.withColumn("time", time_in_name(F.col("name"), fmt, regex) if fmt else F.lit(None).cast("timestamp_ntz"))
    if out.isEmpty():
        raise EngineError(f"no file matches {pattern} below {folder}")
    return out


def template_catalog(spark: SparkSession, folder: str, template: str, fmt: str) -> DataFrame:
    """The catalog of a product whose names follow a template with ``{datetime}`` and ``*``; other files are left out."""
    pattern = template.replace("{datetime}", "*")
    return file_catalog(spark, folder, pattern, fmt, template_regex(template, fmt)).where("time IS NOT NULL")


def exemplar(catalog: DataFrame) -> tuple[str, datetime]:
    """(path, time) of the first image (by time, then path), which stands for all where a source is described."""
    first = catalog.agg(F.min(F.struct("time", "path")).alias("f")).first().f
    if first is None:
        raise EngineError("no image in the time range")
    return first.path, first.time


def _opened(opener, variables: list[str], offsets: list[int] | None):
    """Catalog rows (path, time) to image rows; each file is opened by the task that has its row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, time in zip(batch.column("path").to_pylist(), batch.column("time"), strict=True):
                for rows in opener.rows(fetched(path), variables):
                    n = rows.num_rows
                    if "time" in rows.schema.names:
                        at = rows.column("time")
                    elif offsets is None:
                        at = pa.repeat(time.cast(pa.timestamp("us")), n)
                    else:  # the slots of a file by position
                        slot = np.asarray(rows.column("slot"))
                        known = np.flatnonzero(slot < len(offsets))
                        rows, n = rows.take(pa.array(known)), len(known)
                        at = pa.array(np.int64(time.cast(pa.timestamp("us")).value) + np.array(offsets, np.int64)[slot[known]] * 1_000_000, pa.timestamp("us"))
                    yield pa.RecordBatch.from_arrays([pa.repeat(path, n), at, *(rows.column(c) for c in ("slot", "gpi", *variables))], names=["path", "time", "slot", "gpi", *variables])

    return run


def read_images(
    spark: SparkSession, folder: str | DataFrame, variables: list[str], fmt: str | None = None, pattern: str = "*.csv", regex: str | None = None, opener=None, rename: dict[str, str] | None = None, levels: dict | None = None,
    fill: float | None = None, skip_missing: bool = False, start=None, end=None, offsets: list[int] | None = None, average: str | None = None, landmask: DataFrame | None = None,
) -> DataFrame:
    """Images of a directory (or of a catalog): ``time, gpi, slot`` and the variables.  Only files whose name lies in the time
    range are opened, each by a task of its own; no list of files is collected.

    ``opener`` is ``netcdf``, ``csv`` or an object like those of ``openers``; by default the pattern's ending decides.  The first
    image tells which variables there are.  ``offsets`` are the seconds from a file's time to each of its slots, further slots
    are left out.  Afterwards fill values become NULL, variables are renamed, values off the ``landmask`` (gpi, is_land) become
    NULL and, with ``average="daily"``, days are averaged, in this order."""
    ship(spark)
    catalog = file_catalog(spark, folder, pattern, fmt, regex) if isinstance(folder, str) else folder
    catalog = in_time(catalog.where("time IS NOT NULL"), start, end).select("path", "time")
    first, _ = exemplar(catalog)
    opener = opener or ("netcdf" if pattern.endswith((".nc", ".nc4")) else "csv")
    opener = OPENERS[opener] if isinstance(opener, str) else opener
    back = {new: old for old, new in (rename or {}).items()}
    offered = opener.names(fetched(first))
    wanted = [n for n in dict.fromkeys(back.get(v, v) for v in variables) if n in offered]
    if levels:
        wanted = [n for n in offered if n in {*wanted, *levels}]
    if not wanted and not skip_missing:
        raise EngineError(f"no variables {variables} in {first}")
    columns = ", ".join(f"`{v}` double" for v in wanted)
    data = catalog.mapInArrow(_opened(opener, wanted, offsets), "path string, time timestamp_ntz, slot int, gpi long" + (f", {columns}" if columns else ""))
    data = data.select("time", "gpi", "slot", *(present(F.col(v), *([fill] if fill is not None else [])).alias(v) for v in wanted))
    if levels:
        data = select_levels(data, levels)
    data = select_known(data, ["time", "gpi", "slot", *variables], rename, skip_missing)
    names = [v for v in variables if v in data.columns]
    if landmask is not None:
        data = data.join(landmask.select("gpi", "is_land"), "gpi", "left").withColumns({v: land_only(F.col(v), F.col("is_land")) for v in names}).select("time", "gpi", "slot", *names)
    if average == "daily":
        data = daily_mean(data, names)
    return data


def read_stacks(spark: SparkSession, folder: str, variables: list[str], pattern: str = "*.nc", opener: StackOpener | RaggedOpener = StackOpener()) -> DataFrame:
    """NetCDF files with coordinates and times of their own: ``path, time, gpi, lat, lon`` and the variables; each file is opened by
    one task.  In images, stacks and series by cell gpi is the place's number in its file, in ragged series (``RaggedOpener``) its
    own."""
    ship(spark)

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                for rows in opener.rows(fetched(path), variables):
                    yield pa.RecordBatch.from_arrays([pa.repeat(path, rows.num_rows), *rows.columns], names=["path", *rows.schema.names])

    columns = ", ".join(f"`{v}` double" for v in variables)
    return file_catalog(spark, folder, pattern).select("path").mapInArrow(opened, f"path string, time timestamp_ntz, gpi long, lat double, lon double, {columns}")


def read_grid(spark: SparkSession, path: str) -> DataFrame:
    """A static grid from a Parquet table or a NetCDF file: ``gpi, lat, lon`` and, where there are such, ``cell`` and ``is_land``.

    Of a NetCDF file the variables lat and lon count, along one dimension or as the axes of a regular grid (numbered row by
    row), and gpi, cell and land_flag (or is_land) of the same shape."""
    if not path.endswith((".nc", ".nc4", ".h5")):
        return spark.read.parquet(path)
    nc = netcdf3.opened(fetched(path))
    lat, lon = netcdf3.decoded(nc, "lat"), netcdf3.decoded(nc, "lon")
    if lat.ndim == 1 and nc.dim_names("lat") != nc.dim_names("lon"):
        lat, lon = np.meshgrid(lat, lon, indexing="ij")
    table = pd.DataFrame({"gpi": np.arange(lat.size), "lat": lat.reshape(-1), "lon": lon.reshape(-1)})
    for column, names in (("gpi", ("gpi",)), ("cell", ("cell",)), ("is_land", ("is_land", "land_flag"))):
        for name in names:
            if name in nc.variables and nc.array(name).size == len(table):
                values = nc.array(name).reshape(-1)
                table[column] = values != 0 if column == "is_land" else values.astype(np.int64)
    df = spark.createDataFrame(table)
    return df.withColumn("cell", F.col("cell").cast("int")) if "cell" in df.columns else df


def mask_of(spark: SparkSession, spec: DataFrame | str, folder: str | None = None) -> DataFrame:
    """A landmask (gpi, is_land): a table, ``file:variable`` of a NetCDF file, or a variable of ``folder``'s first image; a
    number other than 0 is land, a missing one is none."""
    if isinstance(spec, DataFrame):
        return spec.select("gpi", "is_land")
    path, _, name = spec.rpartition(":")
    path = path or exemplar(file_catalog(spark, folder, "*.nc", "%Y%m%d"))[0]
    one = spark.createDataFrame([(path,)], "path string").withColumn("time", F.lit("1970-01-01").cast("timestamp_ntz"))
    values = one.mapInArrow(_opened(OPENERS["netcdf"], [name], None), f"path string, time timestamp_ntz, slot int, gpi long, `{name}` double")
    return values.where("slot = 0").select("gpi", F.coalesce(F.col(name) != 0, F.lit(False)).alias("is_land"))


def stack_overpasses(morning: DataFrame, evening: DataFrame, variables: list[str], hours: tuple[float, float] = (6, 18), suffix: str = "_pm") -> DataFrame:
    """Two overpasses of a day, whose variables differ by a suffix in one file or come from two, under one name: slot 0 and 1 with
    their hour added to the day."""
    parts = []
    for slot, (df, hour) in enumerate(zip((morning, evening), hours, strict=True)):
        names = [F.col(v + suffix if slot and v + suffix in df.columns else v).alias(v) for v in variables]
        parts.append(df.select(plus_seconds(F.col("time"), F.lit(hour * 3600)).alias("time"), "gpi", F.lit(slot).alias("slot"), *names))
    return parts[0].unionByName(parts[1])


def read_stack(spark: SparkSession, path: str, variables: list[str] | None = None, rename: dict[str, str] | None = None, load: bool = False) -> DataFrame:
    """An image stack stored as one Parquet table (time, gpi, variables); NaN is NULL.  ``load`` keeps it in memory."""
    ship(spark)
    df = nan_to_null(spark.read.parquet(path))
    df = df.withColumnsRenamed(rename or {})
    if variables:
        df = df.select(*(c for c in ("time", "gpi", "cell", "lat", "lon") if c in df.columns), *variables)
    return df.cache() if load else df


def read_cells(spark: SparkSession, path: str, cell: int | None = None, gpi: int | None = None, scale: dict[str, float] | None = None, offset: dict[str, float] | None = None) -> DataFrame:
    """Series stored by cell; ``cell`` prunes folders, ``gpi`` reaches the scan.  Scaling: value * scale + offset."""
    df = nan_to_null(spark.read.parquet(path))
    if cell is not None:
        df = df.where(F.col("cell") == cell)
    if gpi is not None:
        df = df.where(F.col("gpi") == gpi)
    names = {*(scale or {}), *(offset or {})}
    return df.withColumns({v: F.col(v) * F.lit((scale or {}).get(v, 1.0)) + F.lit((offset or {}).get(v, 0.0)) for v in names})


def _one(regex: str, name: str) -> str:
    found = re.findall(regex, name)
    if len(found) != 1:
        raise EngineError(f"{name}: {len(found)} matches of {regex}, not one")
    return found[0]


MEMBERS = "path string, name string, gpi long, lat double, lon double, start long, packed long, method int, crc long"
ROWS_AT_ONCE, MEMBERS_A_TASK, BYTES_A_TASK = 50_000, 500, 4_000_000


def _members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The CSV files of archives, by their directories alone; of files with one name the last counts."""
    for batch in batches:
        for path in batch["path"]:
            system, place = located(path)
            rows = []
            with system.open_input_file(place) as f, zipfile.ZipFile(f) as z:
                for name, i in sorted(z.NameToInfo.items()):
                    if name.lower().endswith(".csv"):
                        if i.flag_bits & 1:
                            raise EngineError(f"{path}: {name} is encrypted")
                        base = name.rsplit("/", 1)[-1]
                        gpi, lat, lon = int(_one(r"gpi=([0-9]+)", base)), float(_one(r"lat=([-0-9.]+)(?=_|\.csv)", base).rstrip(".")), float(_one(r"lon=([-0-9.]+)(?=_|\.csv)", base).rstrip("."))
                        rows.append((path, name, gpi, lat, lon, i.header_offset, i.compress_size, i.compress_type, i.CRC))
            yield pd.DataFrame(rows, columns=re.findall(r"(\w+) \w+", MEMBERS))


def zip_members(spark: SparkSession, path: str, gpi: int | None = None) -> DataFrame:
    """MEMBERS of the archives at ``path``, those of one place in one task, spread by what there is to unpack."""
    ship(spark)
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path").mapInPandas(_members, MEMBERS)
    found = cut(found if gpi is None else found.where(F.col("gpi") == gpi), "members")
    n, size = found.agg(F.count(F.lit(1)), F.sum("packed")).first()
    return found.repartition(1 + n // MEMBERS_A_TASK + (size or 0) // BYTES_A_TASK, "gpi", "lat", "lon").sortWithinPartitions("gpi", "lat", "lon", "path", "name")


def _contents(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """Each member with its unpacked bytes; the archive's directory is not read again."""
    open_path, f = None, None
    try:
        for batch in batches:
            for m in batch.itertuples(index=False):
                if m.path != open_path:
                    if f:
                        f.close()
                    system, place = located(m.path)
                    open_path, f = m.path, system.open_input_file(place)
                if m.method in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
                    f.seek(m.start)
                    head = f.read(30)
                    f.seek(m.start + 30 + sum(struct.unpack("<HH", head[26:30])))
                    raw = f.read(m.packed)
                    content = raw if m.method == zipfile.ZIP_STORED else zlib.decompress(raw, -15)
                    if head[:4] != b"PK\x03\x04" or zlib.crc32(content) != m.crc:
                        raise EngineError(f"{m.path}: {m.name} is damaged")
                else:
                    with zipfile.ZipFile(f) as z:
                        content = z.read(m.name)
                yield m, content
    finally:
        if f:
            f.close()


def _series(content: bytes) -> tuple[pd.DatetimeIndex, list[str], np.ndarray]:
    """Times, names and values of a CSV file; what is no time or number is missing."""
    table = pd.read_csv(io.BytesIO(content), index_col=0)
    times = pd.to_datetime(table.index, errors="coerce", format="mixed")
    values = np.empty(table.shape)
    for k in range(table.shape[1]):
        column = table.iloc[:, k]
        values[:, k] = column if column.dtype.kind in "iuf" else pd.to_numeric(column, errors="coerce")
    return times, [str(c) for c in table.columns], values


def _unzip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held, n = [], 0
    for m, content in _contents(batches):
        times, names, values = _series(content)
        row, k = np.nonzero(~np.isnan(values))
        held.append(pd.DataFrame({"path": m.path, "gpi": m.gpi, "lat": m.lat, "lon": m.lon, "time": times[row], "variable": np.array(names, object)[k] if names else [], "value": values[row, k]}))
        n += len(row)
        if n >= ROWS_AT_ONCE:
            yield pd.concat(held)
            held, n = [], 0
    if held:
        yield pd.concat(held)


def _headers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seen: dict[bytes, list[str]] = {}
    for _, content in _contents(batches):
        line = content.split(b"\n", 1)[0]
        if line.count(b'"') % 2:  # a name with a line break
            line = content
        if line not in seen:
            seen[line] = [str(c) for c in pd.read_csv(io.BytesIO(line), index_col=0, nrows=0).columns]
    yield pd.DataFrame({"variable": sorted({n for names in seen.values() for n in names})}, dtype=object)


def _wide(names: list[str]):
    """Rows (gpi, lat, lon, time, the variables), one for each place and time that has a number; the greatest where there are several."""
    column = {n: k for k, n in enumerate(names)}
    kinds = {"gpi": "int64", "lat": "float64", "lon": "float64"}

    def whole(key: tuple, times: list, values: list) -> tuple:
        t, v = np.concatenate(times), np.concatenate(values)
        some = ~np.isnan(v).all(1)
        t, v = t[some], v[some]
        if len(np.unique(t)) < len(t):
            table = pd.DataFrame(v).groupby(t, dropna=False).max()
            t, v = table.index.to_numpy("datetime64[us]"), table.to_numpy()
        return key, t, v

    def frame(done: list[tuple]) -> pd.DataFrame:
        n = [len(t) for _, t, _ in done]
        out = {c: np.repeat(np.array([key[k] for key, _, _ in done], kind), n) for k, (c, kind) in enumerate(kinds.items())}
        values = np.concatenate([v for _, _, v in done])
        return pd.DataFrame(out | {"time": np.concatenate([t for _, t, _ in done])} | {f"v{k}": values[:, k] for k in range(len(names))})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, times, values, done, n = None, [], [], [], 0
        for m, content in _contents(batches):
            key = (m.gpi, m.lat, m.lon)
            if key != at and times:
                done.append(whole(at, times, values))
                n += len(done[-1][1])
                times, values = [], []
                if n >= ROWS_AT_ONCE:
                    yield frame(done)
                    done, n = [], 0
            t, own, v = _series(content)
            all_of = np.full((len(t), len(names)), np.nan)
            all_of[:, [column[c] for c in own]] = v
            at = key
            times.append(t.to_numpy("datetime64[us]"))
            values.append(all_of)
        if times:
            done.append(whole(at, times, values))
        if done:
            yield frame(done)

    return run


def read_zipped_csv(spark: SparkSession, path: str, gpi: int | None = None) -> DataFrame:
    """Zipped CSV series in long form: path, gpi, lat, lon, time, variable, value.

    Each CSV holds one location, its place is in the file name (gpi, lat and lon exactly once, else an error), and its
    first column is the time.  Missing numbers are left out; the files of archives are read in parallel.  With ``gpi`` only the
    file of that location is unpacked."""
    return zip_members(spark, path, gpi).mapInPandas(_unzip, "path string, gpi long, lat double, lon double, time timestamp_ntz, variable string, value double")


def read_zipped_table(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """Zipped CSV series as one row per place and time, and the names of its further columns: the variables that have a number
    at all.  The files are unpacked once for their headers and once for their rows, which are then stored."""
    members = zip_members(spark, path)
    names = sorted({r.variable for r in members.mapInPandas(_headers, "variable string").distinct().collect()})  # columns of the CSV files
    types = "".join(f", v{k} double" for k in range(len(names)))
    table = cut(nan_to_null(members.mapInPandas(_wide(names), f"gpi long, lat double, lon double, time timestamp_ntz{types}")), "unzipped")
    held = table.agg(F.count(F.lit(1)), *(F.count(f"v{k}") for k in range(len(names)))).first()[1:]
    return table.drop(*(f"v{k}" for k, n in enumerate(held) if not n)), [n for n, h in zip(names, held, strict=True) if h]


def zip_metadata(content: bytes) -> dict:
    """The metadata.yml of an archive (name ending anywhere in it), {} without one."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = [n for n in z.namelist() if n.endswith("metadata.yml")]
        if not names:
            return {}
        text = z.read(names[0]).decode()
    try:
        import yaml

        return yaml.safe_load(text) or {}
    except ImportError:
        return {k: _plain(v) for k, v in re.findall(r"^\"?(\w+)\"?:\s*(.*)$", text, re.M)}


def _plain(text: str):
    try:
        return json.loads(text)
    except ValueError:
        return text


def from_series(spark: SparkSession, series: list[pd.Series | pd.DataFrame], lats: list[float], lons: list[float], gpis: list[int] | None = None) -> DataFrame:
    """In-memory series as a table; gpi defaults to 0, 1, ...  Columns: gpi, lat, lon, time and the variables."""
    frames = []
    for gpi, (s, lat, lon) in enumerate(zip(series, lats, lons, strict=True)):
        table = s.to_frame(s.name or "value") if isinstance(s, pd.Series) else s.copy()
        table = table.rename_axis("time").reset_index()
        table.insert(0, "lon", float(lon))
        table.insert(0, "lat", float(lat))
        table.insert(0, "gpi", int(gpis[gpi] if gpis else gpi))
        frames.append(table)
    return nan_to_null(spark.createDataFrame(pd.concat(frames, ignore_index=True))).withColumn("time", F.col("time").cast("timestamp_ntz"))
