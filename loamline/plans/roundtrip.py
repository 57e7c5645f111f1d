"""Queries that write with a sink, read back with a source, check uploads or run a stream, over whole tables, each with the
SQL that says what must come back."""

from __future__ import annotations

import io
import zipfile

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamline.functions import cf
from loamline.functions import times as T
from loamline.functions.missing import present
from loamline.operators import grid, images, series, swath, uploads
from loamline.functions.chunks import chunk_sizes, images_in
from loamline.plans.catalog import FRM_SQL, GRID_SQL, KM, OBS_SQL, STATION_SQL, _grid, _obs, _sensors, _stations
from loamline.session import read_table, work_path
from loamline.sources import netcdf3, readers, writers
from loamline.sources.files import stored
from loamline.sources.ingest import ingest_upload, reshuffle
from loamline.sources.openers import RaggedOpener
from loamline.streaming import streams

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def register(sql: str | None = None):
    """Add a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


SMOS_SQL = """(SELECT s.obs_id, s.gpi, g.cell, g.lat, g.lon, make_timestamp(CAST(round((s.acquisition_time + 946684800) * 1000000) AS BIGINT)) AS time, CASE WHEN NOT isnan(s.soil_moisture) AND s.soil_moisture <> -999 THEN s.soil_moisture END AS value
 FROM smos_obs s JOIN grid_points g ON g.gpi = s.gpi AND g.grid_name = 'smos_dgg' WHERE s.acquisition_time IS NOT NULL AND NOT isnan(s.acquisition_time) AND s.acquisition_time <> 0)"""
DAILY_SQL = f"(SELECT cell, gpi, lat, lon, date_trunc('day', time)::TIMESTAMP AS time, avg(value) AS value FROM {SMOS_SQL} s GROUP BY ALL)"


def _points(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "grid_points").where("grid_name = 'smos_dgg'").select("gpi", "cell", "lat", "lon", "is_land")


def _smos(spark: SparkSession, folder: str) -> DataFrame:
    """All SMOS readings with a time at their grid points."""
    o = read_table(spark, folder, "smos_obs").select("obs_id", "gpi", F.nullif(present(F.col("acquisition_time")), F.lit(0.0)).alias("acquisition_time"), present(F.col("soil_moisture"), -999.0).alias("value"))
    return swath.on_grid(o, _points(spark, folder), "smos").select("obs_id", "gpi", "cell", "lat", "lon", "time", "value")


def _daily(spark: SparkSession, folder: str) -> DataFrame:
    return images.daily_mean(_smos(spark, folder), ["value"], ("cell", "gpi", "lat", "lon"))


# --- series by cell -----------------------------------------------------------------------------------------------


@register(f"SELECT obs_id, gpi, cell, time, value FROM {SMOS_SQL} s")
def cells_written(spark, folder):
    out = writers.write_cells(_smos(spark, folder).drop("cell", "lat", "lon"), _points(spark, folder), work_path(spark, "cells"))
    return out.select("obs_id", "gpi", "cell", "time", "value")


@register(f"SELECT obs_id, gpi, cell, time, value FROM {SMOS_SQL} s")
def cells_appended(spark, folder):
    obs, points, path = _smos(spark, folder).drop("cell", "lat", "lon"), _points(spark, folder), work_path(spark, "cells")
    writers.write_cells(obs.where("obs_id % 2 = 0"), points, path)
    return writers.write_cells(obs.where("obs_id % 2 <> 0"), points, path, append=True).select("obs_id", "gpi", "cell", "time", "value")


@register(f"SELECT obs_id, time, round(value * 100 + 0.5, 6) AS value FROM {SMOS_SQL} s WHERE gpi = (SELECT min(gpi) FROM grid_points WHERE grid_name = 'smos_dgg' AND is_land)")
def series_of_point(spark, folder):
    """One point through a series source, from its cell only, scaled on read."""
    points, path = _points(spark, folder), work_path(spark, "cells")
    writers.write_cells(_smos(spark, folder).drop("cell", "lat", "lon"), points, path)
    source = series.StoredSeries(readers.read_cells(spark, path, scale={"value": 100.0}, offset={"value": 0.5}), points)
    first = points.where("is_land").agg(F.min("gpi")).first()[0]
    return source.read(first).select("obs_id", "time", F.round("value", 6).alias("value"))


@register(f"SELECT s.obs_id, s.time FROM {SMOS_SQL} s JOIN (SELECT lat, lon FROM grid_points WHERE grid_name = 'smos_dgg' ORDER BY gpi DESC LIMIT 1) p ON p.lat = s.lat AND p.lon = s.lon")
def series_at_coordinates(spark, folder):
    points = _points(spark, folder)
    last = points.orderBy(F.col("gpi").desc()).first()
    return series.read_exact(_smos(spark, folder), points, last.lat, last.lon).select("obs_id", "time")


@register(f"SELECT obs_id, gpi, CAST(floor(floor((lon + 180) / 5) * 36 + floor((lat + 90) / 5)) AS INTEGER) AS cell FROM {SMOS_SQL} s WHERE lat BETWEEN -30 AND 60 AND lon BETWEEN -100 AND 120 AND time BETWEEN TIMESTAMP '2014-01-01' AND TIMESTAMP '2016-06-30 12:00:00'")
def cells_reshuffled(spark, folder):
    out = reshuffle(_smos(spark, folder).drop("cell"), _points(spark, folder), work_path(spark, "reshuffled"), "2014-01-01", "2016-06-30 12:00:00", -100, -30, 120, 60)
    return out.select("obs_id", "gpi", "cell")


@register(f"SELECT DISTINCT o.event_id, o.gpi, o.time, o.value FROM {OBS_SQL} o JOIN {GRID_SQL} a ON a.gpi = o.gpi WHERE EXISTS (SELECT 1 FROM {STATION_SQL} b WHERE {KM} <= 400)")
def ragged_near_stations(spark, folder):
    obs = _obs(spark, folder).select("event_id", "gpi", "lat", "lon", "time", "value")
    return writers.write_ragged(obs, work_path(spark, "ragged"), _stations(spark, folder), 400).select("event_id", "gpi", "time", "value")


@register(f"SELECT gpi, event_id, time, value FROM {OBS_SQL} o")
def series_transposed(spark, folder):
    path = work_path(spark, "transposed")
    writers.write_transposed(_obs(spark, folder), ["event_id", "value"], path)
    return spark.read.parquet(path).select("gpi", F.inline("series")).select("gpi", "event_id", "time", "value")


# --- image files --------------------------------------------------------------------------------------------------


@register(f"SELECT lat, lon, time, round(value, 6) AS value FROM {DAILY_SQL} d WHERE value IS NOT NULL")
def netcdf_series(spark, folder):
    """One NetCDF file per cell with time last, read back by coordinates."""
    path = work_path(spark, "series")
    writers.write_netcdf_series(_daily(spark, folder), ["value"], path)
    return readers.read_stacks(spark, path, ["value"]).where("value IS NOT NULL").select("lat", "lon", "time", F.round("value", 6).alias("value"))


@register(f"SELECT lat, lon, time, round(value, 6) AS value FROM {DAILY_SQL} d WHERE value IS NOT NULL")
def netcdf_images(spark, folder):
    """One NetCDF file per two weeks of images, read back by coordinates."""
    path = work_path(spark, "images")
    writers.write_netcdf_images(_daily(spark, folder), ["value"], path, "daily", stepsize=14)
    return readers.read_stacks(spark, path, ["value"]).where("value IS NOT NULL").select("lat", "lon", "time", F.round("value", 6).alias("value"))


@register(f"SELECT gpi, lat, lon, time, round(value, 6) AS value, CAST(obs_id AS DOUBLE) AS obs_id FROM {SMOS_SQL} s")
def ragged_files(spark, folder):
    """Series with their own times, one ragged NetCDF file per cell."""
    path = work_path(spark, "ragged")
    writers.write_netcdf_ragged(_smos(spark, folder), ["value", "obs_id"], path)
    return readers.read_stacks(spark, path, ["value", "obs_id"], opener=RaggedOpener()).select("gpi", "lat", "lon", "time", F.round("value", 6).alias("value"), "obs_id")


@register(f"SELECT time, variable, value FROM (SELECT time, unnest(['event_id', 'value']) AS variable, unnest([event_id::DOUBLE, value]) AS value FROM {OBS_SQL} o WHERE gpi = 7) t")
def csv_series_of_point(spark, folder):
    """The one file of a location out of an archive that holds those near some places."""
    path = work_path(spark, "dataset")
    at = _grid(spark, folder).where("gpi IN (7, 8, 9)").select("lat", "lon").collect()
    target = writers.write_csv_dataset(_obs(spark, folder), path, "events", ["event_id", "value"], only=[(r.lat, r.lon) for r in at], radius_km=1.0)
    return readers.read_zipped_csv(spark, target, gpi=7).select("time", "variable", "value")


@register("SELECT gpi, cell, lat, lon, coalesce(is_land, false) AS is_land FROM grid_points WHERE grid_name = 'smos_dgg'")
def grid_from_file(spark, folder):
    """A static grid written as NetCDF and read back."""
    rows = _points(spark, folder).toPandas()  # a grid is metadata of its readers
    path, column = work_path(spark, "grid") + ".nc", lambda c: (["points"], rows[c].to_numpy(float), {})
    land = (["points"], rows["is_land"].fillna(False).to_numpy("i4"), {})
    stored(path, netcdf3.encoded({"points": len(rows)}, {"gpi": column("gpi"), "cell": column("cell"), "lat": column("lat"), "lon": column("lon"), "land_flag": land}))
    return readers.read_grid(spark, path).select("gpi", "cell", "lat", "lon", "is_land")


def _pixels(spark: SparkSession, folder: str) -> DataFrame:
    e = read_table(spark, folder, "embeddings").select(F.timestamp_add("DAY", F.col("vec_id"), F.lit("2000-01-01").cast("timestamp_ntz")).alias("time"), "embedding")
    flat = images.flatten_image(e, "embedding", 8)
    return flat.select("gpi", F.col("row").cast("double").alias("lat"), F.col("col").cast("double").alias("lon"), "time", F.col("value").cast("double").alias("value"))


PIXEL_SQL = "(SELECT vec_id, CAST(i AS BIGINT) AS gpi, TIMESTAMP '2000-01-01' + to_days(CAST(vec_id AS INTEGER)) AS time, embedding[i + 1]::DOUBLE AS value FROM embeddings CROSS JOIN range(64) t(i))"


@register(f"SELECT time, gpi, CAST(0 AS INTEGER) AS slot, round(value, 6) AS signal FROM {PIXEL_SQL} p WHERE time BETWEEN TIMESTAMP '2000-01-31' AND TIMESTAMP '2000-12-31'")
def image_directory(spark, folder):
    """A directory of image files: only those of the time range are opened, the variable is renamed."""
    path = work_path(spark, "images")
    writers.write_netcdf_images(_pixels(spark, folder), ["value"], path, "img", "%Y%m%d")
    return readers.read_images(spark, path, ["signal"], "%Y%m%d", "*.nc", rename={"value": "signal"}, start="2000-01-31", end="2000-12-31").withColumn("signal", F.round("signal", 6))


@register(f"""SELECT min(time) OVER (PARTITION BY n // 2, gpi) + CASE WHEN n % 2 = 0 THEN INTERVAL 6 HOUR ELSE INTERVAL 18 HOUR END AS time, gpi, CAST(n % 2 AS INTEGER) AS slot, round(CASE WHEN gpi % 3 <> 0 THEN value END, 6) AS value
 FROM (SELECT time, gpi, value, dense_rank() OVER (ORDER BY time) - 1 AS n FROM {PIXEL_SQL} p) q""")
def multi_step_files(spark, folder):
    """Files of two time steps each, whose times are the file's plus an offset by position, and a landmask."""
    pairs = _pixels(spark, folder)
    path = work_path(spark, "images")
    writers.write_netcdf_images(pairs, ["value"], path, "img", "%Y%m%d", stepsize=2)
    mask = spark.range(64).select(F.col("id").alias("gpi"), (F.col("id") % 3 != 0).alias("is_land"))
    return readers.read_images(spark, path, ["value"], "%Y%m%d", "*.nc", offsets=[6 * 3600, 18 * 3600], landmask=mask).withColumn("value", F.round("value", 6))


@register(f"SELECT strftime(min(t) OVER (PARTITION BY step), '%Y%m%dT%H%M') AS image, t AS time, n FROM (SELECT t, n, (row_number() OVER (ORDER BY t) - 1) // 5 AS step FROM (SELECT date_trunc('day', time)::TIMESTAMP AS t, count(*) AS n FROM {OBS_SQL} o GROUP BY 1) d) s")
def image_files(spark, folder):
    """Image folders of five consecutive times, named by the first."""
    path = work_path(spark, "images")
    writers.write_images(_obs(spark, folder).select("gpi", F.date_trunc("day", "time").cast("timestamp_ntz").alias("time"), "value"), path, stepsize=5)
    return spark.read.parquet(path).groupBy(F.col("image").cast("string").alias("image"), "time").agg(F.count(F.lit(1)).alias("n"))


@register("SELECT min(received_at) AS time, arg_min(message_id, struct_pack(t := received_at, m := message_id)) AS path FROM documents WHERE received_at IS NOT NULL AND message_id IS NOT NULL")
def exemplar_file(spark, folder):
    """The first file by time, then name, of a catalog."""
    path, time = readers.exemplar(read_table(spark, folder, "documents").where("received_at IS NOT NULL AND message_id IS NOT NULL").select(F.col("message_id").alias("path"), F.col("received_at").alias("time")))
    return spark.createDataFrame([(time, path)], "time timestamp_ntz, path string")


@register(f"SELECT event_id, gpi, CAST(0 AS INTEGER) AS slot, date_trunc('day', time)::TIMESTAMP + INTERVAL 6 HOUR AS time, value FROM {OBS_SQL} o UNION ALL SELECT event_id, gpi, 1, date_trunc('day', time)::TIMESTAMP + INTERVAL 18 HOUR, value * 2 FROM {OBS_SQL} o")
def overpasses_stacked(spark, folder):
    """Morning and evening variables of one table under one name."""
    o = _obs(spark, folder).select("event_id", "gpi", F.date_trunc("day", "time").cast("timestamp_ntz").alias("time"), "value", (F.col("value") * 2).alias("value_pm"), F.col("event_id").alias("event_id_pm"))
    return readers.stack_overpasses(o, o, ["event_id", "value"])


@register("SELECT k AS variable, t AS type, a AS attribute, v AS value FROM (VALUES ('soil_moisture', 'double', 'units', 'm3/m3'), ('soil_moisture', 'double', 'valid_min', '0.02'), ('soil_moisture', 'double', 'valid_max', '0.5'), ('quality_flag', 'int', 'flag_masks', '1,2,4,8'), ('acquisition_time', 'double', 'units', 'seconds since 2000-01-01 12:00')) x(k, t, a, v)")
def variables_described(spark, folder):
    """Attributes go with the columns into the files and come back with them."""
    path = work_path(spark, "described")
    obs = read_table(spark, folder, "smap_obs").select("gpi", "soil_moisture", "quality_flag", "acquisition_time")
    cf.with_attributes(obs, swath.SMAP_ATTRIBUTES).write.parquet(path)
    return cf.variable_description(spark.read.parquet(path)).select("variable", "type", F.explode("attributes").alias("attribute", "value"))


@register("SELECT obs_id, gpi, soil_moisture AS sm FROM smos_obs")
def variables_renamed(spark, folder):
    """Wanted variables by their new names; one that does not exist is left out."""
    return images.select_known(read_table(spark, folder, "smos_obs"), ["obs_id", "gpi", "sm", "absent"], {"soil_moisture": "sm", "nothing": "x"})


# --- series as CSV ------------------------------------------------------------------------------------------------


@register(f"SELECT gpi, lat, lon, time, variable, value FROM (SELECT gpi, lat, lon, time, unnest(['event_id', 'value']) AS variable, unnest([event_id::DOUBLE, value]) AS value FROM {OBS_SQL} o) t")
def csv_dataset(spark, folder):
    """A zip of CSV series with metadata, checked as an upload before it is read back."""
    path = work_path(spark, "dataset")
    target = writers.write_csv_dataset(_obs(spark, folder), path, "events", ["event_id", "value"], {"title": 'a "quoted": title', "tags": ["x", "y"]})
    return readers.read_zipped_csv(spark, target).drop("path")


@register(f"SELECT event_id, gpi, time, value FROM (SELECT gpi, time, max(event_id)::DOUBLE AS event_id, max(value) AS value FROM {OBS_SQL} o GROUP BY gpi, time) t")
def upload_ingested(spark, folder):
    """The same archive as an upload: unpacked into series by cell, one row per place and time."""
    path = work_path(spark, "dataset")
    target = writers.write_csv_dataset(_obs(spark, folder), path, "events", ["event_id", "value"])
    return ingest_upload(spark, target, work_path(spark, "cells")).select("event_id", "gpi", "time", "value")


@register(f"SELECT gpi, 'events_gpi=' || gpi || '_lat=' || lat || '_lon=' || lon || '.csv' AS file, count(*) AS \"rows\" FROM {OBS_SQL} o GROUP BY gpi, lat, lon")
def csv_files(spark, folder):
    files = writers.write_csv_series(_obs(spark, folder), work_path(spark, "csv"), "events", ["value"])
    return files.select("gpi", F.regexp_extract("file", r"([^/]*)$", 1).alias("file"), "rows")


@register("SELECT CAST(n_regionkey AS BIGINT) AS gpi, n_regionkey * 10.0::DOUBLE AS lat, n_regionkey * 20.0::DOUBLE AS lon, TIMESTAMP '2020-01-01' + to_days(n_nationkey) AS time, CASE WHEN n_nationkey % 4 <> 0 THEN n_nationkey::DOUBLE END AS sm FROM nation")
def series_from_memory(spark, folder):
    rows = read_table(spark, folder, "nation").select("n_nationkey", "n_regionkey").toPandas()  # 25 rows, which are series in memory here
    made, keys = [], sorted(rows["n_regionkey"].unique())
    for k in keys:
        n = rows.loc[rows["n_regionkey"] == k, "n_nationkey"]
        made.append(pd.Series(np.where(n % 4 == 0, np.nan, n.astype(float)), index=pd.Timestamp("2020-01-01") + pd.to_timedelta(n, unit="D"), name="sm"))
    return readers.from_series(spark, made, [10.0 * k for k in keys], [20.0 * k for k in keys], keys)


# --- grids --------------------------------------------------------------------------------------------------------


@register("SELECT row_number() OVER (ORDER BY lat, lon) - 1 AS gpi, lat, lon FROM (SELECT DISTINCT lat, lon FROM ismn_stations WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 360) s")
def grid_of_points(spark, folder):
    return grid.grid_from_points(grid.valid_points(read_table(spark, folder, "ismn_stations")).select("lat", "lon").distinct(), ["lat", "lon"]).select("gpi", "lat", "lon")


@register(f"SELECT id, arg_min(gpi, km + gpi * 1e-9) AS gpi, round(min(km), 6) AS km FROM (SELECT a.id, b.gpi, {KM} AS km FROM {STATION_SQL} a CROSS JOIN {GRID_SQL} b) t WHERE km <= 120 GROUP BY id")
def nearest_within(spark, folder):
    return grid.nearest_point(_stations(spark, folder), _grid(spark, folder), "id", 120).select("id", "gpi", F.round("km", 6).alias("km"))


@register("SELECT gpi, lat, lon, coalesce(gpi % 4 = 1, false) AS is_land FROM grid_points WHERE grid_name = 'smos_dgg'")
def grid_with_mask(spark, folder):
    """A grid with the mask of another table."""
    points = _points(spark, folder)
    return images.with_landmask(points, points.select("gpi", (F.col("gpi") % 4 == 1).alias("is_land"))).select("gpi", "lat", "lon", "is_land")


@register("SELECT obs_id, CASE WHEN soil_moisture BETWEEN 0.02 AND 0.5 THEN soil_moisture END AS soil_moisture FROM smap_obs")
def inside_valid_range(spark, folder):
    limits = swath.SMAP_ATTRIBUTES["soil_moisture"]
    return swath.inside_valid_range(read_table(spark, folder, "smap_obs").select("obs_id", "soil_moisture"), {"soil_moisture": (float(limits["valid_min"]), float(limits["valid_max"]))})


@register("SELECT event_id, CASE WHEN user_id % 5 = 0 THEN value END AS value FROM events")
def in_situ_good(spark, folder):
    e = read_table(spark, folder, "events")
    return e.select("event_id", images.where_flag(F.col("value"), F.when(F.col("user_id") % 5 == 0, "G").otherwise("D01")).alias("value"))


@register("SELECT file_id, regexp_matches(lower(path), '\\.(nc4|nc|zip)$') AS ok FROM image_files")
def upload_extensions(spark, folder):
    return read_table(spark, folder, "image_files").select("file_id", T.upload_extension_ok(F.col("path")).alias("ok"))


@register("SELECT file_id, CASE file_id % 5 WHEN 0 THEN 'netcdf3' WHEN 1 THEN 'netcdf3' WHEN 2 THEN 'netcdf4' WHEN 3 THEN 'zip' END AS kind FROM image_files")
def file_kinds(spark, folder):
    marks = F.array(*(F.unhex(F.lit(h)) for h in ("43444601", "43444602", "894844460D0A1A0A", "504B0304", "")))
    content = F.concat(F.get(marks, (F.col("file_id") % 5).cast("int")), F.encode(F.coalesce("content", F.lit("")), "UTF-8"))
    return read_table(spark, folder, "image_files").select("file_id", T.file_kind(content).alias("kind"))


# --- uploads ------------------------------------------------------------------------------------------------------

NAME_RE = r"^(.+?)_gpi=(\d+)_lat=(-?\d+(\.\d+)?)_lon=(-?\d+(\.\d+)?)\.csv$"


def _archives(batches):
    for batch in batches:
        out = []
        for number, names in zip(batch["number"], batch["names"], strict=True):
            b = io.BytesIO()
            with zipfile.ZipFile(b, "w") as z:
                for n in sorted(names):
                    z.writestr(n.replace("/", "_"), ",sm\n2020-01-01,1\n")
            out.append((f"{number}.zip", b.getvalue()))
        yield pd.DataFrame(out, columns=["name", "content"])


@register(rf"""
WITH named AS (SELECT DISTINCT series_id // 20 AS number, replace(file_name, '/', '_') AS n FROM csv_series WHERE file_name IS NOT NULL AND lower(file_name) LIKE '%.csv'),
parts AS (SELECT *, regexp_matches(n, '{NAME_RE}') AS ok, regexp_extract(n, '{NAME_RE}', 1) AS d, regexp_extract(n, '{NAME_RE}', 2) AS g, TRY_CAST(regexp_extract(n, '{NAME_RE}', 3) AS DOUBLE) AS lat, TRY_CAST(regexp_extract(n, '{NAME_RE}', 5) AS DOUBLE) AS lon FROM named)
SELECT number || '.zip' AS name, errors = 0 AS valid, CASE WHEN errors = 0 THEN 200 ELSE 400 END AS status, errors FROM (
  SELECT number, count(*) FILTER (WHERE NOT ok) + (count(*) FILTER (WHERE ok) - count(DISTINCT g) FILTER (WHERE ok)) + count(*) FILTER (WHERE ok AND abs(lat) > 90) + count(*) FILTER (WHERE ok AND abs(lon) > 180) + CAST(count(DISTINCT d) FILTER (WHERE ok) > 1 AS INTEGER) AS errors
  FROM parts GROUP BY number) t
""")
def upload_archives(spark, folder):
    """Archives of the series' file names, twenty each, checked like uploads; errors are counted from the message."""
    c = read_table(spark, folder, "csv_series").where("file_name IS NOT NULL AND lower(file_name) LIKE '%.csv'")
    packed = c.select(F.floor(F.col("series_id") / 20).alias("number"), "file_name").groupBy("number").agg(F.collect_set("file_name").alias("names"))
    found = uploads.validate_uploads(packed.mapInPandas(_archives, "name string, content binary"))
    shown = F.size(F.split(F.regexp_replace("message", r" \(and \d+ more errors\)$", ""), "; "))
    more = F.coalesce(F.regexp_extract("message", r"\(and (\d+) more errors\)$", 1).try_cast("int"), F.lit(0))
    return found.select("name", "valid", "status", F.when(F.col("valid"), 0).otherwise(shown + more).cast("bigint").alias("errors"))


def _cubes(batches):
    for batch in batches:
        out = []
        for k in batch["n_nationkey"]:
            lat = np.array([0.0, 95.0 if k % 7 == 1 else 50.0])
            time = np.array([1.0, 1.0 if k % 7 == 2 else 2.0, 3.0])
            dims = {"time": 3, "lat": 2, "lon": 2}
            sm = (["time", "lat", "lon"], np.zeros((3, 2, 2)), {}) if k % 7 != 3 else (["lat", "lon"], np.zeros((2, 2)), {})
            variables = {"lat": (["lat"], lat, {"units": "degrees_north"}), "lon": (["lon"], np.array([0.0, 10.0]), {"units": "degrees_east"}), "time": (["time"], time, {"units": "days since 2000-01-01"}), "sm" if k % 7 != 4 else "a name": sm}
            content = netcdf3.encoded(dims, variables) if k % 7 != 5 else b"\x89HDF\r\n\x1a\n"
            out.append((f"{k}.{'nc' if k % 7 != 6 else 'txt'}", content))
        yield pd.DataFrame(out, columns=["name", "content"])


@register("""
SELECT n_nationkey || CASE WHEN n_nationkey % 7 = 6 THEN '.txt' ELSE '.nc' END AS name, n_nationkey % 7 = 0 AS valid, CASE n_nationkey % 7 WHEN 0 THEN 200 WHEN 5 THEN 500 ELSE 400 END AS status,
 CASE n_nationkey % 7 WHEN 0 THEN 'validation successful' WHEN 1 THEN 'Latitude from 0 to 95' WHEN 2 THEN 'Duplicate timestamps' WHEN 3 THEN 'Variables need 3 dimensions' WHEN 4 THEN 'Invalid variable name' WHEN 5 THEN 'Error reading NetCDF file' ELSE 'File must be' END AS finding FROM nation
""")
def upload_cubes(spark, folder):
    """Gridded uploads with one fault each, written and checked by tasks."""
    found = uploads.validate_uploads(read_table(spark, folder, "nation").mapInPandas(_cubes, "name string, content binary"))
    known = "validation successful|Latitude from 0 to 95|Duplicate timestamps|Variables need 3 dimensions|Invalid variable name|Error reading NetCDF file|File must be"
    return found.select("name", "valid", "status", F.regexp_extract("message", f"({known})", 1).alias("finding"))


@register(f"SELECT frm_class, criterion, count(*) AS n FROM ({FRM_SQL}) t GROUP BY ALL")
def sensors_qualified(spark, folder):
    """From a triple-collocation result to the sensor file and its counts."""
    return _qualified(spark, folder)[0]


@register(f"SELECT id, frm_class FROM ({FRM_SQL}) t")
def sensors_exported(spark, folder):
    """What the sensor file holds."""
    return spark.read.option("sep", ";").option("header", "true").csv(_qualified(spark, folder)[1]).select(F.col("id").cast("bigint").alias("id"), "frm_class")


def _qualified(spark: SparkSession, folder: str) -> tuple[DataFrame, str]:
    nan = F.lit(float("nan"))
    results = read_table(spark, folder, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.when(F.col("l_partkey") % 11 == 0, nan).otherwise(F.col("l_discount") * 100 - 3).alias("snr_all"),
        F.when(F.col("l_suppkey") % 13 == 0, nan).otherwise(F.col("l_quantity") * 4).alias("n_obs"), (F.col("l_tax") * 100).alias("low"),
        F.when(F.col("l_partkey") % 17 == 0, nan).otherwise(F.col("l_tax") * 100 + F.col("l_quantity") / 10).alias("high"), F.encode(F.col("l_returnflag"), "UTF-8").alias("network"),
    )
    path = work_path(spark, "sensors")
    return writers.export_qualified(results, path, {"snr": "snr_all", "ci_lower": "low", "ci_upper": "high"}, ("id",)), path


# --- streams ------------------------------------------------------------------------------------------------------

STREAM_SQL = "(SELECT gpi, obs_id, acquisition_time + 946728000 AS unix, soil_moisture AS value FROM smap_obs WHERE gpi IS NOT NULL AND NOT isnan(acquisition_time) AND acquisition_time <> -9999 AND NOT isnan(soil_moisture) AND soil_moisture <> -9999)"


def _arriving(spark: SparkSession, folder: str) -> str:
    """The readings as files of a folder, as they would be delivered."""
    path = work_path(spark, "arriving")
    read_table(spark, folder, "smap_obs").select("obs_id", "gpi", "acquisition_time", "soil_moisture", "ingested_at").write.parquet(path)
    return path


@register(f"SELECT s.obs_id, s.gpi, g.cell, round(s.value, 6) AS value FROM {STREAM_SQL} s JOIN (SELECT DISTINCT gpi, cell FROM grid_points WHERE grid_name = 'ease2_m09km') g ON g.gpi = s.gpi")
def stream_appended(spark, folder):
    """New readings appended to the series by cell."""
    points = read_table(spark, folder, "grid_points").where("grid_name = 'ease2_m09km'").select("gpi", "cell")
    path = work_path(spark, "cells")
    streams.append_cells(streams.readings_stream(spark, _arriving(spark, folder)), points, path).awaitTermination()
    return spark.read.parquet(path).select("obs_id", "gpi", "cell", F.round("value", 6).alias("value"))


@register(f"SELECT gpi, make_timestamp(CAST(floor(unix / 86400) * 86400 * 1000000 AS BIGINT)) AS day, round(avg(value), 6) AS value, count(*) AS n FROM {STREAM_SQL} s GROUP BY 1, 2")
def stream_daily(spark, folder):
    path = work_path(spark, "daily")
    streams.stored_results(streams.daily_mean_stream(streams.readings_stream(spark, _arriving(spark, folder))), path).awaitTermination()
    return spark.read.parquet(path).withColumn("value", F.round("value", 6))


@register("SELECT DISTINCT obs_id, gpi FROM smap_obs WHERE ingested_at IS NOT NULL")
def stream_first(spark, folder):
    """Each reading once, however often it is delivered."""
    source, path = _arriving(spark, folder), work_path(spark, "first")
    raw = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source).where("ingested_at IS NOT NULL")
    query = streams.first_deliveries(raw, ["obs_id"]).select("obs_id", "gpi").writeStream.format("parquet").option("checkpointLocation", work_path(spark, "stream")).trigger(availableNow=True).start(path)
    query.awaitTermination()
    return spark.read.parquet(path)


# --- metadata and reports, worked out by tasks -------------------------------------------------------------------------


def _recognised(batches):
    for batch in batches:
        out = []
        for k in batch["n_nationkey"].tolist():
            attrs = {"a": [{"standard_name": "latitude"}, {"long_name": "Latitude"}, {"units": "degrees_north"}, {"_CoordinateAxisType": "Lat"}, {"units": "degreeN"}][k % 5], "b": {"units": "degrees_east"}, "t": {"units": "days since 2000-01-01"}, "v": {}}
            dims = [["y", "x"], ["north_south", "east_west"], ["x", "row"], ["rows", "columns"]][k % 4]
            lat_dims, lon_dims = [(["lat"], ["lon"]), (["loc"], ["loc"]), (["y", "x"], ["y", "x"])][k % 3]
            y, x = cf.yx_dims(dims)
            out.append((k, cf.coordinate_of(attrs, "latitude"), cf.coordinate_of(attrs, "longitude"), cf.time_of(attrs, {"t": ["t"]}), y, x, grid.grid_type(lat_dims, lon_dims), len(cf.with_time_axis(["lat", "lon"], ("lat", "lon")))))
        yield pd.DataFrame(out, columns=["key", "lat", "lon", "time", "y", "x", "grid", "axes"])


@register("""SELECT n_nationkey AS key, 'a' AS lat, 'b' AS lon, 't' AS time, CASE n_nationkey % 4 WHEN 0 THEN 'y' WHEN 1 THEN 'north_south' WHEN 2 THEN 'row' ELSE 'rows' END AS y,
 CASE n_nationkey % 4 WHEN 0 THEN 'x' WHEN 1 THEN 'east_west' WHEN 2 THEN 'x' ELSE 'columns' END AS x, CASE n_nationkey % 3 WHEN 0 THEN 'regular' WHEN 1 THEN 'unstructured' ELSE 'curvilinear' END AS grid, CAST(3 AS INTEGER) AS axes FROM nation""")
def coordinates_recognised(spark, folder):
    """Coordinates, dimensions and the type of grid by their metadata."""
    return read_table(spark, folder, "nation").mapInPandas(_recognised, "key int, lat string, lon string, time string, y string, x string, grid string, axes int")


def _planned(batches):
    for batch in batches:
        rows = [(int(k), *chunk_sizes((int(s) * 40, int(s) * 30, 1000), 8.0, 8), images_in(1.0, (int(s) * 40, 100), 8)) for k, s in zip(batch["p_partkey"], batch["p_size"], strict=True)]
        yield pd.DataFrame(rows, columns=["p_partkey", "a", "b", "c", "images"])


@register("SELECT p_partkey, CAST(least(p_size * 40, 31) AS INTEGER) AS a, CAST(least(p_size * 30, 31) AS INTEGER) AS b, CAST(1000 AS INTEGER) AS c, CAST(floor(1e9 / (p_size * 40 * 100 * 8)) AS BIGINT) AS images FROM part")
def chunks_planned(spark, folder):
    """Chunks of 8 MB with the last dimension whole, and how many images fit in a gigabyte."""
    return read_table(spark, folder, "part").where("p_size > 0").mapInPandas(_planned, "p_partkey long, a int, b int, c int, images long")


def _reported(batches):
    for batch in batches:
        rows = []
        for name, content in zip(batch["name"], batch["content"], strict=True):
            info = uploads.validate_zip(bytes(content)).info
            rows.append((name, info["csv_files"], info["total_files"], info["bytes"], info.get("row_count")))
        yield pd.DataFrame(rows, columns=["name", "csv_files", "total_files", "bytes", "row_count"]).astype({"row_count": "Int64"})


@register("""
WITH named AS (SELECT DISTINCT series_id // 20 AS number, file_name FROM csv_series WHERE file_name IS NOT NULL AND lower(file_name) LIKE '%.csv')
SELECT number || '.zip' AS name, count(*) AS csv_files, count(*) AS total_files, count(*) * 17 AS bytes, CAST(1 AS BIGINT) AS row_count FROM named GROUP BY number
""")
def archive_reports(spark, folder):
    """What a check notes of an archive: files, unpacked bytes, and the rows of its first series."""
    c = read_table(spark, folder, "csv_series").where("file_name IS NOT NULL AND lower(file_name) LIKE '%.csv'")
    packed = c.select(F.floor(F.col("series_id") / 20).alias("number"), "file_name").groupBy("number").agg(F.collect_set("file_name").alias("names"))
    return packed.mapInPandas(_archives, "name string, content binary").mapInPandas(_reported, "name string, csv_files long, total_files long, bytes long, row_count long")


@register(f"SELECT t.id AS idx, t.frm_class, 'S' || (t.id % 7) AS station FROM ({FRM_SQL}) t")
def sensors_with_stations(spark, folder):
    """The sensor file with the columns of its stations, joined by index."""
    path = work_path(spark, "stations")
    classified = _sensors(spark, folder).withColumnRenamed("id", "idx").select("idx", "frm_class", "criterion")
    writers.export_sensors(classified, classified.select("idx", F.concat(F.lit("S"), (F.col("idx") % 7).cast("string")).alias("station")).distinct(), path)
    return spark.read.option("sep", ";").option("header", "true").csv(path).select(F.col("idx").cast("bigint").alias("idx"), "frm_class", "station")
