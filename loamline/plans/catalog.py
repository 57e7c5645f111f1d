"""Queries of the engine's own operators over the driver tables, each with the SQL it is checked against.

``events`` serve as observations (user_id as gpi, ts as time), customers as grid points, suppliers as stations.  The
geography is synthetic and the same on both sides: lat = (k * 37 mod 180) - 89.5, lon = (k * 71 mod 360) - 179.5,
row = k div 15, col = k mod 15.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamline.functions import times as T
from loamline.functions.missing import present
from loamline.operators import agreement, grid, images, sensors, series, swath, uploads
from loamline.operators.near import in_polygons, in_regions, valid_points
from loamline.operators.readings import all_readings
from loamline.operators.regular_grid import daily_means
from loamline.session import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

LAT = "CAST((k * 37) % 180 AS DOUBLE) - 89.5"
LON = "CAST((k * 71) % 360 AS DOUBLE) - 179.5"
OBS_SQL = f"(SELECT user_id AS gpi, ts AS time, value, event_id, {LAT.replace('k', 'user_id')} AS lat, {LON.replace('k', 'user_id')} AS lon, user_id % 3 <> 0 AS is_land FROM events)"


def register(sql: str | None = None):
    """Add a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _obs(spark: SparkSession, folder: str) -> DataFrame:
    e = read_table(spark, folder, "events")
    k = F.col("user_id")
    lat, lon = ((k * 37) % 180).cast("double") - 89.5, ((k * 71) % 360).cast("double") - 179.5
    return e.select(k.alias("gpi"), F.col("ts").alias("time"), "value", "event_id", lat.alias("lat"), lon.alias("lon"), (k % 3 != 0).alias("is_land"))


def _points(df: DataFrame, key: str) -> DataFrame:
    k = F.col(key)
    return df.select(k.alias("id"), (((k * 37) % 180).cast("double") - 89.5).alias("lat"), (((k * 71) % 360).cast("double") - 179.5).alias("lon"))


def _grid(spark: SparkSession, folder: str) -> DataFrame:
    points = _points(read_table(spark, folder, "customer"), "c_custkey").withColumnRenamed("id", "gpi")
    return points.withColumns({"row": F.floor(F.col("gpi") / 15).cast("int"), "col": (F.col("gpi") % 15).cast("int"), "is_land": F.col("gpi") % 3 != 0})


GRID_SQL = f"(SELECT c_custkey AS gpi, {LAT.replace('k', 'c_custkey')} AS lat, {LON.replace('k', 'c_custkey')} AS lon, c_custkey % 3 <> 0 AS is_land FROM customer)"
STATION_SQL = f"(SELECT s_suppkey AS id, {LAT.replace('k', 's_suppkey')} + 0.25 AS lat, {LON.replace('k', 's_suppkey')} + 0.25 AS lon FROM supplier)"
KM = "2 * 6371 * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))"


def _stations(spark: SparkSession, folder: str) -> DataFrame:
    return _points(read_table(spark, folder, "supplier"), "s_suppkey").withColumns({"lat": F.col("lat") + 0.25, "lon": F.col("lon") + 0.25})


# --- images and filters -------------------------------------------------------------------------------------------


@register(f"SELECT gpi, date_trunc('day', time)::TIMESTAMP AS time, round(avg(value), 6) AS value FROM {OBS_SQL} o WHERE lat BETWEEN -45 AND 45 AND lon BETWEEN -90 AND 90 GROUP BY ALL")
def image_to_daily_series(spark, folder):
    daily = images.daily_mean(grid.within_box(_obs(spark, folder), -90, -45, 90, 45), ["value"])
    return daily.withColumn("value", F.round("value", 6))


@register(f"SELECT gpi, time, value, event_id FROM {OBS_SQL} o WHERE time BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12 12:00:00'")
def read_block_range(spark, folder):
    return images.in_time(_obs(spark, folder), "2024-01-05", "2024-01-12 12:00:00").select("gpi", "time", "value", "event_id")


@register(f"SELECT gpi, time, lat, lon, CASE WHEN is_land THEN value END AS value FROM {OBS_SQL} o WHERE time BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20' AND lat BETWEEN -30 AND 60 AND lon BETWEEN -100 AND 100")
def read_block_masked(spark, folder):
    return images.read_block(_obs(spark, folder), "2024-01-05", "2024-01-20", (-100, -30, 100, 60), ["value"], masked=True)


@register(f"SELECT gpi, time, value, event_id FROM {OBS_SQL} o WHERE lat BETWEEN -10.5 AND 50.5 AND lon BETWEEN -100.5 AND 20.5")
def bbox_filter(spark, folder):
    return grid.within_box(_obs(spark, folder), -100.5, -10.5, 20.5, 50.5).select("gpi", "time", "value", "event_id")


@register(f"SELECT event_id, gpi, CASE WHEN is_land THEN value END AS value FROM {OBS_SQL} o")
def landmask_data(spark, folder):
    return _obs(spark, folder).select("event_id", "gpi", grid.land_only(F.col("value"), F.col("is_land")).alias("value"))


@register(f"SELECT o.event_id, o.gpi, o.value FROM {OBS_SQL} o WHERE EXISTS (SELECT 1 FROM {GRID_SQL} g WHERE g.gpi = o.gpi AND g.is_land)")
def landmask_grid(spark, folder):
    return grid.subgrid(_obs(spark, folder), grid.on_land(_grid(spark, folder))).select("event_id", "gpi", "value")


@register("SELECT l_orderkey, l_linenumber, nullif(l_quantity, 10) AS quantity FROM lineitem")
def fill_value_mask(spark, folder):
    li = read_table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("quantity"))
    return images.without_fill(li, 10, ["quantity"])


@register("SELECT l_suppkey, round(avg(CASE WHEN l_quantity <= 40 THEN l_extendedprice END), 4) AS price FROM lineitem GROUP BY l_suppkey")
def nan_mean(spark, folder):
    li = read_table(spark, folder, "lineitem").withColumn("price", F.when(F.col("l_quantity") > 40, float("nan")).otherwise(F.col("l_extendedprice")))
    return li.groupBy("l_suppkey").agg(F.round(F.avg(present(F.col("price"))), 4).alias("price"))


@register("SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE o_orderdate = (SELECT min(o_orderdate) FROM orders)")
def exact_timestamp(spark, folder):
    o = read_table(spark, folder, "orders")
    first = o.agg(F.min("o_orderdate")).first()[0]
    return images.at_time(o, first, "o_orderdate").select("o_orderkey", "o_custkey", "o_orderdate")


@register(f"SELECT gpi, time, value FROM {OBS_SQL} o WHERE time >= TIMESTAMP '2024-01-10' AND time < TIMESTAMP '2024-01-13'")
def period_filter(spark, folder):
    return images.in_period(_obs(spark, folder), "2024-01-10", "2024-01-12").select("gpi", "time", "value")


@register(f"SELECT gpi, time, value FROM {OBS_SQL} o WHERE gpi = 7")
def read_gpi_series(spark, folder):
    return series.read_gpi(_obs(spark, folder), 7).select("gpi", "time", "value")


@register(f"SELECT event_id, CASE WHEN (event_id & 5) = 0 THEN value END AS value FROM {OBS_SQL} o")
def quality_bits(spark, folder):
    return _obs(spark, folder).select("event_id", images.where_bits(F.col("value"), F.col("event_id"), 5).alias("value"))


@register("SELECT obs_id, gpi, CASE WHEN quality_flag IS NOT NULL AND (quality_flag & 1) = 0 AND NOT isnan(soil_moisture) AND soil_moisture <> -9999 THEN soil_moisture END AS soil_moisture FROM smap_obs")
def quality_bits_readings(spark, folder):
    r = read_table(spark, folder, "smap_obs")
    return r.select("obs_id", "gpi", images.where_bits(present(F.col("soil_moisture"), -9999.0), F.col("quality_flag"), 1).alias("soil_moisture"))


# --- grids --------------------------------------------------------------------------------------------------------


@register("SELECT CAST(a.i * 72 + b.j AS BIGINT) AS gpi, CAST(a.i AS INTEGER) AS \"row\", CAST(b.j AS INTEGER) AS col, round(-90 + a.i * 5.0::DOUBLE, 5) AS lat, round(-180 + b.j * 5.0::DOUBLE, 5) AS lon FROM range(36) a(i) CROSS JOIN range(72) b(j)")
def grid_from_dims(spark, folder):
    read_table(spark, folder, "nation")
    return grid.grid_from_dims(grid.coord_range(spark, -90, 90, 5, "lat"), grid.coord_range(spark, -180, 180, 5, "lon"))


@register("SELECT CAST(i AS INTEGER) AS idx, round(29.875::DOUBLE + i * 0.25::DOUBLE, 5) AS lat FROM range(100) t(i)")
def coord_arange(spark, folder):
    read_table(spark, folder, "nation")
    return grid.coord_range(spark, 29.875, 54.75, 0.25, "lat")


@register(f"SELECT CAST(gpi // 15 AS INTEGER) AS \"row\", round(avg(CASE WHEN gpi % 7 <> 0 THEN lat END), 6) AS lat FROM {GRID_SQL} g GROUP BY 1")
def coord_mean_2d(spark, folder):
    g = _grid(spark, folder).withColumn("lat", F.when(F.col("gpi") % 7 == 0, -9999.0).otherwise(F.col("lat")))
    return grid.axis_means(g)[0].withColumn("lat", F.round("lat", 6))


@register(f"SELECT gpi, CAST(floor(floor((lon + 180) / 5) * (180 / 5.0) + floor((lat + 90) / 5)) AS INTEGER) AS cell FROM {GRID_SQL} g")
def cell_assignment(spark, folder):
    return grid.with_cells(_grid(spark, folder), 5).select("gpi", "cell")


@register("SELECT grid_name, gpi, CAST(floor(floor((lon + 180) / 5) * 36 + floor((lat + 90) / 5)) AS INTEGER) AS cell FROM grid_points")
def cell_assignment_points(spark, folder):
    return grid.with_cells(read_table(spark, folder, "grid_points"), 5).select("grid_name", "gpi", "cell")


@register(f"SELECT round(30 * sqrt((max(lat) - min(lat)) * (max(lon) - min(lon)) / count(*)), 6) AS cellsize FROM {GRID_SQL} g")
def cellsize_heuristic(spark, folder):
    return grid.cellsize(_grid(spark, folder)).select(F.round("cellsize", 6).alias("cellsize"))


@register(f"SELECT id, arg_min(gpi, km) AS gpi FROM (SELECT a.id, b.gpi, {KM} + b.gpi * 1e-9 AS km FROM {STATION_SQL} a CROSS JOIN {GRID_SQL} b) t GROUP BY id")
def nearest_gpi(spark, folder):
    return grid.nearest_point(_stations(spark, folder), _grid(spark, folder), "id").select("id", "gpi")


@register(f"SELECT DISTINCT a.gpi, a.lat, a.lon FROM {GRID_SQL} a WHERE EXISTS (SELECT 1 FROM {STATION_SQL} b WHERE {KM} <= 150)")
def radius_semi_join(spark, folder):
    return grid.near_stations(_grid(spark, folder), _stations(spark, folder), "gpi", 150).select("gpi", "lat", "lon")


@register(f"SELECT p.id, o.time, round(avg(o.value), 6) AS mean, count(o.value) AS n FROM (SELECT a.id, b.gpi FROM {STATION_SQL} a JOIN {GRID_SQL} b ON {KM} <= 300) p JOIN {OBS_SQL} o ON o.gpi = p.gpi GROUP BY p.id, o.time")
def area_mean(spark, folder):
    return agreement.area_mean(_obs(spark, folder).select("gpi", "time", "value"), _grid(spark, folder), _stations(spark, folder), "id", 300, "value", 6)


@register(f"SELECT DISTINCT a.id, b.n AS region FROM {STATION_SQL} a JOIN (SELECT n_name AS n, n_nationkey * 6.0 - 80 AS y, n_nationkey * 12.0 - 170 AS x FROM nation) b ON a.lat BETWEEN b.y AND b.y + 10 AND a.lon BETWEEN b.x AND b.x + 20")
def containing_region(spark, folder):
    n = read_table(spark, folder, "nation").select(F.col("n_name").alias("region"), (F.col("n_nationkey") * 6.0 - 80).alias("lat_min"), (F.col("n_nationkey") * 12.0 - 170).alias("lon_min"))
    return in_regions(_stations(spark, folder), n.withColumns({"lat_max": F.col("lat_min") + 10, "lon_max": F.col("lon_min") + 20}), "id", "region")


@register(f"SELECT DISTINCT a.id, b.n AS region FROM {STATION_SQL} a JOIN (SELECT n_name AS n, n_nationkey * 6.0 - 80 AS y, n_nationkey * 15.0 - 190 AS x FROM nation) b ON a.lat BETWEEN b.y AND b.y + 10 AND (a.lon - b.x + 720) % 360 <= 20")
def containing_polygon(spark, folder):
    """As rings, some of them across the date line."""
    n = read_table(spark, folder, "nation").select(F.col("n_name").alias("region"), (F.col("n_nationkey") * 6.0 - 80).alias("y"), (F.col("n_nationkey") * 15.0 - 190).alias("x"))
    corner = lambda dy, dx: F.struct((F.col("y") + dy).alias("lat"), (F.col("x") + dx).alias("lon"))
    return in_polygons(_stations(spark, folder), n.select("region", F.array(corner(0, 0), corner(10, 0), corner(10, 20), corner(0, 20)).alias("ring")), "id", "region")


@register("SELECT DISTINCT lat, lon FROM ismn_stations WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 360")
def distinct_coords(spark, folder):
    return valid_points(read_table(spark, folder, "ismn_stations")).select("lat", "lon").distinct()


# --- swaths and catalogs ------------------------------------------------------------------------------------------


@register("SELECT c.c_custkey AS gpi, o.o_orderkey AS obs FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey")
def swath_to_grid_left(spark, folder):
    orbit = read_table(spark, folder, "orders").select(F.col("o_custkey").alias("gpi"), F.col("o_orderkey").alias("obs"))
    return series.swath_to_grid(orbit, _grid(spark, folder), keep_grid=True).select("gpi", "obs")


@register("SELECT s.obs_id, g.gpi, g.cell FROM smap_obs s JOIN grid_points g ON g.row_idx = s.row_idx AND g.col_idx = s.col_idx WHERE g.grid_name = 'ease2_m09km'")
def swath_by_row_col(spark, folder):
    g = read_table(spark, folder, "grid_points").where("grid_name = 'ease2_m09km'").select("row_idx", "col_idx", "gpi", "cell")
    orbit = read_table(spark, folder, "smap_obs").select("row_idx", "col_idx", "obs_id")
    return series.swath_to_grid(orbit, g, ("row_idx", "col_idx")).select("obs_id", "gpi", "cell")


@register("SELECT l_partkey, l_suppkey, arg_max(l_quantity, (l_orderkey * 100 + l_linenumber) * 1000 + l_quantity) AS quantity, max(l_orderkey * 100 + l_linenumber) AS place FROM lineitem GROUP BY l_partkey, l_suppkey")
def swath_scatter_last_wins(spark, folder):
    li = read_table(spark, folder, "lineitem").select("l_partkey", "l_suppkey", F.col("l_quantity").alias("quantity"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("place"))
    return series.last_wins(li, ["l_partkey", "l_suppkey"], ["place"])


@register("SELECT received_at AS time, max(mailbox) AS path FROM documents WHERE received_at IS NOT NULL GROUP BY received_at")
def file_time_map_last(spark, folder):
    d = read_table(spark, folder, "documents").where("received_at IS NOT NULL").select(F.col("mailbox").alias("path"), F.col("received_at").alias("time"))
    return images.file_of_time(d)


@register("SELECT p_brand, max(p_name) AS version FROM part GROUP BY p_brand")
def latest_version_string(spark, folder):
    return images.latest_versions(read_table(spark, folder, "part").select("p_brand", F.col("p_name").alias("version")), ["p_brand"], "version")


@register("SELECT area, max(trim(vers)) AS vers FROM image_versions GROUP BY area")
def latest_version_images(spark, folder):
    """By text and area, over all rows; ``latest_version_by_image`` goes by numbers and images."""
    return images.latest_versions(read_table(spark, folder, "image_versions").withColumn("vers", F.trim("vers")), ["area"], "vers")


@register(r"""
WITH files AS (SELECT lower(trim(prod)) AS prod, trim(area) AS area, try_strptime(trim(img_datetime), ['%Y%m%d%H%M', '%Y%m%dT%H%M%S', '%Y-%m-%d %H:%M', '%Y-%m-%dT%H:%M:%SZ']) AS time, regexp_replace(trim(vers), '^[vV]', '') AS vers FROM image_versions),
ranked AS (SELECT *, row_number() OVER (PARTITION BY prod, area, time ORDER BY list_resize(list_transform(string_split(vers, '.'), lambda p: coalesce(TRY_CAST(p AS BIGINT), -1)), 8, 0) DESC NULLS LAST, vers DESC) AS r FROM files)
SELECT prod, area, time, vers FROM ranked WHERE r = 1
""")
def latest_version_by_image(spark, folder):
    """The newest version of each image (prod regardless of case, area, instant), by numbers, in any spelling."""
    at = F.trim("img_datetime")
    time = F.coalesce(*(F.try_to_timestamp(at, F.lit(f)) for f in ("yyyyMMddHHmm", "yyyyMMdd'T'HHmmss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd'T'HH:mm:ssX"))).cast("timestamp_ntz")
    files = read_table(spark, folder, "image_versions").select(F.lower(F.trim("prod")).alias("prod"), F.trim("area").alias("area"), time.alias("time"), images.bare_version(F.col("vers")).alias("vers"))
    return images.latest_versions(files, ["prod", "area", "time"], "vers", numeric=True)


@register("SELECT p.p_partkey, p.p_brand, p.p_name FROM part p WHERE EXISTS (SELECT 1 FROM part q WHERE q.p_brand = p.p_brand AND q.p_name > p.p_name)")
def version_cleanup_candidates(spark, folder):
    return images.outdated_files(read_table(spark, folder, "part"), ["p_brand"], "p_name").select("p_partkey", "p_brand", "p_name")


@register("SELECT image_id, try_strptime(regexp_extract(file_name, '_([0-9]{12})_', 1), '%Y%m%d%H%M') AS time FROM image_versions")
def filename_timestamp(spark, folder):
    return read_table(spark, folder, "image_versions").select("image_id", T.time_in_name(F.col("file_name"), "%Y%m%d%H%M", r"_([0-9]{12})_").alias("time"))


@register("SELECT o_orderkey, CAST(u.s AS INTEGER) AS slot, o_orderdate + to_hours(CAST(u.s * 6 AS INTEGER)) AS time FROM orders CROSS JOIN range(4) u(s)")
def timestamp_expansion(spark, folder):
    o = read_table(spark, folder, "orders").select("o_orderkey", F.col("o_orderdate").alias("time"))
    return images.expand_times(o, [0, 6 * 3600, 12 * 3600, 18 * 3600]).select("o_orderkey", "slot", "time")


@register("SELECT DATE '2000-01-01'::TIMESTAMP + to_days(CAST(d.i AS INTEGER)) + to_hours(CAST(h.i * 12 AS INTEGER)) AS time FROM range(10) d(i) CROSS JOIN range(2) h(i)")
def daily_timestamp_grid(spark, folder):
    return images.daily_times(read_table(spark, folder, "nation"), "2000-01-01", "2000-01-10", [0, 12])


@register("SELECT 1 AS part, o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 2, o_orderkey, o_custkey FROM orders WHERE o_orderstatus <> 'F'")
def vstack_union(spark, folder):
    o = read_table(spark, folder, "orders")
    parts = [o.where(c).select(F.lit(i).alias("part"), "o_orderkey", "o_custkey") for i, c in ((1, "o_orderstatus = 'F'"), (2, "o_orderstatus <> 'F'"))]
    return parts[0].unionByName(parts[1])


@register("SELECT c_custkey AS gpi FROM customer INTERSECT SELECT o_custkey FROM orders")
def id_intersection(spark, folder):
    return read_table(spark, folder, "customer").select(F.col("c_custkey").alias("gpi")).intersect(read_table(spark, folder, "orders").select(F.col("o_custkey").alias("gpi")))


# --- times --------------------------------------------------------------------------------------------------------


@register("SELECT event_id, ts + to_seconds(CAST(trunc(value) AS BIGINT)) AS time FROM events")
def offset_to_absolute(spark, folder):
    e = read_table(spark, folder, "events")
    return e.select("event_id", T.shifted(F.col("ts"), F.col("value"), F.lit("Seconds")).alias("time"))


@register("SELECT event_id, TIMESTAMP '2000-01-01 12:00:00' + to_minutes(CAST(trunc(value * 100) AS BIGINT)) AS time FROM events")
def absolute_time_var(spark, folder):
    e = read_table(spark, folder, "events").select("event_id", (F.col("value") * 100).alias("exact"))
    return series.correct_time(e, "exact", "minutes", "2000-01-01 12:00:00")


@register("SELECT event_id, nullif((user_id % 2) * 86400 + event_id % 3, 0) AS seconds FROM events")
def acquisition_zero_null(spark, folder):
    e = read_table(spark, folder, "events")
    return e.select("event_id", T.orbit_seconds(F.col("user_id") % 2, F.col("event_id") % 3).alias("seconds"))


@register("SELECT event_id, CAST(CASE WHEN event_id % 5 = 0 THEN 0 WHEN user_id % 2 = 0 THEN 1 ELSE 2 END AS TINYINT) AS overpass FROM events")
def overpass_flag(spark, folder):
    e = read_table(spark, folder, "events")
    flag, value = F.when(F.col("user_id") % 2 == 0, "A").otherwise("D"), F.when(F.col("event_id") % 5 == 0, float("nan")).otherwise(F.col("value"))
    return e.select("event_id", T.overpass_code(flag, value).alias("overpass"))


@register("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN date_trunc('day', o_orderdate) WHEN 1 THEN date_trunc('minute', o_orderdate) ELSE date_trunc('second', o_orderdate) END::TIMESTAMP AS time FROM orders")
def date_by_length(spark, folder):
    o = read_table(spark, folder, "orders")
    text = F.substring(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(1), F.when(F.col("o_orderkey") % 3 == 0, 10).when(F.col("o_orderkey") % 3 == 1, 16).otherwise(19))
    return o.select("o_orderkey", T.date_by_length(text).alias("time"))


@register("SELECT DISTINCT timeoffsetunit AS unit, CASE lower(left(timeoffsetunit, 1)) WHEN 's' THEN 1 WHEN 'm' THEN 60 WHEN 'h' THEN 3600 WHEN 'd' THEN 86400 END::BIGINT AS seconds FROM acq_raw")
def time_units(spark, folder):
    return read_table(spark, folder, "acq_raw").select(F.col("timeoffsetunit").alias("unit"), T.unit_seconds(F.col("timeoffsetunit")).alias("seconds")).distinct()


@register("SELECT event_id, event_type IN ('True', 'true', 't', 'T', '1', 'yes', 'y') OR user_id % 10 = 1 AS flag FROM events")
def truthy_text(spark, folder):
    e = read_table(spark, folder, "events")
    return e.select("event_id", T.truthy(F.when(F.col("user_id") % 10 == 1, "yes").otherwise(F.col("event_type"))).alias("flag"))


# --- arrays -------------------------------------------------------------------------------------------------------


@register("SELECT vec_id, round(embedding[1]::DOUBLE, 6) AS embedding_0, round(embedding[6]::DOUBLE, 6) AS embedding_5, CAST(NULL AS DOUBLE) AS embedding_99 FROM embeddings")
def level_select(spark, folder):
    e = read_table(spark, folder, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    out = images.select_levels(e, {"embedding": [0, 5, 99]}, ["vec_id", "embedding"])
    return out.select("vec_id", *(F.round(c, 6).alias(c) for c in out.columns[1:]))


@register("SELECT vec_id, CAST(i AS INTEGER) AS gpi, CAST(i // 8 AS INTEGER) AS \"row\", CAST(i % 8 AS INTEGER) AS col, round(embedding[i + 1]::DOUBLE, 6) AS value FROM embeddings CROSS JOIN range(64) t(i)")
def stack_flatten(spark, folder):
    e = read_table(spark, folder, "embeddings").select("vec_id", "embedding")
    return images.flatten_image(e, "embedding", 8).withColumn("value", F.round(F.col("value").cast("double"), 6))


@register("SELECT vec_id, CAST((7 - i // 8) * 8 + i % 8 AS INTEGER) AS gpi, CAST(7 - i // 8 AS INTEGER) AS \"row\", CAST(i % 8 AS INTEGER) AS col, round(embedding[i + 1]::DOUBLE, 6) AS value FROM embeddings CROSS JOIN range(64) t(i)")
def flip_rows(spark, folder):
    e = read_table(spark, folder, "embeddings").select("vec_id", "embedding")
    return images.flatten_image(e, "embedding", 8, flip=True, rows=8).withColumn("value", F.round(F.col("value").cast("double"), 6))


@register(f"SELECT gpi, CAST(count(*) AS INTEGER) AS steps, min(time) AS first_time, arg_min(event_id, struct_pack(t := time, e := event_id)) AS first_event FROM {OBS_SQL} o GROUP BY gpi")
def transpose_series(spark, folder):
    t = series.transposed(_obs(spark, folder), ["event_id", "value"])
    return t.select("gpi", F.size("series").alias("steps"), F.col("series")[0]["time"].alias("first_time"), F.col("series")[0]["event_id"].alias("first_event"))


# --- statistics ---------------------------------------------------------------------------------------------------


@register(f"SELECT gpi, round(corr(value, event_id % 97), 6) AS r, count(*) AS n FROM {OBS_SQL} o GROUP BY gpi")
def pearson_per_gpi(spark, folder):
    o = _obs(spark, folder).withColumn("other", (F.col("event_id") % 97).cast("double"))
    return agreement.correlation(o, "value", "other", ["gpi"]).withColumn("r", F.round("r", 6))


@register(f"SELECT gpi, round(sqrt(avg(pow(value - event_id % 97, 2))), 6) AS rmsd, count(*) AS n FROM {OBS_SQL} o GROUP BY gpi")
def rmsd(spark, folder):
    o = _obs(spark, folder).withColumn("other", (F.col("event_id") % 97).cast("double"))
    return agreement.root_mean_square_difference(o, "value", "other", ["gpi"]).withColumn("rmsd", F.round("rmsd", 6))


@register(f"SELECT o.event_id, round((o.value - m.a) / m.b * m.d + m.c, 4) AS scaled FROM {OBS_SQL} o JOIN (SELECT gpi, avg(value) AS a, stddev_pop(value) AS b, avg(event_id % 97) AS c, stddev_pop(event_id % 97) AS d FROM {OBS_SQL} p GROUP BY gpi) m ON m.gpi = o.gpi")
def mean_std_scale(spark, folder):
    o = _obs(spark, folder).withColumn("other", (F.col("event_id") % 97).cast("double"))
    return agreement.scaled_to(o, "value", "other", ["gpi"]).select("event_id", F.round("scaled", 4).alias("scaled"))


@register(f"SELECT date_trunc('day', time)::TIMESTAMP AS day, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, count(value) AS n FROM {OBS_SQL} o GROUP BY 1")
def pixel_mean_std_count(spark, folder):
    o = _obs(spark, folder).withColumn("day", F.date_trunc("day", "time").cast("timestamp_ntz"))
    return agreement.moments(o, "value", ["day"]).select("day", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "n")


READINGS_DAILY = """
SELECT sensor, gpi, CAST(floor(unix / 86400) AS INTEGER) AS day, round(avg(CASE WHEN value BETWEEN 0 AND 1 THEN value END), 6) AS value, count(*) AS n FROM (
  SELECT 'smap' AS sensor, gpi, acquisition_time + 946728000 AS unix, soil_moisture AS value FROM smap_obs WHERE NOT isnan(acquisition_time) AND acquisition_time <> -9999 AND NOT isnan(soil_moisture) AND soil_moisture <> -9999
  UNION ALL SELECT 'smos', gpi, acquisition_time + 946684800, soil_moisture FROM smos_obs WHERE acquisition_time NOT IN (0, -999) AND NOT isnan(acquisition_time) AND NOT isnan(soil_moisture) AND soil_moisture <> -999) r
GROUP BY 1, 2, 3"""


@register(READINGS_DAILY)
def daily_mean_readings(spark, folder):
    r = all_readings(read_table(spark, folder, "smap_obs"), read_table(spark, folder, "smos_obs"))
    return daily_means(r, (0.0, 1.0)).withColumn("value", F.round("value", 6))


# --- sensors ------------------------------------------------------------------------------------------------------

SENSOR_SQL = """(SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE l_discount * 100 - 3 END AS snr, CASE WHEN l_suppkey % 13 = 0 THEN NULL ELSE l_quantity * 4 END AS nobs,
 l_tax * 100 AS lo, CASE WHEN l_partkey % 17 = 0 THEN NULL ELSE l_tax * 100 + l_quantity / 10 END AS hi FROM lineitem)"""
GOOD_SQL = "coalesce(NOT coalesce(nobs < 100, false) AND NOT coalesce(hi - lo > 3, false) AND snr IS NOT NULL, false)"
FRM_SQL = f"""SELECT id, CASE WHEN {GOOD_SQL} AND snr >= 3 THEN 'very representative' WHEN {GOOD_SQL} AND snr >= 0 THEN 'representative' WHEN {GOOD_SQL} THEN 'not representative' ELSE 'undeducible' END AS frm_class,
 CASE WHEN {GOOD_SQL} THEN 'ok' WHEN coalesce(hi - lo > 3, false) THEN 'large CI range' WHEN coalesce(nobs < 100, false) THEN 'low nobs' ELSE 'other' END AS criterion FROM {SENSOR_SQL} s"""


def _sensors(spark: SparkSession, folder: str) -> DataFrame:
    nan = F.lit(float("nan"))
    li = read_table(spark, folder, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.when(F.col("l_partkey") % 11 == 0, nan).otherwise(F.col("l_discount") * 100 - 3).alias("snr"),
        F.when(F.col("l_suppkey") % 13 == 0, nan).otherwise(F.col("l_quantity") * 4).alias("nobs"), (F.col("l_tax") * 100).alias("lo"),
        F.when(F.col("l_partkey") % 17 == 0, nan).otherwise(F.col("l_tax") * 100 + F.col("l_quantity") / 10).alias("hi"),
    )
    return sensors.classify(li, "snr", "nobs", "lo", "hi")


@register(FRM_SQL)
def frm_classify(spark, folder):
    return _sensors(spark, folder).select("id", "frm_class", "criterion")


@register(f"SELECT frm_class, criterion, count(*) AS n FROM ({FRM_SQL}) t GROUP BY ALL")
def frm_counts(spark, folder):
    return sensors.class_counts(_sensors(spark, folder))


# --- uploads ------------------------------------------------------------------------------------------------------

NAME_RE = r"^(.+?)_gpi=(\d+)_lat=(-?\d+(\.\d+)?)_lon=(-?\d+(\.\d+)?)\.csv$"


@register(rf"SELECT series_id, regexp_matches(file_name, '{NAME_RE}') AS ok, CASE WHEN regexp_matches(file_name, '{NAME_RE}') THEN try_cast(regexp_extract(file_name, '_gpi=(\d+)_', 1) AS BIGINT) END AS gpi FROM csv_series")
def name_validation(spark, folder):
    c = read_table(spark, folder, "csv_series")
    return c.join(uploads.name_findings(c.select("file_name").distinct(), "file_name"), "file_name").select("series_id", "ok", "gpi")


@register(f"SELECT gpi, count(*) AS n, count(DISTINCT date_trunc('hour', time)) AS times, count(*) <> count(DISTINCT date_trunc('hour', time)) AS repeated FROM {OBS_SQL} o GROUP BY gpi")
def duplicate_timestamps(spark, folder):
    return uploads.repeated_times(_obs(spark, folder).withColumn("time", F.date_trunc("hour", "time")), ["gpi"])


@register("SELECT o_custkey, array_to_string(list_slice(e, 1, 3), '; ') || CASE WHEN len(e) > 3 THEN ' (and ' || (len(e) - 3) || ' more errors)' ELSE '' END AS message FROM (SELECT o_custkey, list(CAST(o_orderkey AS VARCHAR) ORDER BY CAST(o_orderkey AS VARCHAR)) AS e FROM orders GROUP BY o_custkey) t")
def error_summary(spark, folder):
    o = read_table(spark, folder, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.col("o_orderkey").cast("string"))).alias("e"))
    return o.select("o_custkey", uploads.error_line(F.col("e")).alias("message"))


@register("""
WITH c AS (SELECT dataset_name, file_name, CASE WHEN CAST(lat AS VARCHAR) NOT IN ('nan', '-9999.0') THEN lat END AS lat, CASE WHEN CAST(lon AS VARCHAR) NOT IN ('nan', '-9999.0') THEN lon END AS lon FROM csv_series)
SELECT dataset_name, count(*) AS files, count(DISTINCT file_name) AS names, min(lat) AS lat_min, max(lat) AS lat_max, min(lon) AS lon_min, max(lon) AS lon_max,
  count(*) FILTER (WHERE lat IS NULL OR lon IS NULL) AS missing, count(*) FILTER (WHERE lat NOT BETWEEN -90 AND 90 OR lon NOT BETWEEN -180 AND 180) AS outside FROM c GROUP BY dataset_name
""")
def coordinate_ranges(spark, folder):
    """Bounds of both coordinates over all rows, and how many lack a coordinate or have one out of -90..90 or -180..180."""
    return uploads.coordinate_report(read_table(spark, folder, "csv_series"), "dataset_name", "file_name")


# --- swaths of the missions, and what remains ---------------------------------------------------------------------


@register("SELECT s.obs_id, s.gpi, g.cell, make_timestamp(CAST(round((s.acquisition_time + 946728000) * 1000000) AS BIGINT)) AS time, CASE WHEN NOT isnan(s.soil_moisture) AND s.soil_moisture <> -9999 THEN s.soil_moisture END AS soil_moisture FROM smap_obs s JOIN grid_points g ON g.row_idx = s.row_idx AND g.col_idx = s.col_idx AND g.grid_name = 'ease2_m09km' WHERE s.acquisition_time IS NOT NULL AND NOT isnan(s.acquisition_time)")
def smap_on_grid(spark, folder):
    g = read_table(spark, folder, "grid_points").where("grid_name = 'ease2_m09km'").select("row_idx", "col_idx", "gpi", "cell", "is_land")
    rows = swath.smap_rows(read_table(spark, folder, "smap_obs").select("obs_id", "row_idx", "col_idx", "acquisition_time", "soil_moisture"))
    return swath.on_grid(rows, g, "smap").select("obs_id", "gpi", "cell", "time", "soil_moisture")


@register("SELECT s.obs_id, s.gpi, make_timestamp(CAST(round((s.acquisition_time + 946684800) * 1000000) AS BIGINT)) AS time FROM smos_obs s JOIN grid_points g ON g.gpi = s.gpi AND g.grid_name = 'smos_dgg' AND g.is_land WHERE s.acquisition_time IS NOT NULL AND NOT isnan(s.acquisition_time) AND s.acquisition_time <> 0")
def smos_on_land(spark, folder):
    g = read_table(spark, folder, "grid_points").where("grid_name = 'smos_dgg'").select("gpi", "cell", "is_land")
    o = read_table(spark, folder, "smos_obs").select("obs_id", "gpi", F.col("soil_moisture").alias("Soil_Moisture"), "acquisition_time")
    day = F.floor(present(F.col("acquisition_time")) / 86400)
    split = o.withColumns({"Days": day, "Seconds": present(F.col("acquisition_time")) - day * 86400}).drop("acquisition_time")
    return swath.on_grid(swath.smos_rows(split), g, "smos", only_land=True).select("obs_id", "gpi", F.expr("CAST(time AS TIMESTAMP_NTZ)").alias("time"))


@register("SELECT DISTINCT file_name, try_strptime(regexp_extract(file_name, '_([0-9]{8}T[0-9]{6})_R', 1), '%Y%m%dT%H%M%S') AS time FROM smap_obs")
def orbit_times(spark, folder):
    return read_table(spark, folder, "smap_obs").select("file_name").distinct().select("file_name", swath.orbit_time(F.col("file_name"), "smap").alias("time"))


@register(f"SELECT a.event_id, a.gpi, round(b.value, 6) AS daily FROM {OBS_SQL} a LEFT JOIN (SELECT gpi, date_trunc('day', time)::TIMESTAMP AS day, avg(value) AS value FROM {OBS_SQL} o WHERE value > 250 GROUP BY ALL) b ON b.gpi = a.gpi AND b.day = date_trunc('day', a.time)::TIMESTAMP")
def join_by_day(spark, folder):
    o = _obs(spark, folder).select("gpi", "time", "value", "event_id")
    daily = images.daily_mean(o.where("value > 250"), ["value"]).withColumnRenamed("value", "daily")
    return images.joined_by_day(o.select("gpi", "time", "event_id"), daily, ["gpi"]).select("event_id", "gpi", F.round("daily", 6).alias("daily"))


@register(f"SELECT o.event_id, g.lat, g.lon FROM {OBS_SQL} o LEFT JOIN {GRID_SQL} g ON g.gpi = o.gpi")
def gpi_coordinates(spark, folder):
    return grid.coordinates_of(_obs(spark, folder).select("event_id", "gpi"), _grid(spark, folder)).select("event_id", "lat", "lon")


@register("SELECT gpi, cell, lat, lon FROM grid_points WHERE cell IN (1780, 2357, 1715, 316)")
def points_of_cell(spark, folder):
    return grid.points_of_cells(read_table(spark, folder, "grid_points"), [1780, 2357, 1715, 316]).select("gpi", "cell", "lat", "lon")


@register("SELECT obs_id, CASE WHEN soil_moisture IS NULL OR isnan(soil_moisture) THEN -1.0 ELSE soil_moisture END AS soil_moisture FROM smos_obs")
def fill_on_read(spark, folder):
    return images.with_fill(read_table(spark, folder, "smos_obs").select("obs_id", "soil_moisture"), -1, ["soil_moisture"])


@register("SELECT reader_name, count(*) AS files, count(*) FILTER (WHERE path LIKE '%.nc') AS nc_files, sum(size_bytes)::BIGINT AS bytes FROM image_files GROUP BY reader_name")
def file_counts(spark, folder):
    return images.file_report(read_table(spark, folder, "image_files"))


@register("SELECT image_id, prod, CASE WHEN starts_with(upper(prod), 'SWI') THEN 'SCATSAR' ELSE 'S1CSAR' END AS sensor FROM image_versions")
def product_sensors(spark, folder):
    return read_table(spark, folder, "image_versions").select("image_id", "prod", T.sensor_of_product(F.upper("prod")).alias("sensor"))


@register("SELECT dataset_name, count(*) AS n, count(*) FILTER (WHERE g > 1) AS in_repeated FROM (SELECT dataset_name, count(*) OVER (PARTITION BY file_name) AS g FROM csv_series) t GROUP BY dataset_name")
def repeated_names(spark, folder):
    return uploads.repeated_names(read_table(spark, folder, "csv_series"), "dataset_name", "file_name")
