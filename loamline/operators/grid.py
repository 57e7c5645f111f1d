"""Grids as tables: gpi, cell, row, col, lat, lon, is_land."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamline.functions.missing import present
from loamline.operators.near import great_circle_km, near_pairs, valid_points
from loamline.session import EngineError, cut

GRID_TYPES = ("regular", "curvilinear", "unstructured")


def coord_range(spark: SparkSession, start: float, stop: float, step: float, name: str = "value") -> DataFrame:
    """(idx, name): start, start + step, ... below stop, rounded to five decimals."""
    n = max(math.ceil((stop - start) / step), 0)
    return spark.range(n).select(F.col("id").cast("int").alias("idx"), F.round(F.lit(float(start)) + F.col("id") * F.lit(float(step)), 5).alias(name))


def grid_from_dims(lats: DataFrame, lons: DataFrame) -> DataFrame:
    """The regular grid of two coordinate tables (idx, lat) and (idx, lon), idx from 0, row by row: gpi = row * columns +
    col.  Points are counted out and look their coordinates up, so nothing is multiplied by a join."""
    rows, columns = (t.agg(F.count(F.lit(1))).first()[0] for t in (lats, lons))
    gpi = F.col("gpi")
    points = lats.sparkSession.range(rows * columns).select(F.col("id").alias("gpi")).withColumns({"row": F.floor(gpi / columns).cast("int"), "col": (gpi % columns).cast("int")})
    return points.join(lats.select(F.col("idx").alias("row"), "lat"), "row").join(lons.select(F.col("idx").alias("col"), "lon"), "col").select("gpi", "row", "col", "lat", "lon")


def grid_from_points(points: DataFrame, order_by: list[str]) -> DataFrame:
    """An unstructured grid: points numbered from 0 in the given order.

    Numbers come from per-partition counts after a range sort, so no task sees all points."""
    ordered = points.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    spark = points.sparkSession
    numbered = ordered.withColumns({"part": F.spark_partition_id(), "within": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})

    numbered = cut(numbered, "grid-points")
    counts = sorted(numbered.groupBy("part").count().collect())  # one row per partition
    starts, total = [], 0
    for part, n in counts:
        starts.append((part, total))
        total += n
    offsets = spark.createDataFrame(starts, "part int, start long")
    return numbered.join(F.broadcast(offsets), "part").withColumn("gpi", F.col("start") + F.col("within")).drop("part", "within", "start")


def cell_number(lat: Column, lon: Column, size: float) -> Column:
    """The cell of a point: columns of ``size`` degrees from the date line, counted upwards; 180 / size isn't rounded."""
    return F.floor(F.floor((lon + 180) / size) * (180 / size) + F.floor((lat + 90) / size)).cast("int")


def cellsize(grid: DataFrame) -> DataFrame:
    """(cellsize): 30 * sqrt(lat extent * lon extent / points); 180 where that is 0 or the grid is empty."""
    area = (F.max("lat") - F.min("lat")) * (F.max("lon") - F.min("lon")) / F.count(F.lit(1))
    return grid.agg((30 * F.sqrt(area)).alias("size")).select(F.when(F.col("size") > 0, F.col("size")).otherwise(180.0).alias("cellsize"))


def infer_cellsize(grid: DataFrame) -> float:
    """``cellsize`` as a number."""
    return cellsize(grid).first()[0]


def with_cells(grid: DataFrame, size: float | None = None) -> DataFrame:
    """Adds ``cell``; the size is inferred where none is given."""
    return grid.withColumn("cell", cell_number(F.col("lat"), F.col("lon"), size or infer_cellsize(grid)))


def within_box(df: DataFrame, lon_min: float, lat_min: float, lon_max: float, lat_max: float) -> DataFrame:
    """Rows inside a box, all edges included; missing coordinates are outside."""
    return df.where(F.col("lat").between(lat_min, lat_max) & F.col("lon").between(lon_min, lon_max))


def on_land(grid: DataFrame) -> DataFrame:
    """Grid points on land; an unknown mask is no land."""
    return grid.where(F.coalesce("is_land", F.lit(False)))


def land_only(value: Column, is_land: Column) -> Column:
    """A value, missing off land: the row stays."""
    return F.when(is_land, value)


def subgrid(grid: DataFrame, gpis: DataFrame) -> DataFrame:
    """Grid points whose gpi is listed."""
    return grid.join(gpis.select("gpi"), "gpi", "left_semi")


def axis_means(grid: DataFrame, fill: float = -9999.0) -> tuple[DataFrame, DataFrame]:
    """Axes of a grid given by two-dimensional coordinates: mean latitude by row and mean longitude by column."""
    by_row = grid.groupBy("row").agg(F.avg(present(F.col("lat"), fill)).alias("lat"))
    return by_row, grid.groupBy("col").agg(F.avg(present(F.col("lon"), fill)).alias("lon"))


def grid_type(lat_dims: list[str], lon_dims: list[str], lat_size: int | None = None, lon_size: int | None = None) -> str:
    """The type of grid that coordinate dimensions describe; without dimension names equal sizes are ambiguous."""
    if len(lat_dims) == 2 and len(lon_dims) == 2:
        return "curvilinear"
    if len(lat_dims) != 1 or len(lon_dims) != 1:
        raise EngineError("coordinates must have one or two dimensions, both the same number")
    if lat_dims[0] and lon_dims[0]:
        return "unstructured" if lat_dims == lon_dims else "regular"
    if lat_size is not None and lat_size == lon_size:
        raise EngineError("latitude and longitude are equally long: name the grid type")
    return "regular"


def nearest_point(points: DataFrame, grid: DataFrame, point_id: str, max_km: float | None = None) -> DataFrame:
    """(point_id, gpi, km): the nearest grid point of each point (ties: smallest gpi), within ``max_km`` if given.

    The search radius doubles from a first guess by the grid's density until every point has its neighbour or the
    radius covers the globe, so no round compares more than near pairs."""

    found = None
    left = cut(valid_points(points).where(f"{point_id} IS NOT NULL").select(point_id, "lat", "lon").distinct(), "nearest-left")
    n = max(grid.count(), 1)
    radius = min(max_km or math.inf, max(1.0, 2 * math.sqrt(4 * math.pi * 6371.0**2 / n / math.pi)))
    best = F.min(F.struct("km", "gpi")).alias("b")
    while True:
        pairs = near_pairs(left.withColumn("radius", F.lit(float(radius))), grid, point_id, "gpi", "radius")
        hit = cut(pairs.groupBy(point_id).agg(best).select(point_id, F.col("b.gpi").alias("gpi"), F.col("b.km").alias("km")), "nearest")
        found = hit if found is None else found.unionByName(hit)
        left = cut(left.join(hit, point_id, "left_anti"), "nearest-left")
        if radius >= (max_km or math.pi * 6371.0) or left.isEmpty():
            return found
        radius = min(radius * 4, max_km or math.pi * 6371.0 + 1)


def near_stations(series: DataFrame, stations: DataFrame, series_id: str, radius_km: float) -> DataFrame:
    """Series with a station within ``radius_km``; the ids keep their numbers."""
    at = stations.select("lat", "lon").distinct().withColumn("station", F.xxhash64("lat", "lon"))
    pairs = near_pairs(series.withColumn("radius", F.lit(float(radius_km))), at, series_id, "station", "radius")
    return series.join(pairs.select(series_id).distinct(), series_id, "left_semi")


def target_points(points: DataFrame, stations: DataFrame | None = None, only: list[tuple[float, float]] | None = None, radius_km: float = 2.0) -> DataFrame:
    """The points (gpi, lat, lon) that an export keeps: near a station, near one of the given places (lat, lon), or all."""
    if stations is not None and only is not None:
        raise EngineError("name stations or places, not both")
    if only is not None:
        stations = points.sparkSession.createDataFrame([(float(a), float(o)) for a, o in only], "lat double, lon double")
    return points if stations is None else near_stations(points, stations, "gpi", radius_km)


def distance(a: tuple[str, str], b: tuple[str, str]) -> Column:
    """Great-circle kilometres between two (lat, lon) column pairs."""
    return great_circle_km(F.col(a[0]), F.col(a[1]), F.col(b[0]), F.col(b[1]))


def points_of_cells(grid: DataFrame, cells: list[int]) -> DataFrame:
    """Grid points of some cells."""
    return grid.where(F.col("cell").isin(*cells))


def coordinates_of(df: DataFrame, grid: DataFrame) -> DataFrame:
    """Rows with the coordinates of their gpi; rows off the grid have none."""
    return df.join(grid.select("gpi", "lat", "lon"), "gpi", "left")
