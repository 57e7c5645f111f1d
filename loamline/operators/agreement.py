"""Statistics between series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamline.functions.missing import present
from loamline.operators.near import by_place, near_pairs


def paired(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rows where both values are present."""
    return df.withColumns({a: present(F.col(a)), b: present(F.col(b))}).where(F.col(a).isNotNull() & F.col(b).isNotNull())


def correlation(df: DataFrame, a: str, b: str, keys: list[str]) -> DataFrame:
    """Pearson correlation by key over complete pairs; NULL for fewer than two pairs or a constant series."""
    return paired(df, a, b).groupBy(*keys).agg(F.corr(a, b).alias("r"), F.count(F.lit(1)).alias("n")).withColumn("r", present(F.col("r")))


def root_mean_square_difference(df: DataFrame, a: str, b: str, keys: list[str]) -> DataFrame:
    """sqrt(mean((a - b)^2)) by key over complete pairs."""
    d = F.col(a) - F.col(b)
    return paired(df, a, b).groupBy(*keys).agg(F.sqrt(F.avg(d * d)).alias("rmsd"), F.count(F.lit(1)).alias("n"))


def moments(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Mean, sample standard deviation and count by key, missing values skipped."""
    v = present(F.col(value))
    return df.groupBy(*keys).agg(F.avg(v).alias("mean"), present(F.stddev_samp(v)).alias("std"), F.count(v).alias("n"))


def scaled_to(df: DataFrame, value: str, reference: str, keys: list[str]) -> DataFrame:
    """``value`` with the mean and (population) deviation of ``reference`` by key: (x - mean) / std * std_ref + mean_ref.

    Moments come from an aggregation that combines before its shuffle; a constant series has no scaled value."""
    p = paired(df, value, reference)
    m = p.groupBy(*keys).agg(*(f(c).alias(f"_{n}{i}") for i, c in enumerate((value, reference)) for n, f in (("m", F.avg), ("s", F.stddev_pop))))
    return p.join(m, keys).withColumn("scaled", F.when(F.col("_s0") > 0, (F.col(value) - F.col("_m0")) / F.col("_s0") * F.col("_s1") + F.col("_m1"))).drop("_m0", "_s0", "_m1", "_s1")


def area_mean(obs: DataFrame, grid: DataFrame, stations: DataFrame, station_id: str, radius_km: float, value: str, digits: int | None = None) -> DataFrame:
    """Mean of all grid points within a radius of each station by time; rounded if ``digits`` is given.

    Stations at one place have one mean: places are paired and summed up, and only the result is repeated for the stations."""
    at, areas = by_place(stations, station_id, "_area")
    points, spots = by_place(grid, "gpi", "_spot")
    pairs = near_pairs(areas.withColumn("_radius", F.lit(float(radius_km))), spots, "_area", "_spot", "_radius").select("_area", "_spot")
    means = obs.join(points.join(pairs, "_spot").select("gpi", "_area"), "gpi").groupBy("_area", "time").agg(F.avg(present(F.col(value))).alias("mean"), F.count(present(F.col(value))).alias("n"))
    if digits is not None:
        means = means.withColumn("mean", F.round("mean", digits))
    return means.join(at, "_area").select(station_id, "time", "mean", "n")
