"""The common shape of sensor readings: (sensor, gpi, unix, value, obs_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamline.functions.missing import present

#: Zero points of acquisition_time as seconds since 1970-01-01 UTC, and fill values.
EPOCH = {"smap": 946_728_000, "smos": 946_684_800}
VALUE_FILL = {"smap": (-9999.0,), "smos": (-999.0,)}
TIME_FILL = {"smap": (-9999.0,), "smos": (0.0, -999.0)}


def readings_of(df: DataFrame, sensor: str) -> DataFrame:
    """Readings of one sensor whose time and value are both present.

    ``unix`` is DOUBLE seconds since 1970-01-01 UTC.  NULL, NaN and the sensor's fill values drop the reading, as does
    a NULL gpi; implausible values stay.  Infinite times or values count as missing.
    """
    t = present(F.col("acquisition_time"), *TIME_FILL[sensor], float("inf"), float("-inf"))
    v = present(F.col("soil_moisture"), *VALUE_FILL[sensor], float("inf"), float("-inf"))
    return df.select(
        F.lit(sensor).alias("sensor"), F.col("gpi").cast("long").alias("gpi"), (t + F.lit(EPOCH[sensor])).alias("unix"), v.cast("double").alias("value"), F.col("obs_id").cast("long").alias("obs_id")
    ).where("gpi IS NOT NULL AND unix IS NOT NULL AND value IS NOT NULL")


def all_readings(smap: DataFrame, smos: DataFrame) -> DataFrame:
    """Readings of both sensors."""
    return readings_of(smap, "smap").unionByName(readings_of(smos, "smos"))
