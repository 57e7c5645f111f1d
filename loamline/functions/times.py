"""Time and name expressions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loamline.functions.missing import present
from loamline.functions.strptime import strptime_parts

#: Spellings that count as true, and unit letters in seconds.
TRUE_TEXT = ("True", "true", "t", "T", "1", "yes", "y")
UNIT_SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86400}
CSV_NAME = r"^(.+?)_gpi=(\d+)_lat=(-?\d+(?:\.\d+)?)_lon=(-?\d+(?:\.\d+)?)\.csv$"
MAGIC = {"netcdf3": ["43444601", "43444602"], "netcdf4": ["894844460D0A1A0A"]}


def date_by_length(text: Column) -> Column:
    """A date of 10, 16 or 19 characters (day, minute or second precision); NULL for any other text."""
    n = F.length(text)
    return (
        F.when(n == 10, F.try_to_timestamp(text, F.lit("yyyy-MM-dd")))
        .when(n == 16, F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm")))
        .when(n == 19, F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss")))
        .cast("timestamp_ntz")
    )


def truthy(text: Column) -> Column:
    """TRUE for a true spelling, FALSE for everything else; NULL stays NULL."""
    return text.isin(*TRUE_TEXT)


def unit_seconds(unit: Column) -> Column:
    """Seconds of a time unit by its first letter in any case (m: minutes); NULL for others."""
    letter = F.lower(F.substring(unit, 1, 1))
    out = F.lit(None).cast("long")
    for k, s in UNIT_SECONDS.items():
        out = F.when(letter == k, F.lit(s).cast("long")).otherwise(out)
    return out


def truncated(value: Column) -> Column:
    """A number cut toward zero as BIGINT; NULL, NaN and out-of-range values are NULL."""
    v = present(value)
    return F.when(F.abs(v) < 9.2e18, F.when(v < 0, F.ceil(v)).otherwise(F.floor(v))).cast("long")


def plus_seconds(time: Column, seconds: Column) -> Column:
    """A zone-free time moved by whole seconds."""
    return time + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))


def shifted(time: Column, offset: Column, unit: Column) -> Column:
    """time + offset, the offset cut toward zero to a whole number of its unit; NULL without an offset."""
    return plus_seconds(time, truncated(offset) * unit_seconds(unit))


def absolute_time(value: Column, unit: str, epoch: str) -> Column:
    """The time behind a number of ``unit`` since ``epoch`` (cut toward zero)."""
    return plus_seconds(F.lit(epoch).cast("timestamp_ntz"), truncated(value) * UNIT_SECONDS[unit[0].lower()])


def orbit_seconds(days: Column, seconds: Column) -> Column:
    """days * 86400 + seconds since 2000-01-01; a sum of 0 means missing."""
    return F.nullif(days * 86400 + seconds, F.lit(0))


def overpass_code(flag: Column, value: Column) -> Column:
    """1 for an ascending (A), 2 for a descending orbit (D), 0 where there is no value; other flags are NULL."""
    return F.when(present(value).isNull(), 0).when(flag == "A", 1).when(flag == "D", 2).cast("tinyint")


def time_in_name(name: Column, fmt: str, regex: str | None = None) -> Column:
    """The time in a file name: the first group of ``regex`` (default: the format's own shape), read by ``fmt``."""
    shape, java = strptime_parts(fmt)
    return F.try_to_timestamp(F.regexp_extract(name, regex or f"({shape})", 1), F.lit(java)).cast("timestamp_ntz")


def csv_name_parts(name: Column) -> Column:
    """STRUCT<dataset, gpi, lat, lon> of a series file name, NULL where the name breaks the convention."""
    part = lambda i: F.regexp_extract(name, CSV_NAME, i)
    return F.when(name.rlike(CSV_NAME), F.struct(part(1).alias("dataset"), part(2).cast("long").alias("gpi"), part(3).cast("double").alias("lat"), part(4).cast("double").alias("lon")))


def upload_extension_ok(name: Column) -> Column:
    """Whether a name ends in .nc4, .nc or .zip in any case."""
    return F.lower(name).rlike(r"\.(nc4|nc|zip)$")


def file_kind(content: Column) -> Column:
    """netcdf3, netcdf4 (HDF5) or zip by the first bytes; NULL for anything else."""
    return (
        F.when(F.hex(F.substring(content, 1, 4)).isin(*MAGIC["netcdf3"]), "netcdf3")
        .when(F.hex(F.substring(content, 1, 8)).isin(*MAGIC["netcdf4"]), "netcdf4")
        .when(F.hex(F.substring(content, 1, 4)) == "504B0304", "zip")
    )


def image_name_parts(name: Column) -> Column:
    """STRUCT<prod, datetime, sensor, vers> of an image file name ``c_gls_{prod}_{datetime}_CEURO_{sensor}_V{vers}.nc``."""
    regex = r"^c_gls_([^_]+)_(\d+)_CEURO_([^_]+)_V(.+)\.nc$"
    part = lambda i: F.regexp_extract(name, regex, i)
    return F.when(name.rlike(regex), F.struct(part(1).alias("prod"), part(2).alias("datetime"), part(3).alias("sensor"), part(4).alias("vers")))


def sensor_of_product(prod: Column) -> Column:
    """The sensor part of a product's file names."""
    return F.when(prod.startswith("SWI"), "SCATSAR").otherwise("S1CSAR")
