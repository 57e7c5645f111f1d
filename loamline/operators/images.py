"""Image stacks as long tables: one row per (time, gpi), one column per variable."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamline.functions.missing import present
from loamline.functions.times import image_name_parts, plus_seconds, sensor_of_product
from loamline.operators.grid import land_only, within_box
from loamline.session import EngineError


def in_time(df: DataFrame, start=None, end=None, time: str = "time") -> DataFrame:
    """Rows from start to end, both included; None leaves that side open.  A date alone means its midnight."""
    if start is not None:
        df = df.where(F.col(time) >= F.lit(start).cast("timestamp_ntz"))
    return df if end is None else df.where(F.col(time) <= F.lit(end).cast("timestamp_ntz"))


def in_period(df: DataFrame, start: str, end: str, time: str = "time") -> DataFrame:
    """Rows of a series period; a year, month or day as its end stands for the whole of it, as its start for the beginning."""
    kinds = {4: ("-01-01", "1 year"), 7: ("-01", "1 month"), 10: ("", "1 day")}
    start = start + kinds[len(start)][0] if len(start) in kinds else start
    if len(end) in kinds:
        rest, span = kinds[len(end)]
        return in_time(df, start, None, time).where(F.col(time) < F.lit(end + rest).cast("timestamp_ntz") + F.expr(f"interval {span}"))
    return in_time(df, start, end, time)


def at_time(df: DataFrame, when, time: str = "time") -> DataFrame:
    """The image of exactly one time; an error if there is none."""
    out = df.where(F.col(time) == F.lit(when).cast("timestamp_ntz"))
    if out.isEmpty():
        raise EngineError(f"no image at {when}")
    return out


def read_block(df: DataFrame, start=None, end=None, box: tuple[float, float, float, float] | None = None, variables: list[str] | None = None, masked: bool = False) -> DataFrame:
    """Images of a time range, cut to a box, with missing values off land: filters reach the scan as they are."""
    names = variables or [c for c in df.columns if c not in ("time", "gpi", "cell", "row", "col", "lat", "lon", "is_land")]
    df = in_time(df, start, end)
    if box:
        df = within_box(df, *box)
    keep = [c for c in ("time", "gpi", "cell", "row", "col", "lat", "lon") if c in df.columns]
    return df.select(*keep, *(land_only(F.col(v), F.col("is_land")).alias(v) if masked else F.col(v) for v in names))


def daily_mean(df: DataFrame, variables: list[str], keys: tuple[str, ...] = ("gpi",), time: str = "time") -> DataFrame:
    """Mean of each variable by key and day (its midnight); missing values are skipped, a day of only those is NULL."""
    return df.groupBy(*keys, F.date_trunc("day", time).cast("timestamp_ntz").alias(time)).agg(*(F.avg(present(F.col(v).cast("double"))).alias(v) for v in variables))


def without_fill(df: DataFrame, fill: float, variables: list[str]) -> DataFrame:
    """Fill values of the named variables as NULL."""
    return df.withColumns({v: present(F.col(v).cast("double"), fill) for v in variables})


def where_bits(value: Column, flags: Column, mask: int) -> Column:
    """A value where none of the mask's bits is set in its quality flags; NULL flags count as not good."""
    return F.when(flags.bitwiseAND(F.lit(mask)) == 0, value)


def select_levels(df: DataFrame, levels: dict[str, list[int] | int | list[list[int]]], variables: list[str] | None = None) -> DataFrame:
    """Levels of array variables: an int keeps the name, a list gives ``name_i``; a list of lists goes through nested
    levels from left to right and gives ``name_i_j``.  A level out of range is NULL; an unknown variable only warns."""
    out: list[Column] = []
    for name in levels:
        if name not in df.columns:
            warnings.warn(f"no variable {name} to select levels from", stacklevel=2)
    for c in variables or df.columns:
        want = levels.get(c)
        if want is None:
            out.append(F.col(c))
        elif isinstance(want, int):
            out.append(F.get(c, F.lit(want)).alias(c))
        else:
            nested = want if want and isinstance(want[0], list) else [want]
            picks = [(c, F.col(c))]
            for level in nested:
                picks = [(f"{n}_{i}", F.get(col, F.lit(i))) for n, col in picks for i in level]
            out += [col.alias(n) for n, col in picks]
    return df.select(*out)


def normalise_level(level: dict, variables: list[str]) -> dict:
    """``{"level": 2}`` for a single variable as ``{variable: 2}``; a mapping by variable stays."""
    if all(k in variables for k in level):
        return level
    if len(variables) != 1:
        raise EngineError("name the variable of each level")
    (value,) = level.values() if len(level) == 1 else (list(level.values()),)
    return {variables[0]: value}


def select_known(df: DataFrame, variables: list[str], rename: dict[str, str] | None = None, skip_missing: bool = True) -> DataFrame:
    """The wanted variables (by their new names), those that don't exist left out with a warning."""
    df = df.withColumnsRenamed({a: b for a, b in (rename or {}).items() if a in df.columns})
    lost = [v for v in variables if v not in df.columns]
    if lost and not skip_missing:
        raise EngineError(f"no variables {lost}")
    for v in lost:
        warnings.warn(f"variable {v} is skipped: it does not exist", stacklevel=2)
    return df.select(*(v for v in variables if v in df.columns))


def flatten_image(df: DataFrame, array: str, columns: int, flip: bool = False, rows: int | None = None) -> DataFrame:
    """One row per pixel of a row-major array: gpi = row * columns + col.  ``flip`` turns the rows over first, so that gpi
    ascends from the bottom row (``rows`` is needed for that)."""
    others = [c for c in df.columns if c != array]
    long = df.select(*others, F.posexplode(array).alias("gpi", "value"))
    row, col = F.floor(F.col("gpi") / columns).cast("int"), (F.col("gpi") % columns).cast("int")
    if flip:
        row = F.lit(rows - 1) - row
    return long.select(*others, (row * columns + col).alias("gpi"), row.alias("row"), col.alias("col"), "value")


def expand_times(catalog: DataFrame, offsets_seconds: list[int], time: str = "time") -> DataFrame:
    """One row per time step of files that hold several: base time plus each offset, numbered by slot."""
    return catalog.select("*", F.posexplode(F.array(*(F.lit(int(s)) for s in offsets_seconds))).alias("slot", "_s")).withColumn(time, plus_seconds(F.col(time), F.col("_s"))).drop("_s")


def file_of_time(catalog: DataFrame, path: str = "path", time: str = "time") -> DataFrame:
    """(time, path): the file of each time; of several the last in path order counts."""
    return catalog.groupBy(time).agg(F.max(path).alias(path))


def daily_times(df: DataFrame, start: str, end: str, hours: list[int]) -> DataFrame:
    """(time): each of the hours on every day from start to end (both cut to their day)."""
    days = F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr("interval 1 day"))
    return df.sparkSession.range(1).select(F.explode(days).alias("day")).select(F.explode(F.array(*(plus_seconds(F.col("day").cast("timestamp_ntz"), F.lit(h * 3600)) for h in hours))).alias("time"))


def with_name_parts(files: DataFrame, name: str = "name") -> DataFrame:
    """prod, datetime, sensor and vers of image files by name; other files are dropped."""
    p = image_name_parts(F.col(name))
    return files.withColumn("_p", p).where("_p IS NOT NULL").select("*", "_p.*").drop("_p").where(F.col("sensor") == sensor_of_product(F.col("prod")))


def bare_version(text: Column) -> Column:
    """A version without blanks and a leading v or V."""
    return F.regexp_replace(F.trim(text), "^[vV]", "")


def latest_versions(files: DataFrame, keys: list[str], version: str = "vers", numeric: bool = False) -> DataFrame:
    """The newest version of each key: by text, or with ``numeric`` component by component (a leading v or V doesn't
    matter, left-out components are 0, other text comes before any number); equal ones by text."""
    order = F.col(version)
    if numeric:
        parts = F.transform(F.split(bare_version(F.col(version)), r"\."), lambda p: F.coalesce(p.try_cast("decimal(38,0)"), F.lit(-1).cast("decimal(38,0)")))
        last = F.array_max(F.transform(parts, lambda p, i: F.when(p != 0, i + 1).otherwise(0)))
        order = F.array_append(F.slice(parts, F.lit(1), F.coalesce(last, F.lit(0))), F.lit(0).cast("decimal(38,0)"))
    return files.groupBy(*keys).agg(F.max_by(version, F.struct(order, F.col(version))).alias(version))


def outdated_files(files: DataFrame, keys: list[str], version: str = "vers") -> DataFrame:
    """Files that have a newer version: candidates for clean-up.  Nothing is deleted."""
    newest = latest_versions(files, keys, version).withColumnRenamed(version, "_newest")
    return files.join(newest, keys).where(F.col(version) < F.col("_newest")).drop("_newest")


def with_fill(df: DataFrame, fill: float, variables: list[str]) -> DataFrame:
    """Missing values of the named variables as a fill value, in a type that holds it."""
    return df.withColumns({v: F.coalesce(present(F.col(v).cast("double")), F.lit(float(fill))) for v in variables})


def where_flag(value: Column, flag: Column, good: str = "G") -> Column:
    """A value where its in-situ flag is the good one."""
    return F.when(flag == good, value)


def with_landmask(grid_df: DataFrame, mask: DataFrame) -> DataFrame:
    """A grid with the mask of another table (gpi, is_land); points the mask doesn't know have none."""
    return grid_df.drop("is_land").join(mask.select("gpi", "is_land"), "gpi", "left")


def joined_by_day(left: DataFrame, right: DataFrame, keys: list[str], time: str = "time") -> DataFrame:
    """Left rows with the right rows of the same day (left join); the right side should have one row per key and day."""
    day = F.date_trunc("day", time).cast("timestamp_ntz")
    return left.withColumn("day", day).join(right.withColumn("day", day).drop(time), [*keys, "day"], "left")


def file_report(files: DataFrame, by: str = "reader_name", path: str = "path", size: str = "size_bytes", ending: str = ".nc") -> DataFrame:
    """Files, files with an ending, and bytes of each group."""
    return files.groupBy(by).agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col(path).endswith(ending)).alias("nc_files"), F.sum(size).alias("bytes"))
