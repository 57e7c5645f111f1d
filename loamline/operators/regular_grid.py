"""Irregular readings onto a regular daily grid (problem 1).

Per source a trend plus annual harmonics is fitted by normal equations whose sums Spark builds in parallel; the fit
predicts the days without a reading, and the residuals of the two observed days around a gap are bridged linearly, so
a filled gap meets both ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

YEAR = 365.2425
ROWS_AT_ONCE = 200_000
#: Days from 0001-01-01 to 9999-12-31; a time outside has no date.
CALENDAR = (-719_162, 2_932_896)
SCHEMA = "sensor string, gpi long, day int, value double, fitted double, missing boolean"


def _basis(day: np.ndarray, origin: float, harmonics: int) -> np.ndarray:
    """Rows of the design: 1, trend in years, then a cosine and sine for each harmonic of the year."""
    t = (day - origin) / YEAR
    cols = [np.ones_like(t), t]
    for h in range(1, harmonics + 1):
        cols += [np.cos(2 * np.pi * h * t), np.sin(2 * np.pi * h * t)]
    return np.stack(cols, -1)


def _solve(xtx: np.ndarray, xty: np.ndarray, n: float, ridge: float) -> np.ndarray:
    """Coefficients; the ridge grows with n and leaves the mean free, so short series fall back to their mean."""
    penalty = np.eye(len(xty)) * ridge * max(n, 1.0)
    penalty[0, 0] = 1e-12
    return np.linalg.solve(xtx + penalty, xty)


def daily_means(readings: DataFrame, valid: tuple[float, float] | None = None) -> DataFrame:
    """One row per (sensor, gpi, UTC day): count and mean of the values inside ``valid`` (NULL if none is).  Partial
    sums are built before the shuffle, so a hot source sends at most one row per day and task."""
    value = F.col("value") if valid is None else F.when(F.col("value").between(*valid), F.col("value"))
    day = F.floor(F.col("unix") / 86400)
    return (
        readings.where(day.between(*CALENDAR)).withColumn("day", day.cast("int"))
        .groupBy("sensor", "gpi", "day")
        .agg(F.avg(value).alias("value"), F.count(F.lit(1)).alias("n"))
    )


def normal_equations(daily: DataFrame, origin: int, harmonics: int = 2) -> list:
    """Aggregates that sum X'X (upper triangle) and X'y over daily means; they combine before the shuffle."""
    t = (F.col("day") - F.lit(origin)) / F.lit(YEAR)
    x = [F.when(F.col("value").isNotNull(), 1.0).otherwise(0.0), t * F.when(F.col("value").isNotNull(), 1.0).otherwise(0.0)]
    for h in range(1, harmonics + 1):
        x += [x[0] * F.cos(t * (2 * np.pi * h)), x[0] * F.sin(t * (2 * np.pi * h))]
    pairs = [F.sum(x[i] * x[j]) for i in range(len(x)) for j in range(i, len(x))]
    return [F.array(*pairs).alias("xtx"), F.array(*(F.coalesce(F.sum(c * F.col("value")), F.lit(0.0)) for c in x)).alias("xty")]


def _rows(batch: pa.RecordBatch, parts: list[tuple]) -> pa.RecordBatch:
    """Grid rows of some of the batch's sources."""
    source, day, value, fitted, missing = (np.concatenate(p) for p in zip(*parts, strict=True))
    pick = pa.array(source)
    return pa.RecordBatch.from_arrays(
        [batch.column("sensor").take(pick), batch.column("gpi").take(pick), pa.array(day, pa.int32()), pa.array(value, from_pandas=True), pa.array(fitted, from_pandas=True), pa.array(missing)],
        names=["sensor", "gpi", "day", "value", "fitted", "missing"],
    )


def regularize(readings: DataFrame, harmonics: int = 2, ridge: float = 1e-4, origin: int = 16_000, valid: tuple[float, float] | None = (0.0, 1.0), only_missing: bool = False) -> DataFrame:
    """A daily series per (sensor, gpi) from its first to its last observed UTC day.

    Input: ``sensor, gpi, unix, value`` (see ``readings_of``); other columns are ignored.  Output: ``day`` (days since
    1970-01-01), ``value`` (daily mean, or the bridged prediction where ``missing``), ``fitted`` (regression alone)
    and ``missing``.  Values outside ``valid`` make their day an observed one but enter neither mean nor fit (``value``
    is NULL where a day, or both ends of a gap, have nothing else).  Several readings of a day, repeated deliveries included, make one day.  An empty input gives an
    empty result; a source with one day gives that day.  A source's daily means meet in one row: their number is
    bounded by the calendar (times outside the years 1 to 9999 have no day and are left out), not by the number of readings.  ``only_missing`` leaves observed days out.
    """
    k = 2 + 2 * harmonics
    upper = np.triu_indices(k)
    daily = daily_means(readings, valid)
    series = daily.groupBy("sensor", "gpi").agg(
        F.collect_list(F.struct("day", "value")).alias("days"), *normal_equations(daily, origin, harmonics)
    )

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("days")
            flat, ends = lists.flatten(), np.asarray(lists.offsets) - np.asarray(lists.offsets)[0]
            days_all = np.asarray(flat.field(0))
            values_all = flat.field(1).to_numpy(zero_copy_only=False).astype(float)
            xtx_all = np.asarray(batch.column("xtx").flatten()).reshape(-1, len(upper[0]))
            xty_all = np.asarray(batch.column("xty").flatten()).reshape(-1, k)
            parts, size = [], 0
            for i in range(batch.num_rows):
                day, value = days_all[ends[i] : ends[i + 1]], values_all[ends[i] : ends[i + 1]]
                order = np.argsort(day)
                day, value = day[order].astype(np.int64), value[order]
                xtx = np.zeros((k, k))
                xtx[upper] = xtx_all[i]
                xtx = xtx + np.triu(xtx, 1).T
                good = ~np.isnan(value)
                beta = _solve(xtx, xty_all[i], good.sum(), ridge) if good.any() else np.full(k, np.nan)
                rest = value[good] - _basis(day[good], origin, harmonics) @ beta if good.any() else None
                for first in range(day[0], day[-1] + 1, ROWS_AT_ONCE):
                    grid = np.arange(first, min(first + ROWS_AT_ONCE, day[-1] + 1))
                    here = slice(*np.searchsorted(day, [first, grid[-1] + 1]))
                    seen = np.zeros(len(grid), bool)
                    seen[day[here] - first] = True
                    if only_missing:
                        grid, seen = grid[~seen], seen[~seen]
                    if not len(grid):
                        continue
                    fitted = _basis(grid, origin, harmonics) @ beta
                    final = fitted + (np.nan if rest is None else np.interp(grid, day[good], rest))
                    if not only_missing:
                        final[seen] = value[here]
                    parts.append((np.full(len(grid), i), grid, final, fitted, ~seen))
                    size += len(grid)
                    if size >= ROWS_AT_ONCE:
                        yield _rows(batch, parts)
                        parts, size = [], 0
            if parts:
                yield _rows(batch, parts)

    return series.mapInArrow(fill, SCHEMA)


def missing_days(readings: DataFrame) -> DataFrame:
    """(sensor, gpi, missing_day): the days that ``regularize`` had to fill, as ``YYYY-MM-DD``."""
    return regularize(readings, only_missing=True).select("sensor", "gpi", F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.col("day")), "yyyy-MM-dd").alias("missing_day"))
