"""Queries of the data-pipeline operators (problems 1, 2, 4, 5, 6, 7), over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamline.operators.compaction import compact, superfluous_files
from loamline.operators.near import near_pairs
from loamline.operators.readings import all_readings
from loamline.operators.regular_grid import missing_days, regularize
from loamline.operators.schema_drift import drift_report, unified_records, unified_table
from loamline.operators.spikes import flag_readings
from loamline.operators.time_dictionary import kept_dictionary, normalise_times
from loamline.plans import drift_sql, times_sql
from loamline.session import read_table, work_path


def _readings(spark: SparkSession, folder: str) -> DataFrame:
    return all_readings(read_table(spark, folder, "smap_obs"), read_table(spark, folder, "smos_obs"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return missing_days(_readings(spark, folder))


def p1_series(spark: SparkSession, folder: str) -> DataFrame:
    """The regular daily series itself."""
    return regularize(_readings(spark, folder))


def p1_grid(spark: SparkSession, folder: str) -> DataFrame:
    """The regular grid with the observed values alone."""
    return regularize(_readings(spark, folder)).select("sensor", "gpi", "day", "missing", F.when(~F.col("missing"), F.round("value", 6)).alias("observed"))


def p1_fitted(spark: SparkSession, folder: str) -> DataFrame:
    """The regular daily series; the regression and what fills gaps to four digits."""
    return regularize(_readings(spark, folder)).select("sensor", "gpi", "day", "missing", F.when(F.col("missing"), F.round("value", 4)).otherwise(F.round("value", 6)).alias("value"), F.round("fitted", 4).alias("fitted"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return superfluous_files(lambda: read_table(spark, folder, "image_files"), read_table(spark, folder, "image_readers"))


def p2_compacted(spark: SparkSession, folder: str) -> DataFrame:
    """The consolidated records."""
    table, _ = compact(lambda: read_table(spark, folder, "image_files"), read_table(spark, folder, "image_readers"), work_path(spark, "images"))
    return table.read().select("reader_name", "image_time", "gpi", "ssm", "ssm_noise", "file_id")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return drift_report(read_table(spark, folder, "smos_headers")).select("stream", "file_name", "field_name", "change_kind")


def p4_unified(spark: SparkSession, folder: str) -> DataFrame:
    """All records under one schema per stream; ``text`` only where no typed column holds the value."""
    return unified_records(read_table(spark, folder, "smos_headers")).withColumn("text", F.when(F.col("number").isNull() & F.col("flag").isNull(), F.col("text")))


def p4_table(spark: SparkSession, folder: str) -> DataFrame:
    """All records of all streams in one typed table."""
    return unified_table(read_table(spark, folder, "smos_headers"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return normalise_times(read_table(spark, folder, "acq_raw"), kept_dictionary(spark))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return near_pairs(read_table(spark, folder, "csv_series"), read_table(spark, folder, "ismn_stations"), "series_id", "station_id", "radius_km").select("series_id", "station_id")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return flag_readings(_readings(spark, folder)).select("sensor", "obs_id").distinct()


def p7_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """How many readings each check flags, per sensor."""
    return flag_readings(_readings(spark, folder)).groupBy("sensor", "reason").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (p1_found, p1_series, p1_grid, p1_fitted, p2_found, p2_compacted, p4_found, p4_unified, p4_table, p5_found, p6_found, p7_found, p7_reasons)}

READINGS_SQL = """
SELECT 'smap' AS sensor, gpi, acquisition_time + 946728000 AS unix, soil_moisture AS value, obs_id FROM smap_obs
WHERE acquisition_time IS NOT NULL AND NOT isnan(acquisition_time) AND acquisition_time <> -9999
  AND soil_moisture IS NOT NULL AND NOT isnan(soil_moisture) AND soil_moisture <> -9999
UNION ALL
SELECT 'smos', gpi, acquisition_time + 946684800, soil_moisture, obs_id FROM smos_obs
WHERE acquisition_time IS NOT NULL AND NOT isnan(acquisition_time) AND acquisition_time NOT IN (0, -999)
  AND soil_moisture IS NOT NULL AND NOT isnan(soil_moisture) AND soil_moisture <> -999
"""



def fitted_sql(size: int = 6, ridge: float = 1e-4) -> str:
    """The regression by elimination on the summed normal equations, and the bridge over gaps by the observed days around."""
    t = "((day - 16000) / 365.2425)"
    x = ["1.0::DOUBLE", t, *(f"{f}({2 * h} * pi() * {t})" for h in (1, 2) for f in ("cos", "sin"))]
    sums = [f"sum({x[i]} * {x[j]}) + {'1e-12' if i == j == 0 else f'{ridge} * count(*)' if i == j else '0'} AS a{i}{j}" for i in range(size) for j in range(i, size)] + [f"sum({x[i]} * value) AS b{i}" for i in range(size)]
    steps = [f"s0 AS (SELECT sensor, gpi, {', '.join(sums)} FROM seen WHERE value IS NOT NULL GROUP BY sensor, gpi)"]
    for k in range(size - 1):
        rest = [f"a{i}{j} - a{k}{i} * a{k}{j} / a{k}{k} AS a{i}{j}" for i in range(k + 1, size) for j in range(i, size)] + [f"b{i} - a{k}{i} * b{k} / a{k}{k} AS b{i}" for i in range(k + 1, size)]
        done = [f"a{i}{j}" for i in range(k + 1) for j in range(i, size)] + [f"b{i}" for i in range(k + 1)]
        steps.append(f"s{k + 1} AS (SELECT sensor, gpi, {', '.join(done + rest)} FROM s{k})")
    back = [f"(b{i}{''.join(f' - a{i}{j} * c{j}' for j in range(i + 1, size))}) / a{i}{i} AS c{i}" for i in reversed(range(size))]
    fit = " + ".join(f"c{i} * {x[i]}" for i in range(size))
    good = "CASE WHEN value IS NOT NULL THEN {} END"
    around = [f"last_value({good.format(c)} IGNORE NULLS) OVER before AS {c}_a, first_value({good.format(c)} IGNORE NULLS) OVER after AS {c}_b" for c in ("day", "rest")]
    return f"""
WITH seen AS MATERIALIZED (SELECT sensor, gpi, CAST(floor(unix / 86400) AS BIGINT) AS day, avg(CASE WHEN value BETWEEN 0 AND 1 THEN value END) AS value FROM ({READINGS_SQL}) r GROUP BY ALL),
{", ".join(steps)}, coefficients AS MATERIALIZED (SELECT sensor, gpi, {", ".join(back)} FROM s{size - 1}),
every AS (SELECT sensor, gpi, unnest(range(min(day), max(day) + 1)) AS day FROM seen GROUP BY sensor, gpi),
fits AS (SELECT e.sensor, e.gpi, e.day, s.day IS NULL AS missing, s.value, {fit.replace("day", "e.day")} AS fitted FROM every e LEFT JOIN seen s USING (sensor, gpi, day) LEFT JOIN coefficients c ON c.sensor = e.sensor AND c.gpi = e.gpi),
rests AS (SELECT *, value - fitted AS rest FROM fits),
spans AS (SELECT *, {", ".join(around)} FROM rests WINDOW before AS (PARTITION BY sensor, gpi ORDER BY day ROWS UNBOUNDED PRECEDING), after AS (PARTITION BY sensor, gpi ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT sensor, gpi, CAST(day AS INTEGER) AS day, missing, CASE WHEN NOT missing THEN round(value, 6) ELSE round(fitted + CASE WHEN day_a IS NULL THEN rest_b WHEN day_b IS NULL THEN rest_a ELSE rest_a + (rest_b - rest_a) * (day - day_a) / (day_b - day_a) END, 4) END AS value, round(fitted, 4) AS fitted FROM spans
"""


#: Matching image files with their image time; the readers' patterns are written out.
FILES_SQL = r"""
WITH named AS (SELECT *, regexp_extract(path, '([^/]*)$', 1) AS base FROM image_files),
timed AS (SELECT file_id, reader_name, content,
  CASE reader_name
    WHEN 'cgls_ssm' THEN CASE WHEN regexp_matches(path, '^(.*/)?[^/]*\.nc$') THEN try_strptime(regexp_extract(base, '^c_gls_SSM1km_(\d{12})_CEURO_S1CSAR_V.*\.nc$', 1), '%Y%m%d%H%M') END
    WHEN 'cgls_swi' THEN CASE WHEN regexp_matches(path, '^(.*/)?[^/]*\.nc$') THEN try_strptime(regexp_extract(base, '^c_gls_SWI1km_(\d{12})_CEURO_SCATSAR_V.*\.nc$', 1), '%Y%m%d%H%M') END
    WHEN 'lis_noah' THEN CASE WHEN regexp_matches(path, '^(.*/)?LIS_HIST_[^/]*\.nc$') THEN try_strptime(regexp_extract(base, '^LIS_HIST_(\d{12})\.d01\.nc$', 1), '%Y%m%d%H%M') END
    WHEN 'reanalysis' THEN CASE WHEN regexp_matches(path, '^[^/]*/20[0-9][0-9]/[^/]*\.nc$') THEN try_strptime(regexp_extract(base, '^swvl_(\d{4}_\d{3})\.nc$', 1), '%Y_%j') END
    WHEN 'smos_l3' THEN CASE WHEN regexp_matches(path, '^(.*/)?SM_[^/]*_CLF31[^/]_[^/]*\.nc$') THEN try_strptime(regexp_extract(base, '^SM_RE06_MIR_CLF31A_(\d{8}T\d{6})_.*\.nc$', 1), '%Y%m%dT%H%M%S') END
  END AS image_time FROM named)
"""

ORACLE = {
    "p1_found": f"""
WITH seen AS (SELECT DISTINCT sensor, gpi, CAST(floor(unix / 86400) AS BIGINT) AS day FROM ({READINGS_SQL}) r),
span AS (SELECT sensor, gpi, min(day) AS a, max(day) AS b FROM seen GROUP BY sensor, gpi),
every AS (SELECT sensor, gpi, unnest(range(a, b)) AS day FROM span)
SELECT e.sensor, e.gpi, strftime(DATE '1970-01-01' + CAST(e.day AS INTEGER), '%Y-%m-%d') AS missing_day
FROM every e WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.sensor = e.sensor AND s.gpi = e.gpi AND s.day = e.day)
""",
    "p1_grid": f"""
WITH seen AS (SELECT sensor, gpi, CAST(floor(unix / 86400) AS BIGINT) AS day, avg(CASE WHEN value BETWEEN 0 AND 1 THEN value END) AS value FROM ({READINGS_SQL}) r GROUP BY ALL),
every AS (SELECT sensor, gpi, unnest(range(min(day), max(day) + 1)) AS day FROM seen GROUP BY sensor, gpi)
SELECT e.sensor, e.gpi, CAST(e.day AS INTEGER) AS day, s.day IS NULL AS missing, round(s.value, 6) AS observed FROM every e LEFT JOIN seen s USING (sensor, gpi, day)
""",
    "p1_fitted": fitted_sql(),
    "p2_found": FILES_SQL + r""",
lines AS (SELECT file_id, reader_name, image_time, unnest(string_split(replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))) AS line FROM timed WHERE image_time IS NOT NULL),
records AS (SELECT file_id, reader_name, image_time, CAST(split_part(line, ',', 1) AS BIGINT) AS gpi FROM lines WHERE regexp_matches(line, '^\d+,')),
firsts AS (SELECT min(file_id) AS file_id FROM records GROUP BY reader_name, image_time, gpi)
SELECT DISTINCT file_id FROM timed WHERE image_time IS NOT NULL AND file_id NOT IN (SELECT file_id FROM firsts)
""",
    "p2_compacted": FILES_SQL + r""",
lines AS (SELECT file_id, reader_name, image_time, unnest(range(1, len(l) + 1)) AS line, unnest(l) AS text FROM (SELECT *, string_split(replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS l FROM timed WHERE image_time IS NOT NULL) t),
cells AS (SELECT *, trim(split_part(text, ',', 2)) AS a, trim(split_part(text, ',', 3)) AS b FROM lines WHERE regexp_matches(text, '^\s*\d+\s*,')),
records AS (SELECT reader_name, image_time, CAST(trim(split_part(text, ',', 1)) AS BIGINT) AS gpi, file_id, line,
  CASE WHEN lower(a) NOT IN ('', 'nan', 'n/a', 'na', 'null', 'none', '-', '-9999', '-9999.0') AND TRY_CAST(a AS DOUBLE) <> -9999 THEN TRY_CAST(a AS DOUBLE) END AS ssm,
  CASE WHEN lower(b) NOT IN ('', 'nan', 'n/a', 'na', 'null', 'none', '-', '-9999', '-9999.0') AND TRY_CAST(b AS DOUBLE) <> -9999 THEN TRY_CAST(b AS DOUBLE) END AS ssm_noise FROM cells),
ranked AS (SELECT *, row_number() OVER (PARTITION BY reader_name, image_time, gpi ORDER BY file_id, line) AS r FROM records)
SELECT reader_name, image_time, gpi, ssm, ssm_noise, file_id FROM ranked WHERE r = 1
""",
    "p4_found": drift_sql.FOUND,
    "p4_unified": drift_sql.UNION,
    "p5_found": times_sql.FOUND,
    "p6_found": """
SELECT DISTINCT s.series_id, t.station_id FROM csv_series s JOIN ismn_stations t
ON 2 * 6371 * asin(sqrt(least(1.0, pow(sin(radians(t.lat - s.lat) / 2), 2) + cos(radians(s.lat)) * cos(radians(t.lat)) * pow(sin(radians(t.lon - s.lon) / 2), 2)))) <= s.radius_km
WHERE s.lat BETWEEN -90 AND 90 AND s.lon BETWEEN -180 AND 360 AND t.lat BETWEEN -90 AND 90 AND t.lon BETWEEN -180 AND 360
  AND NOT isnan(s.radius_km) AND s.radius_km >= 0
""",
}
