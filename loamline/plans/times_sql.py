"""SQL of the instants behind delivered times: the date of each notation, then one clock and zone for all."""

from __future__ import annotations

from loamline.functions.instants import ABBREVIATIONS, MONTHS

ZONES = ", ".join(f"('{n}', {m}, '%')" for n, m in ABBREVIATIONS.items()) + ", ('CST', -360, 'America/%'), ('CDT', -300, 'America/%'), ('CST', 480, 'Asia/%')"
MONTH_NAMES = ", ".join(f"('{n}', {i})" for n, i in MONTHS.items())
CLOCK = r"^(?:[T ]+(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?(?: ?([AaPp])\.?[Mm]\.?)?)?(?: ?([A-Za-z]{1,5}|(?:UTC|GMT)?[+-]\d{2}(?::?\d{2})?))?$"
FOUND = rf"""
WITH zones(name, minutes, sites) AS (VALUES {ZONES}), months(name, m) AS (VALUES {MONTH_NAMES}),
given AS (SELECT DISTINCT reading_id, trim(regexp_replace(acquisition_time, '\s+', ' ', 'g')) AS t, nullif(trim(time_units), '') AS u, nullif(trim(site_zone), '') AS site, timeoffsetvarname AS v, time_offset AS o, timeoffsetunit AS ou FROM acq_raw WHERE reading_id IS NOT NULL),
offsets AS (SELECT *, CASE WHEN v IS NULL THEN 0 WHEN NOT isnan(o) THEN CAST(trunc(o) AS BIGINT) * CASE lower(left(trim(ou), 1)) WHEN 's' THEN 1000 WHEN 'm' THEN 60000 WHEN 'h' THEN 3600000 WHEN 'd' THEN 86400000 END END AS shift FROM given WHERE regexp_matches(t, '\d')),
units AS (SELECT DISTINCT u, CAST(CASE WHEN regexp_matches(lower(u), '^(millisec[a-z]*|ms|msecs?) ') THEN 1 ELSE CASE lower(left(u, 1)) WHEN 's' THEN 1000 WHEN 'm' THEN 60000 WHEN 'h' THEN 3600000 WHEN 'd' THEN 86400000 END END AS DECIMAL(9, 0)) AS size,
  epoch_ms(TRY_CAST(replace(replace(regexp_extract(u, '(?i) since (.+)$', 1), 'Z', ''), 'T', ' ') AS TIMESTAMP)) AS zero FROM given WHERE u IS NOT NULL),
numbers AS (SELECT g.*, TRY_CAST(t AS DECIMAL(25, 10)) AS x FROM offsets g WHERE u IS NOT NULL),
counted AS (SELECT n.reading_id, CAST(round(n.x * u.size) AS BIGINT) + u.zero + n.shift AS utc_ms FROM numbers n JOIN units u USING (u) WHERE n.x NOT IN (-9999, -999)),
texts AS (SELECT * FROM offsets WHERE u IS NULL UNION ALL SELECT * EXCLUDE (x) FROM numbers WHERE x IS NULL AND TRY_CAST(t AS DOUBLE) IS NULL),
dated AS (
  SELECT *, TRY_CAST(regexp_replace(t, '^(\d{{4}})[-/](\d{{1,2}})[-/](\d{{1,2}}).*$', '\1-\2-\3') AS DATE) AS d, regexp_replace(t, '^\d{{4}}[-/]\d{{1,2}}[-/]\d{{1,2}}', '') AS rest FROM texts WHERE regexp_matches(t, '^\d{{4}}[-/]\d{{1,2}}[-/]\d{{1,2}}([T :+A-Za-z-]|$)')
  UNION ALL SELECT *, TRY_CAST(regexp_replace(t, '^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}).*$', '\3-\2-\1') AS DATE), regexp_replace(t, '^[\d]+\.[\d]+\.\d{{4}}', '') FROM texts WHERE regexp_matches(t, '^\d{{1,2}}\.\d{{1,2}}\.\d{{4}}')
  UNION ALL SELECT *, TRY_CAST(t[1:4] || '-01-01' AS DATE) + CASE WHEN t[6:8] <> '000' THEN CAST(t[6:8] AS INTEGER) - 1 END, regexp_replace(regexp_replace(t, '^\d{{4}}[-_]\d{{3}}', ''), '^_(\d{{2}})(\d{{2}})(\d{{2}})?$', 'T\1:\2') FROM texts WHERE regexp_matches(t, '^\d{{4}}-\d{{3}}([T ]|$)') OR regexp_matches(t, '^\d{{4}}_\d{{3}}(_\d{{4}})?$')
  UNION ALL SELECT *, TRY_CAST(t[1:4] || '-' || t[5:6] || '-' || t[7:8] AS DATE), regexp_replace(regexp_replace(t[9:], '^[T ]?(\d{{2}})(\d{{2}})(\d{{2}})', 'T\1:\2:\3'), '^[T ]?(\d{{2}})(\d{{2}})$', 'T\1:\2') FROM texts WHERE regexp_matches(t, '^\d{{8}}([T ]?\d{{4}}(\d{{2}})?)?([.,]\d+)?( ?[A-Za-z+-].*)?$')
  UNION ALL SELECT x.* EXCLUDE (y, n), TRY_CAST(y || '-' || m.m || '-' || n AS DATE), regexp_replace(t, '^([A-Za-z]+,? )?\d{{1,2}}[- ][A-Za-z]+[- ]\d{{4}}', '') FROM (SELECT *, regexp_extract(t, '[- ](\d{{4}})', 1) AS y, regexp_extract(t, '(\d{{1,2}})[- ]', 1) AS n FROM texts WHERE regexp_matches(t, '^([A-Za-z]{{3,9}},? )?\d{{1,2}}[- ][A-Za-z]{{3,9}}[- ]\d{{4}}')) x
    JOIN months m ON m.name = lower(regexp_extract(t, '\d{{1,2}}[- ]([A-Za-z]{{3}})', 1))),
clocked AS (SELECT *, CAST(coalesce(nullif(regexp_extract(rest, '{CLOCK}', 1), ''), '0') AS INTEGER) AS h0, CAST(coalesce(nullif(regexp_extract(rest, '{CLOCK}', 2), ''), '0') AS INTEGER) AS mi, CAST(coalesce(nullif(regexp_extract(rest, '{CLOCK}', 3), ''), '0') AS INTEGER) AS s,
  TRY_CAST('0.' || left(coalesce(nullif(regexp_extract(rest, '{CLOCK}', 4), ''), '0'), 12) AS DECIMAL(16, 12)) * 1000 AS f, upper(regexp_extract(rest, '{CLOCK}', 5)) AS ap, upper(regexp_extract(rest, '{CLOCK}', 6)) AS zone FROM dated WHERE d IS NOT NULL AND regexp_matches(rest, '{CLOCK}')),
valid AS (SELECT *, CASE WHEN ap = '' THEN h0 ELSE h0 % 12 + CASE ap WHEN 'P' THEN 12 ELSE 0 END END AS h FROM clocked WHERE mi < 60 AND s < 60 AND CASE WHEN ap <> '' THEN h0 BETWEEN 1 AND 12 ELSE h0 < 24 OR (h0 = 24 AND mi = 0 AND s = 0 AND f = 0) END),
walls AS (SELECT *, CAST(d AS TIMESTAMP) + to_hours(h) + to_minutes(mi) + to_seconds(s) AS wall FROM valid),
zoned AS (
  SELECT w.*, wall AS utc FROM walls w WHERE zone = '' AND site IS NULL
  UNION ALL SELECT * EXCLUDE (z), timezone('UTC', z) FROM (SELECT *, timezone(site, wall) AS z FROM walls WHERE zone = '' AND site IS NOT NULL) y
    WHERE timezone(site, z) = wall AND timezone(site, z - INTERVAL 1 HOUR) <> wall AND timezone(site, z + INTERVAL 1 HOUR) <> wall
  UNION ALL SELECT w.*, wall - to_minutes(CAST(CASE WHEN zone LIKE '%-%' THEN -1 ELSE 1 END * (CAST(regexp_extract(zone, '[+-](\d{{2}})', 1) AS INTEGER) * 60 + CAST(coalesce(nullif(regexp_extract(zone, '[+-]\d{{2}}:?(\d{{2}})', 1), ''), '0') AS INTEGER)) AS INTEGER)) FROM walls w
    WHERE regexp_matches(zone, '[+-]') AND CAST(regexp_extract(zone, '[+-](\d{{2}})', 1) AS INTEGER) <= 18 AND CAST(coalesce(nullif(regexp_extract(zone, '[+-]\d{{2}}:?(\d{{2}})', 1), ''), '0') AS INTEGER) <= 59
  UNION ALL SELECT w.*, wall - to_minutes(z.minutes) FROM walls w JOIN zones z ON z.name = w.zone AND coalesce(w.site, '') LIKE z.sites)
SELECT DISTINCT reading_id, utc_ms FROM (SELECT reading_id, utc_ms FROM counted UNION ALL SELECT reading_id, CAST(round(epoch_ms(utc) + f) AS BIGINT) + shift FROM zoned) r WHERE utc_ms IS NOT NULL
"""
