"""SQL of the schema-drift queries: headers and records through JSON functions, types through a table of spellings."""

from __future__ import annotations

from loamline.operators.schema_drift import SPELLINGS

KINDS = ", ".join(f"('{name}', '{kind}')" for kind, names in SPELLINGS.items() for name in dict.fromkeys(names.split()))
FIELDS = rf"""
kinds(spelling, kind) AS (VALUES {KINDS}),
every AS (SELECT stream, file_name, header, regexp_extract(file_name, '(\d{{8}}T\d{{6}})', 1) AS start, delivered_at, header_id, record_json FROM smos_headers WHERE stream IS NOT NULL),
files AS MATERIALIZED (SELECT stream, file_name, start, arg_min(header, struct_pack(d := delivered_at, h := header_id)) AS header FROM every WHERE start <> '' GROUP BY ALL),
ordered AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY start, file_name) AS n FROM files)
"""
VARIABLES = r"""
SELECT v.* EXCLUDE (dtype), coalesce(k.kind, CASE WHEN regexp_matches(v.dtype, '^[su]\d+$') THEN 'str' ELSE v.dtype END) AS kind FROM (
  SELECT {keep}, CASE WHEN json_type(o.header, '$.variables') = 'ARRAY' THEN json_extract_string(e.value, '$.name') ELSE e.key END AS name,
    regexp_replace(lower(trim(coalesce(json_extract_string(e.value, '$.dtype'), ''))), '^[<>|=]', '') AS dtype, lower(regexp_replace(coalesce(json_extract_string(e.value, '$.long_name'), ''), '\s', '', 'g')) AS key
  FROM {source} o, json_each(o.header, '$.variables') e) v LEFT JOIN kinds k ON k.spelling = v.dtype
"""

FOUND = f"""
WITH {FIELDS},
fields AS MATERIALIZED ({VARIABLES.format(keep="o.stream, o.n, o.file_name", source="ordered")}),
come AS MATERIALIZED (SELECT c.*, row_number() OVER (PARTITION BY c.stream, c.n, c.key ORDER BY c.name) AS r FROM fields c WHERE c.n > 1 AND NOT EXISTS (SELECT 1 FROM fields p WHERE p.stream = c.stream AND p.n = c.n - 1 AND p.name = c.name)),
gone AS MATERIALIZED (SELECT p.stream, o.n, o.file_name, p.name, p.kind, p.key, row_number() OVER (PARTITION BY p.stream, p.n, p.key ORDER BY p.name) AS r FROM fields p JOIN ordered o ON o.stream = p.stream AND o.n = p.n + 1
  WHERE NOT EXISTS (SELECT 1 FROM fields c WHERE c.stream = p.stream AND c.n = p.n + 1 AND c.name = p.name)),
pairs AS MATERIALIZED (SELECT c.stream, c.n, c.file_name, g.name AS old, c.name, g.kind AS was, c.kind FROM come c JOIN gone g USING (stream, n, key, r) WHERE key <> ''
  UNION ALL SELECT c.stream, c.n, c.file_name, p.name, c.name, p.kind, c.kind FROM fields c JOIN fields p ON p.stream = c.stream AND p.n = c.n - 1 AND p.name = c.name),
attributes AS (SELECT o.stream, o.n, o.file_name, e.key AS name FROM ordered o, json_each(o.header, '$.attrs') e WHERE lower(string_split(e.key, ':')[-1]) = 'ascending_flag'),
flag_come AS (SELECT c.*, row_number() OVER (PARTITION BY stream, n ORDER BY name) AS r FROM attributes c WHERE n > 1 AND NOT EXISTS (SELECT 1 FROM attributes p WHERE p.stream = c.stream AND p.n = c.n - 1 AND p.name = c.name)),
flag_gone AS (SELECT p.stream, o.n, o.file_name, p.name, row_number() OVER (PARTITION BY p.stream, p.n ORDER BY p.name) AS r FROM attributes p JOIN ordered o ON o.stream = p.stream AND o.n = p.n + 1
  WHERE NOT EXISTS (SELECT 1 FROM attributes c WHERE c.stream = p.stream AND c.n = p.n + 1 AND c.name = p.name)),
formats AS (SELECT stream, file_name, trim(json_extract_string(header, '$.file_format')) AS f, lag(trim(json_extract_string(header, '$.file_format'))) OVER (PARTITION BY stream ORDER BY n) AS b, n FROM ordered)
SELECT stream, file_name, name AS field_name, 'renamed' AS change_kind FROM pairs WHERE old <> name
UNION ALL SELECT stream, file_name, name, 'retyped' FROM pairs WHERE was <> kind
UNION ALL SELECT stream, file_name, name, 'added' FROM come c WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.stream = c.stream AND p.n = c.n AND p.name = c.name)
UNION ALL SELECT stream, file_name, name, 'removed' FROM gone g WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.stream = g.stream AND p.n = g.n AND p.old = g.name)
UNION ALL SELECT c.stream, c.file_name, c.name, CASE WHEN g.name IS NULL THEN 'added' ELSE 'renamed' END FROM flag_come c LEFT JOIN flag_gone g USING (stream, n, r)
UNION ALL SELECT g.stream, g.file_name, g.name, 'removed' FROM flag_gone g WHERE NOT EXISTS (SELECT 1 FROM flag_come c WHERE c.stream = g.stream AND c.n = g.n AND c.r = g.r)
UNION ALL SELECT stream, file_name, 'file_format', 'retyped' FROM formats WHERE n > 1 AND f IS DISTINCT FROM b
"""

SIZE = "CAST(kind[2:2] AS INTEGER)"
UNION = f"""
WITH {FIELDS},
names AS MATERIALIZED (SELECT DISTINCT stream, CASE WHEN key = '' THEN name ELSE key END AS key, name, kind FROM ({VARIABLES.format(keep="o.stream", source="every")}) t),
folded AS (SELECT stream, key, min(name) AS field_name, count(DISTINCT kind) AS several, min(kind) AS one, bool_or(kind = 'str' OR kind NOT IN (SELECT kind FROM kinds)) AS text,
  bool_or(kind[1:1] = 'f') AS float, bool_or(kind = 'f8') AS wide, coalesce(max(CASE WHEN kind[1:1] = 'i' AND kind <> 'str' THEN {SIZE} END), 0) AS i, coalesce(max(CASE WHEN kind[1:1] = 'u' THEN {SIZE} END), 0) AS u FROM names GROUP BY stream, key),
fields AS MATERIALIZED (SELECT stream, key, field_name, CASE WHEN several = 1 THEN one WHEN text THEN 'str' WHEN float THEN CASE WHEN wide OR greatest(i, u) >= 4 THEN 'f8' ELSE 'f4' END
  WHEN u = 0 THEN 'i' || i WHEN i = 0 THEN 'u' || u WHEN greatest(i, 2 * u) <= 8 THEN 'i' || greatest(i, 2 * u) ELSE 'f8' END AS kind FROM folded),
records AS MATERIALIZED (SELECT stream, file_name, arg_min(header_id, struct_pack(a := record_json IS NULL, d := delivered_at, h := header_id)) AS header_id, arg_min(coalesce(record_json, ''), struct_pack(a := record_json IS NULL, d := delivered_at, h := header_id)) AS record FROM every GROUP BY stream, file_name),
given AS MATERIALIZED (SELECT r.*, e.key AS name, CASE WHEN e.type <> 'NULL' THEN json_extract_string(e.value, '$') END AS text FROM records r, json_each(CASE WHEN r.record <> '' THEN r.record ELSE '{{}}' END) e),
mapped AS (SELECT g.header_id, g.stream, g.file_name, coalesce(f.field_name, g.name) AS field_name, coalesce(f.kind, 'str') AS kind, g.text, f.key FROM given g LEFT JOIN names n ON n.stream = g.stream AND n.name = g.name LEFT JOIN fields f ON f.stream = n.stream AND f.key = n.key),
cells AS (SELECT DISTINCT * FROM mapped UNION ALL SELECT r.header_id, r.stream, r.file_name, f.field_name, f.kind, NULL, f.key FROM records r JOIN fields f USING (stream) WHERE NOT EXISTS (SELECT 1 FROM mapped m WHERE m.header_id = r.header_id AND m.stream = r.stream AND m.file_name = r.file_name AND m.key = f.key)),
limits(kind, low, high) AS (VALUES ('i1', -128, 127), ('u1', 0, 255), ('i2', -32768, 32767), ('u2', 0, 65535), ('i4', -2147483648, 2147483647), ('u4', 0, 4294967295), ('i8', -9223372036854775808, 9223372036854775807), ('u8', 0, 18446744073709551615))
SELECT c.header_id, c.stream, c.file_name, c.field_name, c.kind, CASE WHEN CASE WHEN c.kind = 'str' THEN true WHEN c.kind = 'b1' THEN TRY_CAST(c.text AS BOOLEAN) IS NULL ELSE TRY_CAST(c.text AS DOUBLE) IS NULL END THEN c.text END AS text, CASE WHEN c.kind NOT IN ('str', 'b1') THEN TRY_CAST(c.text AS DOUBLE) END AS number, CASE WHEN c.kind = 'b1' THEN TRY_CAST(c.text AS BOOLEAN) END AS flag,
  CASE WHEN TRY_CAST(c.text AS DECIMAL(38, 10)) BETWEEN l.low AND l.high AND TRY_CAST(c.text AS DECIMAL(38, 10)) = floor(TRY_CAST(c.text AS DECIMAL(38, 10))) THEN CAST(TRY_CAST(c.text AS DECIMAL(38, 10)) AS DECIMAL(20, 0)) END AS whole, true AS readable
FROM cells c LEFT JOIN limits l ON l.kind = c.kind
"""
