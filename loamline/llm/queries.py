"""Queries of the operators for training text (problems 3, 8, 9, 10), over whole tables and whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loamline.llm.leakage import leaked
from loamline.llm.mixing import mix
from loamline.llm.survivorship import surviving_rows, survivors
from loamline.llm.truncation import truncated, truncation_rates
from loamline.session import read_table


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return survivors(read_table(spark, folder, "image_versions")).select("image_id", "field_name", "donor_id")


def p3_survivors(spark: SparkSession, folder: str) -> DataFrame:
    """The surviving records themselves."""
    return surviving_rows(read_table(spark, folder, "image_versions"))


def p3_voted(spark: SparkSession, folder: str) -> DataFrame:
    """The values that the sources' reliabilities alone choose, without recency."""
    return survivors(read_table(spark, folder, "image_versions"), recency=False).select("image_id", "field_name", "donor_id", "support")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaked(read_table(spark, folder, "documents"), read_table(spark, folder, "eval_items")).select("doc_id", "item_id")


def p8_proximity(spark: SparkSession, folder: str) -> DataFrame:
    """Passages with up to two strange words among at least twelve."""
    return leaked(read_table(spark, folder, "documents"), read_table(spark, folder, "eval_items"), slack=2)


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The mixed documents, with how often each is used."""
    return mix(read_table(spark, folder, "documents"), read_table(spark, folder, "mix_targets"))[0]


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and actual share of each source."""
    return mix(read_table(spark, folder, "documents"), read_table(spark, folder, "mix_targets"))[1]


def p9_balanced(spark: SparkSession, folder: str) -> DataFrame:
    """Shares of the largest mix in which every source that has documents meets its own."""
    return mix(read_table(spark, folder, "documents"), read_table(spark, folder, "mix_targets"), balanced=True)[1]


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return truncated(read_table(spark, folder, "documents")).select("doc_id")


def p10_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Each source's rate of cut texts."""
    return truncation_rates(read_table(spark, folder, "documents"))


QUERIES = {f.__name__: f for f in (p3_found, p3_survivors, p3_voted, p8_found, p8_proximity, p9_mix, p9_shares, p9_balanced, p10_found, p10_rates)}

#: Files of image_versions in rank order, and their fields in one row each.
FILES_SQL = r"""
files AS (SELECT DISTINCT lower(trim(prod)) AS prod, trim(area) AS area, rpad(regexp_replace(img_datetime, '[^0-9]', '', 'g'), 14, '0') AS img,
  image_id, list_transform(regexp_extract_all(vers, '\d+'), lambda p: CAST(p AS BIGINT)) AS v, produced_at,
  CASE WHEN trim(orbit_dir) NOT IN ('', 'n/a') THEN trim(orbit_dir) END AS orbit_dir, CASE WHEN n_valid <> -9999 THEN n_valid END AS n_valid,
  CASE WHEN NOT isnan(mean_value) AND mean_value <> -9999 THEN mean_value END AS mean_value, CASE WHEN NOT isnan(mean_noise) AND mean_noise <> -9999 THEN mean_noise END AS mean_noise,
  CASE WHEN trim(qc_note) NOT IN ('', 'n/a') THEN trim(qc_note) END AS qc_note FROM image_versions),
ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY prod, area, img ORDER BY coalesce(v[1], 0) DESC, coalesce(v[2], 0) DESC, coalesce(v[3], 0) DESC, coalesce(v[4], 0) DESC, produced_at DESC NULLS LAST, image_id) AS r FROM files),
groups AS (SELECT prod, area, img, max(CASE WHEN r = 1 THEN image_id END) AS image_id FROM ranked GROUP BY prod, area, img HAVING count(DISTINCT image_id) > 1),
cells AS MATERIALIZED (
  SELECT prod, area, img, r, v, image_id AS donor_id, 'orbit_dir' AS field_name, orbit_dir AS value FROM ranked WHERE orbit_dir IS NOT NULL UNION ALL
  SELECT prod, area, img, r, v, image_id, 'n_valid', CAST(n_valid AS VARCHAR) FROM ranked WHERE n_valid IS NOT NULL UNION ALL
  SELECT prod, area, img, r, v, image_id, 'mean_value', CAST(mean_value AS VARCHAR) FROM ranked WHERE mean_value IS NOT NULL UNION ALL
  SELECT prod, area, img, r, v, image_id, 'mean_noise', CAST(mean_noise AS VARCHAR) FROM ranked WHERE mean_noise IS NOT NULL UNION ALL
  SELECT prod, area, img, r, v, image_id, 'qc_note', qc_note FROM ranked WHERE qc_note IS NOT NULL)
"""
FOUND_SQL = f"""
WITH {FILES_SQL},
firsts AS (SELECT prod, area, img, field_name, min(r) AS r FROM cells GROUP BY prod, area, img, field_name),
donors AS (SELECT c.* FROM firsts f JOIN cells c ON c.prod = f.prod AND c.area = f.area AND c.img = f.img AND c.field_name = f.field_name AND c.r = f.r)
"""


def voted_sql(rounds: int = 16) -> str:
    """The turns of truth discovery without recency, one after the other; further turns change nothing once they settle."""
    source = "prod || '/' || CAST(coalesce(v[1], 0) AS VARCHAR) || '.' || CAST(coalesce(v[2], 0) AS VARCHAR)"
    steps = [FILES_SQL, f"claims AS MATERIALIZED (SELECT *, {source} AS source FROM cells)", "w0 AS (SELECT DISTINCT source, 0.6::DOUBLE AS w FROM claims)"]
    for k in range(rounds):
        steps += [
            f"s{k} AS (SELECT prod, area, img, field_name, value, sum(w) AS support, min(r) AS r, arg_min(donor_id, r) AS donor_id FROM claims JOIN w{k} USING (source) GROUP BY ALL)",
            f"a{k} AS MATERIALIZED (SELECT *, support / sum(support) OVER g AS share, row_number() OVER (PARTITION BY prod, area, img, field_name ORDER BY round(support, 9) DESC, r) AS place FROM s{k} WINDOW g AS (PARTITION BY prod, area, img, field_name))",
            f"w{k + 1} AS MATERIALIZED (SELECT source, 0.2::DOUBLE + 0.8::DOUBLE * ((count(*) FILTER (WHERE a.place = 1) + 2) / (count(*) + 4)::DOUBLE) AS w FROM claims c JOIN a{k} a USING (prod, area, img, field_name, value) GROUP BY source)",
        ]
    return f"WITH {', '.join(steps)} SELECT g.image_id, a.field_name, a.donor_id, round(a.share, 6) AS support FROM a{rounds - 1} a JOIN groups g USING (prod, area, img) WHERE a.place = 1"


ORACLE = {
    "p3_found": FOUND_SQL + "SELECT g.image_id, d.field_name, d.donor_id FROM groups g JOIN donors d USING (prod, area, img)",
    "p3_survivors": FOUND_SQL + """
SELECT g.image_id, max(CASE WHEN field_name = 'orbit_dir' THEN value END) AS orbit_dir, max(CASE WHEN field_name = 'n_valid' THEN value END) AS n_valid,
  max(CASE WHEN field_name = 'mean_value' THEN value END) AS mean_value, max(CASE WHEN field_name = 'mean_noise' THEN value END) AS mean_noise,
  max(CASE WHEN field_name = 'qc_note' THEN value END) AS qc_note, CAST(count(*) AS INTEGER) AS filled FROM groups g JOIN donors d USING (prod, area, img) GROUP BY g.image_id
""",
    "p3_voted": voted_sql(),
}
