"""Problem 3: best representative of each duplicate group."""

from datetime import datetime

import pytest

import loamline.llm.survivorship as survivorship
import loamline.operators.skew as skew
from loamline.llm.survivorship import discover, image_files, surviving_rows, survivors

SCHEMA = "image_id long, prod string, area string, img_datetime string, vers string, produced_at timestamp_ntz, orbit_dir string, n_valid int, mean_value double, mean_noise double, qc_note string, record string, rank int"
CLAIMS = "entity string, f string, source string, rank int, record int"
T = datetime(2020, 1, 1)
NAN = float("nan")


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)


ROWS = [
    (1, "SSM1km", "A1", "201501010000", "1.9.9", T, "A", 5, 1.0, NAN, ""),
    (2, "ssm1KM", "A1", "2015-01-01T00:00:00Z", "V1.10", T, None, -9999, -9999.0, 7.0, "n/a"),
    (3, "SSM1km", "A1", "20150101T000000", "v1.10.00", datetime(2021, 1, 1), "n/a", None, NAN, 8.0, None),
    (4, "SSM1km", "A1", "2015-01-01 00:00", None, T, "D", 9, 2.0, 9.0, "ok"),
    (10, "SSM1km", "A2", "201501010000", "1.0", T, "A", 1, 1.0, 1.0, "x"),  # alone
    (20, "SSM1km", "A3", "201501010000", "1.0", None, None, None, None, None, None),  # no value at all
    (21, "SSM1km", "A3", "201501010000", "2.0", None, "", None, NAN, -9999.0, "N/A"),
    (30, None, "A1", "201501010000", "1.0", T, "A", 1, 1.0, 1.0, "x"),
    (31, "SSM1km", "A1", "no time", "1.0", T, "A", 1, 1.0, 1.0, "x"),
]


def test_found(spark):
    got = sorted((r.image_id, r.field_name, r.donor_id) for r in survivors(table(spark, ROWS + ROWS[:3])).collect())
    assert got == [(3, "mean_noise", 3), (3, "mean_value", 1), (3, "n_valid", 1), (3, "orbit_dir", 1), (3, "qc_note", 4)]


def test_wide(spark):
    (row,) = surviving_rows(table(spark, ROWS)).collect()
    assert (row.image_id, row.orbit_dir, row.n_valid, row.mean_noise, row.qc_note, row.filled) == (3, "A", "5", "8.0", "ok", 5)


def test_ranks_as_text(spark):
    versions = ["1", "1.0.0", "1.9", "1.10", "1.10.1", "2", "10", "10.0.0.1", None, "0.1"]
    df = spark.createDataFrame([(i, v, t) for i, v in enumerate(versions) for t in (None, datetime(1960, 1, 1), T)], "i int, v string, t timestamp_ntz")
    rows = df.select("i", "t", survivorship.rank_text(survivorship.version_key(df.v), df.t).alias("k")).collect()
    number = lambda v: [int(x) for x in ([*(v or "").split("."), "0", "0", "0"])[:4] if x] if v else []
    key = lambda r: ([*number(versions[r.i]), 0, 0, 0, 0][:4], r.t is not None, r.t or T)
    for a in rows:
        for b in rows:
            assert (a.k < b.k) == (key(a) < key(b)), (versions[a.i], a.t, versions[b.i], b.t)


HOT = [(i, "SSM1km", "HOT" if i % 2 else f"A{i % 9}", "201501010000", f"1.{i}", T, "A" if i % 3 else None, i % 4, float(i), NAN, "n/a") for i in range(120)]


@pytest.mark.parametrize("recency", [True, False])
@pytest.mark.parametrize("how", [{"packed": 3}, {"sources": 2}])
def test_large_groups_and_many_sources_give_the_same(spark, monkeypatch, recency, how):
    files = image_files(table(spark, HOT + ROWS + HOT[:7]))
    one = lambda df: sorted((str(r.entity), r.leader, r.several, r.field, r.value, r.record, round(r.support, 6)) for r in df.collect())
    plain = one(discover(files, survivorship.FIELDS, recency))
    original = skew.hot_aware_join
    monkeypatch.setattr(survivorship, "hot_aware_join", lambda a, b, k, w: original(a, b, k, w, hot_at_least=10))
    assert one(discover(files, survivorship.FIELDS, recency, **how)) == plain


def test_newest_of_a_hot_image(spark):
    """However many newer files lack a field, the newest that has it gives it."""
    rows = [(i, "SSM1km", "HOT", "201501010000", f"1.{i}", T, "A" if i < 3 else None, None, float(i), NAN, None) for i in range(700)]
    got = {(r.field_name, r.donor_id) for r in survivors(table(spark, rows)).collect()}
    assert got == {("orbit_dir", 2), ("mean_value", 699)}


def judged(bad_rank, good_rank, ties=1):
    """Claims where good1..3 agree and bad never does, and one entity where good1 and bad differ."""
    claims = []
    for e in range(30):
        claims += [(f"e{e}", "right", s, 0, e) for s in ("good1", "good2", "good3")]
        claims.append((f"e{e}", f"wrong{e}", "bad", 0, 100 + e))
    return claims + [("open", "from good", "good1", good_rank, 2), ("open", "from bad", "bad", bad_rank, 1)]


def value(spark, claims, **how):
    df = spark.createDataFrame(claims, CLAIMS)
    return {r.entity: r.value for r in discover(df, ["f"], **how).collect()}["open"]


def test_reliability_decides(spark, monkeypatch):
    """Between files of one rank by default, over a newer file with a weak decay, and everywhere without recency."""
    assert value(spark, judged(0, 0)) == "from good"
    assert value(spark, judged(1, 0)) == "from bad"  # the newest file leads
    assert value(spark, judged(1, 0), decay=0.6) == "from good"
    assert value(spark, judged(9, 0), recency=False) == "from good"
    monkeypatch.setattr(survivorship, "LEAST_WEIGHT", 1.0)  # without reliability all three change
    assert value(spark, judged(0, 0)) == "from bad"
    assert value(spark, judged(1, 0), decay=0.6) == "from bad"
    assert value(spark, judged(9, 0), recency=False) == "from bad"


def test_an_unreliable_newest_file_still_leads(spark):
    """At the default decay no number of older files outvotes the newest, however unreliable its source is."""
    claims = judged(50, 0)[:-2] + [("open", "old", f"good{1 + i % 3}", i, i) for i in range(50)] + [("open", "old", "good1", 49, 100 + i) for i in range(40)] + [("open", "new", "bad", 50, 999)]
    assert value(spark, claims) == "new"


def test_reports_when_it_does_not_settle(spark, recwarn):
    claims = [(f"e{e}", v, s, 0, n) for e in range(9) for n, (v, s) in enumerate((("right", "a"), ("right", "b"), ("wrong", "c")))]
    df = spark.createDataFrame(claims, CLAIMS)
    settled = {r.value for r in discover(df, ["f"], recency=False).collect()}
    assert settled == {"right"} and not [w for w in recwarn if "still moved" in str(w.message)]
    with pytest.warns(UserWarning, match="still moved"):
        discover(df, ["f"], recency=False, rounds=1)


def test_empty(spark):
    assert survivors(table(spark, [])).count() == 0 and image_files(table(spark, [])).count() == 0
