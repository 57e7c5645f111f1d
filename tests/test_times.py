"""Problem 5: mixed time notations."""

from datetime import datetime, timezone

import pytest

from loamline.functions.instants import instant_ms, unit_epoch
from loamline.operators.skew import hot_aware_join, salted_join
from loamline.operators.time_dictionary import TimeDictionary, normalise_times
from loamline.session import work_path


def ms(*a, add=0):
    return int(datetime(*a, tzinfo=timezone.utc).timestamp() * 1000) + add


@pytest.mark.parametrize("text,units,site,expected", [
    ("2015-03-23T07:01:28-0500", None, "America/Chicago", ms(2015, 3, 23, 12, 1, 28)),
    ("  2014-05-03T20:28:00+0200\t", None, "Europe/Vienna", ms(2014, 5, 3, 18, 28)),
    ("2016-05-30 17:10:20 CEST", None, "Europe/Vienna", ms(2016, 5, 30, 15, 10, 20)),
    ("2017-11-29 15:25:32 CST", None, "America/Chicago", ms(2017, 11, 29, 21, 25, 32)),
    ("2018_073_0000", None, None, ms(2018, 3, 14)),
    ("2016-092T00:00:00", None, None, ms(2016, 4, 1)),
    ("201711200000", None, None, ms(2017, 11, 20)),
    ("20160605T030000", None, None, ms(2016, 6, 5, 3)),
    ("2014/02/12 12:30 AM", None, "UTC", ms(2014, 2, 12, 0, 30)),
    ("2014/02/12 12:30 PM", None, "UTC", ms(2014, 2, 12, 12, 30)),
    ("28-Jun-2018 10:19:49", None, "Asia/Kolkata", ms(2018, 6, 28, 4, 49, 49)),
    ("11.01.2018 03:44", None, "Australia/Sydney", ms(2018, 1, 10, 16, 44)),
    ("Sun, 13 Nov 2016 22:32:59 +1100", None, None, ms(2016, 11, 13, 11, 32, 59)),
    ("2014-08-19T24:00:00+00:00", None, None, ms(2014, 8, 20)),
    ("2015-11-19T01:59:22.4475", None, None, ms(2015, 11, 19, 1, 59, 22, add=448)),
    ("2018-07-25T08:22:26z", None, "Asia/Kolkata", ms(2018, 7, 25, 8, 22, 26)),
    ("2016-12-29 10:51:48+03", None, None, ms(2016, 12, 29, 7, 51, 48)),
    ("2018-10-28T02:30:00", None, "Europe/Vienna", None),  # shown twice
    ("2018-03-25T02:30:00", None, "Europe/Vienna", None),  # never shown
    ("2018-10-28T02:30:00+01:00", None, "Europe/Vienna", ms(2018, 10, 28, 1, 30)),
    ("2018-03-25T03:00:00", None, "Europe/Vienna", ms(2018, 3, 25, 1)),
    ("2018-01-01 00:00", None, "Not/AZone", None),
    ("2014-06-31T12:00:00", None, None, None), ("2018-04-07 25:10:00", None, None, None), ("2016-13-04T02:00:00Z", None, None, None), ("2015-366T00:00", None, None, None),
    ("-9999", None, None, None), ("pending", None, None, None), ("", None, None, None), (None, None, None, None), ("n/a", None, None, None), ("12345", None, None, None),
    ("567352921", "seconds since 2000-01-01 12:00", None, (567352921 + 946728000) * 1000),
    ("4.651225040E+08", "seconds since 2000-01-01 00:00", None, (465122504 + 946684800) * 1000),
    ("+490860894", "seconds since 2000-01-01 00:00", "Europe/Vienna", (490860894 + 946684800) * 1000),
    ("14294521.25", "minutes since 1990-01-01T00:00:00Z", None, int((14294521.25 * 60 + 631152000) * 1000)),
    ("1491090362691", "milliseconds since 1970-01-01", None, 1491090362691),
    ("6736", "Days since 2000-01-01", None, (6736 * 86400 + 946684800) * 1000),
    ("562100.89", "hours since 1950-01-01 00:00:00", None, 562100890 * 3600 - 631152000000),
    ("-9999.0", "Days since 2000-01-01", None, None), ("NaN", "Days since 2000-01-01", None, None), ("1e400", "s since 1970-01-01", None, None), ("5", "moons ago", None, None), ("5", "years since 2000-01-01", None, None),
])
def test_instants(text, units, site, expected):
    assert instant_ms(text, units, site) == expected


def test_unit_words():
    assert unit_epoch("M since 1970-01-01")[0] == 60_000 and unit_epoch("msec since 1970-01-01")[0] == 1 and unit_epoch("D since 1970-01-01")[0] == 86_400_000


SCHEMA = "reading_id long, site_zone string, acquisition_time string, time_units string, timeoffsetvarname string, time_offset double, timeoffsetunit string, raw string, rows int"


def test_rows(spark):
    base = "2018-01-01 00:00"
    rows = [
        (1, None, base, None, None, None, None, "clash", 1), (1, None, base, None, None, None, None, "clash", 1),
        (2, None, base, None, "o", -1.9, "Hours", "clash", 1), (3, None, base, None, "o", None, "h", "clash", 1), (4, None, base, None, "o", float("nan"), "h", "clash", 1),
        (5, None, base, None, "o", 2.7, "minutes", "clash", 1), (6, None, base, None, "o", 1.0, "weeks", "clash", 1), (7, None, None, None, None, None, None, None, 1),
        (8, None, base, None, None, 5.0, "h", "clash", 1), (None, None, base, None, None, None, None, "x", 1), (9, "", base, "", None, None, None, "x", 1), (10, None, "9" * 5000, None, None, None, None, "x", 1),
    ]
    got = {r.reading_id: r.utc_ms for r in normalise_times(spark.createDataFrame(rows, SCHEMA)).collect()}
    t = ms(2018, 1, 1)
    assert got == {1: t, 2: t - 3600_000, 5: t + 120_000, 8: t, 9: t}
    assert normalise_times(spark.createDataFrame([], SCHEMA)).count() == 0


def test_dictionary_grows_by_what_is_new(spark):
    d = TimeDictionary(spark, work_path(spark, "dict"))
    v = lambda *x: spark.createDataFrame([("s", t, "", "") for t in x], "sensor string, raw string, units string, site string")
    d.extend(v("2018-01-01", "2018-01-02", "2018-01-01"))
    d.extend(v("2018-01-02", "2018-01-03"))
    again = TimeDictionary(spark, d.root)
    again.extend(v("2018-01-03"))
    assert sorted(r.raw for r in again.read().collect()) == ["2018-01-01", "2018-01-02", "2018-01-03"]


def test_every_form_is_tried():
    """A date that does not exist in one notation may exist in another; abbreviations of several countries need a site."""
    assert instant_ms("2017-11-29 15:25:32 CST", None, None) is None and instant_ms("2017-11-29 15:25:32 CST", None, "Europe/Vienna") is None
    assert instant_ms("2017-11-29 15:25:32 CST", None, "Asia/Shanghai") == ms(2017, 11, 29, 7, 25, 32)
    assert instant_ms("2015-366", None, None) is None and instant_ms("2016-366", None, None) == ms(2016, 12, 31)


def test_kept_dictionary_is_used_again(spark, monkeypatch):
    from loamline.operators import time_dictionary

    root = work_path(spark, "kept")
    monkeypatch.setattr(time_dictionary, "shared_folder", lambda s: root)
    row = (1, None, "2018-01-01 00:00", None, None, None, None, "clash", 1)
    rows = spark.createDataFrame([row], SCHEMA)
    for _ in range(2):
        assert normalise_times(rows, time_dictionary.kept_dictionary(spark)).count() == 1
    assert time_dictionary.kept_dictionary(spark).read().count() == 1
    # what it says counts: a second run does not parse again
    spark.createDataFrame([("", "2018-01-02", "", "", 7)], time_dictionary.ENTRY).write.mode("append").parquet(time_dictionary.kept_dictionary(spark).root)
    other = spark.createDataFrame([(2, None, "2018-01-02", *row[3:])], SCHEMA)
    assert normalise_times(other, time_dictionary.kept_dictionary(spark)).first().utc_ms == 7


def test_hot_keys_join_like_others(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 50}") for i in range(3000)], "id int, k string")
    lookup = rows.groupBy("k").count().withColumnRenamed("count", "n")
    lookup = lookup.withColumn("v", lookup.k)
    got = hot_aware_join(rows, lookup, ["k"], "n", hot_at_least=100).collect()
    assert len(got) == 3000 and all(r.k == r.v for r in got)


def test_salted_join_gives_every_pair_once(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 50}") for i in range(3000)] + [(-1, None)], "id int, k string")
    lookup = spark.createDataFrame([(k, v) for k in ("hot", *(f"k{i}" for i in range(50))) for v in (1, 2)], "k string, v int")
    plain, salted = rows.join(lookup, ["k"]), salted_join(rows, lookup, ["k"], salts=4, hot_at_least=100)
    assert salted.columns == plain.columns and sorted(map(tuple, salted.collect())) == sorted(map(tuple, plain.collect()))
    assert salted_join(rows, lookup, ["k"]).count() == plain.count()
