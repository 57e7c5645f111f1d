"""Problems 1 and 7: regular grid and implausible readings."""

import math
import random

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from loamline.operators.readings import EPOCH, all_readings, readings_of
from loamline.operators.regular_grid import missing_days, regularize
from loamline.operators.spikes import esd_limit, features, flag_readings, outlier_limit

SCHEMA = "obs_id long, gpi long, acquisition_time double, soil_moisture double, extra string"
NAN = float("nan")


def raw(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def at(day, sensor="smap"):
    return day * 86400.0 - EPOCH[sensor] + 3600


def test_presence(spark):
    rows = [(1, 5, 100.0, 0.2, None), (2, None, 100.0, 0.2, "x"), (3, 5, None, 0.2, None), (4, 5, NAN, 0.2, None), (5, 5, 100.0, None, None), (6, 5, 100.0, NAN, None), (7, 5, 100.0, -9999.0, None), (8, 5, 100.0, -999.0, None), (9, 5, 0.0, 0.1, None), (10, 5, 1.0, 7.0, None)]
    assert {r.obs_id for r in readings_of(raw(spark, rows), "smap").collect()} == {1, 8, 9, 10}
    assert {r.obs_id for r in readings_of(raw(spark, rows), "smos").collect()} == {1, 7, 10}


def test_missing_days_and_fill(spark):
    truth = lambda d: 0.25 + 0.1 * math.sin(2 * math.pi * d / 365.2425) + 1e-5 * (d - 16000)
    days = [d for d in range(16000, 16400) if not (16100 <= d < 16120 or d % 7 == 3)]
    rows = [(i, 1, at(d), truth(d), None) for i, d in enumerate(days)] * 2 + [(9999, 2, at(16000), 0.5, None)]
    r = all_readings(raw(spark, rows), raw(spark, []))
    got = {(x.gpi, x.missing_day) for x in missing_days(r).collect()}
    last = max(days)
    expected = {d for d in range(16000, last) if d not in days}
    assert got == {(1, str(np.datetime64(d, "D"))) for d in expected}
    table = regularize(r).collect()
    assert len(table) == last - 16000 + 1 + 1
    for x in table:
        if x.gpi == 1:
            assert abs(x.value - truth(x.day)) < 0.01 and x.missing == (x.day in expected)


def test_bridge_meets_its_ends(spark):
    rows = [(1, 1, at(16000), 0.2, None), (2, 1, at(16010), 0.3, None)]
    got = {x.day: x.value for x in regularize(all_readings(raw(spark, rows), raw(spark, []))).collect()}
    steps = [got[16000 + i] for i in range(11)]
    assert steps[0] == 0.2 and steps[-1] == 0.3 and max(abs(b - a) for a, b in zip(steps, steps[1:])) < 0.03


def test_implausible_values_make_a_day_but_no_fit(spark):
    rows = [(i, 1, at(16000 + i), 0.2, None) for i in (0, 1, 2, 8, 9)] + [(99, 1, at(16005), 655.35, None)]
    got = {x.day: x for x in regularize(all_readings(raw(spark, rows), raw(spark, []))).collect()}
    assert got[16005].value is None and not got[16005].missing
    assert got[16004].missing and abs(got[16004].value - 0.2) < 1e-3


def test_wild_times(spark):
    """A time without a date is left out, one far away is filled in slices."""
    rows = [(1, 1, at(16000), 0.2, None), (2, 1, 1e17, 0.2, None), (3, 1, -1e17, 0.2, None), (4, 2, at(16000), 0.2, None), (5, 2, at(-500_000), 0.4, None)]
    r = all_readings(raw(spark, rows), raw(spark, []))
    got = {x.gpi: (x.n, x.a, x.b) for x in regularize(r).groupBy("gpi").agg(F.count(F.lit(1)).alias("n"), F.min("day").alias("a"), F.max("day").alias("b")).collect()}
    assert got == {1: (1, 16000, 16000), 2: (516_001, -500_000, 16000)} and missing_days(r).count() == 515_999


def test_empty(spark):
    r = all_readings(raw(spark, []), raw(spark, []))
    assert regularize(r).count() == 0 and missing_days(r).count() == 0 and flag_readings(r).count() == 0


def made_series(seed, n, gpi, first_id, cases):
    rnd = random.Random(seed)
    t, rows, values = 16000.0, [], []
    for i in range(n):
        t += rnd.choice((0.5, 0.5, 1.0, 1.5))
        values.append([first_id + i, gpi, at(t), 0.25 + 0.05 * math.sin(i / 40) + rnd.gauss(0, 0.006), None])
    truth = set()
    for k, at_ in enumerate(range(15, n - 15, 37)):
        if not cases:
            break
        kind = k % 5
        if kind < 3:
            for j in range(kind + 1):
                values[at_ + j][3] += 0.15 if k % 2 else -0.15
                truth.add(values[at_ + j][0])
        elif kind == 3:
            for j in range(9):
                values[at_ + j][3] = values[at_][3]
                truth.add(values[at_ + j][0])
        else:
            values[at_][3] = 655.35 if k % 2 else -0.3
            truth.add(values[at_][0])
    return [tuple(v) for v in values], truth


def test_spikes_found_however_the_series_is_cut(spark, partitions):
    hot, a = made_series(1, 1500, 1, 0, True)
    small, b = made_series(2, 120, 2, 10_000, True)
    calm, _ = made_series(3, 90, 3, 20_000, False)
    rows = hot + small + calm
    rows = rows + rows[::50]  # repeated deliveries
    random.Random(0).shuffle(rows)
    results = []
    for n in (1, 3, 11):
        partitions(n)
        got = flag_readings(all_readings(raw(spark, rows), raw(spark, []))).collect()
        assert len({(g.sensor, g.obs_id) for g in got}) == len(got)
        results.append({(g.obs_id, g.reason) for g in got})
    assert results[0] == results[1] == results[2]
    assert {o for o, _ in results[0]} == a | b


def test_long_partitions_are_decided_in_pieces(spark, partitions, monkeypatch):
    from loamline.operators import spikes

    hot, truth = made_series(3, 900, 1, 0, True)
    rows = hot + hot[::40]
    partitions(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    source = all_readings(raw(spark, rows), raw(spark, []))
    ordered = source.selectExpr("sensor", "gpi", "unix", "value", "obs_id").orderBy("gpi", "unix", "obs_id").toArrow()
    pieces = {}
    for limit in (10**9, 60, 7):
        monkeypatch.setattr(spikes, "ROWS_AT_ONCE", limit)
        out = pd.concat([b.to_pandas() for b in spikes._sorted_pass((0.0, 1.0), 3, 8)(iter(ordered.to_batches(50)))])
        edges = pa.Table.from_pandas(out[out.kind == "edge"], spikes.FIELDS, preserve_index=False)
        done = pd.concat([out[out.kind == "reading"], spikes._stitch(3, 8)(edges).to_pandas().query("kind == 'reading'")])
        assert not done.duplicated(["obs_id", "reason"]).any()
        sure = done[(done.reason != "spike") | (done.excursion > 0.05)]
        pieces[limit] = set(zip(sure.obs_id, sure.reason, strict=True))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert pieces[10**9] == pieces[60] == pieces[7] and {o for o, _ in pieces[7]} == truth


def test_rain_is_no_spike(spark):
    values = [0.2 + 0.004 * ((i * 7919) % 5 - 2) for i in range(120)]
    for i in range(12):
        values[60 + i] += 0.15 * math.exp(-i / 4)
    rows = [(i, 1, at(16000 + i / 2), v, None) for i, v in enumerate(values)]
    assert flag_readings(all_readings(raw(spark, rows), raw(spark, []))).where("reason = 'spike'").count() == 0


def test_runs_broken_by_an_impossible_reading(spark, partitions):
    values = [0.2 + 0.003 * ((i * 7919) % 7 - 3) for i in range(60)]
    values[20:25] = [0.3] * 5
    values[25] = 5.0
    values[26:30] = [0.3] * 4
    rows = [(i, 1, at(16000 + i), v, None) for i, v in enumerate(values)]
    for n in (1, 5):
        partitions(n)
        got = {(g.obs_id, g.reason) for g in flag_readings(all_readings(raw(spark, rows), raw(spark, []))).collect()}
        assert (25, "range") in got and not any(r == "constant" for _, r in got)


def test_esd_limit_matches_known_values():
    # critical values of the generalised ESD example with 54 values and level 0.05
    assert abs(esd_limit(54, 0.05) - 3.159) < 0.01 and abs(esd_limit(52, 0.05) - 3.144) < 0.01


def test_outlier_limit_equals_the_test_step_by_step():
    """Against the generalised ESD test on single values, with masked outliers."""
    rnd = np.random.default_rng(5)
    for n, shift in ((60, (4, 5, 5.5, 6)), (300, (3.9, 9, 9.1)), (40, ()), (500, (60, 61, -62, 7))):
        x = np.concatenate([rnd.normal(0, 1, n - len(shift)), shift])
        left, passed = list(x), 0
        removed = []
        for i in range(1, n // 5 + 1):
            rest = np.array(left)
            worst = int(np.argmax(np.abs(rest)))  # remainders are centred by their season
            if abs(rest[worst] - rest.mean()) > esd_limit(len(rest), 0.05) * rest.std(ddof=1):
                passed = i
            removed.append(abs(left.pop(worst)))
        expected = removed[passed - 1] if passed else math.inf
        assert outlier_limit(x, np.ones(n, int), 0.05, 0.2) == expected


def test_a_daily_peak_is_the_season(spark):
    """A peak at the same hour of every day leaves its course by far more than eight times the scatter; the season takes
    it, so the generalised ESD limit keeps it from being flagged."""
    rnd = random.Random(4)
    values = [0.2 + rnd.gauss(0, 0.004) + 0.15 * (i % 24 == 12) for i in range(24 * 40)]
    values[101] += 0.15
    values[500] -= 0.15
    rows = [(i, 1, at(16000 + i / 24), v, None) for i, v in enumerate(values)]
    zero = np.zeros(len(values), int)
    _, excursion, step, _ = features(np.array(values), zero, zero.astype(bool), 3, 8)
    plain = set(np.flatnonzero(excursion > 8 * 1.4826 / math.sqrt(2) * np.nanmedian(np.abs(step))).tolist())
    got = {g.obs_id for g in flag_readings(all_readings(raw(spark, rows), raw(spark, []))).where("reason = 'spike'").collect()}
    assert got == {101, 500} and len(plain) > 35


def test_any_sensor_is_judged_by_itself(spark):
    rows = [(s, 1, float(i * 43200), 0.2 + 0.003 * ((i * 7919) % 7 - 3) + (0.2 if (s, i) == ("ascat", 40) else 0.0), i) for s in ("smap", "smos", "ascat") for i in range(80)]
    df = spark.createDataFrame(rows, "sensor string, gpi long, unix double, value double, obs_id long")
    assert [(g.sensor, g.obs_id, g.reason) for g in flag_readings(df).collect()] == [("ascat", 40, "spike")]


def test_clashing_columns_are_ignored(spark):
    rows = [(i, 1, at(16000 + i), 0.2 + 0.003 * (i % 3), "x") for i in range(20)]
    df = raw(spark, rows).withColumn("value", F.lit("clash")).withColumn("sensor", F.lit(3)).withColumn("unix", F.lit(None))
    assert missing_days(readings_of(df, "smap")).count() == 0
