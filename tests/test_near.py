"""Problem 6: points near points."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from loamline.operators import agreement
from loamline.operators.grid import nearest_point
from loamline.operators.near import Tree, dual_tree, in_polygons, in_regions, near_pairs

A = "sid long, lat double, lon double, r double, b_lat string, node int"
B = "tid long, lat double, lon double, x string"


def km(p, q):
    a, b, dl = math.radians(p[0]), math.radians(q[0]), math.radians(p[1] - q[1])
    return 2 * 6371 * math.asin(math.sqrt(min(1, math.sin((a - b) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(dl / 2) ** 2)))


def test_against_brute_force(spark):
    rnd = random.Random(7)
    centre = [(0, 179.99), (89.9, 10), (-89.95, -100), (45, 0), (10, 10)]
    spot = lambda: (lambda c: (max(-90.0, min(90.0, c[0] + rnd.gauss(0, 0.3))), c[1] + rnd.gauss(0, 0.3)))(rnd.choice(centre))
    left = [(i, *spot(), rnd.choice((0.0, 5.0, 50.0, 400.0, 20000.0)), "x", 1) for i in range(150)]
    left = [(i, a, o if o <= 180 else o - 360 if i % 2 else o, r, x, n) for i, a, o, r, x, n in left]
    right = [(i, a, max(-180.0, min(360.0, o)), "x") for i, (a, o) in enumerate(spot() for _ in range(120))]
    bad = [(900, None, 0.0, 1.0, "x", 1), (901, float("nan"), 0.0, 1.0, "x", 1), (902, -9999.0, 0.0, 1.0, "x", 1), (903, 0.0, 361.0, 1.0, "x", 1), (904, 45.0, 0.0, None, "x", 1), (905, 45.0, 0.0, -1.0, "x", 1), (None, 45.0, 0.0, 99.0, "x", 1)]
    l, r = spark.createDataFrame(left + left[:20] + bad, A), spark.createDataFrame(right + right[:5] + [(999, None, 1.0, "x")], B)
    expected = {(p[0], q[0]) for p in left for q in right if km(p[1:3], q[1:3]) <= p[3]}
    for how in ({}, {"right_at_most": 0}, {"right_at_most": 0, "hot_leaf": 3}):
        got = [(x.sid, x.tid) for x in near_pairs(l, r, "sid", "tid", "r", **how).collect()]
        assert len(got) == len(set(got)) and set(got) == expected


def test_many_copies_of_a_place(spark):
    l = spark.createDataFrame([(i, 10.0, 20.0, 3.0, "x", 1) for i in range(500)], A)
    r = spark.createDataFrame([(1, 10.0, 20.01, "x"), (2, 11.0, 20.0, "x")], B)
    for bound in (0, 100):
        assert near_pairs(l, r, "sid", "tid", "r", bound).count() == 500
        assert near_pairs(l.limit(0), r, "sid", "tid", "r", bound).count() == 0 and near_pairs(l, r.limit(0), "sid", "tid", "r", bound).count() == 0


def test_area_mean_by_place(spark, monkeypatch):
    pairs = []
    monkeypatch.setattr(agreement, "near_pairs", lambda *a: pairs.append(near_pairs(*a)) or pairs[-1])
    places = {0: (10.0, 20.0), 1: (10.0, 179.9), 2: (-60.0, 0.0)}
    at = [(s, *places[s % 2]) for s in range(60)] + [(70, *places[0]), (70, *places[1])]  # the last has two places
    points = [(g, places[g % 3][0] + 0.1, places[g % 3][1] - 0.2) for g in range(90)] + [(100, *places[1]), (100, *places[2]), (100, *places[2])]
    seen = [(g, f"2020-01-0{1 + (g or 0) % 2}", None if g == 4 else float("nan") if g == 6 else (g or 0) / 7) for g in [*range(90), 100, 999, None]]
    bad = [(900, None, 1.0), (901, float("nan"), 1.0), (902, 10.0, 361.0), (None, 10.0, 20.0)]
    stations, grid = spark.createDataFrame(at + at[:5] + bad, "id int, lat double, lon double"), spark.createDataFrame(points + bad, "gpi long, lat double, lon double")
    got = agreement.area_mean(spark.createDataFrame(seen, "gpi long, time string, value double").withColumn("time", F.col("time").cast("timestamp_ntz")), grid, stations, "id", 100, "value", 4)
    expected = {}
    for s in {s for s, *_ in at}:
        near = {g for g, *q in points for i, *p in at if i == s and km(p, q) <= 100}
        for g, day, v in seen:
            if g in near:
                expected.setdefault((s, day), []).extend([v] if v is not None and v == v else [])
    expected = {k: (round(sum(v) / len(v), 4), len(v)) for k, v in expected.items()}
    rows = got.collect()
    assert got.columns == ["id", "time", "mean", "n"] and len(rows) == len(expected)
    assert {(r.id, str(r.time)[:10]): (r["mean"], r.n) for r in rows} == expected
    assert pairs[0].count() <= 7  # not one for each of 60 stations and 91 points


def test_pairs_are_accepted_whole():
    """Nodes that lie well inside the reach are taken without a look at their points; undecided pairs stay few."""
    rnd = np.random.default_rng(3)
    spots = lambda n: (10 + rnd.normal(0, 0.2, n), 20 + rnd.normal(0, 0.2, n))
    (a, o), (p, q) = spots(400), spots(300)
    reach = np.full(400, (2 * math.sin(300 / (2 * 6371))) ** 2)
    seen = [np.concatenate(x) for x in zip(*dual_tree(Tree(a, o, reach), Tree(p, q)), strict=True)]
    assert len(seen[0]) == 400 * 300 and seen[2].all()
    assert not list(dual_tree(Tree(a, o, reach), Tree(p - 60, q)))


def test_crowded_places_in_slices(spark, monkeypatch):
    """Many points at nearly one place, more pairs than a slice holds, at any depth."""
    import loamline.operators.near as near

    rnd = np.random.default_rng(4)
    a, o, p, q = (10 + rnd.normal(0, 0.001, 70) for _ in range(4))
    reach = np.full(70, (2 * math.sin(0.1 / (2 * 6371))) ** 2)
    expected = {(i, j) for i in range(70) for j in range(70) if km((a[i], o[i]), (p[j], q[j])) <= 0.1}
    for rows, depth in ((500_000, 20), (7, 20), (7, 6), (500_000, 2)):
        monkeypatch.setattr(near, "ROWS_AT_ONCE", rows)
        left, right = Tree(a, o, reach), Tree(p, q)
        met = [(left.order[i], right.order[j], s) for x, y, sure in dual_tree(left, right, depth) for i, j, s in zip(x, y, sure, strict=True)]
        assert len(met) == len({m[:2] for m in met}) and expected <= {m[:2] for m in met} and {m[:2] for m in met if m[2]} <= expected
    assert [near.depth_of(r) for r in (None, 0.0, 0.001, 0.3, 150, 20_000)] == [20, 20, 20, 16, 8, 6]


def test_nearest(spark):
    grid = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 1.0), (3, 50.0, 50.0), (4, 50.0, 50.0)], "gpi long, lat double, lon double")
    points = spark.createDataFrame([(10, 0.1, 0.2), (11, -80.0, -170.0), (12, 49.0, 50.0), (13, None, 1.0)], "id long, lat double, lon double")
    got = {r.id: r.gpi for r in nearest_point(points, grid, "id").collect()}
    assert got[10] == 1 and got[12] == 3 and got[11] in (1, 2) and 13 not in got
    assert {r.id for r in nearest_point(points, grid, "id", 30).collect()} == {10}


def test_regions(spark):
    p = spark.createDataFrame([(1, 1.0, 1.0), (2, 5.0, 5.0), (3, None, 1.0)], "id long, lat double, lon double")
    b = spark.createDataFrame([("a", 0.0, 1.0, 0.0, 1.0), ("b", 0.5, 9.0, 0.5, 9.0), ("c", 2.0, 1.0, 0.0, 1.0)], "box string, lat_min double, lat_max double, lon_min double, lon_max double")
    assert {(r.id, r.box) for r in in_regions(p, b, "id", "box").collect()} == {(1, "a"), (1, "b"), (2, "b")}


def test_regions_across_the_date_line(spark):
    p = spark.createDataFrame([(1, 0.0, 190.5), (2, 0.0, -169.5), (3, 0.0, 179.5), (4, 0.0, 180.0), (5, 0.0, -180.0), (6, 0.0, 10.0), (7, 95.0, 0.0), (8, 90.0, 10.0)], "id long, lat double, lon double")
    b = spark.createDataFrame([("w", -1.0, 1.0, -170.0, -169.0), ("d", -1.0, 1.0, 179.0, -179.0), ("e", -1.0, 1.0, 170.0, 181.0), ("all", -90.0, 90.0, -180.0, 180.0), ("nan", float("nan"), 1.0, 0.0, 1.0), ("null", None, 1.0, 0.0, 1.0)], "box string, lat_min double, lat_max double, lon_min double, lon_max double")
    got = {(r.id, r.box) for r in in_regions(p, b, "id", "box").collect()}
    assert got == {(1, "w"), (2, "w"), (3, "d"), (4, "d"), (5, "d"), (3, "e"), (4, "e"), (5, "e")} | {(i, "all") for i in (1, 2, 3, 4, 5, 6, 8)}


def test_polygons(spark):
    rnd = random.Random(11)
    rings = {"star": [(0, 0), (3, 10), (10, 12), (4, 14), (2, 25), (-2, 14), (-9, 13), (-3, 9)], "date": [(-5, 175), (5, 178), (6, -172), (-6, -176)], "east": [(20, 350), (20, 370), (30, 370), (30, 350)]}
    spots = [(i, rnd.uniform(-12, 32), rnd.uniform(-180, 360)) for i in range(1500)] + [(2000 + i, rnd.uniform(-7, 7), rnd.uniform(172, 190)) for i in range(300)] + [(3000, None, 1.0), (3001, 1.0, float("nan"))]

    def inside(ring, y, x):
        line = [(a, o if o < 180 else o - 360) for a, o in ring]
        if max(o for _, o in line) - min(o for _, o in line) > 180:
            line, x = [(a, o % 360) for a, o in line], x % 360
        else:
            x = x if x <= 180 else x - 360
        return sum((a1 > y) != (a2 > y) and x < o1 + (y - a1) / (a2 - a1) * (o2 - o1) for (a1, o1), (a2, o2) in zip(line, line[1:] + line[:1], strict=True)) % 2 == 1

    p = spark.createDataFrame(spots, "id long, lat double, lon double")
    bad = [("two", [(0.0, 0.0), (1.0, 1.0)]), ("gap", [(0.0, 0.0), (None, 1.0), (5.0, 5.0)]), ("none", None)]
    s = spark.createDataFrame([(n, [(float(a), float(o)) for a, o in r]) for n, r in rings.items()] + bad, "name string, ring array<struct<lat:double,lon:double>>")
    got = {(r.id, r.name) for r in in_polygons(p, s, "id", "name").collect()}
    expected = {(i, n) for i, a, o in spots[:-2] for n, r in rings.items() if inside(r, a, o)}
    assert got == expected and {n for _, n in got} == set(rings)
