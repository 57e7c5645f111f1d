"""Points near other points, and regions that contain points (problem 6).

Both point sets lie in an octree over the unit sphere; a node is a cell with the bounding box of its points.  A dual-tree
join compares node pairs from the roots down: pairs that can't be near are discarded, pairs that are certainly near are
accepted whole, with all below them, and what is undecided at the leaves is refined point by point.  Boxes are
three-dimensional, so the date line and the poles need no special case.

A right side of up to RIGHT_AT_MOST points (counted) goes to all tasks as a tree; each task builds the tree of its own left
points and runs the join, so no point is shuffled.  Beyond that both trees are tables, rolled up once from the leaves, and
the pairs of one level are joined to those of the next.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from loamline.functions.missing import present
from loamline.operators.skew import salted_join
from loamline.session import cut

EARTH_KM = 6371.0
LEVELS, STRIDE = 20, 2  # cells of 12 m at the deepest; levels that a step of the large join goes down
SLACK = 1e-12  # of the squared chord, for rounding
RIGHT_AT_MOST = 200_000
PAIRS_AT_ONCE, ROWS_AT_ONCE, FEW = 20_000, 500_000, 16


def depth_of(radius_km: float | None) -> int:
    """The level at which cells are about half as wide as a radius: further down little can be discarded any more."""
    if not radius_km or radius_km <= 0:
        return LEVELS
    return min(LEVELS, max(3 * STRIDE, STRIDE * (math.ceil(math.log2(4 * EARTH_KM / radius_km)) // STRIDE)))


def valid_points(df: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Rows with latitude in -90..90 and longitude in -180..360; NULL, NaN and fill values fall out."""
    a, o = present(F.col(lat)), present(F.col(lon))
    return df.where(a.between(-90, 90) & o.between(-180, 360))


def chord2_of(km: Column) -> Column:
    """Squared chord on the unit sphere of a great-circle distance."""
    s = F.sin(F.least(km / F.lit(2 * EARTH_KM), F.lit(math.pi / 2)))
    return 4 * s * s


def great_circle_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Haversine distance on a sphere of 6,371 km."""
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.asin(F.sqrt(F.least(h, F.lit(1.0)))) * (2 * EARTH_KM)


# --- the join inside a task -----------------------------------------------------------------------------------------


class Tree:
    """The octree of some points: for each level the nodes' boxes, where their children and their points in ``order`` begin, and
    (for points with a reach) the greatest and least reach below."""

    def __init__(self, lat: np.ndarray, lon: np.ndarray, reach: np.ndarray | None = None):
        a, o = np.radians(lat), np.radians(lon)
        xyz = np.stack([np.cos(a) * np.cos(o), np.cos(a) * np.sin(o), np.sin(a)], -1)
        cell = np.minimum(np.floor((xyz + 1) * 2 ** (LEVELS - 1)), 2**LEVELS - 1).astype(np.int64)
        code = np.zeros(len(lat), np.int64)
        for bit in range(LEVELS):
            for k in range(3):
                code |= ((cell[:, k] >> bit) & 1) << (3 * bit + k)
        self.order = np.argsort(code, kind="stable")
        node, low, high = code[self.order], xyz[self.order], xyz[self.order]
        most = least = None if reach is None else reach[self.order]
        self.low, self.high, self.start, self.points, self.most, self.least = [], [], [], [], [], []
        for level in range(LEVELS, -1, -1):
            first = np.flatnonzero(np.diff(node, prepend=-1)) if len(node) else np.zeros(0, int)
            self.start.append(np.append(first, len(node)))
            self.points.append(self.points[-1][self.start[-1]] if self.points else self.start[-1])
            if len(first):
                low, high = np.minimum.reduceat(low, first), np.maximum.reduceat(high, first)
                if reach is not None:
                    most, least = np.maximum.reduceat(most, first), np.minimum.reduceat(least, first)
            node = node[first] >> 3 if level else node[first]
            self.low.append(low), self.high.append(high), self.most.append(most), self.least.append(least)
        for kept in (self.low, self.high, self.start, self.points, self.most, self.least):
            kept.reverse()  # by level, the root first


def _combined(first_a: np.ndarray, n_a: np.ndarray, first_b: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each child of a with each child of b, pair by pair, and the pair they come from."""
    k = n_a * n_b
    i = np.repeat(np.arange(len(k)), k)
    w = np.arange(len(i)) - np.repeat(np.cumsum(k) - k, k)
    return i, first_a[i] + w // n_b[i], first_b[i] + w % n_b[i]


def dual_tree(a: Tree, b: Tree, depth: int = LEVELS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place in a.order, place in b.order, sure) of point pairs that may be near, in slices; ``sure`` pairs come from nodes that
    were accepted whole.  Pairs of nodes with few points, or at ``depth``, are taken apart into points."""
    if not len(a.order) or not len(b.order):
        return
    todo = [(0, np.zeros(1, int), np.zeros(1, int), np.zeros(1, bool))]
    while todo:
        level, na, nb, sure = todo.pop()
        if len(na) > PAIRS_AT_ONCE:
            half = len(na) // 2
            todo += [(level, na[:half], nb[:half], sure[:half]), (level, na[half:], nb[half:], sure[half:])]
            continue
        pa_, pb = a.points[level], b.points[level]
        n_a, n_b = pa_[na + 1] - pa_[na], pb[nb + 1] - pb[nb]
        ends = sure | (n_a * n_b <= FEW) | (level == depth)
        e, n = np.flatnonzero(ends), n_a * n_b
        for i in e[n[e] > ROWS_AT_ONCE]:  # a crowded pair: some points of a at a time
            by = max(1, ROWS_AT_ONCE // int(n_b[i]))
            for lo in range(0, int(n_a[i]), by):
                _, x, y = _combined(pa_[na[[i]]] + lo, np.array([min(by, int(n_a[i]) - lo)]), pb[nb[[i]]], n_b[[i]])
                yield x, y, np.full(len(x), sure[i])
        e = e[n[e] <= ROWS_AT_ONCE]
        for part in np.split(e, np.flatnonzero(np.diff(np.cumsum(n[e]) // ROWS_AT_ONCE)) + 1) if len(e) else ():
            i, x, y = _combined(pa_[na[part]], n_a[part], pb[nb[part]], n_b[part])
            yield x, y, sure[part][i]
        go = np.flatnonzero(~ends)
        if not len(go):
            continue
        sa, sb = a.start[level], b.start[level]
        na, nb = na[go], nb[go]
        i, ca, cb = _combined(sa[na], sa[na + 1] - sa[na], sb[nb], sb[nb + 1] - sb[nb])
        level += 1
        lo_a, hi_a, lo_b, hi_b = a.low[level][ca], a.high[level][ca], b.low[level][cb], b.high[level][cb]
        apart = np.maximum(np.maximum(lo_a - hi_b, lo_b - hi_a), 0.0)
        across = np.maximum(hi_a - lo_b, hi_b - lo_a)
        s = (across * across).sum(1) <= a.least[level][ca] * (1 - 1e-9) - SLACK
        keep = np.flatnonzero(s | ((apart * apart).sum(1) <= a.most[level][ca] * (1 + 1e-9) + SLACK))
        if len(keep):
            todo.append((level, ca[keep], cb[keep], s[keep]))


def _km(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray) -> np.ndarray:
    a, b = np.radians(lat1), np.radians(lat2)
    h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return np.arcsin(np.sqrt(np.minimum(h, 1.0))) * (2 * EARTH_KM)


def _searcher(ids: pa.Array, lat: np.ndarray, lon: np.ndarray, names: tuple[str, str]):
    """Left points of a task against the whole right side."""
    tree = Tree(lat, lon)
    lat, lon, ids = lat[tree.order], lon[tree.order], ids.take(pa.array(tree.order))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, whose = np.unique(np.stack([np.asarray(batch.column(c)) for c in ("lat", "lon", "radius")], -1), axis=0, return_inverse=True)
            whose = whose.reshape(-1)
            by_place, first = np.argsort(whose, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(whose, minlength=len(places)))])
            chord = 2 * np.sin(np.minimum(places[:, 2] / (2 * EARTH_KM), math.pi / 2))
            mine = Tree(places[:, 0], places[:, 1], chord * chord)
            for x, y, sure in dual_tree(mine, tree, depth_of(float(np.quantile(places[:, 2], 0.1)) if len(places) else None)):
                p = mine.order[x]
                km = _km(places[p, 0], places[p, 1], lat[y], lon[y])
                near = np.flatnonzero(sure | (km <= places[p, 2]))
                p, y, km = p[near], y[near], km[near]
                n = first[p + 1] - first[p]  # rows of a place
                cuts = np.flatnonzero(np.diff(np.cumsum(n) // ROWS_AT_ONCE, prepend=0)) if len(n) else []
                for part in np.split(np.arange(len(p)), cuts):
                    if len(part):
                        i, row, _ = _combined(first[p[part]], n[part], np.zeros(len(part), int), np.ones(len(part), int))
                        yield pa.RecordBatch.from_arrays([batch.column(names[0]).take(pa.array(by_place[row])), ids.take(pa.array(y[part][i])), pa.array(km[part][i])], names=[*names, "km"])

    return run


# --- the join of two large sides --------------------------------------------------------------------------------------


def _placed(df: DataFrame, depth: int) -> DataFrame:
    """Adds x, y, z and the code of the leaf cell at ``depth``: three bits a level, the coarsest first."""
    lat, lon = F.radians("lat"), F.radians("lon")
    df = df.withColumns({"x": F.cos(lat) * F.cos(lon), "y": F.cos(lat) * F.sin(lon), "z": F.sin(lat)})
    cell = {c: F.least(F.floor((F.col(c) + 1) * 2 ** (depth - 1)), F.lit(2**depth - 1)).cast("long") for c in "xyz"}
    code = F.lit(0).cast("long")
    for bit in range(depth):
        for k, c in enumerate("xyz"):
            code = code.bitwiseOR(F.shiftleft(F.shiftright(cell[c], bit).bitwiseAND(F.lit(1).cast("long")), 3 * bit + k))
    return df.withColumn("leaf", code)


BOX = [f"{f}_{c}" for c in "xyz" for f in ("lo", "hi")]


def _leaves(points: DataFrame, side: str) -> DataFrame:
    aggs = [agg.alias(f"{side}_{n}") for c in "xyz" for agg, n in ((F.min(c), f"lo_{c}"), (F.max(c), f"hi_{c}"))] + [F.count(F.lit(1)).alias(f"{side}_n")]
    if side == "a":
        aggs += [F.max("reach").alias("reach_max"), F.min("reach").alias("reach_min")]
    return points.groupBy(F.col("leaf").alias(f"{side}_node")).agg(*aggs)


def _levels(leaves: DataFrame, side: str, depth: int) -> dict[int, DataFrame]:
    """The nodes of every step's level, each rolled up from the one below."""
    out = {depth: cut(leaves, f"near-{side}-{depth}")}
    for level in range(depth - STRIDE, 0, -STRIDE):
        below = out[level + STRIDE]
        aggs = [(F.min if c.startswith("lo") else F.max)(f"{side}_{c}").alias(f"{side}_{c}") for c in BOX] + [F.sum(f"{side}_n").alias(f"{side}_n")]
        if side == "a":
            aggs += [F.max("reach_max").alias("reach_max"), F.min("reach_min").alias("reach_min")]
        out[level] = cut(below.groupBy(F.shiftright(f"{side}_node", 3 * STRIDE).alias(f"{side}_node")).agg(*aggs), f"near-{side}-{level}")
    return {level: nodes.withColumn(f"{side}_parent", F.shiftright(f"{side}_node", 3 * STRIDE)) for level, nodes in out.items()}


def _gap2() -> tuple[Column, Column]:
    """Least and greatest squared chord between two boxes."""
    least = most = F.lit(0.0)
    for c in "xyz":
        apart = F.greatest(F.col(f"a_lo_{c}") - F.col(f"b_hi_{c}"), F.col(f"b_lo_{c}") - F.col(f"a_hi_{c}"), F.lit(0.0))
        reach = F.greatest(F.col(f"a_hi_{c}") - F.col(f"b_lo_{c}"), F.col(f"b_hi_{c}") - F.col(f"a_lo_{c}"))
        least, most = least + apart * apart, most + reach * reach
    return least, most


def _large_pairs(left: DataFrame, right: DataFrame, left_id: str, right_id: str, hot_leaf: int) -> DataFrame:
    place = ["lat", "lon", "radius"]
    depth = depth_of(left.agg(F.percentile_approx("radius", 0.1)).first()[0])
    a = cut(_placed(left.select(*place).distinct(), depth).withColumn("reach", chord2_of(F.col("radius"))).select(*place, "leaf", "x", "y", "z", "reach"), "near-a")
    b = cut(_placed(right, depth).select(right_id, F.col("lat").alias("b_lat"), F.col("lon").alias("b_lon"), "leaf", "x", "y", "z"), "near-b")
    nodes_a, nodes_b = _levels(_leaves(a, "a"), "a", depth), _levels(_leaves(b, "b"), "b", depth)
    least, most = _gap2()
    pairs = a.sparkSession.createDataFrame([(0, 0, False)], "a_parent long, b_parent long, sure boolean")  # the pair of roots
    for level in range(STRIDE, depth + 1, STRIDE):
        below = pairs.join(nodes_a[level], "a_parent").join(nodes_b[level], "b_parent")
        below = below.withColumn("sure", F.col("sure") | (most <= F.col("reach_min") * (1 - 1e-9) - SLACK)).where(F.col("sure") | (least <= F.col("reach_max") * (1 + 1e-9) + SLACK))
        pairs = cut(below.select("a_node", "b_node", "a_n", "b_n", "sure"), f"near-pairs-{level}")
        if level < depth:
            pairs = pairs.select(F.col("a_node").alias("a_parent"), F.col("b_node").alias("b_parent"), "sure")

    def parts(side: str) -> Column:
        return F.ceil(F.col(f"{side}_n") / F.lit(hot_leaf)).cast("int")

    def spread(points: DataFrame, nodes: DataFrame, side: str, by: list[str]) -> DataFrame:
        """Points with a part of their leaf; only leaves with more than ``hot_leaf`` points have several."""
        hot = nodes.where(F.col(f"{side}_n") > hot_leaf).select(f"{side}_node", parts(side).alias("parts"))
        keyed = points.withColumnRenamed("leaf", f"{side}_node").drop("x", "y", "z", "reach").join(hot, f"{side}_node", "left")
        return keyed.withColumn(f"{side}_part", F.pmod(F.xxhash64(*by), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")

    every = lambda side: F.explode(F.sequence(F.lit(0), parts(side) - 1)).alias(f"{side}_part")
    middle = pairs.select("a_node", "b_node", "b_n", "sure", every("a")).select("a_node", "b_node", "sure", "a_part", every("b"))
    met = middle.join(spread(a, nodes_a[depth], "a", place), ["a_node", "a_part"]).join(spread(b, nodes_b[depth], "b", [right_id, "b_lat", "b_lon"]), ["b_node", "b_part"])
    met = met.withColumn("km", great_circle_km(F.col("lat"), F.col("lon"), F.col("b_lat"), F.col("b_lon"))).where(F.col("sure") | (F.col("km") <= F.col("radius")))
    return salted_join(left, met.select(*place, right_id, "km"), place).select(left_id, right_id, "km")


def near_pairs(left: DataFrame, right: DataFrame, left_id: str, right_id: str, radius_km: str, right_at_most: int = RIGHT_AT_MOST, hot_leaf: int = 50_000) -> DataFrame:
    """(left_id, right_id, km): every pair at a great-circle distance of at most the left row's radius.

    ``left`` needs ``lat, lon`` and the radius column, ``right`` needs ``lat, lon``; other columns are ignored.  Rows
    with missing or out-of-range coordinates, or a missing or negative radius, give no pair; repeated rows give each
    pair once.  Left rows that share a place and a radius are searched once (in a task, or altogether) and expanded at the
    end.  Leaves with more than ``hot_leaf`` points of either side are cut into parts of that size."""
    radius = present(F.col(radius_km), -9999.0)
    left = valid_points(left).where(left_id + " IS NOT NULL").select(left_id, F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), radius.cast("double").alias("radius")).where("radius >= 0")
    right = valid_points(right).where(right_id + " IS NOT NULL").select(right_id, F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))
    found = right.limit(right_at_most + 1).collect()  # bounded, and used only if that is all of it
    if len(found) > right_at_most:
        return _large_pairs(left, right.distinct(), left_id, right_id, hot_leaf).distinct()
    found = [*zip(*set(map(tuple, found)), strict=True)] or [(), (), ()]
    search = _searcher(pa.array(found[0], to_arrow_type(right.schema[right_id].dataType)), np.array(found[1], float), np.array(found[2], float), (left_id, right_id))
    kinds = {n: t for df in (right, left) for n, t in df.dtypes}
    return left.mapInArrow(search, f"`{left_id}` {kinds[left_id]}, `{right_id}` {dict(right.dtypes)[right_id]}, km double").distinct()


def by_place(points: DataFrame, point_id: str, name: str) -> tuple[DataFrame, DataFrame]:
    """(point_id, name), and (name, lat, lon) for ``near_pairs``: points at one place go by the least id there, a point with
    several places by its own.  Rows without an id or a valid place fall out, repeated rows count once."""
    rows = valid_points(points).where(F.col(point_id).isNotNull()).select(point_id, F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon")).distinct()
    ids = cut(rows.groupBy(point_id).agg(F.count(F.lit(1)).alias("_n"), F.min("lat").alias("lat"), F.min("lon").alias("lon")), "near-ids")
    one, several = ids.where("_n = 1").drop("_n"), ids.where("_n > 1").select(point_id)
    named = cut(one.groupBy("lat", "lon").agg(F.min(point_id).alias(name)), "near-places")
    members = salted_join(one, named, ["lat", "lon"]).select(point_id, name).unionByName(several.withColumn(name, F.col(point_id)))
    return members, named.select(name, "lat", "lon").unionByName(rows.join(several, point_id).select(F.col(point_id).alias(name), "lat", "lon"))


# --- regions ------------------------------------------------------------------------------------------------------------


def _turned(lon: Column) -> Column:
    """A longitude in -180..180; 180 stays as it is."""
    return F.when(lon.between(-180, 180), lon).otherwise(F.pmod(lon + 180, F.lit(360.0)) - 180)


def _in_tiles(points: DataFrame, regions: DataFrame, point_id: str, region_columns: list[str]) -> DataFrame:
    """Points beside the regions whose box (lat_min, lat_max, lon_min, lon_max; lon_min > lon_max crosses the date line) holds
    them, by one-degree tiles; a tile with a large share of the points is salted."""
    tile = lambda c: F.floor(F.col(c)).cast("int")
    west, east = F.col("lon_min"), F.col("lon_max")
    whole = east - west >= 360
    west, east = F.when(whole, -180.0).otherwise(_turned(west)), F.when(whole, 180.0).otherwise(_turned(east))
    spans = F.when(west <= east, F.array(F.struct(west.alias("w"), east.alias("e")))).otherwise(F.array(F.struct(west.alias("w"), F.lit(180.0).alias("e")), F.struct(F.lit(-180.0).alias("w"), east.alias("e"))))
    good = regions.where("lat_min <= lat_max AND NOT isnan(lat_max) AND lat_max >= -90 AND lat_min <= 90 AND lon_min BETWEEN -180 AND 360 AND lon_max BETWEEN -180 AND 540")
    cells = good.withColumn("span", F.explode(spans)).withColumns({"west": F.col("span.w"), "east": F.col("span.e"), "south": F.greatest("lat_min", F.lit(-90.0)), "north": F.least("lat_max", F.lit(90.0))})
    cells = cells.withColumn("tile_y", F.explode(F.sequence(tile("south"), tile("north")))).withColumn("tile_x", F.explode(F.sequence(tile("west"), tile("east"))))
    p = valid_points(points).select(point_id, "lat", _turned(F.col("lon")).alias("lon"))
    both = F.when(F.abs("lon") == 180, F.array(F.lit(-180.0), F.lit(180.0))).otherwise(F.array("lon"))  # the date line is one line
    p = p.select(point_id, "lat", F.explode(both).alias("lon")).withColumns({"tile_y": tile("lat"), "tile_x": tile("lon")})
    hit = salted_join(p, cells.select(*region_columns, "south", "north", "west", "east", "tile_y", "tile_x"), ["tile_y", "tile_x"])
    return hit.where("lat BETWEEN south AND north AND lon BETWEEN west AND east")


def in_regions(points: DataFrame, boxes: DataFrame, point_id: str, box_id: str) -> DataFrame:
    """(point_id, box_id): boxes (lat_min, lat_max, lon_min, lon_max, edges included) that contain a point.

    Longitudes may run to 180 or to 360 on both sides; a box whose lon_min lies east of its lon_max crosses the date line.
    A box over n one-degree tiles (64,800 at most) is repeated n times, a point once.  Missing or impossible coordinates
    match nothing, as does a box that is upside down."""
    return _in_tiles(points, boxes, point_id, [box_id]).select(point_id, box_id).distinct()


def in_polygons(points: DataFrame, polygons: DataFrame, point_id: str, polygon_id: str) -> DataFrame:
    """(point_id, polygon_id): polygons that contain a point.

    ``polygons`` has ``ring``, an array of (lat, lon), closed or not; edges are straight in degrees, and successive points
    less than 180 degrees of longitude apart are joined the short way, so a ring may cross the date line (but not hold a
    pole).  A point is inside if it lies west of an odd number of edges at its latitude; rings of less than three points, or
    with a missing coordinate, contain nothing."""
    step = lambda o, before: before + F.pmod(o - before + 180, F.lit(360.0)) - 180
    ring = F.col("ring")
    whole = (F.size(ring) >= 3) & ~F.exists(ring, lambda p: p["lat"].isNull() | p["lon"].isNull() | F.isnan(p["lat"]) | F.isnan(p["lon"]))
    start = F.slice(F.transform(ring, lambda p: F.struct(p["lat"].cast("double").alias("lat"), _turned(p["lon"].cast("double")).alias("lon"))), 1, 1)
    rest = F.slice(ring, F.lit(2), F.size(ring))
    along = F.aggregate(rest, start, lambda done, p: F.concat(done, F.array(F.struct(p["lat"].cast("double").alias("lat"), step(p["lon"].cast("double"), F.element_at(done, -1)["lon"]).alias("lon")))))
    lats, lons = F.transform("line", lambda p: p["lat"]), F.transform("line", lambda p: p["lon"])
    shapes = polygons.where(whole).select(polygon_id, along.alias("line")).withColumns({"lat_min": F.array_min(lats), "lat_max": F.array_max(lats), "first": F.array_min(lons), "last": F.array_max(lons)})
    shapes = shapes.withColumns({"lon_min": _turned(F.col("first")), "lon_max": _turned(F.col("first")) + F.col("last") - F.col("first")})
    hit = _in_tiles(points, shapes, point_id, [polygon_id, "line", "first"])
    # the point's longitude in the ring's own turn
    x, y = F.col("first") + F.pmod(F.col("lon") - F.col("first"), F.lit(360.0)), F.col("lat")
    closing = F.concat(F.slice("line", F.lit(2), F.size("line")), F.slice("line", 1, 1))
    crossed = F.zip_with("line", closing, lambda p, q: F.when((p["lat"] > y) != (q["lat"] > y), (x < p["lon"] + (y - p["lat"]) / (q["lat"] - p["lat"]) * (q["lon"] - p["lon"])).cast("int")).otherwise(0))
    return hit.where(F.aggregate(crossed, F.lit(0), lambda n, c: n + c) % 2 == 1).select(point_id, polygon_id).distinct()
