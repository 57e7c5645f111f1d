"""Implausible readings per source (problem 7).

One range-partitioned, sorted pass splits a source of any size over many tasks.  Each task decomposes its pieces of
the series and emits a mergeable sketch per source plus the readings that stand out; the few readings near the cut
between two tasks are decided in a second, tiny pass that joins both sides.  The running-median trend takes the course
of the year with it; the merged sketches give each source its season by hour of day, its scatter and, from the remainder,
its generalised extreme studentised deviate limit.  Only readings beyond the limit can be spikes; they are then checked
against the course on both sides.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamline.session import cut

#: Readings needed on each side of a reading before it can be decided.
CONTEXT = 7
#: Readings a task holds at once; a longer partition is decided piece by piece, as if it were cut there.
ROWS_AT_ONCE = 250_000
PHASES, PHASE_STRIDE, BIN_MID = 24, 2048, 1024
#: Readings that a phase of the day needs for a season of its own.
PHASE_LEAST = 8
LOG_STEP, LEAST = math.log(1.04), 1e-5
PASS_SCHEMA = "kind string, sensor string, gpi long, unix double, value double, obs_id long, brk boolean, open boolean, newpiece boolean, reason string, detrended double, phase int, excursion double, steps array<int>, step_n array<int>, rests array<int>, rest_n array<int>"
FIELDS = pa.schema(
    [("kind", pa.string()), ("sensor", pa.string()), ("gpi", pa.int64()), ("unix", pa.float64()), ("value", pa.float64()), ("obs_id", pa.int64()), ("brk", pa.bool_()), ("open", pa.bool_()), ("newpiece", pa.bool_()), ("reason", pa.string()), ("detrended", pa.float64()), ("phase", pa.int32()), ("excursion", pa.float64()), ("steps", pa.list_(pa.int32())), ("step_n", pa.list_(pa.int32())), ("rests", pa.list_(pa.int32())), ("rest_n", pa.list_(pa.int32()))]
)


def log_bin(v: np.ndarray) -> np.ndarray:
    """Signed logarithmic bin: 4 % wide, 0 for less than 1e-5."""
    size = np.abs(v)
    return (np.sign(v) * np.ceil(np.log(np.maximum(size, LEAST) / LEAST) / LOG_STEP)).astype(np.int32)


def bin_value(b: np.ndarray) -> np.ndarray:
    """Middle of a signed bin."""
    return np.sign(b) * LEAST * np.exp((np.abs(b) - 0.5) * LOG_STEP)


def _shifted(x: np.ndarray, piece: np.ndarray, by: int) -> np.ndarray:
    """x moved by ``by`` places within its piece; NaN where that leaves the piece."""
    out = np.full(len(x), np.nan)
    n = len(x)
    if abs(by) < n:
        dst, src = (slice(by, n), slice(0, n - by)) if by > 0 else (slice(0, n + by), slice(-by, n))
        same = piece[dst] == piece[src]
        out[dst] = np.where(same, x[src], np.nan)
    return out


def _median(columns: list[np.ndarray]) -> np.ndarray:
    """Row-wise median that skips NaN; NaN where all are."""
    m = np.sort(np.stack(columns, -1), axis=-1)  # NaN sorts last
    n = (~np.isnan(m)).sum(-1)
    at = np.arange(len(m))
    low, high = m[at, np.maximum(n - 1, 0) // 2], m[at, n // 2]
    return np.where(n > 0, (low + high) / 2, np.nan)


def features(x: np.ndarray, piece: np.ndarray, brk: np.ndarray, longest: int, least_run: int) -> tuple[np.ndarray, ...]:
    """Per reading: value minus running-median trend, largest excursion from the course on both sides, step from the
    reading before, and whether it belongs to a constant run.  ``brk``: an out-of-range reading came in between."""
    around = [_shifted(x, piece, d) for d in range(-CONTEXT, CONTEXT + 1)]
    detrended = x - _median(around)
    before = _median([_shifted(x, piece, d) for d in (1, 2, 3)])
    after = _median([_shifted(x, piece, -d) for d in (1, 2, 3)])
    excursion = np.zeros(len(x))
    low, high, end = x.copy(), x.copy(), after
    for w in range(1, longest + 1):
        if w > 1:
            nxt = _shifted(x, piece, -(w - 1))
            low, high = np.minimum(low, nxt), np.maximum(high, nxt)
            end = _shifted(after, piece, -(w - 1))
        v = np.maximum(low - np.maximum(before, end), np.minimum(before, end) - high)
        v = np.where(v > np.abs(end - before), v, 0)  # it must return: a rise that only fades stays half way
        for d in range(w):  # every reading of the window
            excursion = np.fmax(excursion, v if d == 0 else np.nan_to_num(_shifted(v, piece, d)))
    step = x - _shifted(x, piece, 1)
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (piece[1:] != piece[:-1]) | brk[1:]
    run = np.cumsum(new) - 1
    stuck = np.bincount(run, minlength=1)[run] >= least_run if len(x) else np.zeros(0, bool)
    return detrended, excursion, step, stuck


def _phase(unix: np.ndarray) -> np.ndarray:
    return (np.floor(np.mod(unix, 86400) / (86400 / PHASES))).astype(np.int32)


def _counted(group: np.ndarray, key: np.ndarray) -> dict[int, tuple[list[int], list[int]]]:
    """Per group: the distinct keys and how often each occurs."""
    both, n = np.unique(np.stack([group, key]), axis=1, return_counts=True) if len(group) else (np.zeros((2, 0), int), np.zeros(0, int))
    cuts = np.flatnonzero(np.diff(both[0])) + 1
    return {int(g[0]): (k.tolist(), c.tolist()) for g, k, c in zip(np.split(both[0], cuts), np.split(both[1], cuts), np.split(n, cuts), strict=True) if len(g)}


def _empty(n: int) -> dict[str, pa.Array]:
    return {f.name: pa.nulls(n, f.type) for f in FIELDS}


def _batch(n: int, **columns: pa.Array) -> pa.RecordBatch:
    full = _empty(n) | columns
    return pa.RecordBatch.from_arrays([full[f.name].cast(f.type) if full[f.name].type != f.type else full[f.name] for f in FIELDS], schema=FIELDS)


def _decided(sensor: pa.Array, gpi: np.ndarray, unix: np.ndarray, x: np.ndarray, obs: np.ndarray, series: np.ndarray, piece: np.ndarray, brk: np.ndarray, decide: np.ndarray, longest: int, least_run: int) -> Iterator[pa.RecordBatch]:
    """Features of the readings to decide: a sketch per series, and the readings that are stuck or stand out."""
    detrended, excursion, step, stuck = features(x, piece, brk, longest, least_run)
    phase = _phase(unix)
    ok = decide & ~np.isnan(step)
    steps = _counted(series[ok], log_bin(np.abs(step[ok])))
    rests = _counted(series[decide], phase[decide] * PHASE_STRIDE + BIN_MID + log_bin(detrended[decide]))
    if rests:
        ids = np.array(sorted(rests))
        first = np.unique(series, return_index=True)
        at = pa.array(first[1][np.searchsorted(first[0], ids)])
        none = ([], [])
        yield _batch(
            len(ids), kind=pa.array(["sketch"] * len(ids)), sensor=sensor.take(at), gpi=pa.array(gpi[np.asarray(at)]),
            steps=pa.array([steps.get(i, none)[0] for i in ids], pa.list_(pa.int32())), step_n=pa.array([steps.get(i, none)[1] for i in ids], pa.list_(pa.int32())),
            rests=pa.array([rests[i][0] for i in ids], pa.list_(pa.int32())), rest_n=pa.array([rests[i][1] for i in ids], pa.list_(pa.int32())),
        )
    keep = np.flatnonzero(decide & (stuck | ((excursion > 0) & (np.sign(detrended) != 0))))
    if len(keep):
        yield _batch(
            len(keep), kind=pa.array(["reading"] * len(keep)), sensor=sensor.take(pa.array(keep)), gpi=pa.array(gpi[keep]), unix=pa.array(unix[keep]), value=pa.array(x[keep]), obs_id=pa.array(obs[keep]),
            reason=pa.array(np.where(stuck[keep], "constant", "spike")), detrended=pa.array(detrended[keep]), phase=pa.array(phase[keep]), excursion=pa.array(excursion[keep]),
        )


def _last_key(table: pa.Table) -> int:
    """Where the last (sensor, gpi, time) of a sorted table begins."""
    last = np.ones(table.num_rows, bool)
    for c in ("unix", "gpi", "sensor"):
        last &= pc.equal(table[c], table[c][-1]).to_numpy(zero_copy_only=False) if c == "sensor" else table[c].to_numpy() == table[c][-1].as_py()
    return int(np.argmin(last[::-1])) and table.num_rows - int(np.argmin(last[::-1]))


def _sorted_pass(valid: tuple[float, float], longest: int, least_run: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= ROWS_AT_ONCE:
                table = pa.Table.from_batches(held).combine_chunks()
                end = _last_key(table)  # readings of one time stay together
                if end:
                    yield from part(table.slice(0, end))
                    held = table.slice(end).to_batches()
                    size = table.num_rows - end
        if size:
            yield from part(pa.Table.from_batches(held).combine_chunks())

    def part(table: pa.Table) -> Iterator[pa.RecordBatch]:
        sensors = table["sensor"].combine_chunks().dictionary_encode()
        code = np.asarray(sensors.indices)
        gpi, unix, x = (np.asarray(table[c]) for c in ("gpi", "unix", "value"))
        obs = table["obs_id"].to_numpy()
        new = np.ones(len(x), bool)
        new[1:] = (gpi[1:] != gpi[:-1]) | (code[1:] != code[:-1])
        repeat = np.zeros(len(x), bool)
        repeat[1:] = ~new[1:] & (obs[1:] == obs[:-1]) & (unix[1:] == unix[:-1]) & (x[1:] == x[:-1])
        series = np.cumsum(new) - 1
        kept = np.flatnonzero(~repeat)
        code, gpi, unix, x, obs, series = code[kept], gpi[kept], unix[kept], x[kept], obs[kept], series[kept]
        sensor = sensors.dictionary.take(pa.array(code))
        inside = (x >= valid[0]) & (x <= valid[1])
        out = np.flatnonzero(~inside)
        if len(out):
            yield _batch(len(out), kind=pa.array(["reading"] * len(out)), sensor=sensor.take(pa.array(out)), gpi=pa.array(gpi[out]), unix=pa.array(unix[out]), value=pa.array(x[out]), obs_id=pa.array(obs[out]), reason=pa.array(["range"] * len(out)))
        good = np.flatnonzero(inside)
        brk = np.zeros(len(good), bool)
        brk[1:] = np.diff(good) > 1
        if len(good):
            brk[0] = good[0] > 0
        # an out-of-range reading that closes the piece must still break a run that goes on in the next one
        trailing = len(x) - 1 if len(x) and not inside[-1] else None
        tail_mark = {} if trailing is None else dict(sensor=sensor.take(pa.array([trailing])), gpi=pa.array(gpi[[trailing]]), unix=pa.array(unix[[trailing]]))
        sensor, gpi, unix, x, obs, series = sensor.take(pa.array(good)), gpi[good], unix[good], x[good], obs[good], series[good]
        n = len(x)
        decide = np.ones(n, bool)
        edge = np.zeros(n, bool)
        newpiece = np.zeros(n, bool)
        if n:
            for which in {int(series[0]), int(series[-1])}:  # only these can go on in a neighbouring piece
                a, b = np.searchsorted(series, [which, which + 1])
                if b - a <= 4 * CONTEXT:
                    decide[a:b], edge[a:b] = False, True
                else:
                    decide[a : a + CONTEXT] = decide[b - CONTEXT : b] = False
                    edge[a : a + 2 * CONTEXT] = edge[b - 2 * CONTEXT : b] = True
                    newpiece[b - 2 * CONTEXT] = True
            yield from _decided(sensor, gpi, unix, x, obs, series, series, brk, decide, longest, least_run)
            e = np.flatnonzero(edge)
            yield _batch(len(e), kind=pa.array(["edge"] * len(e)), sensor=sensor.take(pa.array(e)), gpi=pa.array(gpi[e]), unix=pa.array(unix[e]), value=pa.array(x[e]), obs_id=pa.array(obs[e]), brk=pa.array(brk[e]), open=pa.array(~decide[e]), newpiece=pa.array(newpiece[e]))
        if tail_mark:
            yield _batch(1, kind=pa.array(["edge"]), brk=pa.array([True]), open=pa.array([False]), newpiece=pa.array([False]), **tail_mark)

    return run


def _stitch(longest: int, least_run: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("unix", "ascending"), ("obs_id", "ascending")])
        mark = table["value"].is_null().to_numpy()
        brk = table["brk"].to_numpy().copy()
        brk[1:] |= mark[:-1]
        keep = np.flatnonzero(~mark)
        if not len(keep):
            return FIELDS.empty_table()
        table = table.take(pa.array(keep))
        brk = brk[keep]
        piece = np.cumsum(table["newpiece"].to_numpy())
        arrays = [np.asarray(table[c]) for c in ("gpi", "unix", "value", "obs_id")]
        zero = np.zeros(len(keep), int)
        parts = list(_decided(table["sensor"].combine_chunks(), *arrays, zero, piece, brk, table["open"].to_numpy(), longest, least_run))
        return pa.Table.from_batches(parts, FIELDS) if parts else FIELDS.empty_table()

    return run


@lru_cache(maxsize=1 << 17)
def esd_limit(m: int, alpha: float) -> float:
    """Critical value of a step of the generalised ESD test at which m values are left, the tested one included.

    Student's t comes from its normal quantile by the Cornish-Fisher series."""
    if m < 4:
        return math.inf
    z, df = NormalDist().inv_cdf(1 - alpha / (2 * m)), m - 2
    t = z + (z**3 + z) / (4 * df) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * df**2) + (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / (384 * df**3)
    return (m - 1) * t / math.sqrt((df + t * t) * m)


def _weighted_median(values: np.ndarray, n: np.ndarray) -> float:
    order = np.argsort(values)
    c = np.cumsum(n[order])
    return float(values[order][np.searchsorted(c, c[-1] / 2)])


def season_of(phase: np.ndarray, value: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The median of each phase of the day; phases with too few values take the median of all."""
    out = np.full(PHASES, _weighted_median(value, n))
    order = np.lexsort((value, phase))
    p, c = phase[order], np.cumsum(n[order])
    first = np.flatnonzero(np.diff(p, prepend=-1))
    before = np.where(first > 0, c[first - 1], 0)
    size = np.append(before[1:], c[-1]) - before
    enough = size >= PHASE_LEAST
    out[p[first[enough]]] = value[order][np.searchsorted(c, (before + size / 2)[enough])]
    return out


def outlier_limit(rest: np.ndarray, n: np.ndarray, alpha: float, most: float) -> float:
    """The smallest deviation that the generalised ESD test calls an outlier; infinite if there is none.

    ``rest`` holds remainders and ``n`` how often each occurs.  The extremes are taken away one by one, up to the share
    ``most``, centre and scale are estimated anew from what is left, and all up to the last step that passes are outliers."""
    order = np.argsort(-np.abs(rest))
    r, c = rest[order], n[order]
    total, gone = int(c.sum()), np.cumsum(c)
    # before the last value of a bin goes, it and all smaller bins are left
    left = total - gone + 1
    s1, s2 = r * c, r * r * c
    s1, s2 = s1.sum() - np.cumsum(s1) + r, s2.sum() - np.cumsum(s2) + r * r
    tail = np.flatnonzero((gone <= max(1, most * total)) & (left > 3))
    if not len(tail):
        return math.inf
    m = left[tail]
    mean = s1[tail] / m
    deviation = np.sqrt(np.maximum(s2[tail] - m * mean * mean, 0.0) / (m - 1))
    limits = np.array([esd_limit(int(k), alpha) for k in m])
    passed = np.flatnonzero(np.abs(r[tail] - mean) > limits * np.maximum(deviation, LEAST))
    return float(np.abs(r[tail[passed[-1]]])) if len(passed) else math.inf


def _summaries(alpha: float, most: float):
    """From merged sketches: scatter, season by phase of day, and ESD limit of each source."""

    def columns(batch: pa.RecordBatch, name: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        lists = batch.column(name)
        flat, sizes = lists.flatten(), np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(int)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        bins, n = np.asarray(flat.field("bin")), np.asarray(flat.field("n"))
        return ((bins[a:b], n[a:b]) for a, b in zip(ends, ends[1:], strict=False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scatter, limit, season = [], [], []
            for (b, c), (k, kn) in zip(columns(batch, "steps"), columns(batch, "rests"), strict=True):
                s = 0.0
                if len(b):
                    v = np.abs(bin_value(b))
                    s = 1.4826 / math.sqrt(2) * _weighted_median(v, c)
                    if _weighted_median(b.astype(float), c) == 0 and (b > 0).any():  # mostly repeated values: the rest tells
                        s = 1.4826 / math.sqrt(2) * _weighted_median(v[b > 0], c[b > 0])
                phase, value = k // PHASE_STRIDE, bin_value(k % PHASE_STRIDE - BIN_MID)
                of_day = season_of(phase, value, kn)
                scatter.append(max(s, LEAST))
                limit.append(outlier_limit(value - of_day[phase], kn, alpha, most) * math.exp(-LOG_STEP))  # a bin's lower end
                season.append(of_day)
            yield pa.RecordBatch.from_arrays([batch.column("sensor"), batch.column("gpi"), pa.array(scatter, pa.float64()), pa.array(limit, pa.float64()), pa.array(season, pa.list_(pa.float64()))], names=["sensor", "gpi", "scatter", "limit", "season"])

    return run


def flag_readings(readings: DataFrame, valid: tuple[float, float] = (0.0, 1.0), times: float = 8.0, longest: int = 3, least_run: int = 8, alpha: float = 0.05, most: float = 0.2) -> DataFrame:
    """(sensor, gpi, unix, value, obs_id, reason) of readings that can't be true for their source.

    ``reason`` is ``range`` (outside ``valid``), ``constant`` (at least ``least_run`` present readings in a row with one
    value) or ``spike``: the remainder of the decomposition passes the source's generalised ESD limit (level ``alpha``,
    up to the share ``most`` of readings), so a peak that comes every day at its hour is none, and one to ``longest`` readings in a row leave the course before and after
    them to the same side by more than ``times`` the source's scatter, and by more than the course itself has moved.  Each obs_id comes once per sensor; repeated
    deliveries count once; equal times are ordered by obs_id.  Input needs ``sensor`` (any text), gpi, unix, value
    and obs_id; rows with NULL in one of them must be gone (``readings_of`` drops them, but for obs_id).  An empty input
    gives an empty result.  Series of less than three readings have no spikes.
    """
    ordered = readings.where("sensor IS NOT NULL").select("sensor", "gpi", "unix", "value", F.coalesce(F.col("obs_id"), F.lit(-1)).alias("obs_id"))
    ordered = ordered.distinct()  # copies fall together before the shuffle: no range holds more than distinct readings
    ordered = ordered.repartitionByRange("sensor", "gpi", "unix").sortWithinPartitions("sensor", "gpi", "unix", "obs_id")
    first = cut(ordered.mapInArrow(_sorted_pass(valid, longest, least_run), PASS_SCHEMA), "spikes-pass")
    stitched = first.where("kind = 'edge'").groupBy("sensor", "gpi").applyInArrow(_stitch(longest, least_run), PASS_SCHEMA)
    both = cut(first.where("kind <> 'edge'").unionByName(stitched), "spikes-decided")

    def merged(keys: str, counts: str, name: str) -> DataFrame:
        pairs = both.where("kind = 'sketch'").select("sensor", "gpi", F.explode(F.arrays_zip(keys, counts)).alias("p"))
        bins = pairs.groupBy("sensor", "gpi", F.col(f"p.{keys}").alias("bin")).agg(F.sum(f"p.{counts}").alias("n"))
        return bins.groupBy("sensor", "gpi").agg(F.collect_list(F.struct("bin", "n")).alias(name))

    sources = merged("rests", "rest_n", "rests").join(merged("steps", "step_n", "steps"), ["sensor", "gpi"], "left")
    sources = sources.select("sensor", "gpi", "steps", "rests").mapInArrow(_summaries(alpha, most), "sensor string, gpi long, scatter double, limit double, season array<double>")
    found = both.where("kind = 'reading'").select("sensor", "gpi", "unix", "value", "obs_id", "reason", "detrended", "phase", "excursion")
    sure = found.where("reason <> 'spike'")
    spikes = (
        found.where("reason = 'spike'")
        .join(sources, ["sensor", "gpi"])
        .where((F.abs(F.col("detrended") - F.element_at("season", F.col("phase") + 1)) > F.col("limit")) & (F.col("excursion") > F.lit(times) * F.col("scatter")))
    )
    columns = ["sensor", "gpi", "unix", "value", "obs_id", "reason"]
    return sure.select(*columns).unionByName(spikes.select(*columns))
