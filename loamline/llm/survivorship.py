"""The best representative of each duplicate group (problem 3), by iterative truth discovery.

The files of a group claim field values.  A claim's vote weighs as much as its source is reliable, and decays with every
newer version that also has the field; the value with the highest support is accepted, and a source's reliability is
its share of accepted claims.  Both are estimated in turns until nothing changes.

Groups of up to PACKED files lie in one row each, so a round is one pass over rows that sends only sums by source through
a shuffle.  Larger groups, or all if there are too many sources to hand out, take part in the same rounds as tables of
votes, aggregated partially before each shuffle.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamline.operators.skew import hot_aware_join
from loamline.session import cut

FIELDS = ["orbit_dir", "n_valid", "mean_value", "mean_noise", "qc_note"]
MISSING_TEXT = ["", "n/a", "na", "nan", "null", "none", "-9999", "-9999.0"]
PLAIN_TIME = r"^\d{4}-?\d{2}-?\d{2}(?:[T ]?\d{2}:?\d{2}(?::?\d{2})?)?Z?$"
TIME_FORMATS = ["yyyy-MM-dd'T'HH:mm:ssX", "yyyy-MM-dd'T'HH:mm:ss.SSS", "yyyy-MM-dd'T'HH:mm:ss.SSSX", "yyyy-MM-dd HH:mm:ssX", "yyyyMMdd'T'HHmmssX"]
#: Files of a group that share one row, and sources whose reliabilities travel with a task.
PACKED, SOURCES = 256, 100_000
#: The least weight of a vote: below (1 - LEAST_WEIGHT) of a vote is a matter of reliability.
LEAST_WEIGHT = 0.2


def instant(text: Column) -> Column:
    """The instant behind the notations of img_datetime; zone-free ones are UTC, anything else is NULL."""
    t = F.trim(text)
    digits = F.rpad(F.regexp_replace(t, "[^0-9]", ""), 14, "0")
    plain = F.when(t.rlike(PLAIN_TIME), F.try_to_timestamp(digits, F.lit("yyyyMMddHHmmss")))
    return F.coalesce(plain, *(F.when(~t.rlike(PLAIN_TIME), F.try_to_timestamp(t, F.lit(f))) for f in TIME_FORMATS)).cast("timestamp_ntz")


def version_key(text: Column) -> Column:
    """The digits of each version number without leading zeros: left-out components are 0, so trailing zeros go."""
    parts = F.transform(F.regexp_extract_all(text, F.lit(r"(\d+)")), lambda p: F.ltrim(p, F.lit("0")))
    last = F.array_max(F.transform(parts, lambda p, i: F.when(p != "", i + 1).otherwise(0)))
    return F.when(text.isNull(), F.array().cast("array<string>")).otherwise(F.slice(parts, F.lit(1), F.coalesce(last, F.lit(0))))


def rank_text(version: Column, produced: Column) -> Column:
    """Version and production time as a text in the same order: each number behind its count of digits, a missing time
    first."""
    digits = F.transform(version, lambda p: F.concat(F.lpad(F.length(p).cast("string"), 4, "0"), p))
    time = F.lpad((F.unix_micros(produced.cast("timestamp")) + F.lit(10**17)).cast("string"), 18, "0")
    return F.concat(F.array_join(digits, ""), F.lit(" "), F.coalesce(time, F.lit("")))


def claim_text(name: str, kind: str) -> Column:
    """A field's value as text, NULL where it is missing in any spelling."""
    c = F.col(name)
    if kind in ("double", "float"):
        return F.when(~F.isnan(c) & (c != -9999), c.cast("double").cast("string"))
    if kind == "string":
        return F.when(~F.lower(F.trim(c)).isin(*MISSING_TEXT), F.trim(c))
    return F.when(c != -9999, c.cast("string"))


def image_files(versions: DataFrame) -> DataFrame:
    """One row per file: entity (prod regardless of case, area, instant), record, rank, source and the fields as text, NULL
    where missing.  Rows without prod, area, a readable img_datetime or an image_id belong to no image."""
    kinds = dict(versions.dtypes)
    entity = F.struct(F.lower(F.trim("prod")).alias("prod"), F.trim("area").alias("area"), instant(F.col("img_datetime")).alias("at"))
    rows = versions.select(entity.alias("entity"), F.col("image_id").cast("long").alias("record"), version_key(F.col("vers")).alias("version"), "produced_at", *(claim_text(f, kinds[f]).alias(f) for f in FIELDS))
    part = lambda i: F.coalesce(F.nullif(F.get("version", F.lit(i)), F.lit("")), F.lit("0"))
    source = F.concat(F.col("entity.prod"), F.lit("/"), part(0), F.lit("."), part(1))
    return rows.where("record IS NOT NULL AND entity.prod IS NOT NULL AND entity.area IS NOT NULL AND entity.at IS NOT NULL").select("entity", "record", rank_text(F.col("version"), F.col("produced_at")).alias("rank"), source.alias("source"), *FIELDS)


def _codes(column: pa.Array) -> np.ndarray:
    """Whole numbers in the order of the values, -1 for NULL."""
    coded = column.dictionary_encode()
    values = coded.dictionary.to_pylist()
    place = np.empty(len(values) + 1, np.int64)
    place[sorted(range(len(values)), key=values.__getitem__)] = np.arange(len(values))
    place[-1] = -1
    return place[coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)]


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return new


def _lists(counts: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), values)


def _pack(fields: list[str], ids: dict[str, int], decay: float | None):
    """Groups as flat lists of votes, those for one value together and the best-ranked file first among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = batch.column("files")
            flat, n = files.flatten(), batch.num_rows
            entity = np.repeat(np.arange(n), files.value_lengths().to_numpy(zero_copy_only=False))
            rank, record = _codes(flat.field("rank")), np.asarray(flat.field("record"))
            source = flat.field("source").dictionary_encode()
            source = np.array([ids[s] for s in source.dictionary.to_pylist()], np.int64)[np.asarray(source.indices)]
            order = np.lexsort((record, -rank, entity))
            first = np.flatnonzero(_starts(entity[order]))
            leader, several = record[order][first], np.maximum.reduceat(record[order], first) > np.minimum.reduceat(record[order], first)
            kept = [np.flatnonzero(flat.field(f).is_valid().to_numpy(zero_copy_only=False)) for f in fields]
            at, field = np.concatenate(kept), np.repeat(np.arange(len(fields)), [len(k) for k in kept])
            value = np.concatenate([_codes(flat.field(f))[k] for f, k in zip(fields, kept, strict=True)])
            text = pa.concat_arrays([flat.field(f).take(pa.array(k)) for f, k in zip(fields, kept, strict=True)])
            base = np.ones(len(at))
            if decay is not None and len(at):
                newest = np.lexsort((-rank[at], field, entity[at]))
                group, tier = _starts(entity[at][newest], field[newest]), _starts(entity[at][newest], field[newest], rank[at][newest])
                number = np.cumsum(tier) - 1
                age = number - np.maximum.accumulate(np.where(group, number, 0))
                base[newest] = np.power(decay, age.astype(float)) / np.bincount(number)[number]
            order = np.lexsort((record[at], -rank[at], value, field, entity[at]))
            at, field, value, base = at[order], field[order], value[order], base[order]
            lists = (pa.array(field, pa.int32()), pa.array(_starts(entity[at], field, value)), pa.array(source[at], pa.int32()), pa.array(base), pa.array(rank[at], pa.int32()), pa.array(record[at]), text.take(pa.array(order)))
            counts = np.bincount(entity[at], minlength=n)
            yield pa.RecordBatch.from_arrays([batch.column("entity"), pa.array(leader), pa.array(several), *(_lists(counts, v) for v in lists)], names=["entity", "leader", "several", "field", "first", "source", "base", "rank", "record", "text"])

    return run


def _elect(batch: pa.RecordBatch, reliability: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of a batch of packed groups: where each value's votes begin, its support and group, and the chosen values."""
    flat = {c: np.asarray(batch.column(c).flatten()) if c != "first" else batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("field", "first", "source", "base", "rank", "record")}
    entity = np.repeat(np.arange(batch.num_rows), batch.column("source").value_lengths().to_numpy(zero_copy_only=False))
    start = np.flatnonzero(flat["first"])
    support = np.add.reduceat(flat["base"] * reliability[flat["source"]], start) if len(start) else np.zeros(0)
    group = entity[start] * (int(flat["field"].max(initial=0)) + 1) + flat["field"][start]
    order = np.lexsort((-flat["record"][start], flat["rank"][start], np.round(support, 9), group))
    last = np.ones(len(order), bool)
    last[:-1] = group[order][1:] != group[order][:-1]
    return flat, entity, start, support, group, order[last]


def _tally(reliability: np.ndarray):
    """Accepted and all claims by source, of one task's groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        agreed, claims = np.zeros(len(reliability)), np.zeros(len(reliability))
        for batch in batches:
            flat, _, start, _, _, won = _elect(batch, reliability)
            chosen = np.zeros(len(start) + 1, bool)
            chosen[won] = True
            agreed += np.bincount(flat["source"], chosen[np.cumsum(flat["first"]) - 1], len(reliability))
            claims += np.bincount(flat["source"], minlength=len(reliability))
        seen = np.flatnonzero(claims)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(agreed[seen].astype(np.int64)), pa.array(claims[seen].astype(np.int64))], names=["id", "agreed", "claims"])

    return run


def _accept(reliability: np.ndarray, fields: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, entity, start, support, group, won = _elect(batch, reliability)
            total = np.bincount(group, support) if len(group) else np.zeros(0)
            at = start[won]
            rows = pa.array(entity[at])
            yield pa.RecordBatch.from_arrays(
                [batch.column("entity").take(rows), batch.column("leader").take(rows), batch.column("several").take(rows), pa.array([fields[i] for i in flat["field"][at]], pa.string()), batch.column("text").flatten().take(pa.array(at)), pa.array(flat["record"][at]), pa.array(support[won] / total[group[won]])],
                names=["entity", "leader", "several", "field", "value", "record", "support"],
            )

    return run


def _votes(files: DataFrame, fields: list[str], decay: float | None) -> DataFrame:
    """Votes of groups of any size as a table; the place of each rank in its (entity, field) is counted by ranges, so no task
    sees more than a range of a group."""
    votes = files.unpivot(["entity", "record", "rank", "source"], fields, "field", "value").where("value IS NOT NULL").distinct()
    if decay is None:
        return cut(votes.withColumn("base", F.lit(1.0)), "votes")
    group, newest = ["entity", "field"], F.col("rank").desc()
    votes = cut(votes, "votes")
    tiers = votes.groupBy(*group, "rank").agg(F.count(F.lit(1)).alias("tied")).repartitionByRange(*group, newest)
    tiers = cut(tiers.withColumn("part", F.spark_partition_id()), "tiers")
    before = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    ahead = tiers.groupBy(*group, "part").agg(F.count(F.lit(1)).alias("n")).withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = F.row_number().over(Window.partitionBy(*group, "part").orderBy(newest)) - 1
    aged = tiers.withColumn("within", within).join(ahead, [*group, "part"]).select(*group, "rank", F.pow(F.lit(decay), F.col("ahead") + F.col("within")).alias("power"), F.col("tied"), F.col("tied").alias("rows"))
    return cut(hot_aware_join(votes, aged, [*group, "rank"], "rows").withColumn("base", F.col("power") / F.col("tied")).drop("power", "tied"), "votes")


def _elected(votes: DataFrame, trust: DataFrame) -> DataFrame:
    """The accepted value of each (entity, field), its best-ranked record and its share of all support."""
    weighed = hot_aware_join(votes, trust.select("source", "weight", "rows"), ["source"], "rows")
    values = weighed.groupBy("entity", "field", "value").agg(F.sum(F.col("base") * F.col("weight")).alias("support"), F.max(F.struct("rank", (-F.col("record")).alias("order"))).alias("top"), F.count(F.lit(1)).alias("votes"))
    best = F.max(F.struct(F.round("support", 9).alias("rounded"), "top", "value", "support")).alias("b")
    chosen = values.groupBy("entity", "field").agg(best, F.sum("support").alias("total"), F.sum("votes").alias("votes"))
    return cut(chosen.select("entity", "field", F.col("b.value").alias("value"), (-F.col("b.top.order")).alias("record"), (F.col("b.support") / F.col("total")).alias("support"), "votes"), "accepted")


def discover(files: DataFrame, fields: list[str], recency: bool = True, decay: float = 0.1, rounds: int = 20, prior: float = 4.0, packed: int = PACKED, sources: int = SOURCES) -> DataFrame:
    """(entity, leader, several, field, value, record, support): the accepted value of each field of each entity.

    ``files`` holds entity, record, rank (NULL comes last), source and the ``fields`` as text (NULL is no claim); repeated
    rows count once.  A vote weighs LEAST_WEIGHT plus the rest in proportion to its source's reliability.  With ``recency``
    it is also multiplied by ``decay`` for each newer rank that has the field, and files of one rank share one vote: with
    the default 0.1 a rank of one mind outweighs all older ones (at least 0.2 against at most 0.111), reliability decides
    within a rank; from 0.17 on it can overrule a newer file.  Without ``recency`` reliability alone decides.  Equal support (to
    nine digits) goes to the value of the best-ranked, then smallest record.

    Reliabilities start equal and are the smoothed share of accepted claims (``prior`` pseudo-claims at one half).  The
    turns end when they no longer change, which then holds for good; a warning tells if ``rounds`` don't suffice.
    ``record`` is the best-ranked, then smallest record with the value, ``leader`` that of the entity, ``several`` tells
    whether the entity has different records, ``support`` is the value's share of all support."""
    files = cut(files.select("entity", F.col("record").cast("long").alias("record"), "rank", "source", *fields), "files")
    spark, kind = files.sparkSession, files.schema["entity"].dataType.simpleString()
    age = decay if recency else None
    counts = files.groupBy("source").agg((F.count(F.lit(1)) * len(fields)).alias("rows"))
    listed = {r.source: r.rows for r in counts.limit(sources + 1).collect()}
    bounded = len(listed) <= sources
    big = cut(files.groupBy("entity").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > (packed if bounded else 0)).select("entity"), "large-groups")
    large = not big.isEmpty()
    groups = votes = None
    if bounded:
        names = sorted(listed, key=str)
        small = files.join(big, "entity", "left_anti") if large else files
        whole = small.groupBy("entity").agg(F.collect_set(F.struct("rank", "record", "source", *fields)).alias("files"))
        lists = "field array<int>, first array<boolean>, source array<int>, base array<double>, rank array<int>, record array<long>, text array<string>"
        groups = cut(whole.mapInArrow(_pack(fields, {s: i for i, s in enumerate(names)}, age), f"entity {kind}, leader long, several boolean, {lists}"), "groups")
        trust = np.full(len(names), 0.5)
    if large or not bounded:
        own = files.join(big, "entity", "left_semi")
        votes = _votes(own, fields, age)
    table = cut(counts.withColumn("trust", F.lit(0.5)), "trust") if not bounded else None

    def weights() -> tuple[np.ndarray | None, DataFrame | None]:
        if bounded:
            reliability = LEAST_WEIGHT + (1 - LEAST_WEIGHT) * trust
            rows = [(s, float(w), int(listed[s])) for s, w in zip(names, reliability, strict=True)]
            return reliability, spark.createDataFrame(rows, "source string, weight double, rows long") if votes is not None else None
        return None, table.withColumn("weight", LEAST_WEIGHT + (1 - LEAST_WEIGHT) * F.col("trust"))

    moved = 1.0
    for _ in range(rounds):
        reliability, by_source = weights()
        tallies = None
        if votes is not None:
            chosen = _elected(votes, by_source)
            judged = hot_aware_join(votes.select("entity", "field", "value", "source"), chosen.select("entity", "field", F.col("value").alias("chosen"), "votes"), ["entity", "field"], "votes")
            tallies = judged.groupBy("source").agg(F.count_if(F.col("value") == F.col("chosen")).alias("agreed"), F.count(F.lit(1)).alias("claims"))
        if not bounded:
            renewed = cut(table.drop("trust").join(tallies, "source", "left").withColumn("trust", (F.coalesce("agreed", F.lit(0)) + prior / 2) / (F.coalesce("claims", F.lit(0)) + prior)).drop("agreed", "claims"), "trust")
            moved = renewed.join(table.select("source", F.col("trust").alias("was")), "source").agg(F.max(F.abs(F.col("trust") - F.col("was")))).first()[0] or 0.0
            table = renewed
        else:
            sums = np.zeros((2, len(names)))
            passed = groups.select("field", "first", "source", "base", "rank", "record").mapInArrow(_tally(reliability), "id long, agreed long, claims long")
            place = {s: i for i, s in enumerate(names)}
            found = [(r.id, r.agreed, r.claims) for r in passed.groupBy("id").agg(F.sum("agreed").alias("agreed"), F.sum("claims").alias("claims")).collect()]  # one row per source
            found += [(place[r.source], r.agreed, r.claims) for r in tallies.collect()] if tallies is not None else []
            for i, agreed, claims in found:
                sums[:, i] += agreed, claims
            renewed = (sums[0] + prior / 2) / (sums[1] + prior)
            moved, trust = float(np.abs(renewed - trust).max(initial=0.0)), renewed
        if not moved:
            break
    else:
        warnings.warn(f"reliabilities still moved by {moved:.3g} in round {rounds}; the accepted values may not be final", stacklevel=2)
    reliability, by_source = weights()
    out = None
    if bounded:
        out = groups.mapInArrow(_accept(reliability, fields), f"entity {kind}, leader long, several boolean, field string, value string, record long, support double")
    if votes is not None:
        heads = own.groupBy("entity").agg((-F.max(F.struct("rank", (-F.col("record")).alias("order")))["order"]).alias("leader"), (F.max("record") > F.min("record")).alias("several"))
        rest = _elected(votes, by_source).join(heads, "entity").select("entity", "leader", "several", "field", "value", "record", "support")
        out = rest if out is None else out.unionByName(rest)
    return out


def survivors(versions: DataFrame, recency: bool = True, decay: float = 0.1) -> DataFrame:
    """(image_id, field_name, donor_id, value, support) for images with at least two different image_ids.

    ``image_id`` is the image's newest file (version, then produced_at; equal ones by smaller image_id), ``donor_id`` the
    best-ranked file whose value of the field was accepted.  Fields without any value have no row.  Exact repeats count
    once; an empty table gives none."""
    chosen = discover(image_files(versions), FIELDS, recency, decay).where("several")
    return chosen.select(F.col("leader").alias("image_id"), F.col("field").alias("field_name"), F.col("record").alias("donor_id"), "value", F.round("support", 6).alias("support"))


def surviving_rows(versions: DataFrame) -> DataFrame:
    """One wide row per image: its key, the leading image_id, and the completed fields as text."""
    found = survivors(versions)
    pivot = [F.max(F.when(F.col("field_name") == f, F.col("value"))).alias(f) for f in FIELDS]
    return found.groupBy("image_id").agg(*pivot, reduce(lambda a, b: a + b, [F.max(F.when(F.col("field_name") == f, 1).otherwise(0)) for f in FIELDS]).alias("filled"))
